"""Phrases, pieces and clusters against brute force, and on nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import clusters, phrases, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
CODER, LIBRARY = pieces.piece_coder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
TEXT = "doc_id long, lang string, text string, phrase string, k int"
R = random.Random(11)
FEW = ["new", "york", "city", "the", "of", "São", "a\x1fb", "x"]
DOCS = [
    (1, "en", "New York city. the NEW york City of the new\tyork", "p", 1), (2, "en", None, None, 2), (3, None, "und und und und", "", 3), (4, "und", "und und, und; und", "", 3), (5, "en", "", "", 3),
    (6, "en", " \t\n.,", "", 3), (None, "fr", "a b a b a b a b a b a b a b", "", 3), (7, "fr", "À à ÀÀ à", "", 3), (7, "fr", "À à ÀÀ à", "", 3),
    *[(10 + i, R.choice(["en", "fr", "de"]), " ".join(R.choice(FEW) + R.choice(["", "", "", "", ".", "\n", "!"]) for _ in range(R.randint(1, 60))), "", 0) for i in range(150)],
    (500, "de", " ".join(R.choices(FEW, k=20_000)), "", 0),
]


def mined(rows, least, longest, top):
    count, n = defaultdict(Counter), Counter()
    for _, lang, text, _, _ in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    count[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in count.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in cand.items():
            if any(len(q) > len(p) and b >= a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in cand.items()):
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("bits", [None, 6, 10])
def test_collocations_against_brute_force(spark, bits):
    docs = spark.createDataFrame(DOCS, TEXT).repartition(5)
    got = sorted(map(tuple, phrases.collocations(docs, least=4, longest=5, top=60, bits=bits).collect()))
    assert got == mined(DOCS, 4, 5, 60) and {r[0] for r in got} == {"en", "fr", "de", "und"}


def test_collocations_where_hashes_collide(spark, monkeypatch):
    """Sequences of one hash are told apart by their words."""
    spare = phrases.sequence_hashes
    monkeypatch.setattr(phrases, "sequence_hashes", lambda words, lang, longest: [h & np.uint64(7 << 61) for h in spare(words, lang, longest)])
    words = phrases.Words()
    numbers = words.numbers(b"a b c a b d. a b")
    assert numbers.tolist() == [1, 2, 3, 1, 2, 4, 0, 1, 2]
    raw = phrases._counted(spark.createDataFrame([("en", "a b c a b d. a b c d e f g h i")], "lang string, text string"), 1, 2, 2, 6, None)
    got = {r["phrase"]: r["f"] for r in raw.where("phrase IS NOT NULL").collect()}
    assert got == Counter("a b c a b d a b c d e f g h i".split())


def test_collocations_of_long_texts_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 300)
    batch = spark.createDataFrame(DOCS, TEXT).select(F.coalesce("lang", F.lit("und")), "text").toArrow().to_batches()
    whole = Counter()
    for b in batch:
        for lang, text in phrases._blocks(b):
            for piece in text.translate(phrases._FOLD).split(b"\xff"):
                whole.update((lang, w) for w in piece.split())
    plain = Counter()
    for _, lang, text, _, _ in DOCS:
        for piece in (text or "").encode().translate(phrases._FOLD).split(b"\xff"):
            plain.update(("und" if lang is None else lang, w) for w in piece.split())
    assert whole == plain
    assert phrases.collocations(spark.createDataFrame([], TEXT)).collect() == []
    assert phrases.collocations(spark.createDataFrame([(1, None, None, None, 1)], TEXT)).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabcdeéñ  ▁\n\t.,0123日本😀<>/s\x00\N{REPLACEMENT CHARACTER}") | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_agenda_equals_the_library(text):
    ids = LIBRARY.encode(text)
    assert CODER.encode(text) == ids
    assert CODER.decode(ids).decode() == LIBRARY.decode(ids)
    found = CODER.found(CODER.segments(text))
    assert b"".join(x[0] for x in found)[:-1].decode() == ",".join(map(str, ids)) and b"".join(x[1] for x in found)[1:].decode() == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(0, 258), max_size=12))
def test_decode_of_any_ids_equals_the_library(ids):
    assert CODER.decode(ids).decode() == LIBRARY.decode(ids)


def test_agenda_takes_the_best_pair_first():
    """Against the plain rule: merge the best-scored adjacent pair, the leftmost of equals, until none is left."""
    for _ in range(300):
        part = "".join(R.choices("▁theinganodr", k=R.randint(1, 14)))
        symbols = list(part)
        while pairs := [(-CODER.score[p], i) for i in range(len(symbols) - 1) if (p := symbols[i] + symbols[i + 1]) in CODER.score]:
            i = min(pairs)[1]
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
        assert CODER.merged(part) == symbols


def test_coded_texts_on_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    odd = [(None, None), (-1, ""), (-2, " "), (-3, "a" * 30_000), (-4, "<s> </s>\n\n naïve café"), (-4, "<s> </s>\n\n naïve café")]
    docs = docs.unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    want = []
    for r in docs.collect():
        ids = LIBRARY.encode(r["text"] or "")
        want.append((repr(r["doc_id"]), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    got = pieces.coded_texts(docs.withColumn("ids", F.lit(1)).withColumn("raw", F.lit(2)), MODEL).collect()
    assert sorted(want) == sorted((repr(r[0]), *r[1:]) for r in got)


def test_pieces_come_back_from_their_ids(spark):
    rows = [(1, "Hello  world\n"), (2, None), (3, "日本 😀")]
    coded = pieces.coded_texts(spark.createDataFrame(rows, "doc_id long, text string"), MODEL, with_ids=True)
    assert {r["doc_id"]: r["decoded"] for r in coded.collect()} == {1: "Hello  world\n", 2: "", 3: "日本 😀"}
    assert {r["doc_id"]: r["decoded"] for r in pieces.decoded_ids(coded, MODEL).collect()} == {1: "Hello  world\n", 2: "", 3: "日本 😀"}
    assert pieces.coded_texts(spark.createDataFrame([], "doc_id string, text string"), MODEL).collect() == []


def test_a_difference_from_the_library_fails_the_task(monkeypatch):
    coder = pieces.PieceCoder(MODEL)
    monkeypatch.setattr(coder, "merged", list)
    with pytest.raises(AssertionError, match="differ"):
        coder.found(coder.segments("the other"))


def many_segments(n=3000):
    odd = ["▁", "▁▁", "▁▁▁the", "▁\n", "▁\x00\x00", "▁😀é日本#", "▁<s>", "▁" + "ñ" * 31, "▁" + "a" * 40]
    return [*odd, *dict.fromkeys("▁" + "".join(R.choices("theinganodrst.\n#ßñ日😀", k=R.randint(1, 30))) for _ in range(n))]


def test_many_new_segments_meet_in_arrays(monkeypatch):
    """Without an agenda of its own in Python for each, which took most of op12_pieces' time."""
    coder, segments = pieces.PieceCoder(MODEL), many_segments()
    short = [s for s in segments if len(s) <= pieces.ROW_LENGTH]
    monkeypatch.setattr(coder, "merged", None)
    want = LIBRARY.encode([s[1:] for s in short])
    got = coder.found(short)
    assert len(short) > 2900 and [[int(x) for x in i.split(b",")[:-1]] for i, _ in got[1:]] == want[1:]
    assert [t[1:].decode() for _, t in got[1:]] == LIBRARY.decode(want[1:])
    assert coder.found(short) == got


def test_arrays_and_heaps_agree_and_take_the_leftmost_of_equals(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as spec

    model = spec.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    for p in model.pieces:
        p.score = float(int(p.score) // 3000)
    (tied := tmp_path / "tied.model").write_bytes(model.SerializeToString())
    for path in (MODEL, str(tied)):
        coder, library = pieces.PieceCoder(path), sentencepiece.SentencePieceProcessor(model_file=path)
        segments = many_segments(1500)
        want = library.encode([s[1:] for s in segments])
        assert coder.new_ids(segments)[1:] == want[1:] and [coder.segment_ids(s) for s in segments][1:] == want[1:]
        assert coder.row_ids(segments)[1:] == want[1:]
        assert [coder.row_ids([s])[0] for s in segments[1:40]] == want[1:40]


def test_texts_meet_in_groups(monkeypatch):
    monkeypatch.setattr(pieces, "GROUP_CHARS", 100)
    texts = ["", " ", "the other " * 30, "", *(s[1:].replace("▁", " ") for s in many_segments(200)), " and\n", ""]
    ids = LIBRARY.encode(texts)
    want = [("".join(f"{i}," for i in x).encode(), t.encode()) for x, t in zip(ids, LIBRARY.decode(ids), strict=True)]
    assert list(pieces.PieceCoder(MODEL).coded(texts)) == want and list(CODER.coded([])) == []


def test_a_difference_in_the_arrays_fails_the_task(monkeypatch):
    coder = pieces.PieceCoder(MODEL)
    monkeypatch.setattr(coder, "makes", np.roll(coder.makes, 1))
    with pytest.raises(AssertionError, match="differ"):
        coder.found(many_segments(100))


def clustered(rows, k, rounds, dim):
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in x]) for i, x in rows if x is not None and len(x) == dim and all(c is not None and np.isfinite(c) for c in x)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    cents = [x for _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cents))

    for _ in range(rounds):
        at = [nearest(x)[1] for _, x in kept]
        cents = [[sum(col) // len(g) for col in zip(*g, strict=True)] if (g := [x for (_, x), a in zip(kept, at, strict=True) if a == j]) else c for j, c in enumerate(cents)]
    last = [(i, *nearest(x)) for i, x in kept]
    per = Counter()
    for _, d, j in last:
        per[j] += d
    return sorted((repr(i), j, d, per[j], sum(per.values()), hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()) for i, d, j in last)


def test_clusters_against_brute_force(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(r.choice([-3, 0, 4]), 0.4) for _ in range(8)]) for i in range(300)]
    rows += [(1, rows[1][1]), (1, rows[1][1]), (None, rows[2][1]), (None, [0.0] * 8), (900, None), (901, [1.0] * 7), (902, [1.0] * 7 + [None]), (903, [float("nan")] + [1.0] * 7), (904, [float("-inf")] + [1.0] * 7), (905, [-0.001] * 8)]
    df = spark.createDataFrame([(*x, 1, "c") for x in rows], "vec_id long, embedding array<float>, cluster int, v string")
    found = clusters.centroid_clusters(df, clusters=9, rounds=3, dimension=8).collect()
    assert sorted((repr(x[0]), *x[1:6]) for x in found) == clustered(rows, 9, 3, 8)


def test_clusters_of_few_vectors_and_of_none(spark):
    kind = "vec_id long, embedding array<float>"
    assert clusters.centroid_clusters(spark.createDataFrame([], kind)).collect() == []
    same = spark.createDataFrame([(i, [0.5] * 64) for i in range(5)], kind)
    assert {(x["cluster"], x["distance"], x["inertia"]) for x in clusters.centroid_clusters(same).collect()} == {(0, 0, 0)}
    huge = spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)], kind)
    assert {x["distance"] for x in clusters.centroid_clusters(huge).collect()} == {0}


def test_screening_prunes_and_never_loses_the_nearest():
    r = np.random.default_rng(4)
    cents = r.integers(-2000, 2000, (40, 64))
    x = cents[r.integers(0, 40, 3000)] + r.integers(-60, 60, (3000, 64))
    cluster, distance, exact = clusters.nearest(x, clusters.segment_norms(x), cents)
    every = np.square(x[:, None, :] - cents[None, :, :]).sum(axis=2)
    assert (cluster == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all() and exact.mean() < 10
