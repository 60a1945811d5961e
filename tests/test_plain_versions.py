"""Operators that SQL can't express, row by row on the fixtures against plain versions written apart from them."""

import hashlib
import math
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from factloom.operators import chunking, enrichment
from factloom.operators import search as S
from factloom.plans import registry
from factloom.sources import scans


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in rows}


def got(spark, sf_dir, name, key="doc_id"):
    return {r[key]: r for r in registry.queries()[name](spark, sf_dir).collect()}


def test_hash_embedding(spark, sf_dir, texts):
    rows = got(spark, sf_dir, "hash_embedding")
    for doc, text in texts.items():
        plain = " ".join((text or "").lower().split())
        if not plain:
            assert rows[doc]["embedding"] is None
            continue
        tokens = re.findall("[a-z0-9]+|[一-鿿]", plain)
        features = tokens + [f"{tokens[i]}_{tokens[i + 1]}" for i in range(len(tokens) - 1)] or [plain]
        sums = {}
        for f in features:
            d = hashlib.blake2b(f.encode("utf-8"), digest_size=8).digest()
            place, sign = int.from_bytes(d[:4], "big") % 128, 1 if d[4] % 2 == 0 else -1
            sums[place] = sums.get(place, 0.0) + sign * (1 + min(len(f), 12) / 12)
        norm = math.sqrt(sum(v * v for v in sums.values()))
        want = [sums.get(i, 0.0) / norm if norm else 0.0 for i in range(128)]
        assert max(abs(a - b) for a, b in zip(rows[doc]["embedding"], want, strict=True)) < 2e-6


def plain_focus(text, words, most, head, before, after):
    if len(text) <= most:
        return text
    spans = [(0, head)]
    for w in words:
        at = 0
        while (at := text.find(w, at)) >= 0:
            spans.append((max(0, at - before), min(len(text), at + after)))
            at += len(w)
    return spans


def test_keyword_focus_keeps_the_head_and_only_what_it_should(spark, sf_dir, texts):
    rows = got(spark, sf_dir, "keyword_focus")
    for doc, text in texts.items():
        spans, focused = plain_focus(text or "", ("License", "the"), 4000, 500, 300, 700), rows[doc]["focused"]
        if isinstance(spans, str):
            assert focused == spans
            continue
        assert focused.startswith(text[:500].strip()[:400]) and len(focused) < len(text) + 200
        # every word of the result comes from the head or from a window round a keyword
        allowed = set()
        for s, e in spans:
            allowed.update(text[s:e].split())
        inner = [w for part in re.split(r"\n{2,}|\.{3}|…", focused) for w in part.split()[1:-1]]
        assert sum(w not in allowed for w in inner) <= 2


def plain_recursive(text, size, overlap, marks):
    """Parts of the first separator, joined while they fit; longer ones by the next; without one left, windows."""
    if len(text) <= size:
        return [text] if text else []
    if not marks:
        return [text[i : i + size] for i in range(0, len(text), max(1, size - overlap))]
    out, now = [], None
    for part in text.split(marks[0]):
        if not now:
            now = part
        elif len(now) + len(marks[0]) + len(part) <= size:
            now = now + marks[0] + part
        else:
            out.append(now)
            now = part
    return [x for piece in [*out, now or ""] for x in plain_recursive(piece, size, overlap, marks[1:])]


@pytest.mark.parametrize(("size", "overlap"), [(1600, 300), (200, 50), (40, 39)])
def test_recursive_chunks(spark, texts, size, overlap):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in docs.select("doc_id", chunking.recursive(F.col("text"), size, overlap).alias("c")).collect():
        text = (texts[r["doc_id"]] or "").strip()
        assert [c["text"] for c in r["c"]] == plain_recursive(text, size, overlap, list(chunking.RECURSIVE_SEPARATORS))
        assert all(c["chunk_index"] == i and c["text"] == text[c["char_start"] : c["char_end"]] for i, c in enumerate(r["c"]))


def test_section_chunks_keep_every_word(spark, texts):
    marked = {d: "" if t is None else "<!-- SECTION: A -->\n" + t[: len(t) // 2] + "\n<!-- SECTION: B -->\n" + t[len(t) // 2 :] for d, t in texts.items()}
    docs = spark.createDataFrame(list(marked.items()), "doc_id long, text string")
    for r in docs.select("doc_id", chunking.section_aware(F.col("text"), 300, 0, 50).alias("c")).collect():
        body = chunking.SECTION_MARK.split(marked[r["doc_id"]])
        words = "".join("".join(b.split()) for b in (body[:1] + body[2::2] if len(body) > 1 else body))
        assert "".join("".join(c["text"].split()) for c in r["c"]) == words
        assert all(c["chunk_index"] == i and len(c["text"]) <= 300 + chunking.SLACK for i, c in enumerate(r["c"]))


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out, self.depth = [], 0

    def handle_starttag(self, tag, attrs):
        self.depth += tag in ("script", "style", "noscript")
        self.out.append("\n" if tag in ("p", "br", "li", "tr", "h1", "h2", "h3") else "")

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - (tag in ("script", "style", "noscript")))
        self.out.append("\n" if tag in ("p", "br", "li", "tr", "h1", "h2", "h3") else "")

    def handle_data(self, data):
        self.out.append("" if self.depth else data)


def test_readable_html(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    rows = {r["page_id"]: r["t"] for r in pages.select("page_id", scans.readable_html(F.col("html")).alias("t")).collect()}
    for r in pages.collect():
        p = Plain()
        p.feed(r["html"] or "")
        p.close()
        lines = (" ".join(line.split()) for line in "".join(p.out).split("\n"))
        assert rows[r["page_id"]] == "\n".join(x for x in lines if x)


def test_section_marks(spark):
    long = "B" * 200
    rows = [("a B-body c", [("T", "B-body")]), ("x", [("U", "gone")]), ("y", [("V", "  ")]), (f"0{long}1", [("L", long + "tail")]), (None, [("W", "w")]), ("p q p", [("P", "p"), ("P", "p"), ("Q", "q")]), ("z", None)]
    df = spark.createDataFrame(rows, "t string, s array<struct<title:string,content:string>>")
    got = [r["m"] for r in df.select(enrichment.mark_sections(F.col("t"), F.col("s")).alias("m")).collect()]
    note = lambda t: f"\n\n<!-- SECTION: {t} -->\n"
    assert got == [f"a {note('T')}B-body c", f"x{note('U')}gone", "y", f"0{note('L')}{long}1", f"{note('W')}w", f"{note('P')}p {note('Q')}q p", "z"]


def test_prioritized_content_fits_and_prefers_weighted_sections(spark):
    body = {k: f"## {k}\n" + (k + " ") * 60 for k in ("filler", "risk", "other", "revenue")}
    text = "intro " * 30 + "\n" + "\n".join(body.values())
    df = spark.createDataFrame([(text,), ("short",), ("x" * 3000,)], "t string")
    out = [r["p"] for r in df.select(enrichment.prioritized(F.col("t"), {"revenue": 5.0, "risk": 3.0}, 1000, least=50, lead=200, ratio=5).alias("p")).collect()]
    assert out[1] == "short" and out[2] == "x" * 1000
    assert len(out[0]) <= 1100 and "revenue revenue" in out[0] and out[0].startswith(text[:150])
    assert out[0].count("filler filler") <= out[0].count("revenue revenue")


def test_tokens_of_embeddings_are_stable(spark):
    df = spark.createDataFrame([("A  b",), ("a b",), (" ",), (None,)], "t string")
    got = [r["v"] for r in df.select(S.hash_embedding(F.col("t")).alias("v")).collect()]
    assert got[0] == got[1] and got[2] is None and got[3] is None
