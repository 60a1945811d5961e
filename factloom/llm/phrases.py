"""Phrase collocation mining: hashed bucket counts one length ahead, Apriori pruning, then exact counts (PCY / DHP).

Pass k reads the texts once. It counts exactly the k-word sequences that can still be frequent, and counts the (k+1)-word
sequences whose two k-word parts survived into hashed buckets. After a pass two bitmaps go out to the next one: buckets
that reached the threshold, and buckets of the exactly counted frequent k-word sequences (Apriori: both k-word parts of a
candidate must be frequent). A sequence in any other bucket can't be frequent, so nothing is lost; whatever passes both
is counted exactly, by its text, so collisions cost time and never change a count. Within a block of texts sequences are
found by 64-bit hashes and compared word by word with the first of their hash.

Bitmaps have 2^16 to 2^26 buckets (8 MB at most), by the bytes of the input; beyond some 10^9 words per threshold the bucket
bitmap fills and pruning is left to the frequent parts. Tasks send bucket counts, held at the threshold, in
compressed stretches of 4096 buckets, which are summed where their stretch is dealt to.

Null or blank text: no words. Null language: `und`, with rows of that name. Null ids, ties and repeated rows: each row counts.
Very long texts: whole, in blocks cut at piece ends. Empty table: empty result. Extra columns, whatever their names: ignored.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from factloom.llm.common import as_bytes, drop_table, materialize, partitions, plan_bytes

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text that a task looks at together; words that it keeps numbered.
BLOCK_BYTES, MOST_WORDS, STRETCH = 2_500_000, 500_000, 4096
END = b"\xff"  # never part of UTF-8
_FOLD = bytes(255 if b in b".,;:!?\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPREAD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Words(dict):
    """Numbers of words in order of appearance; number 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__({END: 0})
        self.names, self.hashes = [END], array("Q", [0])

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.names)
        self.names.append(word)
        self.hashes.append(xxh64_intdigest(word))
        return number

    def numbers(self, text: bytes) -> np.ndarray:
        found = text.translate(_FOLD).replace(END, b" \xff ").split()
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    """(lang, texts joined by piece ends) of at most about `BLOCK_BYTES`; longer texts are cut at piece ends where they have any."""
    held: dict[str, list[bytes]] = {}
    size: dict[str, int] = {}
    for lang, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
        for text in _cut(raw or b""):
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= BLOCK_BYTES:
                yield lang, END.join(held.pop(lang))
                size[lang] = 0
    for lang, texts in held.items():
        yield lang, END.join(texts)


def _cut(text: bytes) -> Iterator[bytes]:
    start = 0
    while len(text) - start > BLOCK_BYTES:
        ends = [i for c in b".,;:!?\n\x0b\x0c\r" if (i := text.rfind(bytes([c]), start, start + BLOCK_BYTES)) >= 0]
        if not ends:
            break
        yield text[start : max(ends)]
        start = max(ends) + 1
    yield text[start:]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(32)
    x *= _MIX
    return x ^ x >> np.uint64(29)


def sequence_hashes(words: np.ndarray, lang: str, longest: int) -> list[np.ndarray]:
    """Hashes of the 1, 2, ... `longest`-word sequences that start at each word, from hashes of words; ends of pieces aren't looked at."""
    out = [_mixed(words + np.uint64(xxh64_intdigest(lang.encode("utf-8"))))]
    for k in range(1, longest):
        out.append(_mixed(out[-1][: max(0, len(words) - k)] * _SPREAD + words[k:]))
    return out


def _inside(numbers: np.ndarray, longest: int) -> list[np.ndarray]:
    """Where sequences of 1, 2, ... words stay within their piece."""
    out = [numbers != 0]
    for k in range(1, longest):
        out.append(out[-1][: max(0, len(numbers) - k)] & out[0][k:])
    return out


class Bitmap:
    """Buckets, by the upper bits of a hash."""

    def __init__(self, packed: np.ndarray, bits: int) -> None:
        self.packed, self.shift = packed, np.uint64(64 - bits)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        bucket = hashes >> self.shift
        return (self.packed[bucket >> np.uint64(3)] >> (bucket & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _buckets(spark: SparkSession, stretches: DataFrame, bits: int, join: str) -> np.ndarray:
    """The packed bitmap of 2^bits buckets from (chunk, data); data of one chunk is joined by `join` in the task that it's dealt to."""
    size = min(STRETCH, 1 << bits)
    reach = int(join) if join.isdigit() else 0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if reach:
                    new = np.frombuffer(pa.decompress(data, size * _width(reach), "zstd", asbytes=True), f"<u{_width(reach)}")
                    held[chunk] = np.minimum(held[chunk] + new, reach) if chunk in held else new.astype(np.int64)
                else:
                    new = np.frombuffer(data, np.uint8)
                    held[chunk] = held[chunk] | new if chunk in held else new
        packed = [(np.packbits(x >= reach, bitorder="little") if reach else x).tobytes() for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(packed, pa.binary())], ["chunk", "data"])

    met = stretches.repartition(partitions(spark), "chunk").mapInArrow(work, "chunk int, data binary").toArrow()  # 2^bits bits in all
    out = np.zeros((1 << bits) // 8, np.uint8)
    for chunk, data in zip(met.column(0).to_pylist(), met.column(1).to_pylist(), strict=True):
        out[chunk * size // 8 :][: size // 8] = np.frombuffer(data, np.uint8)
    return out


def _width(most: int) -> int:
    return 1 if most < 1 << 8 else 4


def _counted(texts: DataFrame, k: int, longest: int, least: int, bits: int, sent) -> DataFrame:
    """(lang, phrase, f, chunk, data): partial counts of k-word sequences, and stretches of bucket counts of (k+1)-word ones."""
    size, width = min(STRETCH, 1 << bits), _width(least)

    def counts(words: Words, numbers: np.ndarray, hashes: np.ndarray, at: np.ndarray) -> dict[bytes, int]:
        found, first, which, n = np.unique(hashes[at], return_index=True, return_inverse=True, return_counts=True)
        head, alike = at[first][which], np.ones(len(at), bool)
        for j in range(k):
            alike &= numbers[at + j] == numbers[head + j]
        out: dict[bytes, int] = {}
        if not alike.all():  # two sequences of one hash
            for i in at.tolist():
                phrase = b" ".join([words.names[x] for x in numbers[i : i + k].tolist()])
                out[phrase] = out.get(phrase, 0) + 1
            return out
        name = words.names
        starts = at[first]
        return dict(zip((b" ".join([name[x] for x in row]) for row in np.stack([numbers[starts + j] for j in range(k)], axis=1).tolist()), n.tolist(), strict=True)) if len(found) else out

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ahead = Words(), np.zeros(1 << bits if k < longest else 0, f"<u{width}")
        maps = [Bitmap(x, bits) for x in sent.value] if sent is not None else []

        def rows(lang, phrases, f, chunks, data) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(f, pa.int64()), pa.array(chunks, pa.int32()), pa.array(data, pa.binary())], ["lang", "phrase", "f", "chunk", "data"])

        for batch in batches:
            for lang, text in _blocks(batch):
                if len(words) > MOST_WORDS:
                    words = Words()
                numbers = words.numbers(text)
                depth = min(k + 1, longest)
                hashes = sequence_hashes(np.array(words.hashes, np.uint64)[numbers], lang, depth)
                inside = _inside(numbers, depth)
                alive = inside[k - 1].copy()
                if k > 1:
                    parts = inside[k - 2].copy()
                    at = np.flatnonzero(parts)
                    parts[at] = maps[0].has(hashes[k - 2][at])  # frequent sequences of k - 1 words
                    alive &= parts[:-1] & parts[1:] if len(parts) else alive
                    at = np.flatnonzero(alive)
                    alive[at] = maps[1].has(hashes[k - 1][at])
                at = np.flatnonzero(alive)
                found = counts(words, numbers, hashes[k - 1], at)
                if found:
                    n = len(found)
                    yield rows([lang] * n, list(found), list(found.values()), [None] * n, [None] * n)
                if k < longest and len(alive) > 1:
                    longer = np.flatnonzero(alive[:-1] & alive[1:] & inside[k])
                    bucket, n = np.unique(hashes[k][longer] >> np.uint64(64 - bits), return_counts=True)
                    ahead[bucket] = np.minimum(ahead[bucket] + n, least)
        stretches = ahead.reshape(-1, size)
        used = np.flatnonzero(stretches.any(axis=1)).tolist()
        for at in range(0, len(used), 256):
            some = used[at : at + 256]
            yield rows([None] * len(some), [None] * len(some), [None] * len(some), some, [pa.compress(stretches[c].tobytes(), "zstd", asbytes=True) for c in some])

    return texts.mapInArrow(work, "lang string, phrase string, f long, chunk int, data binary")


def _frequent_buckets(frequent: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the buckets of exactly counted sequences (lang, phrase)."""
    size = min(STRETCH, 1 << bits)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(1 << bits, bool)
        for batch in batches:
            for lang, phrase in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                words = phrase.split(b" ")
                found = sequence_hashes(np.array([xxh64_intdigest(w) for w in words], np.uint64), lang, len(words))
                flags[int(found[-1][0]) >> (64 - bits)] = True
        packed = np.packbits(flags, bitorder="little").reshape(-1, size // 8)
        used = np.flatnonzero(packed.any(axis=1)).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([packed[c].tobytes() for c in used], pa.binary())], ["chunk", "data"])

    return _buckets(frequent.sparkSession, frequent.select("lang", "phrase").mapInArrow(work, "chunk int, data binary"), bits, "or")


def frequent_sequences(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((lang, size, phrase, f) of all sequences of 1 to `longest` words with f >= least, (lang, n) words of each language)."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    if bits is None:
        bits = min(26, max(16, (plan_bytes(docs) // 64).bit_length()))
    levels, totals, sent = [], None, None
    for k in range(1, longest + 1):
        raw = materialize(_counted(texts, k, longest, least, bits, sent), f"pass{k}")
        exact = raw.where("phrase IS NOT NULL").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
        if k == 1:
            exact = materialize(exact, "words")
            totals = exact.groupBy("lang").agg(F.sum("f").alias("n"))
        level = materialize(exact.where(F.col("f") >= least).select("lang", F.lit(k).alias("size"), "phrase", "f"), f"frequent{k}")
        levels.append(level)
        if sent is not None:
            sent.destroy()
        if k < longest:
            sent = spark.sparkContext.broadcast([_frequent_buckets(level, bits), _buckets(spark, raw.where("chunk IS NOT NULL").select("chunk", "data"), bits, str(least))])
        drop_table(raw)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found, totals


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, covered: int = 100, bits: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words by their weakest cut.

    A phrase goes where a longer one that holds it has at least `covered` per cent of its occurrences. A longer phrase reaches
    that only if the one with one word more does too, so the first and last words of each candidate are all there is to test.
    """
    found, totals = frequent_sequences(docs, least, longest, bits)
    words = F.split("phrase", " ")
    longer = found.where("size > 2").select("lang", "f", F.explode(F.array(F.array_join(F.slice(words, 1, F.col("size") - 1), " "), F.array_join(F.slice(words, 2, F.col("size") - 1), " "))).alias("phrase"))
    cover = longer.groupBy("lang", "phrase").agg(F.max("f").alias("cover"))
    many = lambda c: F.col(c).cast("decimal(19,0)")
    kept = found.where("size > 1").join(cover, ["lang", "phrase"], "left").where(F.col("cover").isNull() | (100 * many("cover") < covered * many("f")))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice(words, 1, F.col("k")), " ").alias("left"), F.array_join(F.slice(words, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    one = found.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    two = found.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    met = cuts.join(one, ["lang", "left"]).join(two, ["lang", "right"]).join(totals, "lang")
    score = F.expr("CAST(1000 AS decimal(4,0)) * CAST(a AS decimal(17,0)) * CAST(n AS decimal(17,0)) div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0)))")
    best = met.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "n", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> str:
    """The same rows in SQL: every sequence counted, every longer phrase compared."""
    return rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM listed GROUP BY lang),
grams AS (SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase
  FROM (SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM listed, range(1, {longest + 1}) s(size) WHERE len(w) >= size)),
freq AS MATERIALIZED (SELECT lang, CAST(size AS INTEGER) AS size, phrase, count(*) AS f FROM grams GROUP BY lang, size, phrase HAVING count(*) >= {least}),
parts AS (SELECT lang, f, array_to_string(w[i : j], ' ') AS part
  FROM (SELECT lang, f, size, w, i, unnest(range(i + 1, size + 1)) AS j
        FROM (SELECT lang, f, size, string_split(phrase, ' ') AS w, unnest(range(1, size)) AS i FROM freq WHERE size > 2)) WHERE j - i + 1 < size),
kept AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM freq c
  WHERE size > 1 AND NOT EXISTS (SELECT 1 FROM parts p WHERE p.lang = c.lang AND p.part = c.phrase AND 100 * p.f >= 100 * c.f)),
cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS head, array_to_string(w[k + 1 :], ' ') AS tail FROM (SELECT *, unnest(range(1, size)) AS k FROM kept)),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, CAST((CAST(1000 AS HUGEINT) * c.a * t.n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM cuts c JOIN freq x ON x.lang = c.lang AND x.phrase = c.head JOIN freq y ON y.lang = c.lang AND y.phrase = c.tail JOIN total t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM best QUALIFY rank <= {top}"""
