"""SimHash near-duplicates: 64-bit fingerprints, pigeonhole blocks, Hamming verification, components.

A fingerprint is cut into `blocks` blocks; two that differ in at most `distance` bits agree on at least
`blocks - distance` of them, so every such choice of blocks is a join key and each close pair shares one.
Copies collapse to one fingerprint first. Rows meet on the key; inside one key's bucket each fingerprint is
compared with those not yet reached (a breadth-first forest), so a bucket of m near copies gives at most
m - 1 links, never all pairs, while no link between different groups is lost. A bucket above `MAX_BUCKET`
fingerprints isn't held: its rows go out as midpoints within distance/2 flips of the bits outside the key
(close pairs share a midpoint, and sharing one proves closeness), which meet by a grouped minimum. So `distance` is even.

Null or empty text: fingerprint zero, linked like any other. Null ids: the row keeps its fingerprint and
component, but never names one. Ties and repeated rows: one result each; `drop_near_copies` keeps the least id, then the
least fingerprint and text digest. Very long texts: whole, hashed in parts. Empty table: empty result. Extra columns:
ignored, or handed through by `drop_near_copies`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from factloom.llm.common import arrow_batches, as_bytes, drop_table, give_back, materialize, partitions, unused
from factloom.llm.components import connected_components

BITS, SEED = 64, 42
MAX_BUCKET = 1 << 16
#: Near copies of the pipeline stage: least 5-word Jaccard, bands and minima to a band (a pair at 0.8 shares none of 20 bands in 3 of 100 000).
SIMILAR, BANDS, BAND = 0.8, 20, 4
#: Pairs of whole texts that are in memory together.
PAIRS_A_BATCH = 128
#: Texts of a bucket that all others are compared with: the least, and others chosen anew in each band.
HEADS = 3
_MINS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes, width: int = 4) -> int:
    """Majority of the bits of the shingles' XXH64, as an unsigned number; no words: 0."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxh64_intdigest(line, SEED)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - width + 1].tolist()
    hashes = [xxh64_intdigest(line[s:e], SEED) for s, e in zip(starts, ends[width - 1 :].tolist(), strict=True)]
    n = len(hashes)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer."""
    spec = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            fps = np.array([fingerprint(t or b"", width) for t in as_bytes(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return spec.mapInArrow(work, f"doc_id {spec.schema['doc_id'].dataType.simpleString()}, fp long")


def block_masks(blocks: int, distance: int) -> list[int]:
    """Masks of the block choices of which every close pair agrees on one."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(block, blocks - distance)]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect exactly those fingerprints that are connected by close pairs."""
    links, rest = [], fps.astype(np.uint64)
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            head, front = front[0], front[1:]
            near = np.bitwise_count(rest ^ head) <= distance
            if near.any():
                found, rest = rest[near], rest[~near]
                links.extend((int(head), int(x)) for x in found)
                front = np.concatenate([front, found])
    return links


def _midpoints(fp: int, mask: int, radius: int) -> np.ndarray:
    """All values within `radius` flips of `fp` outside the key's bits."""
    free = [np.uint64(1 << i) for i in range(BITS) if not mask >> i & 1]
    flips = [np.uint64(0)] + [np.bitwise_or.reduce(np.array(c, np.uint64)) for r in range(1, radius + 1) for c in combinations(free, r)]
    return np.array(flips, np.uint64) ^ np.uint64(fp)


def close_links(fps: DataFrame, distance: int = 4, blocks: int = 6, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b) over distinct fingerprints in `fps.fp`: a forest of close pairs per bucket, all pairs within `distance`."""
    if distance % 2:
        raise ValueError("midpoints need an even distance")
    spark = fps.sparkSession
    masks = block_masks(blocks, distance)
    keyed = fps.select(
        F.explode(F.array(*[F.struct(F.lit(i).cast("short").alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("part")) for i, m in enumerate(masks)])).alias("k"),
        "fp",
    ).select("k.choice", "k.part", "fp")
    keyed = keyed.repartition(partitions(spark), "choice", "part").sortWithinPartitions("choice", "part", "fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        out: list[tuple[int, int, int]] = []

        def emit() -> pa.RecordBatch:
            rows = np.array(out, np.uint64).reshape(-1, 3).view(np.int64)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(3)], ["kind", "a", "b"])

        held, key, spread = [], None, False  # of the bucket in hand

        def close() -> None:
            nonlocal held
            if not spread and sum(map(len, held)) > 1:
                out.extend((0, a, b) for a, b in _forest(np.concatenate(held), distance))
            held = []

        for batch in batches:
            choice, part, fp = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero((choice[1:] != choice[:-1]) | (part[1:] != part[:-1])) + 1
            starts = np.concatenate([[0], cuts]) if len(fp) else []
            ends = np.concatenate([cuts, [len(fp)]]) if len(fp) else []
            big = np.flatnonzero(ends - starts > 1) if len(fp) else []
            # singletons inside the batch can't link; only its ends and longer runs matter
            for i in sorted({0, *map(int, big), len(starts) - 1}) if len(fp) else []:
                s, e = int(starts[i]), int(ends[i])
                now = (int(choice[s]), int(part[s]))
                if now != key:
                    close()
                    key, spread = now, False
                held.append(fp[s:e].view(np.uint64))
                if spread or sum(map(len, held)) > max_bucket:
                    spread = True
                    for x in np.concatenate(held):
                        out.extend((1, int(m), int(x)) for m in _midpoints(int(x), masks[key[0]], distance // 2))
                        if len(out) > 100_000:
                            yield emit()
                    held = []
            if len(out) > 100_000:
                yield emit()
        close()
        yield emit()

    met = materialize(keyed.mapInArrow(work, "kind long, a long, b long"), "close")
    points = met.where("kind = 1").select("a", "b")
    stars = points.join(points.groupBy("a").agg(F.min("b").alias("low")), "a").where("b <> low").select(F.col("low").alias("a"), "b")
    return met.where("kind = 0").select("a", "b").unionByName(stars)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4, blocks: int = 6) -> DataFrame:
    """(doc_id, fp, component_id) per row; component_id is the smallest id reachable by links of at most `distance` bits."""
    rows = materialize(fingerprints(docs, id_col, text_col, width), "fps")
    first = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    members = connected_components(close_links(first.select("fp"), distance, blocks))
    named = first.join(members.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("component", "fp"))
    names = materialize(named.groupBy("label").agg(F.min("rep").alias("component_id")), "names")
    return rows.join(named.select("fp", "label").join(names, "label").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


def _bands(grams: set[bytes]) -> list[int]:
    """Keys of `BANDS` bands of `BAND` minima each over the 5-word shingles; none under five words."""
    if not grams:
        return []
    hashes = np.fromiter((xxh64_intdigest(g, SEED) for g in grams), np.uint64, len(grams))
    low = np.full(len(_MINS), ~np.uint64(0))
    for at in range(0, len(hashes), 4096):
        x = hashes[at : at + 4096, None] * _MINS
        low = np.minimum(low, (x ^ x >> np.uint64(29)).min(axis=0))
    return [xxh64_intdigest(row.tobytes(), SEED) - (1 << 63) for row in low.reshape(BANDS, BAND)]


def shingles(text: bytes, width: int = 5) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def _features(base: DataFrame) -> DataFrame:
    """(digest, fp, bands, grams) of (digest, text); grams: number of different shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            texts = [t or b"" for t in as_bytes(batch.column(1))]
            fps = np.array([fingerprint(t) for t in texts], np.uint64)
            bands, sizes = [], []
            for t in texts:  # the shingles of one text at a time
                grams = shingles(t)
                bands.append(_bands(grams))
                sizes.append(len(grams))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["digest", "fp", "bands", "grams"])

    return base.select("digest", "text").mapInArrow(work, "digest long, fp long, bands array<long>, grams long")


def _alike(pairs: DataFrame) -> DataFrame:
    """(a, b) of the rows (a, b, one, two) whose texts share at least `SIMILAR` of their 5-word shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        last, x = None, set()
        for batch in batches:
            keep = []
            for one, two in zip(as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True):
                if one != last:  # pairs of one head come one after the other
                    last, x = one, shingles(one or b"")
                y = shingles(two or b"")
                keep.append(len(x & y) >= SIMILAR * len(x | y))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    return pairs.select("a", "b", "one", "two").mapInArrow(work, "a long, b long")


def _labels(base: DataFrame, distance: int) -> DataFrame:
    """(digest, fp, label) of each text of `base` (digest, text): texts of one component share the label.

    Links are fingerprints within `distance` bits and, between the components of these, texts of 5-word Jaccard at least
    `SIMILAR`. Texts that share a band of minima meet in a bucket; each is compared with `HEADS` of them. Buckets in which
    texts of several components are left over are settled exactly by `_left_over`.
    """
    found = materialize(_features(base).dropDuplicates(["digest"]), "features")
    fps = found.select("fp").distinct()
    members = connected_components(close_links(fps, distance)).withColumnRenamed("node", "fp")
    known = materialize(found.join(members, "fp", "left").select("digest", "fp", F.coalesce("component", "fp").alias("label"), "bands", "grams"), "labels")
    banded = known.select("digest", "label", "grams", F.posexplode("bands").alias("band", "key"))
    least = F.min(F.struct("label", "digest", "grams")).alias("h0")
    seeded = [F.min(F.struct(F.xxhash64("digest", "band", F.lit(i)).alias("by"), "label", "digest", "grams")).alias(f"h{i}") for i in range(1, HEADS)]
    buckets = banded.groupBy("band", "key").agg(least, *seeded, F.max("label").alias("top")).where("h0.label <> top")
    each = F.explode(F.array(*[F.struct(F.col(f"h{i}.label").alias("a"), F.col(f"h{i}.digest").alias("x"), F.col(f"h{i}.grams").alias("theirs")) for i in range(HEADS)]))
    heads = buckets.select("band", "key", each.alias("head")).select("band", "key", "head.*")
    ends = F.sort_array(F.array(F.struct(F.col("x").alias("of"), F.col("a").alias("label")), F.struct(F.col("digest").alias("of"), F.col("label").alias("label"))))
    # no two sets are more alike than the smaller is to the larger in size: most chance meetings end here, before any text is fetched
    sized = F.least("grams", "theirs") >= SIMILAR * F.greatest("grams", "theirs")
    met = banded.join(heads, ["band", "key"]).where("label <> a").where(sized).select(ends.alias("e"))
    met = met.select(F.col("e")[0]["label"].alias("a"), F.col("e")[1]["label"].alias("b"), F.col("e")[0]["of"].alias("x"), F.col("e")[1]["of"].alias("y")).distinct()
    met = materialize(met, "met")
    first = connected_components(_verified(met, base)).withColumnsRenamed({"node": "label", "component": "whole"})
    known = materialize(known.join(first, "label", "left").select("digest", "fp", F.coalesce("whole", "label").alias("label"), "bands", "grams"), "joined")
    more = _left_over(known, base, met.select("x", "y"))
    if more is None:
        return known.select("digest", "fp", "label")
    last = connected_components(more).withColumnsRenamed({"node": "label", "component": "whole"})
    return materialize(known.join(last, "label", "left").select("digest", "fp", F.coalesce("whole", "label").alias("label")), "settled")


def _verified(met: DataFrame, base: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b, x, y) whose texts, of digests x and y, are alike."""
    needed = met.select(F.col("x").alias("digest")).union(met.select("y")).distinct()
    texts = materialize(base.select("digest", "text").join(needed, "digest", "left_semi").dropDuplicates(["digest"]), "texts")
    pairs = met.join(texts.select(F.col("digest").alias("y"), F.col("text").alias("two")), "y").join(texts.select(F.col("digest").alias("x"), F.col("text").alias("one")), "x")
    with arrow_batches(base.sparkSession, PAIRS_A_BATCH):
        alike = materialize(_alike(pairs).distinct(), "alike")
    drop_table(texts)
    return alike


def _left_over(known: DataFrame, base: DataFrame, compared: DataFrame) -> DataFrame | None:
    """(a, b) of further alike texts among those in a bucket of three or more with several labels; None where there is no such bucket.

    Prefix filtering: the shingles of these texts are put in one order, rarest first. Two texts of Jaccard at least `SIMILAR`
    share one of their first n - ceil(SIMILAR * n) + 1 shingles, so every such pair meets at a shingle, and rare ones bring few
    texts together; what comes after the first that they share must suffice for the rest. Shingles of a single text meet
    nothing and are left out before anything is joined.
    """
    banded = known.select("digest", "label", F.posexplode("bands").alias("band", "key"))
    mixed = banded.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("top")).where("n > 2 AND low <> top").select("band", "key")
    rest = materialize(banded.join(mixed, ["band", "key"]).select("digest").distinct().join(known.select("digest", "label", "grams"), "digest"), "rest")
    if rest.isEmpty():
        return None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for digest, raw in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                tokens = np.unique(np.fromiter((xxh64_intdigest(g, SEED) for g in shingles(raw or b"")), np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(tokens), digest)), pa.array(tokens)], ["digest", "token"])

    with arrow_batches(base.sparkSession, PAIRS_A_BATCH):
        texts = base.select("digest", "text").join(rest.select("digest"), "digest", "left_semi").dropDuplicates(["digest"])
        tokens = materialize(texts.mapInArrow(work, "digest long, token long"), "tokens")
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = tokens.join(common, "token")
    of_text = Window.partitionBy("digest")
    placed = shared.withColumns({"place": F.row_number().over(of_text.orderBy("df", "token")), "shared": F.count(F.lit(1)).over(of_text)}).join(rest, "digest")
    alone = F.col("grams") - F.col("shared")  # shingles of this text only come before all others
    prefix = placed.where(alone + F.col("place") <= F.col("grams") - F.ceil(SIMILAR * F.col("grams") - 1e-9) + 1).select("token", "digest", "label", "grams", (F.col("grams") - alone - F.col("place")).alias("after"))
    prefix = materialize(prefix, "prefix")
    one, two = (prefix.select("token", F.col("digest").alias(d), F.col("label").alias(x), F.col("grams").alias(g), F.col("after").alias(r)) for d, x, g, r in (("x", "a", "m", "i"), ("y", "b", "n", "j")))
    # at its first common shingle a pair has at most that one and what comes after it in both in common
    enough = 1 + F.least("i", "j") >= F.ceil(SIMILAR / (1 + SIMILAR) * (F.col("m") + F.col("n")) - 1e-9)
    pairs = one.join(two, "token").where("a < b").where(enough).select("a", "b", "x", "y").distinct()
    before = compared.select("x", "y").union(compared.select("y", "x"))
    pairs = materialize(pairs.join(before, ["x", "y"], "left_anti"), "candidates")
    alike = _verified(pairs, base)
    for table in (tokens, prefix, pairs):
        drop_table(table)
    return alike


def drop_near_copies(docs: DataFrame, distance: int = 4) -> DataFrame:
    """`docs` with exactly one row of each component (`_labels`): the one of least (doc_id, fingerprint, text digest), null ids last."""
    base = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("digest", F.xxhash64("text"))
    labels = _labels(base, distance)
    rows = base.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("copies")).join(labels, "digest")
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "fp", "digest", "copies")).alias("first"))
    own, digest, stay, copies, label = unused(docs.columns, "own", "digest", "stay", "copies", "label")
    stays = first.select(F.col("label").alias(label), F.col("first.doc_id").alias(stay), F.col("first.digest").alias(digest), F.col("first.copies").alias(copies))
    kept = docs.withColumn(own, F.xxhash64(F.col("text").cast("string"))).join(stays, (F.col(own) == F.col(digest)) & F.col("doc_id").eqNullSafe(F.col(stay)))
    both = kept.where(F.col(copies) == 1).unionByName(kept.where(F.col(copies) > 1).dropDuplicates([label]))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns])
