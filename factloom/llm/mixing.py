"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Targets: sources ordered by cap / weight; a source is capped as long as its ratio lies under the level that
the rest would get. Sampling: every document of a source is taken floor(target / size) times, and a seeded
share of them once more: documents in the order of a seeded digest, until one no longer fits the rest of the target. What
is still free then goes to documents not yet taken once more, longest first, as many of each length as fit (a histogram of
lengths per source), chosen by digest: the gap that stays is under the shortest document left.
Running sums are two-level (sums per digest range of about RANGE_DOCS documents, then inside a range), so no
task holds a whole source however large one is. Only rows that are alike in id and text share a digest.

Null text: size 0. Null source: a source of its own, last. Null ids: like any other. Ties and repeated rows: ordered by
digest, so reruns agree; `mixed_documents` gives copies owed to repeated rows to one of them. Very long texts: whole.
A source without words has target 0. Empty table: empty result. Extra columns: ignored, or handed through by
`mixed_documents`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import WORD, materialize, unused

WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
SEED = "mix-1"
RANGE_DOCS = 4096


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, docs, target) from (source, size): a few rows per source, whatever the corpus holds.

    The windows without a key run over one row per source, after a grouped sum with map-side combining.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", max_epochs * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the level holds from the first source, in the order of ratios, that it leaves under its cap
    per = per.withColumn("at", F.row_number().over(by_ratio))
    first = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("at", "level")))
    per = per.withColumn("free_level", first.over(everything)["level"])
    target = F.round(F.least("cap", F.coalesce(F.col("free_level") * F.col("weight"), F.col("cap"))), 6)
    return per.select("source", "source_size", "docs", target.alias("target"))


def _digest(id_col: str, text_col: str, seed: str) -> Column:
    text = F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), text))


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _with_before(rows: DataFrame, keys: list[str], value: Column, docs: Column) -> DataFrame:
    """`rows` and `before`: the sum of `value` over the rows of the same keys that come first by digest; `docs` counts them."""
    place = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("value", value).withColumn("range", F.floor(place * F.ceil(docs / RANGE_DOCS) / F.lit(1 << 32)).cast("long"))
    sums = rows.groupBy(*keys, "range").agg(F.sum("value").alias("in_range"))
    running = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    named = {k: f"their_{k}" for k in (*keys, "range")}
    sums = sums.withColumn("outside", F.coalesce(F.sum("in_range").over(running), F.lit(0))).drop("in_range").withColumnsRenamed(named)
    same = F.lit(True)
    for k, other in named.items():
        same = same & F.col(k).eqNullSafe(F.col(other))
    inside = Window.partitionBy(*keys, "range").orderBy("digest").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.join(sums, same).withColumn("before", F.col("outside") + F.coalesce(F.sum("value").over(inside), F.lit(0)))
    return met.drop("value", "range", "outside", *named.values())


def _filled(placed: DataFrame) -> DataFrame:
    """(source, size, docs, take): how many more documents of each length fill what a source's first share leaves free."""
    left = placed.where("rest > 0").groupBy("source").agg((F.first("rest") - F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0))).alias("free"))
    rows = placed.where("rest > 0 AND size > 0 AND NOT extra").join(left.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).where("size <= free")
    lengths = rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs"), F.first("free").alias("free"))
    per = lengths.groupBy("source").agg(F.first("free").alias("free"), F.sort_array(F.collect_list(F.struct("size", "docs")), False).alias("lengths"))
    none = F.array().cast("array<struct<size:bigint,docs:bigint,take:bigint>>")

    def step(state: Column, x: Column) -> Column:
        take = F.least(x["docs"], F.floor(state["free"] / x["size"]).cast("long"))
        more = F.when(take > 0, F.concat(state["picks"], F.array(F.struct(x["size"], x["docs"], take.alias("take"))))).otherwise(state["picks"])
        return F.struct((state["free"] - take * x["size"]).alias("free"), more.alias("picks"))

    picks = F.aggregate("lengths", F.struct("free", none.alias("picks")), step)["picks"]
    return per.select("source", F.inline(picks))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS, seed: str = SEED
) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, taken, digest) per row."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), _size(text_col).alias("size"), _digest(id_col, text_col, seed).alias("digest"))
    sizes = materialize(rows, "sizes")
    targets = materialize(source_targets(sizes, weights, max_epochs), "targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = targets.withColumn("whole", F.floor(share).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # one row per source, joined null-safely; Spark broadcasts it only under its own size threshold
    known = sizes.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    placed = _with_before(known, ["source"], F.col("size"), F.col("docs")).drop("docs")
    extra = (F.col("rest") > 0) & (F.col("before") + F.col("size") <= F.col("rest"))
    placed = materialize(placed.withColumn("extra", extra).drop("before"), "placed")
    picks = materialize(_filled(placed), "picks").withColumnsRenamed({"source": "s", "size": "length"})
    offered = placed.join(picks, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("length")) & ~F.col("extra"), "left").drop("s", "length")
    settled = offered.where("take IS NULL").drop("docs", "take")
    more = _with_before(offered.where("take IS NOT NULL"), ["source", "size"], F.lit(1), F.col("docs")).withColumn("extra", F.col("before") < F.col("take")).drop("docs", "take", "before")
    repeats = F.least(F.col("whole") + F.col("extra").cast("long"), F.lit(int(max_epochs))).cast("long")
    out = settled.unionByName(more).withColumn("repeats", repeats)
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("size") * F.col("repeats")).alias("taken"), "digest")


def mixed_documents(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """`docs` (columns of documents) with each row as often as the mix takes it; rows taken zero times go.

    The plan is one small row per document; it meets the texts by digest. Rows alike in id, text and source share its
    repeats evenly, and one of them has what is left over.
    """
    own, digest, source, rows, repeats, times = unused(docs.columns, "own", "digest", "of", "rows", "repeats", "times")
    plan = mix_sources(docs, seed=seed).groupBy(F.col("digest").alias("d"), F.col("source").alias("s")).agg(F.count(F.lit(1)).alias(rows), F.sum("repeats").alias(repeats))
    plan = plan.where(F.col(repeats) > 0).withColumnsRenamed({"d": digest, "s": source})
    met = docs.withColumn(own, _digest("doc_id", "text", seed)).join(plan, (F.col(own) == F.col(digest)) & F.col("source").eqNullSafe(F.col(source)))
    even = met.withColumn(times, F.floor(F.col(repeats) / F.col(rows)))
    left = met.where(F.col(repeats) % F.col(rows) > 0).dropDuplicates([digest, source]).withColumn(times, F.col(repeats) % F.col(rows))
    both = even.unionByName(left).where(F.col(times) > 0)
    return both.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
