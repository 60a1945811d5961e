"""Evaluation of rankings, extractions and coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, query: str, item: str, k: int) -> DataFrame:
    """(query, recall, ndcg, mrr, precision, f1, average_precision) at k, binary relevance, for every query of `ranked` or `relevant`.

    A query without relevant items scores 1 if nothing was returned, else 0.
    """
    top = ranked.where(F.col("rank") <= k)
    hit = top.join(relevant.select(query, item).distinct().withColumn("rel", F.lit(1)), [query, item], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    gains = hit.groupBy(query).agg(
        F.count(F.lit(1)).alias("returned"), F.sum("rel").alias("hits"), F.sum(F.col("rel") / F.log2(F.col("rank") + 1)).alias("dcg"), F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.array_sort(F.collect_list(F.when(F.col("rel") == 1, F.col("rank")))).alias("places"),  # at most k entries
    )
    sizes = relevant.groupBy(query).agg(F.countDistinct(item).alias("n"))
    both = gains.join(sizes, query, "full").fillna({"returned": 0, "hits": 0, "dcg": 0.0, "n": 0})
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least("n", F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1))
    empty = F.when(F.col("returned") == 0, 1.0).otherwise(0.0)

    def score(c: Column) -> Column:
        return F.round(F.when(F.col("n") == 0, empty).otherwise(F.coalesce(c, F.lit(0.0))), 6)

    ap = F.aggregate(F.transform(F.coalesce("places", F.array().cast("array<int>")), lambda r, i: (i + 1) / r), F.lit(0.0), lambda s, x: s + x) / F.least("n", F.lit(k))
    precision, recall = F.col("hits") / k, F.col("hits") / F.col("n")
    f1 = F.when(F.col("hits") > 0, 2 * precision * recall / (precision + recall))
    return both.select(query, score(recall).alias("recall"), score(F.col("dcg") / ideal).alias("ndcg"), score(1 / F.col("first")).alias("mrr"), score(precision).alias("precision"), score(f1).alias("f1"), score(ap).alias("average_precision"))


def micro_prf(predicted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 over distinct key tuples."""
    p = predicted.select(*keys).distinct().withColumn("p", F.lit(1))
    e = expected.select(*keys).distinct().withColumn("e", F.lit(1))
    c = p.join(e, keys, "full").agg(F.count_if(F.expr("p = 1 AND e = 1")).alias("tp"), F.count_if(F.expr("p = 1 AND e IS NULL")).alias("fp"), F.count_if(F.expr("p IS NULL AND e = 1")).alias("fn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.round(F.when(b > 0, a / b).otherwise(0.0), 6)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def coverage(cases: DataFrame, least: float = 0.7) -> DataFrame:
    """Cases (expected, observed arrays, n_sources, n_facts) with their coverage, density and whether they pass."""
    tidy = cases.withColumns({c: F.array_sort(F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(F.trim(x))), lambda x: x != ""))) for c in ("expected", "observed")})
    n = F.size("expected")
    share = F.round(F.when(n > 0, F.size(F.array_intersect("expected", "observed")) / n).otherwise(1.0), 4)
    out = tidy.withColumns({"coverage": share, "density": F.round(F.when(F.col("n_sources") > 0, F.col("n_facts") / F.col("n_sources")).otherwise(0.0), 4), "missing": F.array_except("expected", "observed"), "unexpected": F.array_except("observed", "expected")})
    return out.withColumn("passed", (F.col("n_sources") > 0) & (F.col("n_facts") > 0) & (F.col("coverage") >= least))


def paired_summary(rows: DataFrame, systems: tuple[str, ...]) -> DataFrame:
    """(system, metrics, p50, p95) over queries (relevant_count, and per system `<s>_recall`, `<s>_ndcg`, `<s>_mrr`, `<s>_returned`, `<s>_ms`).

    Quality is averaged over queries with relevant items, false positives are the share of the others that got an answer;
    p95 is the value at the place that 95 % of the queries don't exceed.
    """
    positive = F.col("relevant_count") > 0
    out = None
    for s in systems:
        means = [F.round(F.avg(F.when(positive, F.col(f"{s}_{m}"))), 6).alias(m) for m in ("recall", "ndcg", "mrr")]
        wrong = F.round(F.avg(F.when(~positive, (F.col(f"{s}_returned") > 0).cast("double"))), 6).alias("false_positive_rate")
        part = rows.agg(F.lit(s).alias("system"), *means, F.count_if(positive).alias("positives"), F.count_if(~positive).alias("negatives"), wrong, F.round(F.percentile(f"{s}_ms", 0.5), 6).alias("p50"), F.percentile_approx(f"{s}_ms", 0.95, 1_000_000).alias("p95"))
        out = part if out is None else out.unionByName(part)
    return out


def hit_rate(fused: DataFrame, relevant: DataFrame, query: str, item: str, k: int = 10) -> DataFrame:
    """(hit_rate): share of the queries of `relevant` with a relevant item among their first k."""
    hits = fused.where(F.col("rank") <= k).join(relevant.select(query, item).distinct(), [query, item], "left_semi").select(query).distinct().withColumn("hit", F.lit(1))
    return relevant.select(query).distinct().join(hits, query, "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("hit_rate"))


def section_completeness(reports: DataFrame) -> DataFrame:
    """(completeness): share of reports (content, required) that hold every section they must."""
    return reports.agg(F.round(F.avg(F.forall("required", lambda s: F.contains(F.col("content"), s)).cast("double")), 6).alias("completeness"))


def required(dataset: DataFrame) -> DataFrame:
    """A dataset that an evaluation can't do without; empty ones are refused."""
    if dataset.isEmpty():
        raise ValueError("an evaluation dataset must not be empty")
    return dataset
