"""Multi-source reconciliation: facts of one metric and period are compared across sources and each gets a verdict.

Groups are formed by grouped aggregates and joined back, not by windows: what a group needs (counts, flags, sorted
source ids) combines before the shuffle, and a group that holds a third of all facts is one skewed join key, which
adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.functions.text import strip


def _blank(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def enrich(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts with their source's credibility, layer and publication year; unknown sources give nulls."""
    return facts.join(sources.select("source_id", "credibility", "layer", "published_year"), "source_id", "left")


def reject_reason(df: DataFrame) -> Column:
    number = V.digits_number(F.col("value"))
    return (
        F.when(_blank(F.col("source_id")), "missing_source_id")
        .when(_blank(F.col("claim")) | _blank(F.col("metric_name")) | _blank(F.col("value")) | _blank(F.col("period")), "missing_required_fields")
        .when(number.isNotNull() & (number <= 0), "invalid_numeric_value")
        .when(V.implausible(F.col("metric_name"), F.col("value")), "invalid_numeric_value")
        .when(F.col("credibility") < 0.2, "low_credibility_source")
    )


def verify(facts: DataFrame, as_of_year: int, single_source_conflicts: bool = True) -> DataFrame:
    """Facts (with credibility, layer, published_year) plus status, reason_code, score, supporting and conflicting sources."""
    period_year = F.regexp_extract(F.coalesce("period", F.lit("")), r"(\d{4})", 1).try_cast("int")
    old = (F.coalesce(F.col("published_year"), F.lit(9999)) < as_of_year - 5) | (F.coalesce(period_year, F.lit(9999)) < as_of_year - 5)
    model = F.coalesce(F.col("confidence"), F.lit(0.0)) >= 1.0
    rows = facts.withColumn("reject", reject_reason(facts))
    rows = rows.withColumn("path", F.when(F.col("reject").isNotNull(), "rejected").when(model, "model").when(old, "outdated").otherwise("rule"))
    rows = rows.withColumn("group_metric", V.metric_key(F.col("metric_name"))).withColumn("group_period", F.lower(strip(F.coalesce("period", F.lit("")))))
    rows = rows.withColumn("value_key", V.value_key(F.col("value")))
    keys = ["path", "group_metric", "group_period"]
    low = F.coalesce(F.col("credibility") < V.LOW_AUTHORITY, F.lit(False))
    layer = F.coalesce("layer", F.lit("third_party_background"))
    groups = rows.where(F.col("path").isin("rule", "model")).groupBy(*keys).agg(
        F.sort_array(F.collect_set("source_id")).alias("sources"),
        F.size(F.collect_set("value_key")).alias("n_values"),
        F.size(F.collect_set("value")).alias("n_raw"),
        F.size(F.collect_set("metric_name")).alias("n_metrics"),
        F.bool_or(low).alias("any_low"),
        F.bool_and(layer == "official_entry_page").alias("only_entry"),
        F.bool_and(V.official_body(F.col("layer")) & (F.col("credibility").isNull() | (F.col("credibility") >= 0.5))).alias("trusted"),
        F.bool_or(V.digits_number(F.col("value")).isNotNull()).alias("any_number"),
    )
    met = rows.join(groups, keys, "left")
    n, blocked = F.size("sources"), F.col("any_low") | F.col("only_entry")
    differs = F.col("n_values") > 1
    status, reason, score = _cascade(
        [
            (F.col("path") == "rejected", "rejected", F.col("reject"), 0.20),
            (F.col("path") == "outdated", "outdated", F.lit("outdated_period_or_source"), 0.50),
            ((F.col("path") == "model") & differs, "conflicted", F.lit("llm_value_divergence"), 0.50),
            (F.col("path") == "model", "verified", F.lit("llm_extracted"), 0.92),
            ((n >= 2) & differs, "conflicted", F.lit("different_value_multi_source"), 0.42),
            (differs & single_source_conflicts, "conflicted", F.lit("same_period_value_divergence"), 0.40),
            (~blocked & ~F.col("any_number"), "insufficient", F.lit("non_numeric_value_not_verified"), 0.52),
            ((n >= 2) & ~blocked, "verified", _agreement(), 0.88),
            (~blocked & F.col("trusted"), "verified", F.lit("official_disclosure_single_source"), 0.82),
            (F.col("any_low"), "insufficient", F.lit("low_authority_source_not_verified"), 0.55),
            (F.col("only_entry"), "insufficient", F.lit("official_entry_page_only"), 0.55),
            (F.lit(True), "insufficient", F.lit("single_source_only"), 0.55),
        ]
    )
    out = met.withColumn("status", status).withColumn("reason_code", reason).withColumn("score", score)
    others = F.array_except("sources", F.array("source_id"))
    empty = F.array().cast("array<string>")
    clash = F.when(F.col("reason_code") == "same_period_value_divergence", F.col("sources")).when(F.size(others) > 0, others).otherwise(F.col("sources"))
    out = out.withColumn("supporting", F.when(F.col("status") == "verified", F.col("sources")).when(F.col("status") == "insufficient", F.col("sources")).otherwise(empty))
    out = out.withColumn("conflicting", F.when(F.col("status") == "conflicted", clash).otherwise(empty))
    return out.select(*facts.columns, "group_metric", "group_period", "value_key", "status", "reason_code", "score", "supporting", "conflicting")


def _cascade(cases: list[tuple[Column, str, Column, float]]) -> tuple[Column, Column, Column]:
    """First case that holds gives status, reason and score."""
    columns = []
    for at in (1, 2, 3):
        out = None
        for case in cases:
            value = case[at] if isinstance(case[at], Column) else F.lit(case[at])
            out = F.when(case[0], value) if out is None else out.when(case[0], value)
        columns.append(out)
    return tuple(columns)


def _agreement() -> Column:
    """How the sources agree: by metric alias, by unit, by both, or literally."""
    alias, unit = F.col("n_metrics") > 1, F.col("n_raw") > 1
    return F.when(alias & unit, "metric_and_unit_normalized_same_value_multi_source").when(alias, "metric_normalized_same_value_multi_source").when(unit, "unit_normalized_same_value_multi_source").otherwise("same_value_multi_source")


def ambiguities(verdicts: DataFrame) -> DataFrame:
    """(group_metric, group_period, options): groups of conflicted facts with more than one value, values sorted."""
    g = verdicts.where("status = 'conflicted'").groupBy("group_metric", "group_period").agg(F.sort_array(F.collect_set("value_key")).alias("options"))
    return g.where(F.size("options") > 1)


def summary(verdicts: DataFrame) -> DataFrame:
    """One row: facts per status, and whether a review is needed."""
    names = ("verified", "conflicted", "insufficient", "outdated", "rejected")
    one = verdicts.agg(*[F.count_if(F.col("status") == s).alias(s) for s in names])
    return one.withColumn("needs_review", (F.col("conflicted") > 0) | (F.col("rejected") > 0) | ((F.col("insufficient") > 0) & (F.col("verified") == 0)))


def source_quality(sources: DataFrame) -> DataFrame:
    """One row: sources per authority, and whether they are insufficient."""
    level = V.authority(F.col("credibility"))
    one = sources.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(level == a).alias(a) for a in ("high", "medium", "low", "unknown")], F.count_if(V.official_body(F.col("layer"))).alias("official_body"))
    weak = (F.col("high") == 0) & (F.col("official_body") == 0) & (F.col("low") >= 0.5 * F.col("n"))
    return one.withColumn("insufficient", (F.col("n") == 0) | weak)
