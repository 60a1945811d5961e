"""Queries on extraction, normalisation and verification, over facts rendered from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.operators import extraction as X
from factloom.operators import verification as Y
from factloom.plans.registry import query, table

AS_OF = 2022
#: Counts per year, status and priority, rendered as facts of five sources; integers only, so both engines agree.
BASE = """
base AS (SELECT CAST(year(o_orderdate) + 20 AS INTEGER) AS y, o_orderstatus AS st, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS pr, count(*) AS n FROM orders GROUP BY ALL),
facts AS (
  SELECT st || '-' || y || '-' || pr AS fact_id, 'src-' || pr AS source_id, CAST(y AS VARCHAR) AS period,
    CASE WHEN y = 2021 AND pr = 5 THEN NULL WHEN st = 'F' THEN CASE WHEN pr = 2 THEN '营业收入' ELSE 'revenue' END WHEN st = 'O' THEN 'net profit' ELSE 'revenue_segment: 储能（A）' END AS metric_name,
    CASE WHEN y = 2018 AND pr = 4 THEN '-5亿元' WHEN y = 2020 AND st = 'O' THEN CASE WHEN pr < 3 THEN '稳定' ELSE '增长' END
         WHEN y % 3 = 0 THEN CAST(10 + pr AS VARCHAR) || '.50亿元' WHEN pr = 2 THEN CAST((y % 7 + 2) * 100000 AS VARCHAR) || '万元' ELSE CAST((y % 7 + 2) * 10 AS VARCHAR) || '亿元' END AS value,
    y || '年' || st AS claim, CASE WHEN st = 'P' AND pr < 4 THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence, n
  FROM base WHERE st <> 'O' OR y % 2 = 0 OR pr = 1),
sources AS (SELECT 'src-' || pr AS source_id, CASE pr WHEN 1 THEN 0.96 WHEN 2 THEN 0.7 WHEN 3 THEN 0.65 WHEN 4 THEN 0.15 END::DOUBLE AS credibility,
    CASE pr WHEN 1 THEN 'official_pdf' WHEN 5 THEN 'official_entry_page' ELSE 'third_party_background' END AS layer, 2016 + pr AS published_year FROM (SELECT unnest([1, 2, 3, 4]) AS pr))
"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of BASE's `facts`."""
    pr = F.substring("o_orderpriority", 1, 1).cast("int")
    base = table(spark, sf_dir, "orders").groupBy((F.year("o_orderdate") + 20).alias("y"), F.col("o_orderstatus").alias("st"), pr.alias("pr")).agg(F.count(F.lit(1)).alias("n"))
    y, st, p = F.col("y"), F.col("st"), F.col("pr")
    metric = F.when((y == 2021) & (p == 5), None).when(st == "F", F.when(p == 2, "营业收入").otherwise("revenue")).when(st == "O", "net profit").otherwise("revenue_segment: 储能（A）")
    value = (
        F.when((y == 2018) & (p == 4), "-5亿元")
        .when((y == 2020) & (st == "O"), F.when(p < 3, "稳定").otherwise("增长"))
        .when(y % 3 == 0, F.concat((p + 10).cast("string"), F.lit(".50亿元")))
        .when(p == 2, F.concat(((y % 7 + 2) * 100000).cast("string"), F.lit("万元")))
        .otherwise(F.concat(((y % 7 + 2) * 10).cast("string"), F.lit("亿元")))
    )
    return base.where((st != "O") | (y % 2 == 0) | (p == 1)).select(
        F.concat_ws("-", st, y.cast("string"), p.cast("string")).alias("fact_id"), F.concat(F.lit("src-"), p.cast("string")).alias("source_id"), y.cast("string").alias("period"),
        metric.alias("metric_name"), value.alias("value"), F.concat(y.cast("string"), F.lit("年"), st).alias("claim"), F.when((st == "P") & (p < 4), 1.0).otherwise(0.8).alias("confidence"), "n",
    )


def sources(spark: SparkSession) -> DataFrame:
    rows = [("src-1", 0.96, "official_pdf", 2017), ("src-2", 0.7, "third_party_background", 2018), ("src-3", 0.65, "third_party_background", 2019), ("src-4", 0.15, "third_party_background", 2020)]
    return spark.createDataFrame(rows, "source_id string, credibility double, layer string, published_year int")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.verify(Y.enrich(facts(spark, sf_dir), sources(spark)), AS_OF)


# In this rendering metric keys and value keys have a closed form, which keeps the oracle independent of the operator.
KEYED = """
keyed AS (
  SELECT f.*, s.credibility, s.layer, s.published_year,
    CASE WHEN metric_name IS NULL THEN '' WHEN metric_name = '营业收入' THEN 'revenue' WHEN metric_name LIKE 'revenue_segment%' THEN 'revenue_segment:储能(a)' ELSE metric_name END AS group_metric,
    CASE WHEN value LIKE '%亿元' THEN 'money:' || CAST(CAST(CAST(replace(value, '亿元', '') AS DOUBLE) * 100000000 AS BIGINT) AS VARCHAR) || ':yuan'
         WHEN value LIKE '%万元' THEN 'money:' || CAST(CAST(CAST(replace(value, '万元', '') AS DOUBLE) * 10000 AS BIGINT) AS VARCHAR) || ':yuan' ELSE value END AS value_key,
    CASE WHEN metric_name IS NULL THEN 'missing_required_fields' WHEN value LIKE '-%' AND metric_name <> 'net profit' THEN 'invalid_numeric_value' WHEN credibility < 0.2 THEN 'low_credibility_source' END AS reject
  FROM facts f LEFT JOIN sources s USING (source_id)),
pathed AS (SELECT *, CASE WHEN reject IS NOT NULL THEN 'rejected' WHEN confidence >= 1 THEN 'model' WHEN coalesce(published_year, 9999) < 2017 OR CAST(period AS INTEGER) < 2017 THEN 'outdated' ELSE 'rule' END AS path FROM keyed),
groups AS (
  SELECT path, group_metric, period, list_sort(list_distinct(list(source_id))) AS sources, count(DISTINCT value_key) AS n_values, count(DISTINCT value) AS n_raw, count(DISTINCT metric_name) AS n_metrics,
    bool_or(coalesce(credibility < 0.6, false)) AS any_low, bool_and(coalesce(layer, '') = 'official_entry_page') AS only_entry,
    bool_and(coalesce(layer, '') = 'official_pdf' AND coalesce(credibility >= 0.5, true)) AS trusted, bool_or(regexp_matches(value, '[0-9]')) AS any_number
  FROM pathed WHERE path IN ('rule', 'model') GROUP BY ALL),
met AS (SELECT p.*, g.sources, g.n_values > 1 AS differs, len(g.sources) AS n_sources, g.any_low, g.only_entry, g.trusted, g.any_number, g.n_metrics > 1 AS alias, g.n_raw > 1 AS unit,
          NOT (g.any_low OR g.only_entry) AS open FROM pathed p LEFT JOIN groups g USING (path, group_metric, period)),
verdicts AS (
  SELECT fact_id, source_id, period, group_metric, value, value_key, confidence, n, sources,
    CASE WHEN path IN ('rejected', 'outdated') THEN path WHEN differs THEN 'conflicted' WHEN path = 'model' THEN 'verified' WHEN open AND NOT any_number THEN 'insufficient' WHEN open AND (n_sources >= 2 OR trusted) THEN 'verified' ELSE 'insufficient' END AS status,
    CASE WHEN path = 'rejected' THEN reject WHEN path = 'outdated' THEN 'outdated_period_or_source' WHEN path = 'model' THEN CASE WHEN differs THEN 'llm_value_divergence' ELSE 'llm_extracted' END
      WHEN differs THEN CASE WHEN n_sources >= 2 THEN 'different_value_multi_source' ELSE 'same_period_value_divergence' END
      WHEN open AND NOT any_number THEN 'non_numeric_value_not_verified'
      WHEN open AND n_sources >= 2 THEN CASE WHEN alias AND unit THEN 'metric_and_unit_normalized_' WHEN alias THEN 'metric_normalized_' WHEN unit THEN 'unit_normalized_' ELSE '' END || 'same_value_multi_source'
      WHEN open AND trusted THEN 'official_disclosure_single_source' WHEN any_low THEN 'low_authority_source_not_verified' WHEN only_entry THEN 'official_entry_page_only' ELSE 'single_source_only' END AS reason_code
  FROM met)
"""


@query(
    "verify_facts",
    f"""
WITH {BASE}, {KEYED}
SELECT fact_id, status, reason_code,
  CASE status WHEN 'rejected' THEN 0.2 WHEN 'outdated' THEN 0.5 WHEN 'conflicted' THEN CASE reason_code WHEN 'llm_value_divergence' THEN 0.5 WHEN 'different_value_multi_source' THEN 0.42 ELSE 0.4 END
    WHEN 'verified' THEN CASE reason_code WHEN 'llm_extracted' THEN 0.92 WHEN 'official_disclosure_single_source' THEN 0.82 ELSE 0.88 END ELSE CASE reason_code WHEN 'non_numeric_value_not_verified' THEN 0.52 ELSE 0.55 END END::DOUBLE AS score,
  CASE WHEN status IN ('verified', 'insufficient') THEN array_to_string(sources, ',') ELSE '' END AS supporting,
  CASE WHEN status <> 'conflicted' THEN '' WHEN reason_code = 'same_period_value_divergence' OR len(sources) = 1 THEN array_to_string(sources, ',') ELSE array_to_string(list_filter(sources, lambda s: s <> source_id), ',') END AS conflicting
FROM verdicts
""",
)
def verify_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = verdicts(spark, sf_dir)
    return v.select("fact_id", "status", "reason_code", "score", F.array_join("supporting", ",").alias("supporting"), F.array_join("conflicting", ",").alias("conflicting"))


@query("verify_llm_facts", f"WITH {BASE}, {KEYED} SELECT fact_id, status, reason_code FROM verdicts WHERE confidence >= 1")
def verify_llm_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.verify(Y.enrich(facts(spark, sf_dir).where("confidence >= 1"), sources(spark)), AS_OF).select("fact_id", "status", "reason_code")


@query(
    "metric_ambiguities",
    f"WITH {BASE}, {KEYED} SELECT group_metric, period AS group_period, array_to_string(list_sort(list_distinct(list(value_key))), ' | ') AS options FROM verdicts WHERE status = 'conflicted' GROUP BY ALL HAVING count(DISTINCT value_key) > 1",
)
def metric_ambiguities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.ambiguities(verdicts(spark, sf_dir)).select("group_metric", "group_period", F.array_join("options", " | ").alias("options"))


@query(
    "verification_summary",
    f"""
WITH {BASE}, {KEYED}, s AS (SELECT count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'conflicted') AS conflicted, count(*) FILTER (status = 'insufficient') AS insufficient,
  count(*) FILTER (status = 'outdated') AS outdated, count(*) FILTER (status = 'rejected') AS rejected FROM verdicts)
SELECT *, conflicted > 0 OR rejected > 0 OR (insufficient > 0 AND verified = 0) AS needs_review FROM s
""",
)
def verification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.summary(verdicts(spark, sf_dir))


@query(
    "source_quality_gate",
    """
WITH s AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 0.96 WHEN 1 THEN 0.7 WHEN 2 THEN 0.4 WHEN 3 THEN 0.5 END::DOUBLE AS credibility FROM documents),
c AS (SELECT count(*) AS n, count(*) FILTER (credibility >= 0.85) AS high, count(*) FILTER (credibility >= 0.6 AND credibility < 0.85) AS medium, count(*) FILTER (credibility < 0.6) AS low,
  count(*) FILTER (credibility IS NULL) AS unknown, count(*) FILTER (doc_id % 9 = 0) AS official_body FROM s)
SELECT *, n = 0 OR (high = 0 AND official_body = 0 AND low >= 0.5 * n) AS insufficient FROM c
""",
)
def source_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id") % 5
    score = F.when(i == 0, 0.96).when(i == 1, 0.7).when(i == 2, 0.4).when(i == 3, 0.5)
    return Y.source_quality(table(spark, sf_dir, "documents").select(score.alias("credibility"), F.when(F.col("doc_id") % 9 == 0, "official_pdf").otherwise("official_entry_page").alias("layer")))


@query(
    "value_normalize",
    """
SELECT o_orderkey, 'money:' || CAST(o_orderkey * 10000 AS VARCHAR) || ':yuan' AS from_wan,
  'energy:' || regexp_replace(regexp_replace(CAST(CAST(o_orderkey AS DECIMAL(20, 6)) * CAST(1000 AS DECIMAL(12, 0)) / 4 AS DECIMAL(38, 6))::VARCHAR, '0+$', ''), '[.]$', '') || ':MWh' AS from_gwh,
  'stable' AS raw FROM orders
""".replace("CAST(CAST(o_orderkey AS DECIMAL(20, 6)) * CAST(1000 AS DECIMAL(12, 0)) / 4 AS DECIMAL(38, 6))", "CAST(o_orderkey * 250 AS DECIMAL(38, 6))"),
)
def value_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    gwh = F.concat(F.floor(key / 4).cast("string"), F.lit("."), F.lpad((key % 4 * 25).cast("string"), 2, "0"), F.lit(" gwh"))
    return table(spark, sf_dir, "orders").select("o_orderkey", V.value_key(F.concat(key.cast("string"), F.lit(" 万元"))).alias("from_wan"), V.value_key(gwh).alias("from_gwh"), V.value_key(F.lit(" Sta, ble")).alias("raw"))


@query(
    "metric_normalize",
    """
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'R&D_expenditure' WHEN 1 THEN 'revenue' WHEN 2 THEN 'Gross Margin' WHEN 3 THEN 'revenue_segment:电池(x)' || (o_orderkey % 9) WHEN 4 THEN 'net_profit_parent' ELSE '' END AS metric_key FROM orders
""",
)
def metric_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    name = F.when(key % 6 == 0, " Research-Expense").when(key % 6 == 1, "operating  revenue:whole").when(key % 6 == 2, " Gross Margin ").when(key % 6 == 3, F.concat(F.lit("revenue_segment: 电池 （X） "), (key % 9).cast("string"))).when(key % 6 == 4, "归母净利润")
    return table(spark, sf_dir, "orders").select("o_orderkey", V.metric_key(name).alias("metric_key"))


@query(
    "plausibility_filter",
    """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN o_orderkey % 200 >= 100 WHEN 1 THEN false WHEN 2 THEN false WHEN 3 THEN false ELSE true END AS plausible FROM orders
""",
)
def plausibility_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    metric = F.when(key % 5 == 3, "sales_volume:SUV").when(key % 5 == 4, "production_volume").otherwise("revenue")
    value = F.when(key % 5 == 0, F.concat((key % 200).cast("string"), F.lit("00万元"))).when(key % 5 == 1, "12.5%").when(key % 5 == 2, "300万辆").when(key % 5 == 3, "3亿元").otherwise("12GWh")
    return table(spark, sf_dir, "orders").select("o_orderkey", (~V.implausible(metric, value)).alias("plausible"))


#: Yearly counts per market segment rendered as prose and as tables.
SEGMENT = "seg AS (SELECT c_mktsegment AS company, CAST(year(o_orderdate) + 20 AS INTEGER) AS y, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_mktsegment").alias("company"), (F.year("o_orderdate") + 20).alias("y")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "fact_extract_rules",
    f"""
WITH {SEGMENT}
SELECT company, 'revenue' AS metric_name, CAST(n * 100000 AS VARCHAR) || '万元' AS value, CAST(y AS VARCHAR) AS period FROM seg
UNION ALL SELECT company, 'net_profit', CAST(n AS VARCHAR) || '亿元', CAST(y AS VARCHAR) FROM seg
""",
)
def fact_extract_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = _segments(spark, sf_dir), F.col("n").cast("string")
    text = F.concat(F.col("y").cast("string"), F.lit("年，公司营业收入为"), (F.col("n") * 100000).cast("string"), F.lit("万元；净利润达"), n, F.lit("亿，同比增长。"))
    return s.select("company", F.explode(X.facts_of(text)).alias("f")).select("company", "f.metric_name", "f.value", "f.period")


@query(
    "fact_extract_table",
    f"""
WITH {SEGMENT}
SELECT company, 'revenue' AS metric_name, CAST(n * 100000 AS VARCHAR) || '万元' AS value, CAST(y AS VARCHAR) AS period, 0.78::DOUBLE AS confidence FROM seg
UNION ALL SELECT company, 'net_profit_parent', CAST(n * 20000 AS VARCHAR) || '万元', CAST(y AS VARCHAR), 0.78::DOUBLE FROM seg
""",
)
def fact_extract_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One table per company: a header of years, a unit note, and rows of bare amounts. A company has a handful of years."""
    g = _segments(spark, sf_dir).groupBy("company").agg(F.array_sort(F.collect_list(F.struct("y", "n"))).alias("x"))
    years = F.array_join(F.transform("x", lambda r: F.concat(r["y"].cast("string"), F.lit("年"))), " ")
    revenue = F.array_join(F.transform("x", lambda r: F.format_string("%,.2f", (r["n"] * 100000).cast("double"))), " ")
    profit = F.array_join(F.transform("x", lambda r: F.format_string("%,d", r["n"] * 20000)), " ")
    text = F.concat(F.lit("单位：万元\n项目 "), years, F.lit("\n营业收入合计 "), F.replace(revenue, F.lit(".00"), F.lit("")), F.lit("\n归母净利润 "), profit, F.lit("\n"))
    return g.select("company", F.explode(X.facts_of(text)).alias("f")).select("company", "f.metric_name", "f.value", "f.period", "f.confidence")


@query(
    "fact_dedupe_period",
    f"""
WITH {SEGMENT}, f AS (
  SELECT company AS source_id, 'revenue' AS metric_name, CASE WHEN i = 2 THEN 'unknown_period' ELSE CAST(y AS VARCHAR) END AS period, CAST(n AS VARCHAR) || '亿元' AS value, i * 100 + y AS pos
  FROM seg, (SELECT unnest([0, 1, 2]) AS i) WHERE i < 2 OR y % 2 = 0
  UNION ALL SELECT company, 'net_profit', 'unknown_period', CAST(n AS VARCHAR) || '亿元', y FROM seg WHERE y % 3 = 0)
SELECT source_id, metric_name, period, value, min(pos) AS pos FROM f
WHERE period <> 'unknown_period' OR NOT EXISTS (SELECT 1 FROM f g WHERE g.source_id = f.source_id AND g.metric_name = f.metric_name AND g.value = f.value AND g.period <> 'unknown_period') GROUP BY ALL
""",
)
def fact_dedupe_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segments(spark, sf_dir).withColumn("value", F.concat(F.col("n").cast("string"), F.lit("亿元")))
    thrice = s.select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("i")).where("i < 2 OR y % 2 = 0")
    one = thrice.select(F.col("company").alias("source_id"), F.lit("revenue").alias("metric_name"), F.when(F.col("i") == 2, "unknown_period").otherwise(F.col("y").cast("string")).alias("period"), "value", (F.col("i") * 100 + F.col("y")).alias("pos"))
    two = s.where("y % 3 = 0").select(F.col("company").alias("source_id"), F.lit("net_profit").alias("metric_name"), F.lit("unknown_period").alias("period"), "value", F.col("y").alias("pos"))
    return X.dedupe(one.unionByName(two)).select("source_id", "metric_name", "period", "value", "pos")
