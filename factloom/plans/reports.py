"""Queries on composed answers, reports, enrichment and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import enrichment as N
from factloom.operators import rendering as D
from factloom.operators import report as R
from factloom.operators import selection as A
from factloom.plans import answers as P
from factloom.plans.facts import SEGMENT, _segments
from factloom.plans.registry import query, table
from factloom.sources import scans


@query(
    "answer_compose",
    f"""
WITH {P.ROWS}, r AS (SELECT *, CAST(period AS INTEGER) AS y, row_number() OVER (PARTITION BY company ORDER BY CASE WHEN CAST(period AS INTEGER) IN ({P.LIST}) THEN 0 ELSE 1 END, period DESC, CASE WHEN confidence >= 1 THEN 0 ELSE 1 END, quality DESC, pos) AS rank FROM rows QUALIFY rank <= 8),
c AS (SELECT *, period || '年为' || value AS claim, row_number() OVER (PARTITION BY company ORDER BY y, rank) AS t FROM r)
SELECT company, string_agg(claim, '；' ORDER BY rank) FILTER (rank <= 4) || '。' AS direct,
  '从已核对条目看，' || (SELECT string_agg(CAST(y AS VARCHAR), ' → ' ORDER BY y) FROM (SELECT DISTINCT y FROM c d WHERE d.company = c.company)) || ' 年间相关数据为：' || string_agg(claim, '；' ORDER BY t) FILTER (t <= 5) || '。' AS trend FROM c GROUP BY company
""",
)
def answer_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = A.rank_answers(P.rows(spark, sf_dir), "company", P.YEARS)
    return R.compose(ranked.withColumn("claim", F.concat("period", F.lit("年为"), "value", F.lit("（来源 1 年报）"))), "company")


@query(
    "chart_payload",
    f"WITH {SEGMENT}, r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY y) AS k FROM seg WHERE y % 2 = 0 QUALIFY k <= 6) SELECT company, string_agg(CAST(y AS VARCHAR), ',' ORDER BY k) AS labels, string_agg(CAST(n AS VARCHAR), ',' ORDER BY k) AS numbers FROM r GROUP BY company",
)
def chart_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segments(spark, sf_dir).select("company", F.when(F.col("y") % 2 == 0, "Net_Profit").otherwise("capacity").alias("metric_name"), F.concat(F.lit("约-"), F.col("n").cast("string"), F.lit("亿元")).alias("value"), F.col("y").cast("string").alias("period"), F.col("y").alias("pos"))
    c = R.chart_payload(s, "company")
    return c.select("company", F.array_join("labels", ",").alias("labels"), F.array_join(F.transform("numbers", lambda x: x.cast("long").cast("string")), ",").alias("numbers"))


@query("report_roundtrip", "SELECT r_regionkey, r_name AS summary, '' AS absent, '# ' || r_name || chr(10) || chr(10) || '## 总结' || chr(10) || r_name || chr(10) || chr(10) || '## 风险' || chr(10) || '1. a' || chr(10) || '2. b' AS report FROM region")
def report_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report rendered, and its sections read back."""
    r = table(spark, sf_dir, "region").withColumn("report", R.markdown_report(F.col("r_name"), [("总结", F.col("r_name")), ("空", F.lit("")), ("风险", R.numbered(F.array(F.lit("a"), F.lit("b"))))]))
    return r.select("r_regionkey", R.report_section(F.col("report"), "总结").alias("summary"), R.report_section(F.col("report"), "空").alias("absent"), "report")


@query("append_tables", "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name ELSE n_name || chr(10) || '报告年度：未知' || chr(10) || '单位：元' || chr(10) || chr(10) || chr(10) || '# 结构化表格' || chr(10) || chr(10) || '## 表格 1' || chr(10) || 't' END AS enriched FROM nation")
def append_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = F.when(F.col("n_nationkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("t"), F.lit("u")))
    return table(spark, sf_dir, "nation").select("n_nationkey", N.append_tables(F.col("n_name"), tables, F.lit(None).cast("string"), F.lit("单位：元"), most=1).alias("enriched"))


@query("section_marks")
def section_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(F.struct(F.lit("Body").alias("title"), F.substring("text", 50, 200).alias("content")), F.struct(F.lit("Added").alias("title"), F.lit("not in the text").alias("content")))
    return table(spark, sf_dir, "documents").select("doc_id", N.mark_sections(F.col("text"), parts).alias("marked"))


@query("content_prioritize")
def content_prioritize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", N.prioritized(F.regexp_replace("text", "\n", "\n## "), {"the": 1.0, "que": 0.8}, 3000).alias("picked"))


@query("rule_entities", "SELECT n_nationkey, 'ORG:测试科技|MONEY:2024年 12.5亿元|DATE:2024年' AS entities FROM nation")
def rule_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = N.entities(F.concat(F.lit("测试科技，2024年 12.5亿元 "), F.col("n_name")))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.transform(found, lambda e: F.concat(e["label"], F.lit(":"), e["text"])), "|").alias("entities"))


@query("statement_consistency", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'contradiction' WHEN 1 THEN 'contradiction' WHEN 2 THEN 'entailment' ELSE 'neutral' END AS verdict FROM nation")
def statement_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey") % 4
    a = F.when(k == 0, "收入 12.5 亿元").when(k == 1, "利润增长").when(k == 2, " same ").otherwise("one")
    b = F.when(k == 0, "收入 13 亿元").when(k == 1, "利润下降").when(k == 2, "same").otherwise("two")
    return table(spark, sf_dir, "nation").select("n_nationkey", N.consistency(a, b).alias("verdict"))


@query("reference_flatten", "SELECT page_id, 'r' || page_id AS title, url, page_id % 3 <> 2 AS relevant FROM pages")
def reference_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search responses as JSON, flattened, with the relevance test."""
    k = F.col("page_id") % 3
    content = F.when(k == 0, "Ａcme 公司 年度报告").when(k == 1, "A-c-m-e 产品").otherwise("Acme 考试题 年报")
    item = F.struct(F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("title"), F.col("url"), content.alias("content"))
    one = F.to_json(F.struct(F.array(item).alias("references")))
    two = F.to_json(F.struct(F.array(item).alias("search_results")))
    raw = table(spark, sf_dir, "pages").select("page_id", F.when(k == 0, one).otherwise(two).alias("raw"))
    flat = raw.select("page_id", F.explode(scans.references(F.col("raw"))).alias("r"))
    return flat.select("page_id", "r.title", "r.url", scans.relevant("Acme", F.col("r.title"), F.col("r.url"), F.col("r.content")).alias("relevant"))


@query(
    "mock_sources",
    """
SELECT r_name AS company, CAST(pos AS INTEGER) AS pos, 'other' AS source_type, '[MOCK 演示占位] ' || r_name || ' - ' || ['非真实年度报告', '非真实公告', '非真实新闻'][pos + 1] AS title,
       'mock://local/' || r_name || '/placeholder-' || ['annual-report', 'announcement', 'news'][pos + 1] AS url, 0.61::DOUBLE AS credibility FROM region, (SELECT unnest([0, 1, 2]) AS pos)
""",
)
def mock_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.mock_sources(table(spark, sf_dir, "region").select(F.col("r_name").alias("company"))).select("company", "pos", "source_type", "title", "url", "credibility")


@query(
    "answer_mode",
    "SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'trend' WHEN 1 THEN 'list' ELSE 'direct' END AS mode, item_id % 3 < 2 AS strict FROM benchmark",
)
def answer_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("item_id") % 3
    q = F.when(k == 0, "近三年营收变化趋势").when(k == 1, "净利润分别是多少").otherwise("整体情况，研发如何")
    b = table(spark, sf_dir, "benchmark").select("item_id", q.alias("q")).withColumn("f", A.families(F.col("q")))
    return b.select("item_id", R.answer_mode(F.col("q"), F.col("f")).alias("mode"), R.strict_metrics(F.col("q"), F.col("f")).alias("strict"))


@query(
    "report_rendered",
    f"""
WITH f AS (SELECT o_custkey AS t, o_orderkey AS pos, 'o' || o_orderkey AS claim, CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'conflicted' ELSE 'outdated' END AS status, 'u' || (o_orderkey % 3) AS url FROM orders),
u AS (SELECT t, url, row_number() OVER (PARTITION BY t ORDER BY min(pos)) AS ref FROM f GROUP BY t, url),
g AS (SELECT f.*, ref, row_number() OVER (PARTITION BY f.t, status ORDER BY pos) AS k, count(*) OVER (PARTITION BY f.t, status) AS n FROM f JOIN u USING (t, url)),
a AS (SELECT t, count(*) FILTER (status = 'verified') AS v, count(*) FILTER (status = 'conflicted') AS c, count(*) FILTER (status = 'outdated') AS o, count(*) AS n,
  string_agg(claim, '；' ORDER BY pos) FILTER (status = 'verified' AND k <= 3) AS told,
  string_agg('- ' || claim || '（来源 ' || ref || '）', chr(10) ORDER BY pos) FILTER (status = 'verified' AND k <= 10) AS core,
  string_agg('- ' || claim || '：{D.NO_REASON} 来源 ' || ref, chr(10) ORDER BY pos) FILTER (status = 'conflicted' AND k <= 4) AS clash,
  string_agg('- ' || claim || '：{D.OLD}', chr(10) ORDER BY pos) FILTER (status = 'outdated' AND k <= 3) AS old FROM g GROUP BY t),
s AS (SELECT t, string_agg('- [' || ref || '] T：' || url, chr(10) ORDER BY ref) AS items FROM u GROUP BY t)
SELECT t AS task_id, '# C' || t || ' 公开信息研究报告' || chr(10) || chr(10) || '**研究问题**：营收' || chr(10) || chr(10) || '{D.DISCLAIMER}' || chr(10) || chr(10) || '## 总结' || chr(10)
  || coalesce('C' || t || '：' || told || '。', '本次采集的公开资料中，暂未找到可直接回答「营收」的C' || t || '数据。') || chr(10) || chr(10) || '## 核心发现' || chr(10) || coalesce(core, '{D.NO_CORE}')
  || CASE WHEN v > 10 THEN chr(10) || '{D.notice("核心发现", 10)}' ELSE '' END || chr(10) || chr(10) || '## 风险观察' || chr(10) || CASE WHEN c = 0 THEN '{D.NO_RISK}' WHEN v = 0 THEN '{D.CLASH_ALONE}' ELSE '{D.CLASH}' END
  || chr(10) || chr(10) || '## 公开资料来源' || chr(10) || items || CASE WHEN n > 30 THEN chr(10) || '{D.notice("来源", 30)}' ELSE '' END || chr(10) || chr(10) || '## 附录' || chr(10)
  || '- 数据核对：已采信 ' || v || ' 条，口径差异 ' || c || ' 条，证据不足 0 条' || CASE WHEN o > 0 THEN '，已排除 ' || o || ' 条' ELSE '' END || '。' || coalesce(chr(10) || clash, '') || CASE WHEN c > 4 THEN chr(10) || '{D.notice("冲突条目", 4)}' ELSE '' END
  || coalesce(chr(10) || old, '') || chr(10) || chr(10) || '## 免责声明' || chr(10) || '{D.LAST}' AS content
FROM a JOIN s USING (t)
""",
)
def report_rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each customer: orders are its facts, and what they cite."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    status = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "conflicted").otherwise("outdated")
    source, none = F.concat(F.lit("s"), key.cast("string")), F.lit(None).cast("string")
    facts = o.select(
        F.col("o_custkey").alias("task_id"), key.alias("fact_id"), source.alias("source_id"), F.lit("c").alias("chunk_id"), F.concat(F.lit("o"), key.cast("string")).alias("claim"), F.lit("revenue").alias("metric_name"),
        status.alias("status"), none.alias("reason"), F.when(status == "verified", "core").alias("part"), key.alias("pos"),
    )
    cited = o.select(F.col("o_custkey").alias("task_id"), key.alias("pos"), source.alias("source_id"), F.lit("c").alias("chunk_id"), F.lit("T").alias("title"), F.concat(F.lit("u"), (key % 3).cast("string")).alias("url"))
    tasks = facts.select("task_id").distinct().select("task_id", F.concat(F.lit("C"), F.col("task_id").cast("string")).alias("company"), F.lit("营收").alias("question"), none.alias("summary"), none.alias("risk_analysis"))
    return D.rendered(tasks, facts, cited, spark.createDataFrame([], "task_id long, pos int, metric string, period string, claims array<string>")).select("task_id", "content")
