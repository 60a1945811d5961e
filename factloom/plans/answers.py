"""Queries on answer selection, citations and grounding; a question's company is a market segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import selection as A
from factloom.plans import facts as P
from factloom.plans.registry import query, table

YEARS = (2021, 2020, 2016)
#: Yearly facts of each segment in two readings, one of them with a model's confidence.
ROWS = f"""
{P.SEGMENT},
rows AS (SELECT company, 'revenue' AS family, CAST(y AS VARCHAR) AS period, CAST(n + i AS VARCHAR) || '亿元' AS value, CASE WHEN i = 1 AND y % 2 = 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence, y * 10 + i AS pos,
           1e9 + (n + i) * 100000000.0 + CASE WHEN i = 1 AND y % 2 = 0 THEN 1.0 ELSE 0.8 END AS quality FROM seg, (SELECT unnest([0, 1]) AS i) WHERE y <> 2019)
"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P._segments(spark, sf_dir).where("y <> 2019").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("i"))
    r = s.select("company", F.lit("revenue").alias("family"), F.col("y").cast("string").alias("period"), F.concat((F.col("n") + F.col("i")).cast("string"), F.lit("亿元")).alias("value"), F.when((F.col("i") == 1) & (F.col("y") % 2 == 0), 1.0).otherwise(0.8).alias("confidence"), (F.col("y") * 10 + F.col("i")).alias("pos"))
    return r.withColumn("quality", A.quality(F.col("period"), F.col("value"), F.col("confidence")))


LIST = ", ".join(map(str, YEARS))


#: Orders' yearly facts by customer: the years differ from customer to customer, and every seventh fact has no year.
CUSTOMER_FACTS = "cf AS (SELECT o_custkey AS company, CASE WHEN o_orderkey % 7 = 0 THEN '最近' ELSE CAST(year(o_orderdate) + 20 AS VARCHAR) || '年' END AS period, o_orderkey AS pos FROM orders)"
TIME_FILTER = f"""
WITH {CUSTOMER_FACTS}, m AS (SELECT *, period = '最近' OR left(period, 4) IN ('2015', '2016') AS inside FROM cf),
o AS (SELECT *, bool_or(inside) OVER (PARTITION BY company) AS has_any, row_number() OVER (PARTITION BY company, inside ORDER BY pos) AS k FROM m)
SELECT company, period, pos FROM o WHERE NOT has_any OR inside"""


def customer_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    period = F.when(F.col("o_orderkey") % 7 == 0, "最近").otherwise(F.concat((F.year("o_orderdate") + 20).cast("string"), F.lit("年")))
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("company"), period.alias("period"), F.col("o_orderkey").alias("pos"))


@query("time_filter", TIME_FILTER + " OR k = 1")
def time_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft scope: the years asked for and the first other fact, or everything where a company has none of those years."""
    return A.time_filter(customer_facts(spark, sf_dir), "company", (2015, 2016), strict=False)


@query("time_filter_strict", TIME_FILTER)
def time_filter_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.time_filter(customer_facts(spark, sf_dir), "company", (2015, 2016), strict=True)


@query("answer_dedupe", f"WITH {ROWS} SELECT company, family, period, value, pos FROM rows QUALIFY row_number() OVER (PARTITION BY company, family, period ORDER BY confidence < 1, quality DESC, pos) = 1")
def answer_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.one_per_period(rows(spark, sf_dir), ["company", "family", "period"]).select("company", "family", "period", "value", "pos")


@query(
    "answer_rank",
    f"""
WITH {ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY CASE WHEN CAST(period AS INTEGER) IN ({LIST}) THEN 0 ELSE 1 END, period DESC, CASE WHEN confidence >= 1 THEN 0 ELSE 1 END, quality DESC, pos) AS rank FROM rows)
SELECT company, period, value, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8
""",
)
def answer_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rank_answers(rows(spark, sf_dir), "company", YEARS).select("company", "period", "value", "rank")


@query(
    "missing_years",
    f"""
WITH {ROWS}, w AS (SELECT DISTINCT company, y FROM rows, (SELECT unnest([2015, 2019, 2020, 2023]) AS y)),
m AS (SELECT w.company, w.y, count(r.pos) AS n FROM w LEFT JOIN rows r ON r.company = w.company AND CAST(r.period AS INTEGER) = w.y GROUP BY ALL)
SELECT company, coalesce(string_agg(CAST(y AS VARCHAR), ',' ORDER BY y) FILTER (n = 0), '') AS missing FROM m GROUP BY company
""",
)
def missing_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = A.missing_years(rows(spark, sf_dir), "company", (2015, 2019, 2020, 2023))
    return m.select("company", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


@query(
    "family_detect",
    """
SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'profit,revenue' WHEN 1 THEN 'revenue_structure' WHEN 2 THEN 'capacity,risk' ELSE '' END AS families FROM benchmark
""",
)
def family_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id") % 4
    q = F.when(i == 0, "公司的净利润和 Revenue 如何？").when(i == 1, "公司的收入结构？").when(i == 2, "产能与不确定因素？").otherwise("?")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(A.families(q), ",").alias("families"))


@query("status_bucket", f"WITH {P.BASE}, {P.KEYED} SELECT status, count(*) AS n FROM (SELECT f.fact_id, coalesce(v.status, 'insufficient') AS status FROM facts f LEFT JOIN (SELECT * FROM verdicts WHERE n % 2 = 0) v USING (fact_id)) GROUP BY ALL")
def status_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = P.verdicts(spark, sf_dir)
    return A.status_buckets(P.facts(spark, sf_dir), v.where("n % 2 = 0")).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


CITED = """
one AS (SELECT doc_id % 50 AS task_id, source AS source_id, doc_id % 7 AS chunk_id, min(doc_id) AS pos FROM documents GROUP BY ALL),
two AS (SELECT doc_id % 50 AS task_id, source AS source_id, doc_id % 5 AS chunk_id, min(doc_id) AS pos FROM documents WHERE doc_id % 3 = 0 GROUP BY ALL)
"""


def _cited(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    docs = table(spark, sf_dir, "documents")
    task = (F.col("doc_id") % 50).alias("task_id")
    return [
        docs.groupBy(task, F.col("source").alias("source_id"), (F.col("doc_id") % 7).alias("chunk_id")).agg(F.min("doc_id").alias("pos")),
        docs.where("doc_id % 3 = 0").groupBy(task, F.col("source").alias("source_id"), (F.col("doc_id") % 5).alias("chunk_id")).agg(F.min("doc_id").alias("pos")),
    ]


@query(
    "citation_merge",
    f"""
WITH {CITED}, u AS (SELECT 0 AS l, * FROM one UNION ALL SELECT 1, * FROM two),
g AS (SELECT task_id, source_id, chunk_id, min((l, pos)) AS place FROM u GROUP BY ALL)
SELECT task_id, source_id, chunk_id, CAST(row_number() OVER (PARTITION BY task_id ORDER BY place, source_id, chunk_id) AS INTEGER) AS pos FROM g
""",
)
def citation_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.merge_citations(_cited(spark, sf_dir), "task_id")


@query(
    "citation_number",
    f"""
WITH {CITED}, u AS (SELECT *, CASE WHEN chunk_id % 2 = 0 THEN 'http://a/' || chunk_id ELSE '' END AS url FROM one),
k AS (SELECT *, coalesce(nullif(url, ''), source_id) AS key FROM u), f AS (SELECT task_id, key, min(pos) AS first_pos FROM k GROUP BY ALL),
n AS (SELECT task_id, key, row_number() OVER (PARTITION BY task_id ORDER BY first_pos) AS number FROM f)
SELECT task_id, source_id, chunk_id, CAST(number AS INTEGER) AS number FROM k JOIN n USING (task_id, key)
""",
)
def citation_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = _cited(spark, sf_dir)[0].withColumn("url", F.when(F.col("chunk_id") % 2 == 0, F.concat(F.lit("http://a/"), F.col("chunk_id").cast("string"))).otherwise(""))
    return A.number_citations(cited, "task_id").select("task_id", "source_id", "chunk_id", "number")


EVIDENCE = r"""
e AS (SELECT lang, source AS source_id, doc_id AS chunk_id, 'Report ' || source AS source_title, CASE WHEN doc_id % 9 = 0 THEN 'official_pdf' WHEN doc_id % 5 = 0 THEN 'official_entry_page' ELSE 'blog' END AS layer, (doc_id % 8) / 10.0 AS credibility, n_chars AS score, doc_id AS pos, '目标价 ' || text AS text FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY CASE layer WHEN 'official_pdf' THEN 4 WHEN 'official_entry_page' THEN 3 ELSE 2 END DESC, credibility DESC, score DESC, pos) AS rank FROM e),
x AS (SELECT *, replace(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), chr(10), ' ') AS line FROM r WHERE rank <= 3),
c AS (SELECT *, replace(CASE WHEN length(line) > 300 THEN substr(line, 1, 300) || '...' ELSE line END, '目标价', '【已移除】') AS excerpt FROM x)
"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    layer = F.when(i % 9 == 0, "official_pdf").when(i % 5 == 0, "official_entry_page").otherwise("blog")
    title, text = F.concat(F.lit("Report "), F.col("source")), F.concat(F.lit("目标价 "), F.col("text"))
    return table(spark, sf_dir, "documents").select("lang", F.col("source").alias("source_id"), i.alias("chunk_id"), title.alias("source_title"), F.lit(None).cast("string").alias("url"), layer.alias("layer"), (i % 8 / 10.0).alias("credibility"), F.col("n_chars").alias("score"), i.alias("pos"), text.alias("text"))


@query("grounded_excerpt", f"WITH {EVIDENCE} SELECT lang, CAST(rank AS INTEGER) AS rank, source_id, excerpt FROM c")
def grounded_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.grounded(_evidence(spark, sf_dir), "lang").select("lang", "rank", "source_id", "excerpt")


@query(
    "grounded_section",
    f"""
WITH {EVIDENCE}, q AS (SELECT DISTINCT lang, lang || ' 研发?' AS query FROM documents UNION ALL SELECT 'xx', '产能')
SELECT q.lang, '证据摘录' AS title,
  CASE WHEN count(c.rank) = 0 THEN '围绕问题“' || query || '”，当前检索结果证据不足，还不够支撑细化结论。建议补充公开披露正文、公告或年报后再检索。'
       ELSE '与问题「' || query || '」相关的公开资料摘录如下（供回查，不构成结论）：' || chr(10) || chr(10) || string_agg(rank || '. 《' || source_title || '》：' || excerpt, chr(10) ORDER BY rank) || chr(10) || chr(10) || '以上摘自原始披露片段，是否采纳须结合上文核对结果判断。' END AS content,
  coalesce(string_agg(source_id || ':' || chunk_id, ',' ORDER BY rank), '') AS cited
FROM q LEFT JOIN c ON q.lang = c.lang GROUP BY q.lang, query
""",
)
def grounded_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    evidence = _evidence(spark, sf_dir)
    asked = evidence.select("lang", F.concat("lang", F.lit(" 研发? ")).alias("query")).distinct().unionByName(spark.createDataFrame([("xx", "产能")], "lang string, query string"))
    found = A.grounded_sections(asked, evidence, "lang")
    return found.select("lang", "title", "content", F.array_join(F.transform("citations", lambda c: F.concat(c["source_id"], F.lit(":"), c["chunk_id"].cast("string"))), ",").alias("cited"))


@query(
    "risk_text_cleanup",
    r"""
WITH l AS (SELECT doc_id, unnest(string_split('## ' || text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
a AS (SELECT doc_id, pos, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^\s+', ''), '\s+$', ''), '^#{1,4}\s+', ''), '^[-*•]\s*', ''), '^\d+[.、．]\s*', '') AS c FROM l),
b AS (SELECT doc_id, pos, regexp_replace(regexp_replace(regexp_replace(c, '\*{1,2}([^*]+)\*{1,2}', '\1', 'g'), '^[ \-*\t]+', ''), '[ \-*\t]+$', '') AS line FROM a),
t AS (SELECT doc_id, pos, CASE WHEN length(line) <= 220 THEN line ELSE regexp_replace(substr(line, 1, 219), '\s+$', '') || '…' END AS line FROM b WHERE length(line) >= 12),
f AS (SELECT doc_id, substr(line, 1, 48) AS s, min(pos) AS pos, arg_min(line, pos) AS line FROM t GROUP BY ALL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS INTEGER) AS rank, line FROM f QUALIFY rank <= 5
""",
)
def risk_text_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("## "), F.col("text")).alias("text"))
    return A.risk_lines(docs, "doc_id", "text")


@query(
    "compare_two_entities",
    f"WITH {P.SEGMENT} SELECT y, sum(n) FILTER (company = 'BUILDING') AS building, sum(n) FILTER (company = 'MACHINERY') AS machinery FROM seg GROUP BY y HAVING count(*) FILTER (company IN ('BUILDING', 'MACHINERY')) > 0".replace("sum(n)", "CAST(sum(n)").replace("'BUILDING') AS building", "'BUILDING') AS BIGINT) AS building").replace("'MACHINERY') AS machinery", "'MACHINERY') AS BIGINT) AS machinery"),
)
def compare_two_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two entities side by side from one job: the names are given, so the pivot needs no extra pass."""
    s = P._segments(spark, sf_dir).where(F.col("company").isin("BUILDING", "MACHINERY"))
    return s.groupBy("y").pivot("company", ["BUILDING", "MACHINERY"]).agg(F.sum("n")).withColumnsRenamed({"BUILDING": "building", "MACHINERY": "machinery"})
