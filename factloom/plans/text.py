"""Queries on chunking, tokens, white space and Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import chunking
from factloom.operators import sections as R
from factloom.plans.registry import query, table

STRIPPED = r"regexp_replace(regexp_replace(coalesce(text, ''), '^\s+', ''), '\s+$', '')"


@query(
    "chunk_fixed_window",
    f"""
WITH d AS (SELECT doc_id, {STRIPPED} AS t FROM documents),
c AS (SELECT doc_id, t, unnest(range(0, CAST(greatest(ceil((length(t) - 400) / 320.0), 0) AS BIGINT) + 1)) AS i FROM d WHERE length(t) > 0)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(i * 320 AS INTEGER) AS char_start, CAST(least(i * 320 + 400, length(t)) AS INTEGER) AS char_end,
       substr(t, CAST(i * 320 + 1 AS BIGINT), 400) AS chunk_text
FROM c
""",
)
def chunk_fixed_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(T.chunk_windows(F.col("text"), 400, 80)).alias("c")).select("doc_id", "c.chunk_index", "c.char_start", "c.char_end", F.col("c.text").alias("chunk_text"))


@query("chunk_recursive")
def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(chunking.recursive(F.col("text"), 800, 100)).alias("c")).select("doc_id", "c.*")


@query("chunk_section_aware")
def chunk_section_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode(chunking.chunk(F.col("text"))).alias("c")).select("doc_id", "c.*")


@query(
    "whitespace_normalize",
    r"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)),
         lambda x: regexp_replace(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '^ ', ''), ' $', '')), lambda x: x <> ''), chr(10)) AS clean_text
FROM documents
""",
)
def whitespace_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_lines(F.coalesce("text", F.lit(""))).alias("clean_text"))


@query(
    "tokenize",
    f"""
SELECT doc_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(list_transform(t, lambda x: lower(x)))) AS INTEGER) AS n_distinct, coalesce(t[1], '') AS first_token
FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{T.TOKEN}') AS t FROM documents)
""",
)
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").select("doc_id", T.tokens(F.col("text")).alias("t"), T.token_set(F.col("text")).alias("s"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size("s").alias("n_distinct"), F.coalesce(F.try_element_at("t", F.lit(1)), F.lit("")).alias("first_token"))


@query(
    "keyword_topn",
    f"""
WITH t AS (SELECT item_id, unnest(tk) AS token, generate_subscripts(tk, 1) AS pos FROM (SELECT item_id, regexp_extract_all(text, '{T.TOKEN}') AS tk FROM benchmark)),
g AS (SELECT item_id, token, count(*) AS hits, min(pos) AS first_pos FROM t WHERE token NOT IN ('the', 'and', 'of', 'to') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, first_pos) AS rank FROM g)
SELECT item_id, token, hits, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 8
""",
)
def keyword_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.operators.search import keywords

    return keywords(table(spark, sf_dir, "benchmark"), "item_id", "text", top=8, stop_words=("the", "and", "of", "to"))


@query(
    "query_decompose",
    r"""
SELECT item_id, length(q) >= 40 OR length(q) - length(replace(replace(q, '?', ''), '？', '')) >= 2 AS is_complex,
       array_to_string(list_filter(list_transform(string_split_regex(q, '[？?；;]'), lambda x: regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '')), lambda x: length(x) >= 6)[1:3], ' / ') AS parts
FROM (SELECT item_id, replace(text, '.', '?') AS q FROM benchmark)
""",
)
def query_decompose(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.operators.search import decompose, is_complex

    q = table(spark, sf_dir, "benchmark").select("item_id", F.replace("text", F.lit("."), F.lit("?")).alias("q"))
    return q.select("item_id", is_complex(F.col("q")).alias("is_complex"), F.array_join(decompose(F.col("q")), " / ").alias("parts"))


@query(
    "table_to_markdown",
    """
WITH r AS (SELECT r_regionkey, r_name, list([CAST(n_nationkey AS VARCHAR), n_name] ORDER BY n_nationkey) AS rows FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL)
SELECT r_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || array_to_string(list_transform(rows, lambda x: '| ' || x[1] || ' | ' || x[2] || ' |'), chr(10)) AS markdown FROM r
""",
)
def table_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = joined.groupBy("r_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("rows"))
    cells = F.transform("rows", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    return rows.select("r_regionkey", T.markdown_table(F.concat(F.array(F.array(F.lit("key"), F.lit("name"))), cells)).alias("markdown"))


@query("embedding_fingerprint", r"SELECT doc_id, 'local-hash-v1-dim128-' || substr(sha256(regexp_replace(regexp_replace(lower(regexp_replace(text, '\s+', ' ', 'g')), '^ ', ''), ' $', '')), 1, 16) AS embedding_id FROM documents")
def embedding_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.concat(F.lit("local-hash-v1-dim128-"), F.substring(F.sha2(T.squeeze(F.lower("text")), 256), 1, 16)).alias("embedding_id"))


#: Documents as reports: some lines become headings, and a first line holds the header fields; some reports have none.
REPORTS = r"""
reports AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN (2000 + doc_id % 30) || ' 年' || CASE doc_id % 2 WHEN 0 THEN '度' ELSE '末' END || '报告 单位：' || CASE doc_id % 4 WHEN 0 THEN '万元' WHEN 1 THEN '亿元' WHEN 2 THEN ' 元' ELSE '股' END || chr(10) || '审计机构: 甲' || doc_id || ' ' || chr(10) ELSE '' END || coalesce(text, '') AS body FROM documents),
raw AS (SELECT doc_id, string_split(body, chr(10)) AS l FROM reports),
lines AS (SELECT doc_id, i AS line_no, CASE WHEN (doc_id + i) % 5 = 4 THEN ' 第二节 ' || left(l[i + 1], 12) ELSE l[i + 1] END AS line FROM (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM raw)),
heads AS (SELECT *, regexp_matches(regexp_replace(regexp_replace(line, '^\s+', ''), '\s+$', ''), '^(第[一二三四五六七八九十]+节|[一二三四五六七八九十]+、)\s*(.+)$') AS head FROM lines),
placed AS (SELECT *, coalesce(last_value(CASE WHEN head THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), -1) AS start FROM heads),
texts AS (SELECT p.doc_id, p.start, string_agg(p.line, chr(10) ORDER BY p.line_no) AS content FROM placed p WHERE NOT head GROUP BY p.doc_id, p.start),
sections AS (SELECT t.doc_id, t.start, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.start) AS section_no, CASE WHEN t.start < 0 THEN '正文' ELSE regexp_replace(regexp_extract(regexp_replace(h.line, '\s+$', ''), '第二节\s*(.+)$', 1), '\s+$', '') END AS title, content
  FROM texts t LEFT JOIN lines h ON h.doc_id = t.doc_id AND h.line_no = t.start)
"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    unit = F.element_at(F.array(*map(F.lit, ("万元", "亿元", " 元", "股"))), (i % 4 + 1).cast("int"))
    head = F.concat((i % 30 + 2000).cast("string"), F.lit(" 年"), F.when(i % 2 == 0, "度").otherwise("末"), F.lit("报告 单位："), unit, F.lit("\n审计机构: 甲"), i.cast("string"), F.lit(" \n"))
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(i % 3 == 0, head).otherwise(""), F.coalesce("text", F.lit(""))).alias("body"))


def _report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _reports(spark, sf_dir).select("doc_id", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    return lines.withColumn("line", F.when((F.col("doc_id") + F.col("line_no")) % 5 == 4, F.concat(F.lit(" 第二节 "), F.substring("line", 1, 12))).otherwise(F.col("line")))


@query(
    "report_header_parse",
    rf"""
WITH {REPORTS} SELECT doc_id, nullif(regexp_extract(body, '(20\d{{2}})\s*年(度|报)', 1), '') AS year,
  CASE WHEN doc_id % 3 = 0 THEN '甲' || doc_id END AS auditor, CASE WHEN doc_id % 3 = 0 THEN CASE doc_id % 4 WHEN 0 THEN '单位：万元' WHEN 1 THEN '单位：亿元' WHEN 2 THEN '单位： 元' END END AS unit_note FROM reports
""",
)
def report_header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year (only before 年度 or 年报), auditor and unit note of each report."""
    return R.report_header(_reports(spark, sf_dir), "doc_id", "body")


@query("report_sections", f"WITH {REPORTS} SELECT doc_id, CAST(section_no AS INTEGER) AS section_no, title, content FROM sections")
def report_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section of every report, from its lines."""
    return R.section_texts(_report_lines(spark, sf_dir), "doc_id")


@query(
    "report_enrichment",
    f"""
WITH {REPORTS}, firsts AS (SELECT doc_id, string_agg(chr(10) || '## ' || title || chr(10) || left(content, 4000), chr(10) ORDER BY section_no) AS s FROM sections WHERE section_no <= 12 GROUP BY doc_id),
parsed AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) AS t FROM lines GROUP BY doc_id),
header AS (SELECT doc_id, nullif(regexp_extract(t, '(20[0-9][0-9])\\s*年(度|报)', 1), '') AS year,
  CASE WHEN contains(t, '单位：万元') THEN '单位：万元' WHEN contains(t, '单位：亿元') THEN '单位：亿元' WHEN contains(t, '单位： 元') THEN '单位： 元' END AS unit FROM parsed)
SELECT h.doc_id, CASE WHEN h.doc_id % 2 = 1 THEN 'raw' ELSE 'raw' || chr(10) || chr(10) || chr(10) || '# 财报结构化解析' || chr(10) || '报告年度：' || coalesce(year, '未知') || coalesce(chr(10) || unit, '') || coalesce(chr(10) || s, '') END AS text
FROM header h LEFT JOIN firsts f ON f.doc_id = h.doc_id
""",
)
def report_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What parsed reports add to their sources; every second source has none."""
    lines = _report_lines(spark, sf_dir)
    whole = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("parsed"))
    return R.enriched_text(whole.select("doc_id", F.lit("raw").alias("raw"), F.when(F.col("doc_id") % 2 == 0, F.col("parsed")).alias("parsed")), "doc_id", "raw", "parsed")
