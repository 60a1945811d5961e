"""Queries on pages and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import values as V
from factloom.plans.registry import query, table
from factloom.sources import scans

#: Page URLs with some hosts exchanged for listed ones, the same in both dialects.
URLS = """
SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'https://www.cninfo.com.cn/pdf/' || page_id WHEN 1 THEN 'https://zhihu.com/q/' || page_id WHEN 2 THEN 'https://m.qcc.com/firm/' || page_id ELSE url END AS url,
       CASE page_id % 5 WHEN 0 THEN '2024年年度报告' WHEN 1 THEN '2024年半年度报告摘要' WHEN 2 THEN 'Investor news' WHEN 3 THEN '第三季度公告' ELSE 'Careers: hiring' END AS title,
       CASE WHEN page_id % 2 = 0 THEN 'web' END AS raw_type
FROM pages
"""


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, i = table(spark, sf_dir, "pages").select("page_id", "url"), F.col("page_id").cast("string")
    m, t = F.col("page_id") % 6, F.col("page_id") % 5
    url = F.when(m == 0, F.concat(F.lit("https://www.cninfo.com.cn/pdf/"), i)).when(m == 1, F.concat(F.lit("https://zhihu.com/q/"), i)).when(m == 2, F.concat(F.lit("https://m.qcc.com/firm/"), i)).otherwise(F.col("url"))
    title = F.when(t == 0, "2024年年度报告").when(t == 1, "2024年半年度报告摘要").when(t == 2, "Investor news").when(t == 3, "第三季度公告").otherwise("Careers: hiring")
    return p.select("page_id", url.alias("url"), title.alias("title"), F.when(F.col("page_id") % 2 == 0, "web").alias("raw_type"))


def _in(names: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in names) + ")"


HOSTS = f"u AS ({URLS}), h AS (SELECT *, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM u)"


@query("html_readable_text")
def html_readable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scans.readable_html(F.col("html")).alias("readable"))


@query(
    "url_host_credibility",
    f"""
WITH {HOSTS}
SELECT page_id, host, CASE WHEN {_in(V.AUTHORITATIVE)} THEN 0.96 WHEN {_in(V.LOW_DOMAINS)} THEN 0.46 WHEN {_in(V.REGISTRY_DOMAINS)} THEN 0.72
  WHEN regexp_matches(lower(title || ' ' || host), '官网|official|investor|ir\\.|investor-relations') THEN 0.84
  WHEN regexp_matches(lower(title || ' ' || host), '年报|年度报告|交易所|监管披露|公告') THEN 0.78 ELSE 0.68 END::DOUBLE AS credibility,
  CASE WHEN {_in(V.AUTHORITATIVE)} THEN 'high' WHEN {_in(V.LOW_DOMAINS)} THEN 'low' ELSE 'medium' END AS authority
FROM h
""",
)
def url_host_credibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = urls(spark, sf_dir).select("page_id", V.host_of(F.col("url")).alias("host"), V.credibility(F.col("title"), F.col("url")).alias("credibility"))
    return u.withColumn("authority", F.when(F.col("credibility") == 0.84, "medium").otherwise(V.authority(F.col("credibility"))))


@query(
    "source_layer",
    f"WITH {HOSTS} SELECT page_id, CASE WHEN {_in(V.AUTHORITATIVE)} AND contains(lower(title || ' ' || url), 'pdf') THEN 'official_pdf' WHEN {_in(V.AUTHORITATIVE)} THEN 'official_disclosure_page' ELSE 'third_party_background' END AS layer FROM h",
)
def source_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls(spark, sf_dir).select("page_id", V.source_layer(F.col("title"), F.col("url")).alias("layer"))


@query(
    "source_type",
    f"""
WITH {HOSTS}, t AS (SELECT *, lower(title || ' ' || url || ' ' || coalesce(raw_type, '')) AS text FROM h)
SELECT page_id, CASE WHEN regexp_matches(text, 'annual|年报|年度报告') THEN 'annual_report' WHEN regexp_matches(text, '公告|announcement|disclosure') THEN 'announcement'
  WHEN regexp_matches(text, 'gov|政府|监管') THEN 'government' WHEN regexp_matches(text, '招聘|hiring|job|career') THEN 'hiring' WHEN {_in(V.REGISTRY_DOMAINS)} THEN 'other'
  WHEN regexp_matches(text, 'news|新闻') OR coalesce(raw_type = 'web', false) THEN 'news' ELSE 'other' END AS source_type FROM t
""",
)
def source_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls(spark, sf_dir).select("page_id", V.source_type(F.col("title"), F.col("url"), F.col("raw_type")).alias("source_type"))


@query(
    "disclosure_kind",
    f"""
WITH u AS ({URLS})
SELECT page_id, CASE WHEN regexp_matches(lower(title), '年度报告|年报|annual') THEN 'annual' WHEN regexp_matches(lower(title), '半年度|半年报|semi') THEN 'semi_annual'
  WHEN regexp_matches(lower(title), '季度|一季报|三季报|临时') THEN 'interim' WHEN coalesce(raw_type, 'other') IN ('news', 'other') THEN 'media' ELSE 'interim' END AS kind FROM u
""",
)
def disclosure_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls(spark, sf_dir).select("page_id", V.disclosure_kind(F.col("title"), F.coalesce("raw_type", F.lit("other"))).alias("kind"))


@query(
    "source_priority_dedupe",
    f"""
WITH u AS ({URLS}),
p AS (SELECT 0 AS provider, page_id AS pos, url, title FROM u WHERE page_id % 3 <> 0 UNION ALL SELECT 1, page_id, upper(url) || ' ', title FROM u WHERE page_id % 2 = 0 UNION ALL SELECT 2, page_id, '', title FROM u WHERE page_id % 7 = 0),
k AS (SELECT *, CASE WHEN lower(trim(url)) <> '' THEN lower(trim(url)) ELSE title || ':0' END AS key FROM p)
SELECT key, CAST(provider AS INTEGER) AS provider, pos FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY provider, pos) = 1
""",
)
def source_priority_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = urls(spark, sf_dir).select(F.col("page_id").alias("pos"), "url", "title", F.lit(None).cast("string").alias("content"), F.lit("official_pdf").alias("layer"), F.lit(0.7).alias("credibility"))
    shouted = u.where("pos % 2 = 0").withColumn("url", F.concat(F.upper("url"), F.lit(" ")))
    return scans.union_providers([u.where("pos % 3 <> 0"), shouted, u.where("pos % 7 = 0").withColumn("url", F.lit(""))]).select("key", "provider", "pos")


@query(
    "announcement_rank",
    f"""
WITH u AS ({URLS})
SELECT page_id, CAST(row_number() OVER (ORDER BY contains(title, '半年度'), page_id DESC, url) AS INTEGER) AS rank FROM u
WHERE regexp_matches(title, '年度报告|半年度报告') AND NOT regexp_matches(title, '摘要|英文|取消|更正')
QUALIFY row_number() OVER (PARTITION BY url ORDER BY page_id) = 1
""",
)
def announcement_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles filtered, one row per URL, in reading order: a report over one catalog, so the order is global."""
    return scans.ranked_announcements(urls(spark, sf_dir).withColumn("published", F.col("page_id"))).select("page_id", "rank")


@query("keyword_focus")
def keyword_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", scans.focus_windows(F.col("text"), ("License", "the"), most=4000, head=500, before=300, after=700).alias("focused"))


@query(
    "front_matter_parse",
    r"""
SELECT page_id, 'Page: ' || page_id AS title, url, CASE page_id % 3 WHEN 0 THEN 'news' WHEN 1 THEN 'announcement' ELSE 'other' END AS source_type,
       CASE page_id % 4 WHEN 0 THEN 0.8 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 0.5 END::DOUBLE AS credibility_score, substr(html, 1, 15) AS raw_content
FROM pages
""",
)
def front_matter_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages rendered as documents with front matter, then parsed and coerced."""
    i = F.col("page_id")
    kind = F.when(i % 3 == 0, "news").when(i % 3 == 1, "Announcement").otherwise("blog")
    score = F.when(i % 4 == 0, "nan").when(i % 4 == 1, "7.5").when(i % 4 == 2, "-2").otherwise("0.5")
    raw = F.concat(F.lit('---\ntitle: "Page: '), i.cast("string"), F.lit('"\nsource_type: '), kind, F.lit("\nurl: "), F.col("url"), F.lit("\ncredibility_score: "), score, F.lit("\n---\n"), F.substring("html", 1, 15))
    files = table(spark, sf_dir, "pages").select(i.alias("path"), raw.alias("raw"))
    return scans.parsed_documents(files).select(F.col("path").alias("page_id"), "title", "url", "source_type", "credibility_score", "raw_content")
