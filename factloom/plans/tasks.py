"""Queries on tasks, ingest, model answers, follow-up chat and evaluation summaries; a document's source is its task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import chat as H
from factloom.operators import evaluation as E
from factloom.operators import model_output as O
from factloom.operators import report as R
from factloom.operators import selection as A
from factloom.operators import tasks as K
from factloom.plans.dialogue import LEXICON
from factloom.operators.numbering import numbered
from factloom.plans.registry import query, table
from factloom.sources import scans

STEP, SIZE = 320, 400


@query(
    "ingest_chunks",
    f"""
WITH t AS (SELECT doc_id, source, lang, regexp_replace(regexp_replace(coalesce(text, ''), '^\\s+', ''), '\\s+$', '') AS s FROM documents WHERE doc_id % 5 = 0),
c AS (SELECT *, unnest(range(0, CASE WHEN length(s) = 0 THEN 0 ELSE CAST(greatest(ceil((length(s) - {SIZE}) / {STEP}.0), 0) AS BIGINT) + 1 END)) AS i FROM t)
SELECT source AS task_id, doc_id AS source_id, CAST(i AS INTEGER) AS chunk_index, md5(substr(s, CAST(i * {STEP} + 1 AS BIGINT), {SIZE})) AS digest, 'doc ' || doc_id AS source_title, lang AS source_type, 0.75::DOUBLE AS credibility, {SIZE} AS chunk_size FROM c
""",
)
def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document in five stands for a source, so ids are a stated part of the table, as they are in the SQL."""
    i = F.col("doc_id")
    sources = table(spark, sf_dir, "documents").where(i % 5 == 0).select(F.col("source").alias("task_id"), i.alias("source_id"), F.concat(F.lit("doc "), i.cast("string")).alias("title"), F.lit(None).cast("string").alias("url"), F.col("lang").alias("source_type"), F.lit(0.75).alias("credibility"), F.col("text").alias("raw_content"))
    c = K.ingest(sources, "fixed_window", SIZE, SIZE - STEP)
    return c.select("task_id", "source_id", "chunk_index", F.md5("text").alias("digest"), "metadata.source_title", "metadata.source_type", "metadata.credibility", "metadata.chunk_size")


@query(
    "embed_chunks",
    r"""
SELECT doc_id, 'local-hash-v1-dim128-' || substr(sha256(regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^\s+', ''), '\s+$', '')), 1, 16) AS embedding_id, 128 AS dimension, TRUE AS unit FROM documents WHERE regexp_matches(text, '[^\s]')
""",
)
def embed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.operators.search import dot

    docs = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"(?U)\S")).select("doc_id", "text")
    v = K.embedded(docs).select("doc_id", "embedding_id", "embedding")
    return v.select("doc_id", "embedding_id", F.size("embedding").alias("dimension"), (F.abs(dot(F.col("embedding"), F.col("embedding")) - 1) < 1e-3).alias("unit"))


@query("reindex_task", "SELECT vec_id, label FROM embeddings WHERE label <> 4 UNION ALL SELECT vec_id + 1000000, 4 FROM embeddings WHERE label = 4 AND vec_id % 2 = 0")
def reindex_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return K.reindexed(stored, stored.where("label = 4 AND vec_id % 2 = 0").select((F.col("vec_id") + 1_000_000).alias("vec_id"), "label"), "label")


@query(
    "knn_of_json",
    """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v, v AS q WHERE q.vec_id % 20 = 0)
SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 3
""",
)
def knn_of_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.to_json(F.col("embedding").cast("array<double>")).alias("embedding_json"))
    return K.knn_of_json(rows, rows.where("vec_id % 20 = 0"), 3, 64)


@query("approximate_knn")
def approximate_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return K.approximate_knn(rows, rows.where("vec_id % 20 = 0"), 10)


@query("recent_tasks", "SELECT o_orderkey AS task_id, o_orderstatus AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 200")
def recent_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))
    return K.recent_tasks(tasks, 500).select("task_id", "status")


@query("owned_tasks", "SELECT o_orderkey AS task_id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7)")
def owned_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("session_id"))
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("session_id"), F.col("c_nationkey").cast("string").alias("user_id"))
    return K.owned(tasks, sessions, "7").select("task_id")


@query("task_claim", "SELECT o_orderkey AS task_id, CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE o_orderstatus = 'F') THEN 'running' WHEN o_orderstatus = 'F' THEN 'failed' ELSE 'completed' END AS status FROM orders")
def task_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    first = orders.where("o_orderstatus = 'F'").agg(F.min("o_orderkey")).first()[0]
    return K.claimed(orders.select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status")), first).select("task_id", "status")


@query("task_scan", "SELECT doc_id, CAST(row_number() OVER (ORDER BY source, doc_id) AS INTEGER) AS pos FROM documents WHERE lang = 'de'")
def task_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task's chunks in their order; numbering them here is only to compare the order."""
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("task_id"), F.col("source").alias("source_id"), F.col("doc_id").alias("chunk_index"))
    return numbered(rows.where("task_id = 'de'"), [F.asc(c) for c in K.TASK_ORDER["chunks"]], "pos").select(F.col("chunk_index").alias("doc_id"), "pos")


@query("cache_merge", "SELECT n_nationkey AS company, CASE WHEN n_nationkey % 3 = 0 THEN 'live' ELSE 'old' END AS origin FROM nation WHERE n_nationkey % 3 = 0 OR n_nationkey % 2 = 0")
def cache_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("company"))
    return K.merged_cache(n.where("company % 2 = 0").withColumn("origin", F.lit("old")), n.where("company % 3 = 0").withColumn("origin", F.lit("live")), "company")


@query("event_snapshot", "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS seq FROM events")
def event_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.numbered_events(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("event_id", "seq")


@query(
    "model_facts",
    """
SELECT o_orderkey, 's' || (o_orderkey % 3) AS source_id, CASE o_orderkey % 3 WHEN 0 THEN 'net_profit_parent' WHEN 1 THEN 'revenue' ELSE 'margin' END AS metric_name,
       CASE o_orderkey % 2 WHEN 0 THEN '2025' ELSE '2023' END AS period, o_orderkey || '亿元' AS value, 1.0::DOUBLE AS confidence FROM orders WHERE o_orderkey % 5 <> 0
""",
)
def model_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers rendered from orders: fenced JSON, each fact twice, one of a chunk that wasn't sent, and every fifth broken."""
    k = F.col("o_orderkey")
    metric = F.when(k % 3 == 0, "归母净利润").when(k % 3 == 1, "营业总收入").otherwise("margin")
    fact = F.struct(F.lit("x").alias("claim"), metric.alias("metric_name"), F.concat(k.cast("string"), F.lit("亿元")).alias("value"), F.when(k % 2 == 0, "二零二五年").otherwise("2023年度").alias("period"), F.concat(F.lit("s"), (k % 3).cast("string")).alias("source_id"), F.lit("c1").alias("chunk_id"))
    text = F.to_json(F.struct(F.array(fact, fact, F.struct(*[fact[n].alias(n) for n in ("claim", "metric_name", "value", "period", "source_id")], F.lit("c9").alias("chunk_id"))).alias("facts")))
    orders = table(spark, sf_dir, "orders")
    answers = orders.select("o_orderkey", F.when(k % 5 == 0, "{broken").otherwise(F.concat(F.lit("```json\n"), text, F.lit("\n```"))).alias("answer"))
    chunks = orders.select("o_orderkey", F.concat(F.lit("s"), (k % 3).cast("string")).alias("source_id"), F.lit("c1").alias("chunk_id"))
    return O.parsed_facts(answers, chunks, "o_orderkey").select("o_orderkey", "source_id", "metric_name", "period", "value", "confidence")


@query("rewritten_query", f"SELECT item_id, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') || '{O.REWRITE_SUFFIX}' AS q FROM benchmark")
def rewritten_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", O.rewritten_query(F.col("text"), True).alias("q"))


@query(
    "preferred_metrics",
    """
WITH f AS (SELECT o_custkey, o_orderkey AS pos, ['R&D_total_spending', 'R&D_expenditure', 'revenue', 'revenue_segment:a', 'net_profit'][1 + o_orderkey % 5] AS metric_name FROM orders),
h AS (SELECT o_custkey, bool_or(metric_name = 'R&D_total_spending') AS rd, bool_or(metric_name = 'revenue') AS rev FROM f GROUP BY ALL)
SELECT pos, metric_name FROM f JOIN h USING (o_custkey) WHERE NOT (metric_name = 'R&D_expenditure' AND rd) AND NOT (metric_name LIKE 'revenue_segment%' AND rev)
""",
)
def preferred_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    names = F.array(*map(F.lit, ("R&D_total_spending", "R&D_expenditure", "revenue", "revenue_segment:a", "net_profit")))
    f = table(spark, sf_dir, "orders").select("o_custkey", k.alias("pos"), F.element_at(names, (k % 5 + 1).cast("int")).alias("metric_name"))
    return A.preferred_only(f, "o_custkey", F.array(F.lit("rd"), F.lit("revenue"))).select("pos", "metric_name")


@query("conflicted_fallback", "SELECT o_orderkey AS pos, o_orderkey % 7 > 0 AS conflicted FROM orders WHERE o_orderkey % 7 = 0 OR (o_orderkey % 2 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0))")
def conflicted_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    f = table(spark, sf_dir, "orders").select("o_custkey", k.alias("pos"), F.when(k % 2 == 0, "revenue").otherwise("net_profit").alias("metric_name"), F.lit("x").alias("claim"))
    return A.conflicted_fallback(f.where("pos % 7 = 0"), f.where("pos % 7 > 0"), "o_custkey", F.array(F.lit("revenue")), F.lit(True)).select("pos", "conflicted")


@query("verified_rank", "SELECT o_orderkey AS pos, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY [0, 1, 2, 3, 2][1 + o_orderkey % 5], o_orderdate DESC, o_orderkey % 10 DESC, o_orderkey) AS INTEGER) AS rank FROM orders")
def verified_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("annual", "semi_annual", "interim", "media", "odd")))
    f = table(spark, sf_dir, "orders").select("o_custkey", k.alias("pos"), F.element_at(kinds, (k % 5 + 1).cast("int")).alias("disclosure_kind"), F.col("o_orderdate").cast("timestamp").alias("published_at"), (k % 10 / 10.0).alias("confidence"))
    return A.rank_verified(f, "o_custkey").select("pos", "rank")


@query(
    "evidence_strength",
    f"""
WITH s AS (SELECT source, CASE WHEN doc_id % 40 = 0 THEN 'official_pdf' WHEN doc_id % 7 = 0 THEN 'official_entry_page' ELSE 'blog' END AS layer, CASE WHEN doc_id % 23 = 0 THEN 0.9 ELSE 0.4 END AS c FROM documents),
g AS (SELECT source, count(*) FILTER (layer = 'official_pdf') AS official_body, count(*) FILTER (layer = 'official_entry_page') AS entry_page, count(*) FILTER (layer = 'blog') AS background, count(*) FILTER (c < 0.6) AS low, count(*) FILTER (c >= 0.85) AS high FROM s GROUP BY source)
SELECT source, CASE WHEN official_body > 0 THEN '{R.STRENGTHS[0][0]}' WHEN high > 0 THEN '{R.STRENGTHS[1][0]}' ELSE '{R.STRENGTHS[2][0]}' END AS strength, official_body, entry_page, background, low FROM g
""",
)
def evidence_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    s = table(spark, sf_dir, "documents").select("source", F.when(i % 40 == 0, "official_pdf").when(i % 7 == 0, "official_entry_page").otherwise("blog").alias("layer"), F.when(i % 23 == 0, 0.9).otherwise(0.4).alias("credibility"))
    return R.source_summary(s, "source").drop("summary")


@query(
    "followup_chat",
    f"""
WITH low AS (SELECT conv_id, turn, text, lower(coalesce(text, '')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])sell($|[^\\p{{L}}\\p{{N}}_])') OR contains(t, 'que la') THEN 'refused' WHEN turn % 3 = 0 THEN 'fallback' ELSE 'allow' END AS outcome FROM low
""",
)
def followup_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.when(F.col("turn") % 3 == 0, "报告中没有该数据").otherwise("好")
    return H.chat(table(spark, sf_dir, "conversations"), answer, F.lit("见报告"), LEXICON).select("conv_id", "turn", "outcome")


@query(
    "memory_context",
    "SELECT conv_id, string_agg(role || ': ' || text, ' | ' ORDER BY turn) AS hot FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6) GROUP BY conv_id",
)
def memory_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "conversations")
    memories = messages.select(F.col("conv_id").alias("user_id"), F.lit("warm").alias("layer"), F.lit(True).alias("is_active"), F.col("turn").alias("updated_at"), F.col("role").alias("memory_key"), F.col("text").alias("value"))
    return H.memory_context(messages, memories, "conv_id", "turn", "user_id")[0].select("conv_id", F.array_join("hot", " | ").alias("hot"))


@query(
    "paired_summary",
    """
WITH q AS (SELECT event_id % 5 AS relevant_count, value AS a, value / 2 AS b FROM events)
SELECT 'one' AS system, round(avg(a) FILTER (relevant_count > 0), 6) AS recall, count(*) FILTER (relevant_count = 0) AS negatives, 1.0::DOUBLE AS false_positive_rate, round(median(a), 6) AS p50 FROM q
UNION ALL SELECT 'two', round(avg(b) FILTER (relevant_count > 0), 6), count(*) FILTER (relevant_count = 0), 0.0, round(median(b), 6) FROM q
""",
)
def paired_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select((F.col("event_id") % 5).alias("relevant_count"), *[x.alias(f"{s}_{m}") for s, x in (("one", v), ("two", v / 2)) for m in ("recall", "ndcg", "mrr", "ms")], F.lit(3).alias("one_returned"), F.lit(0).alias("two_returned"))
    return E.paired_summary(rows, ("one", "two")).select("system", "recall", "negatives", "false_positive_rate", "p50")


@query(
    "reference_sources",
    r"""
WITH r AS (SELECT page_id, regexp_replace(url, '/[^/]*$', '/') AS url, CASE WHEN page_id % 2 = 0 THEN 'Acme 年报' ELSE '年报' END AS title FROM pages WHERE url IS NOT NULL),
f AS (SELECT url, min(page_id) AS pos, arg_min(title, page_id) AS title FROM r GROUP BY url)
SELECT url, pos, title, title || '内容' || chr(10) || chr(10) || '正文' || pos AS raw_content FROM f WHERE contains(title, 'Acme')
""",
)
def reference_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    title = F.when(i % 2 == 0, "Acme 年报").otherwise("年报")
    refs = table(spark, sf_dir, "pages").where("url IS NOT NULL").select(title.alias("title"), F.regexp_replace("url", "/[^/]*$", "/").alias("url"), F.concat(title, F.lit("内容")).alias("content"), F.concat(F.lit("正文"), i.cast("string")).alias("body"), F.lit("web").alias("type"), i.alias("pos"))
    return scans.sources_of_references(refs, "Acme").select("url", "pos", "title", "raw_content")
