"""Queries on versioned tables, caches, keyed streams, ranked extraction and relevance."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import ranked as X
from factloom.operators import relevance as V
from factloom.plans import facts as P
from factloom.plans.registry import query, table
from factloom.sources.cache import ResultCache
from factloom.sources.commits import VersionedTable, claim
from factloom.sources.staging import shared_folder, staged
from factloom.streaming import keyed


def _new(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/factloom/{tag}-{uuid.uuid4().hex}"


@query(
    "versioned_vectors",
    """
SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN label + 100 ELSE label END AS label, len(embedding) AS dimension FROM embeddings WHERE vec_id % 11 <> 5
UNION ALL SELECT vec_id + 10000000, label, len(embedding) FROM embeddings WHERE vec_id % 50 = 0
""",
)
def versioned_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after a first write, a batch of changed and new vectors, and a delete: three commits, read at the last."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    store = VersionedTable(spark, _new(spark, "store"), "vec_id long, label int, embedding array<float>", "vec_id", "embedding")
    store.upsert(rows)
    fresh = rows.where("vec_id % 50 = 0").withColumn("vec_id", F.col("vec_id") + 10_000_000)
    store.upsert(rows.where("vec_id % 7 = 0").withColumn("label", F.col("label") + 100).unionByName(fresh))
    store.delete(rows.where("vec_id % 11 = 5"))
    return store.read().select("vec_id", "label", F.size("embedding").cast("long").alias("dimension"))


@query(
    "task_claims",
    """
WITH t AS (SELECT CAST(o_orderkey AS VARCHAR) AS task_id, CASE o_orderstatus WHEN 'O' THEN 'created' WHEN 'F' THEN 'failed' ELSE 'done' END AS status, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS k FROM orders)
SELECT task_id, CASE WHEN k = 1 AND status <> 'done' THEN 'running' ELSE status END AS status FROM t
""",
)
def task_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first task of each status is claimed twice: created and failed ones run, finished ones don't."""
    status = F.when(F.col("o_orderstatus") == "O", "created").when(F.col("o_orderstatus") == "F", "failed").otherwise("done")
    rows = table(spark, sf_dir, "orders")
    tasks = VersionedTable(spark, _new(spark, "tasks"), "task_id string, status string", "task_id")
    tasks.upsert(rows.select(F.col("o_orderkey").cast("string").alias("task_id"), status.alias("status")))
    for r in rows.groupBy("o_orderstatus").agg(F.min("o_orderkey").alias("first")).collect():  # three rows
        claim(tasks, str(r["first"]))
        claim(tasks, str(r["first"]))
    return tasks.read()


@query(
    "cached_results",
    """
WITH puts AS (SELECT CAST(c_custkey // 2 AS VARCHAR) AS k, 10.0 * (c_custkey % 3) AS t, max(c_name) AS value FROM customer GROUP BY ALL),
last AS (SELECT k, max(t) AS t, arg_max(value, t) AS value FROM puts GROUP BY k),
used AS (SELECT *, sum(length(value)) OVER (ORDER BY t DESC, k) AS used FROM last WHERE t > 20.0 - 15)
SELECT k AS key, value FROM used WHERE used <= 12000
""",
)
def cached_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers put at three times, read at the last: replaced, expired and evicted ones are gone."""
    rows = table(spark, sf_dir, "customer").select(F.floor(F.col("c_custkey") / 2).cast("string").alias("key"), F.col("c_name").alias("value"), (F.col("c_custkey") % 3).alias("turn"))
    cache = ResultCache(spark, _new(spark, "cache"), 15, 12_000)
    for i in range(3):
        cache.put(rows.where(F.col("turn") == i).select("key", "value"), 10.0 * i)
    return cache.get(rows.select("key"), 20.0)


def _streamed(spark: SparkSession, path: str, name: str, make, schema: str) -> DataFrame:
    """Rows that a keyed stream over a table's files gave, until it had read all of them."""
    before = {name: spark.conf.get(name, None) for name in keyed.STORE}
    keyed.use_state_store(spark)
    at, out, first = _new(spark, "state"), _new(spark, "out"), spark.read.parquet(path)
    stream = spark.readStream.schema(first.schema).option("pathGlobFilter", "*.parquet").parquet(path if _is_folder(spark, path) else path.replace(f"{name}.parquet", f"{name}*.parquet"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("append").parquet(out)

    try:
        make(stream).writeStream.outputMode("update").option("checkpointLocation", at).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)
    return spark.read.schema(schema).parquet(out)


def _is_folder(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


@query("stream_event_numbers", "SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id FROM events")
def stream_event_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered in their task by a keyed stream."""
    make = lambda s: keyed.number_events(s.select(F.col("user_id").alias("task_id"), "ts", "event_id", F.lit("step").alias("event_type")))
    return _streamed(spark, f"{sf_dir}/events.parquet", "events", make, keyed.EVENT).select("task_id", "seq", "event_id")


@query(
    "stream_memory_fold",
    """
WITH ops AS (
  SELECT conv_id % 20 AS user_id, role AS memory_type, CASE turn % 4 WHEN 0 THEN 'ADD' WHEN 1 THEN 'UPDATE' WHEN 2 THEN CASE WHEN conv_id % 3 = 0 THEN 'DELETE' ELSE 'UPDATE' END ELSE 'NOOP' END AS op,
         CASE WHEN (conv_id + turn) % 3 = 0 THEN '' ELSE 'v' || (conv_id * 10 + turn) END AS value, conv_id * 100 + turn AS pos FROM conversations),
d AS (SELECT user_id, memory_type, max(pos) FILTER (op = 'DELETE') AS died FROM ops GROUP BY ALL),
a AS (SELECT o.* FROM ops o JOIN d USING (user_id, memory_type) WHERE op IN ('ADD', 'UPDATE') AND (died IS NULL OR pos > died))
SELECT user_id, memory_type, coalesce(arg_max(value, pos) FILTER (op = 'ADD' OR value <> ''), '') AS value, max(pos) AS pos FROM a GROUP BY ALL
""",
)
def stream_memory_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory operations folded by a keyed stream, in the order of their positions."""
    c, t = F.col("conv_id"), F.col("turn")
    op = F.when(t % 4 == 0, "ADD").when(t % 4 == 1, "UPDATE").when(t % 4 == 2, F.when(c % 3 == 0, "DELETE").otherwise("UPDATE")).otherwise("NOOP")
    value = F.when((c + t) % 3 == 0, "").otherwise(F.concat(F.lit("v"), (c * 10 + t).cast("string")))
    make = lambda s: keyed.fold_memories(s.select((c % 20).alias("user_id"), F.col("role").alias("memory_type"), F.lit("k").alias("key"), op.alias("op"), value.alias("value"), F.lit(0.5).alias("confidence"), (c * 100 + t).alias("pos")))
    changes = _streamed(spark, f"{sf_dir}/conversations.parquet", "conversations", make, keyed.MEMORY)
    return keyed.current_memories(changes).select("user_id", "memory_type", "value", "pos")


QUESTIONS = (("src-1", "近3年收入和净利润"), ("src-2", "收入结构"), ("src-3", "公司怎么样"), ("src-4", "净利润"), ("src-5", "收入"))


@query(
    "fact_relevance",
    f"""
WITH {P.BASE}, q(source_id, rev, seg, profit, win) AS (VALUES ('src-1', true, false, true, 3), ('src-2', false, true, false, NULL), ('src-3', false, false, false, NULL), ('src-4', false, false, true, NULL), ('src-5', true, false, false, NULL)),
f AS (SELECT facts.*, q.*, CAST(period AS INTEGER) AS y, row_number() OVER (ORDER BY fact_id) AS pos,
        CASE WHEN metric_name = 'revenue' THEN 'revenue' WHEN contains(metric_name, 'profit') THEN 'profit' WHEN starts_with(metric_name, 'revenue_segment') THEN 'revenue_segment' WHEN metric_name IS NULL THEN 'unknown' ELSE metric_name END AS fam,
        1e9 + coalesce(TRY_CAST(nullif(regexp_extract(value, '([0-9]+([.][0-9]+)?)', 1), '') AS DOUBLE), 0) * CASE WHEN contains(value, '亿元') THEN 1e8 WHEN contains(value, '万元') THEN 1e4 ELSE 1 END + confidence AS quality
      FROM facts JOIN q USING (source_id)),
s AS (SELECT *, CASE WHEN NOT (rev OR seg OR profit) THEN 'core' WHEN (rev AND coalesce(metric_name = 'revenue', false)) OR (seg AND fam = 'revenue_segment') OR (profit AND fam = 'profit') THEN 'core' ELSE 'supporting' END AS part FROM f),
best AS (SELECT *, min(pos) OVER (PARTITION BY source_id, fam, y) AS first_pos FROM s WHERE part = 'core' AND (rev OR seg OR profit) QUALIFY row_number() OVER (PARTITION BY source_id, fam, y ORDER BY quality DESC, pos) = 1),
yrs AS (SELECT source_id, list_sort(list(DISTINCT y) FILTER (y < 2022), 'DESC') AS ys FROM best GROUP BY source_id),
core AS (SELECT b.source_id, fact_id, y, CASE WHEN rev AND fam = 'revenue' THEN 0 WHEN profit AND fam = 'profit' THEN 1 WHEN seg AND fam = 'revenue_segment' THEN 3 ELSE 9 END AS place, quality, first_pos AS pos FROM best b JOIN yrs USING (source_id) WHERE win IS NULL OR len(ys[1:3]) < 2 OR list_contains(ys[1:3], y)),
every AS (SELECT source_id, fact_id, 'core' AS part, -y AS a, place AS b, -quality AS c, pos FROM core UNION ALL SELECT source_id, fact_id, 'core', 0, 0, 0, pos FROM s WHERE NOT (rev OR seg OR profit) UNION ALL SELECT source_id, fact_id, 'supporting', 0, 0, 0, pos FROM s WHERE part = 'supporting')
SELECT source_id, fact_id, part, CAST(row_number() OVER (PARTITION BY source_id, part ORDER BY a, b, c, pos) AS INTEGER) AS rank FROM every
""",
)
def fact_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts that answer each source's question, and those beside it."""
    from pyspark.sql import Window

    rows = staged(P.facts(spark, sf_dir), "facts")
    rows = rows.withColumn("pos", F.row_number().over(Window.orderBy("fact_id")))  # a few dozen facts
    return V.relevant_facts(spark.createDataFrame(list(QUESTIONS), "source_id string, question string"), rows, "source_id", 2022)


@query(
    "ranked_extraction",
    """
WITH g AS (SELECT DISTINCT source AS task_id, right(source, 1) IN ('1', '3', '5', '7', '9') AS strict FROM documents WHERE source IS NOT NULL),
c AS (SELECT source AS task_id, doc_id AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY (doc_id % 97) / 97.0 DESC, doc_id) AS round, doc_id % 5 AS kind FROM documents WHERE source IS NOT NULL AND doc_id % 5 <> 0 QUALIFY round <= 10),
f AS (SELECT c.*, strict, kind IN (1, 3) AS has_fact, CASE WHEN strict THEN kind = 3 ELSE kind IN (1, 3) END AS fits FROM c JOIN g USING (task_id)),
e AS (SELECT task_id, coalesce(min(round) FILTER (fits), max(round)) AS attempts, bool_or(fits) AS matched FROM f GROUP BY task_id)
SELECT g.task_id, CAST(coalesce(attempts, 0) AS INTEGER) AS attempts, coalesce(matched, false) AS matched, (SELECT count(*) FROM f WHERE f.task_id = g.task_id AND has_fact AND round <= attempts) AS facts FROM g LEFT JOIN e USING (task_id)
""",
)
def ranked_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of each source tried from the best on until one gives a fact that fits: attempts, success, and facts so far."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    words = F.element_at(F.array(*map(F.lit, ("nothing", "收入", "费用", "利润", "资产"))), (i % 5 + 1).cast("int"))
    # an angle to the question's vector that falls as the share rises, so its cosine rises with it
    share = (i % 97) / F.lit(97.0)
    chunks = docs.select(F.col("source").alias("task_id"), i.alias("chunk_id"), words.alias("text"), F.array(share, F.sqrt(1 - share * share)).alias("vector"), i.alias("pos"))
    odd = F.substring("source", -1, 1).isin("1", "3", "5", "7", "9")
    groups = docs.select("source").distinct().select(F.col("source").alias("task_id"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"), F.array(F.lit("profit")).alias("wanted"), odd.alias("strict"))

    def extract(some: DataFrame) -> DataFrame:
        metric = F.when(F.col("text") == "收入", "revenue").when(F.col("text") == "利润", "net_profit")
        return some.select("task_id", "chunk_id", metric.alias("metric_name"), F.col("text").alias("claim")).where("metric_name IS NOT NULL")

    facts, attempts = X.ranked_extraction(groups, chunks, extract)
    counts = facts.groupBy("task_id").agg(F.count(F.lit(1)).alias("facts"))
    return attempts.join(counts, "task_id", "left").select("task_id", "attempts", "matched", F.coalesce("facts", F.lit(0)).alias("facts"))
