"""Queries on vectors, BM25, fusion and hybrid search."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.text import TOKEN
from factloom.operators import search as S
from factloom.operators.segments import SegmentIndex
from factloom.plans.registry import query, table
from factloom.sources.staging import shared_folder, staged


def _probe(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector with the smallest id: one row."""
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]


COS = "round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6)"


@query("cosine_topk", f"WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, {COS} AS score FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.knn(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 10)


@query("cosine_topk_filtered", f"WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) SELECT vec_id, {COS} AS score FROM embeddings e, q WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.knn(table(spark, sf_dir, "embeddings").where("label = 3"), _probe(spark, sf_dir), 10)


@query(
    "batch_knn",
    f"""
WITH q AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, e.vec_id, {COS} AS score FROM embeddings e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""",
)
def batch_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return S.batch_knn(vectors, vectors.where("vec_id % 20 = 0"), 5)


@query(
    "vector_upsert",
    """
SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN label + 100 ELSE label END AS label FROM embeddings
UNION ALL SELECT vec_id + 10000000, label + 200 FROM embeddings WHERE vec_id % 50 = 0
""",
)
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    fresh = stored.where("vec_id % 50 = 0").select((F.col("vec_id") + 10_000_000).alias("vec_id"), (F.col("label") + 200).alias("label"))
    batch = stored.where("vec_id % 7 = 0").select("vec_id", (F.col("label") + 100).alias("label")).unionByName(fresh)
    return S.upsert(stored, batch, "vec_id")


@query("vector_delete_task", "SELECT vec_id, label FROM embeddings WHERE label <> 4")
def vector_delete_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    return S.delete_ids(stored, stored.where("label = 4"), "vec_id")


@query(
    "dense_retrieve_join",
    f"""
WITH q AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1),
h AS (SELECT vec_id, {COS} AS score FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 50)
SELECT h.vec_id, h.score, d.source, d.lang FROM h JOIN documents d ON d.doc_id = h.vec_id
""",
)
def dense_retrieve_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits inner-joined to their documents; dangling hits drop. The hit side has 50 rows."""
    hits = S.knn(table(spark, sf_dir, "embeddings"), _probe(spark, sf_dir), 50)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source", "lang")
    return docs.join(F.broadcast(hits), "vec_id").select("vec_id", "score", "source", "lang")


@query("hash_embedding")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.hash_embedding(F.col("text")).alias("embedding"))


BM25 = f"""
bag AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS tokens FROM documents),
stats AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM bag),
tf AS (SELECT doc_id, len(tokens) AS dl, term, count(*) AS tf FROM (SELECT doc_id, tokens, unnest(tokens) AS term FROM bag) GROUP BY ALL),
raw AS (SELECT term, ln((n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stats GROUP BY term, n),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
asked AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(text, '{TOKEN}')) AS term FROM benchmark) GROUP BY ALL),
matched AS (SELECT item_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN idf USING (term) JOIN asked USING (term), stats GROUP BY ALL),
filled AS (SELECT i.item_id, d.doc_id, coalesce(m.score, 0.0) AS score FROM (SELECT DISTINCT item_id FROM benchmark) i CROSS JOIN (SELECT doc_id FROM documents) d LEFT JOIN matched m ON m.item_id = i.item_id AND m.doc_id = d.doc_id),
sparse AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM filled QUALIFY rank <= 50)
"""


def _corpus(spark: SparkSession, sf_dir: str) -> SegmentIndex:
    """The index of `documents`, kept in the shared folder under the names, sizes and times of the table's files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    told = sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in files)
    index = SegmentIndex(spark, f"{shared_folder(spark)}/factloom/corpus-{hashlib.sha256(repr(told).encode()).hexdigest()[:32]}")
    return index if index.version else index.add(table(spark, sf_dir, "documents"))


@query("bm25_topk", f"WITH {BM25} SELECT item_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM sparse WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _corpus(spark, sf_dir).search(table(spark, sf_dir, "benchmark"), 10)


FUSE = f"""
lists AS (SELECT vec_id % 40 AS query_id, 1 AS list_no, vec_id AS doc_id, row_number() OVER (PARTITION BY vec_id % 40 ORDER BY vec_id) AS rank FROM embeddings
          UNION ALL SELECT vec_id % 40, 2, vec_id, row_number() OVER (PARTITION BY vec_id % 40 ORDER BY label, vec_id DESC) FROM embeddings WHERE vec_id % 3 > 0)
"""


@query(
    "rrf_fuse",
    f"""
WITH {FUSE},
g AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min((list_no, rank)) AS seen FROM lists GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen, doc_id) AS rank FROM g)
SELECT query_id, doc_id, rrf, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 30
""",
)
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").withColumn("query_id", F.col("vec_id") % 40)
    one = e.select("query_id", F.lit(1).alias("list_no"), F.col("vec_id").alias("doc_id"), F.row_number().over(Window.partitionBy("query_id").orderBy("vec_id")).alias("rank"))
    two = e.where("vec_id % 3 > 0").select("query_id", F.lit(2).alias("list_no"), F.col("vec_id").alias("doc_id"), F.row_number().over(Window.partitionBy("query_id").orderBy("label", F.desc("vec_id"))).alias("rank"))
    return S.fuse(one.unionByName(two), "query_id", "doc_id")


RECALL = """
sets AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '{t}')) AS ds FROM documents),
qsets AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{t}')) AS qs FROM benchmark)
""".replace("{t}", TOKEN)


@query(
    "lexical_rerank",
    f"""
WITH {BM25}, {RECALL},
s AS (SELECT item_id, doc_id, sparse.rank AS old, round(len(list_intersect(qs, ds)) / greatest(len(qs), 1), 6) AS overlap FROM sparse JOIN sets USING (doc_id) JOIN qsets USING (item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, old) AS rank FROM s)
SELECT item_id, doc_id, overlap, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
""",
)
def lexical_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25's top 50 reordered by token recall, stable on the old rank."""
    docs, asked = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = _corpus(spark, sf_dir).search(asked, 50).select("item_id", "doc_id", F.col("rank").alias("old"))
    met = hits.join(docs.select("doc_id", "text"), "doc_id").join(asked.select("item_id", F.col("text").alias("asked")), "item_id")
    s = met.select("item_id", "doc_id", "old", F.round(S.overlap_recall(F.col("asked"), F.col("text")), 6).alias("overlap"))
    r = s.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("overlap"), "old")))
    return r.where("rank <= 5").select("item_id", "doc_id", "overlap", "rank")


EXPANDED = f"""
words AS (SELECT item_id, token, count(*) AS hits, min(pos) AS first_pos FROM (SELECT item_id, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM (SELECT item_id, regexp_extract_all(text, '{TOKEN}') AS t FROM benchmark)) GROUP BY ALL),
keyed AS (SELECT item_id, string_agg(token, ' ' ORDER BY hits DESC, first_pos) AS text FROM (SELECT * FROM words QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY hits DESC, first_pos) <= 8) GROUP BY item_id),
pieces AS (SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[？?；;]'), lambda x: trim(x)), lambda x: length(x) >= 6)[1:3] AS p FROM benchmark
           WHERE length(text) >= 40 OR length(text) - length(regexp_replace(text, '[?？]', '', 'g')) >= 2),
every AS (SELECT item_id, 0 AS part, trim(text) AS text FROM benchmark UNION ALL SELECT item_id, 1, text FROM keyed UNION ALL SELECT item_id, 1 + generate_subscripts(p, 1), unnest(p) FROM pieces),
firsts AS (SELECT item_id, text, min(part) AS part FROM every WHERE text <> '' GROUP BY ALL),
parts AS (SELECT item_id, text, row_number() OVER (PARTITION BY item_id ORDER BY part) - 1 AS part, item_id * 16 + row_number() OVER (PARTITION BY item_id ORDER BY part) - 1 AS part_id FROM firsts)
"""
HYBRID = f"""
WITH {EXPANDED}, {BM25.replace("benchmark", "parts").replace("item_id", "part_id")},
vectors AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
near AS (SELECT p.item_id, p.part, e.vec_id AS doc_id, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM parts p JOIN vectors q ON q.vec_id = p.item_id + 7 * p.part, vectors e WHERE e.vec_id IN (SELECT doc_id FROM documents)),
dense AS (SELECT *, row_number() OVER (PARTITION BY item_id, part ORDER BY score DESC, doc_id) AS rank FROM near QUALIFY rank <= 50),
lists AS (SELECT item_id, part AS list_no, doc_id, rank FROM dense UNION ALL SELECT item_id, part + 16, doc_id, rank FROM sparse JOIN parts USING (part_id)),
g AS (SELECT item_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min((list_no, rank)) AS seen FROM lists GROUP BY ALL),
fused AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY rrf DESC, seen, doc_id) AS old FROM g QUALIFY old <= 30)
"""


@query(
    "hybrid_search",
    HYBRID + """
, s AS (SELECT f.item_id, f.doc_id, old, coalesce(list_cosine_similarity(q.v, e.v), 0.0) AS cos FROM fused f LEFT JOIN vectors q ON q.vec_id = f.item_id LEFT JOIN vectors e ON e.vec_id = f.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(cos, 6) DESC, old) AS rank FROM s QUALIFY rank <= 5)
SELECT item_id, r.doc_id, round(cos, 4) AS score, CAST(rank AS INTEGER) AS rank, d.source FROM r JOIN documents d ON d.doc_id = r.doc_id
""",
)
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors and BM25 over each expansion of a query, fused, reranked by cosine and joined to the source.

    A document's vector is the one of its id; an expansion has one of its own, looked up by item and part as a provider would
    answer. Documents without a vector are found by words alone.
    """
    docs, asked = _with_vectors(spark, sf_dir)
    return S.hybrid(docs, asked, 5, embed=_looked_up(spark, sf_dir), index=_corpus(spark, sf_dir)).join(docs.select("doc_id", "source"), "doc_id").select("item_id", "doc_id", "score", "rank", "source")


@query(
    "hybrid_search_lexical",
    HYBRID + f""", {RECALL},
s AS (SELECT item_id, doc_id, old, len(list_intersect(qs, ds)) / greatest(len(qs), 1) AS overlap FROM fused JOIN sets USING (doc_id) JOIN qsets USING (item_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(overlap, 6) DESC, old) AS rank FROM s QUALIFY rank <= 5)
SELECT item_id, doc_id, round(overlap, 4) AS score, CAST(rank AS INTEGER) AS rank FROM r
""",
)
def hybrid_search_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search with the reranker that unknown backends fall back to."""
    docs, asked = _with_vectors(spark, sf_dir)
    return S.hybrid(docs, asked, 5, reranker="lexical", embed=_looked_up(spark, sf_dir), index=_corpus(spark, sf_dir))


@query(
    "retrieval_run_metrics",
    HYBRID
    + """
SELECT 'queries' AS name, count(*) AS value FROM parts WHERE part = 0 UNION ALL SELECT 'expansions', count(*) FROM parts
UNION ALL SELECT CASE WHEN list_no < 16 THEN 'dense_' ELSE 'sparse_' END || (list_no % 16), count(*) FROM lists GROUP BY list_no
UNION ALL SELECT 'fusion_candidates', count(*) FROM fused UNION ALL SELECT 'results', CAST(sum(least(n, 5)) AS BIGINT) FROM (SELECT count(*) AS n FROM fused GROUP BY item_id)
""",
)
def retrieval_run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a hybrid run counted while it ran, without a second pass over its lists."""
    docs, asked = _with_vectors(spark, sf_dir)
    run = S.retrieve(docs, asked, 5, embed=_looked_up(spark, sf_dir), index=_corpus(spark, sf_dir))
    staged(run.rows, "results")
    m = run.metrics()
    rows = [(name, v) for name, v in m.items() if not isinstance(v, list)] + [(f"{kind}_{i}", v) for kind in ("dense", "sparse") for i, v in enumerate(m[f"{kind}_hits"])]
    return spark.createDataFrame(rows, "name string, value long")


@query("dense_only_search", HYBRID + "SELECT item_id, doc_id, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM dense WHERE part = 0 AND rank <= 5")
def dense_only_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The switch that leaves words, fusion and reranking out."""
    docs, asked = _with_vectors(spark, sf_dir)
    return S.hybrid(docs, asked, 5, dense_only=True)


def _looked_up(spark: SparkSession, sf_dir: str) -> Callable[[DataFrame], DataFrame]:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_at"), F.col("embedding").cast("array<double>").alias("vector"))
    return lambda parts: parts.withColumn("_at", F.col("item_id") + 7 * F.col("part")).join(vectors, "_at", "left").drop("_at")


def _with_vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    docs = table(spark, sf_dir, "documents").join(vectors, F.col("doc_id") == F.col("vec_id"), "left").select("doc_id", "text", "source", "vector")
    return docs, table(spark, sf_dir, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id"), "left").select("item_id", "text", "vector")


@query(
    "official_fallback_append",
    f"""
WITH {BM25},
seen AS (SELECT DISTINCT doc_id FROM sparse WHERE rank <= 5),
extra AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents WHERE source IN ('src0', 'src1', 'src2') AND doc_id NOT IN (SELECT doc_id FROM seen))
SELECT doc_id, source, 0.01::DOUBLE AS score FROM extra WHERE n = 1
UNION ALL SELECT s.doc_id, d.source, 1.0::DOUBLE FROM seen s JOIN documents d ON d.doc_id = s.doc_id
""",
)
def official_fallback_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits, plus the first not yet seen chunk of each official source at score 0.01."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    seen = staged(_corpus(spark, sf_dir).search(table(spark, sf_dir, "benchmark"), 5).select("doc_id").distinct(), "seen")
    official = docs.where(F.col("source").isin("src0", "src1", "src2")).select("doc_id", "source").join(seen, "doc_id", "left_anti")
    extra = official.groupBy("source").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "source", F.lit(0.01).alias("score"))
    return extra.unionByName(docs.join(seen, "doc_id").select("doc_id", "source", F.lit(1.0).alias("score")))
