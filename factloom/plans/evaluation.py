"""Queries on evaluation; an embedding is relevant to a query if it has the query's label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import evaluation as E
from factloom.operators import search as S
from factloom.plans import facts as P
from factloom.plans.registry import query, table
from factloom.plans.search import COS


@query(
    "retrieval_metrics",
    f"""
WITH q AS (SELECT vec_id AS query_id, label, embedding FROM embeddings WHERE vec_id % 20 = 0),
r AS (SELECT query_id, e.vec_id, q.label = e.label AS rel, row_number() OVER (PARTITION BY query_id ORDER BY {COS} DESC, e.vec_id) AS rank FROM embeddings e, q QUALIFY rank <= 10),
n AS (SELECT query_id, count(*) AS n FROM q JOIN embeddings e USING (label) GROUP BY query_id),
o AS (SELECT *, sum(CAST(rel AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank) AS so_far FROM r),
g AS (SELECT query_id, count(*) FILTER (rel) AS hits, coalesce(sum(1 / log2(rank + 1)) FILTER (rel), 0) AS dcg, min(rank) FILTER (rel) AS first_rank, coalesce(sum(so_far / rank) FILTER (rel), 0) AS ap FROM o GROUP BY query_id)
SELECT query_id, round(hits / n, 6) AS recall, round(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 10) + 1) t(i)), 6) AS ndcg, round(coalesce(1.0::DOUBLE / first_rank, 0), 6) AS mrr,
  round(hits / 10, 6) AS precision, round(CASE WHEN hits > 0 THEN 2 * (hits / 10) * (hits / n) / (hits / 10 + hits / n) ELSE 0 END, 6) AS f1, round(ap / least(n, 10), 6) AS average_precision
FROM g JOIN n USING (query_id)
""",
)
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.where("vec_id % 20 = 0")
    relevant = asked.select(F.col("vec_id").alias("query_id"), "label").join(vectors.select("vec_id", "label"), "label").select("query_id", "vec_id")
    return E.ranking_metrics(S.batch_knn(vectors, asked, 10), relevant, "query_id", "vec_id", 10)


@query(
    "extraction_prf",
    f"""
WITH {P.SEGMENT}, e AS (SELECT company, y, n FROM seg WHERE y % 2 = 0 OR n % 3 = 0), p AS (SELECT company, y, n FROM seg WHERE y < 2020 UNION ALL SELECT company, y, n + 1 FROM seg WHERE y = 2020),
c AS (SELECT (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM e)) AS tp, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM e)) AS fp, (SELECT count(*) FROM (SELECT * FROM e EXCEPT SELECT * FROM p)) AS fn)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS f1 FROM c
""",
)
def extraction_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P._segments(spark, sf_dir)
    predicted = s.where("y < 2020").unionByName(s.where("y = 2020").withColumn("n", F.col("n") + 1))
    return E.micro_prf(predicted, s.where("y % 2 = 0 OR n % 3 = 0"), ["company", "y", "n"])


@query(
    "coverage_score",
    """
WITH c AS (SELECT source, list_distinct(list(lang) FILTER (doc_id % 2 = 0)) AS observed, count(*) AS n_facts, count(DISTINCT lang) AS n_sources FROM documents GROUP BY source)
SELECT source, round(len(list_intersect(observed, ['de', 'en', 'fr', 'xx'])) / 4, 4) AS coverage, round(n_facts / n_sources, 4) AS density,
  array_to_string(list_sort(list_filter(['de', 'en', 'fr', 'xx'], lambda x: NOT list_contains(observed, x))), ',') AS missing, round(len(list_intersect(observed, ['de', 'en', 'fr', 'xx'])) / 4, 4) >= 0.7 AS passed FROM (SELECT source, coalesce(observed, []) AS observed, n_facts, n_sources FROM c)
""",
)
def coverage_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cases = docs.groupBy("source").agg(F.collect_set(F.when(F.col("doc_id") % 2 == 0, F.col("lang"))).alias("observed"), F.count(F.lit(1)).alias("n_facts"), F.countDistinct("lang").alias("n_sources"))
    cases = cases.withColumn("expected", F.array(*map(F.lit, ("DE ", "en", "fr", "xx", "en"))))
    return E.coverage(cases).select("source", "coverage", "density", F.array_join("missing", ",").alias("missing"), "passed")
