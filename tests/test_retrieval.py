"""Hybrid retrieval: every expansion by its own vector, task scope, the dense-only switch, counts of a run."""

import pytest
from pyspark.sql import functions as F

from factloom.operators import search as S

DOCS = [(1, "alpha beta", [1.0, 0.0, 0.0], "t1"), (2, "gamma delta", [0.0, 1.0, 0.0], "t1"), (3, "alpha gamma", [0.0, 0.0, 1.0], "t2"), (4, "nothing here", None, "t1")]


def tables(spark, *asked):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, vector array<double>, task_id string")
    return docs, spark.createDataFrame(list(asked), "item_id string, text string")


def by_part(parts):
    """The first expansion looks along one axis, the others along the next."""
    return parts.withColumn("vector", F.when(F.col("part") == 0, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))))


def test_each_expansion_is_searched_by_its_own_vector(spark):
    docs, asked = tables(spark, ("q", "alpha, beta?"))
    run = S.retrieve(docs, asked, 3, depth=3, embed=by_part)
    first = {(r["doc_id"], r["rank"]) for r in S.fuse(spark.createDataFrame([("q", 0, 1, 1), ("q", 1, 2, 1)], "item_id string, list_no int, doc_id long, rank int"), "item_id", "doc_id").collect()}
    assert first == {(1, 1), (2, 2)}
    rows = {r["doc_id"]: r["score"] for r in run.rows.collect()}
    assert rows[1] == 1.0 and rows[2] == 0.0
    m = run.metrics()
    assert m["queries"] == 1 and m["expansions"] == 2 and m["dense_hits"] == [3, 3] and m["sparse_hits"] == [3, 3] and m["results"] == m["fusion_candidates"] == 3


def test_a_run_counts_what_its_tables_hold(spark):
    docs, asked = tables(spark, ("q", "alpha gamma"), ("r", "delta"))
    run = S.retrieve(docs, asked, 2, depth=2, embed=by_part, expand_queries=False)
    n = run.rows.count()
    assert run.metrics() == {"dense_hits": [4], "sparse_hits": [4], "queries": 2, "expansions": 2, "fusion_candidates": run.metrics()["fusion_candidates"], "results": n}


def test_a_task_sees_its_own_documents(spark):
    docs, asked = tables(spark, ("q", "alpha gamma"))
    got = S.hybrid(docs, asked, 9, embed=by_part, task_id="t1").collect()
    assert {r["doc_id"] for r in got} == {1, 2, 4}
    assert S.hybrid(docs, asked, 9, embed=by_part, task_id="none").collect() == []


def test_dense_only_leaves_words_out(spark):
    docs, asked = tables(spark, ("q", "gamma"))
    got = S.hybrid(docs, asked, 2, embed=by_part, dense_only=True).orderBy("rank").collect()
    assert [(r["doc_id"], r["score"]) for r in got] == [(1, 1.0), (2, 0.0)]


def test_odd_requests(spark):
    docs, asked = tables(spark, ("q", "gamma"))
    assert S.hybrid(docs, asked, 0).collect() == []
    with pytest.raises(Exception, match="blank"):
        S.hybrid(docs, tables(spark, ("q", " \t"))[1], 3, embed=by_part).collect()


def test_texts_are_embedded_by_hashing_where_nothing_else_is_given(spark):
    docs, asked = tables(spark, ("q", "alpha beta"))
    hashed = docs.withColumn("vector", S.hash_embedding(F.col("text")))
    assert S.hybrid(hashed, asked, 1).first()["doc_id"] == 1
