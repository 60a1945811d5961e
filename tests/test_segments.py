"""The segment index against scoring every document, and what it skips."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.functions.text import TOKEN
from factloom.operators import search as S
from factloom.operators.segments import SegmentIndex

DOCS, ASKED = "doc_id long, text string", "item_id long, text string"


def brute(docs, queries, k):
    """{(query, doc, score, rank)} by the public Okapi formula over all documents, ties by id."""
    bags = {d: re.findall(TOKEN, t or "") for d, t in docs}
    n, mean = len(bags), sum(map(len, bags.values())) / len(bags) if bags else 0
    df = Counter(t for b in bags.values() for t in set(b))
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw) if raw else 0
    out = set()
    for q, text in queries:
        scores = []
        for d, bag in bags.items():
            tf = Counter(bag)
            s = sum((raw[t] if raw[t] >= 0 else floor) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(bag) / mean)) for t in re.findall(TOKEN, text) if t in df)
            scores.append((-round(s, 6) + 0.0, d))
        out |= {(q, d, -s + 0.0, i + 1) for i, (s, d) in enumerate(sorted(scores)[:k])}
    return out


def rows(df):
    return {(r[0], r[1], r[2] + 0.0, r[3]) for r in df.collect()}


def corpus(seed, n, first=0):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    return [(first + i, None if r.random() < 0.05 else " ".join(r.choices(words, weights, k=r.randint(0, 30)))) for i in range(n)]


def test_exact_over_adds_replacements_deletes_and_compaction(spark, tmp_path):
    r = random.Random(1)
    queries = [(i, " ".join(r.choices([f"w{j}" for j in range(70)], k=r.randint(0, 6)))) for i in range(25)] + [(99, "w0 w0 w1")]
    asked = spark.createDataFrame(queries, ASKED)
    make = lambda docs: spark.createDataFrame(docs, DOCS)
    path = f"file://{tmp_path}/index"
    docs = dict(corpus(2, 400))
    index = SegmentIndex(spark, path).add(make(list(docs.items())))
    assert rows(index.search(asked, 7)) == brute(docs.items(), queries, 7)
    first = index.manifest["segments"]
    old = SegmentIndex(spark, path)  # keeps the version that it opened

    batch = corpus(3, 150, first=330)  # replaces 70
    docs |= dict(batch)
    index.add(make(batch))
    assert index.manifest["segments"][: len(first)] == first
    assert rows(SegmentIndex(spark, path).search(asked, 7)) == brute(docs.items(), queries, 7)

    gone = [d for d in docs if d % 3 == 0]
    index.delete(make([(d, "") for d in [*gone, 10_000]]))
    docs = {d: t for d, t in docs.items() if d % 3}
    again = SegmentIndex(spark, path)
    assert rows(again.search(asked, 7)) == brute(docs.items(), queries, 7)
    assert rows(old.search(asked, 3)) == brute(corpus(2, 400), queries, 3)

    index.compact()
    assert len(index.manifest["segments"]) == 1 and rows(index.search(asked, 200)) == brute(docs.items(), queries, 200)
    index.delete(make([(d, "") for d in docs]))
    assert index.search(asked, 5).count() == 0
    index.add(make([(5, "w1"), (6, "w2")]))
    assert rows(index.search(asked, 5)) == brute([(5, "w1"), (6, "w2")], queries, 5)


def test_negative_scores_rank_below_unmatched_documents(spark):
    docs = [(i, "apple apple") for i in range(1, 9)] + [(i, "x") for i in range(9, 13)]
    got = S.bm25(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, "apple")], ASKED), 4)
    assert rows(got) == brute(docs, [(1, "apple")], 4) and {r[1] for r in rows(got)} == {9, 10, 11, 12}


def test_lists_are_filled_without_a_cap(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "rare word").otherwise("other").alias("text"))
    got = S.bm25(docs, spark.createDataFrame([(1, "rare")], ASKED), 2000).collect()
    assert len(got) == 2000 and {r["rank"] for r in got} == set(range(1, 2001))
    many = S.bm25(docs, spark.createDataFrame([(1, "nothing"), (2, "other")], ASKED), 1600)
    assert rows(many) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(1, "nothing"), (2, "other")], 1600)


def test_blocks_are_skipped(spark, tmp_path):
    """A frequent and a rare term: the frequent term's blocks are opened only where the rare one is."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.when(F.col("id") % 3 > 0, "common "), F.lit("filler"), F.when(F.col("id").between(700, 720), " rare common seldom").otherwise("")).alias("text"))
    docs = docs.withColumn("text", F.coalesce("text", F.lit("filler")))
    index = SegmentIndex(spark, f"file://{tmp_path}/i").add(docs)
    queries, report = [(1, "common rare seldom")], {}
    got = index.search(spark.createDataFrame(queries, ASKED), 10, report=report)
    assert rows(got) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], queries, 10)
    assert report["blocks"] > 40 and report["skipped"] > 0.6 * report["blocks"]


def test_no_table_holds_a_row_for_each_query_and_document(spark, tmp_path, monkeypatch):
    from factloom.operators import segments

    kept, sizes = segments.staged, []
    monkeypatch.setattr(segments, "staged", lambda df, tag: (out := kept(df, tag), sizes.append(out.count()))[0])
    docs = [(i, f"common word w{i % 7}") for i in range(1500)]
    queries = [(i, f"common word w{i % 7}") for i in range(40)]
    index = SegmentIndex(spark, f"file://{tmp_path}/p").add(spark.createDataFrame(docs, DOCS))
    assert rows(index.search(spark.createDataFrame(queries, ASKED), 3)) == brute(docs, queries, 3)
    assert max(sizes) <= 3 * len(queries)


def test_many_blocks_of_queries_and_groups_of_shards(spark, tmp_path, monkeypatch):
    from factloom.operators import segments

    monkeypatch.setattr(segments, "QUERY_BLOCK", 4)
    docs, queries = corpus(5, 300), [(i, f"w{i} w{i % 3} w50") for i in range(9)]
    index = SegmentIndex(spark, f"file://{tmp_path}/q").add(spark.createDataFrame(docs, DOCS))
    assert rows(index.search(spark.createDataFrame(queries, ASKED), 5)) == brute(docs, queries, 5)
    seen = [pa.RecordBatch.from_pydict({"seg": [0] * 5, "shard": [1, 1, 2, 3, 3], "word": [*range(5)]})]
    got = [(t.column("word").to_pylist(), list(n)) for t, n in segments._groups(iter(seen), 2)]
    assert got == [([0, 1, 2], [0, 0, 1]), ([3, 4], [0, 0])]


def test_only_found_texts_meet_their_vectors(spark):
    docs = spark.createDataFrame([(i, f"some word w{i % 5}") for i in range(40)], DOCS)
    vectors = spark.range(40).select(F.col("id").alias("vec_id"), F.array(*map(F.lit, [1.0] * 7), F.col("id").cast("double")).alias("vector"))
    joined = docs.join(vectors, F.col("doc_id") == F.col("vec_id"), "left").select("doc_id", "text", "vector")
    found = S.hybrid(joined, spark.createDataFrame([(1, "word w3")], ASKED), 3, embed=lambda p: p.withColumn("vector", F.array(*map(F.lit, [1.0] * 8))), reranker="lexical")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("LeftOuter") < plan.index("LeftSemi")  # below it
    assert [r["doc_id"] % 5 for r in found.orderBy("rank").collect()] == [3, 3, 3]


def test_ids_of_text_repeated_ids_and_empty_tables(spark, tmp_path):
    index = SegmentIndex(spark, f"file://{tmp_path}/s", "string")
    kind = "doc_id string, text string"
    index.add(spark.createDataFrame([("b", "xx yy"), ("a", "xx"), ("a", "zz"), (None, "xx")], kind))
    got = index.search(spark.createDataFrame([("q", "xx zz")], "item_id string, text string"), 9)
    assert rows(got) == brute([("b", "xx yy"), ("a", "zz")], [("q", "xx zz")], 9)
    assert index.search(spark.createDataFrame([("q", "xx")], "item_id string, text string"), 0).count() == 0
    assert index.search(spark.createDataFrame([], "item_id string, text string"), 3).count() == 0
    empty = SegmentIndex(spark, f"file://{tmp_path}/e").add(spark.createDataFrame([], DOCS))
    assert empty.search(spark.createDataFrame([(1, "xx")], ASKED), 3).count() == 0


def test_a_search_reads_no_documents_and_crosses_nothing(spark, sf_dir, tmp_path):
    index = SegmentIndex(spark, f"file://{tmp_path}/d").add(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    plan = index.search(spark.createDataFrame([(1, "the")], ASKED), 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 0 and "CartesianProduct" not in plan


@pytest.mark.parametrize("k", [1, 40])
def test_documents_of_the_fixtures(spark, sf_dir, tmp_path, k):
    docs, asked = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").limit(12)
    index = SegmentIndex(spark, f"file://{tmp_path}/d").add(docs)
    got = rows(index.search(asked, k))
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in asked.collect()], k)
    assert {x[:2] for x in got} == {x[:2] for x in want} and max(abs(a[2] - b[2]) for a, b in zip(sorted(got), sorted(want), strict=True)) < 2e-6
