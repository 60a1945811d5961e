"""Vector and lexical retrieval: exact kNN, Okapi BM25, reciprocal rank fusion, reranking, query shaping."""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators.segments import SegmentIndex
from factloom.sources.staging import shared_folder, staged

#: Fixed value: the fusion constant.
RRF_K = 60
#: Queries sent out at a time.
QUERY_BLOCK = 2048


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def checked_dimension(vector: Column, dimension: int) -> Column:
    """The vector, or a failed query if it has another dimension."""
    return F.when(F.size(vector) == dimension, vector).otherwise(F.raise_error(F.concat(F.lit(f"vector dimension is not {dimension}: "), F.size(vector).cast("string"))))


def knn(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Exact top k by cosine for one query vector: scan, project, TakeOrderedAndProject. k <= 0: no rows."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = vectors.select(F.col(id_col), F.round(cosine(F.col(vector_col), q), 6).alias("score"))
    return scored.orderBy(F.desc("score"), F.asc(id_col)).limit(max(0, k))


def batch_knn(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, score, rank): exact top k of every query, a stated set against all rows.

    Queries go out in blocks of at most about `block` vectors, so what is broadcast has a fixed size; rows stay where
    they are, a task scores them by matrix products and keeps k rows per query, and only those meet in the shuffle.
    Null vectors are skipped; a zero vector scores 0.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col(id_col).alias("query_id"), F.col(vector_col).cast("array<double>").alias("q")).where("query_id IS NOT NULL AND q IS NOT NULL")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    blocks = max(1, -(-asked.count() // block))
    found = None
    for i in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i).orderBy("query_id").toArrow()
        sent = spark.sparkContext.broadcast((part.column(0).to_numpy(), _unit(part.column(1))))

        def work(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, asked_units = sent.value
            best, ids = np.full((len(names), 0), 0.0), np.full((len(names), 0), 0, np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows if len(names) else 0, 512):
                    some = batch.slice(at, 512)
                    scores = np.concatenate([best, np.round(asked_units @ _unit(some.column(1)).T, 6)], axis=1)
                    every = np.concatenate([ids, np.broadcast_to(some.column(0).to_numpy(), (len(names), some.num_rows))], axis=1)
                    order = np.lexsort((every, -scores), axis=-1)[:, : max(0, k)]
                    best, ids = np.take_along_axis(scores, order, 1), np.take_along_axis(every, order, 1)
            columns = [np.repeat(names, best.shape[1]), ids.ravel(), best.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0].astype(np.int64)), pa.array(columns[1]), pa.array(columns[2])], ["query_id", "id", "score"])

        hits = rows.mapInArrow(work, "query_id long, id long, score double")
        found = hits if found is None else found.unionByName(hits)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))))
    return ranked.where(F.col("rank") <= k).withColumnRenamed("id", id_col)


def _unit(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of unit length; zero vectors stay zero."""
    listed = vectors.to_pylist()
    x = np.array(listed, np.float64).reshape(len(listed), -1)
    norm = np.linalg.norm(x, axis=1, keepdims=True) if len(listed) else np.zeros((0, 1))
    return np.where(norm > 0, x / np.where(norm > 0, norm, 1.0), 0.0)


def upsert(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """Last write wins per key; rows that `batch` doesn't touch stay as they are."""
    return stored.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def delete_ids(stored: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return stored.join(ids.select(key).distinct(), key, "left_anti")


@lru_cache(maxsize=1 << 18)
def _feature(text: str) -> tuple[int, float]:
    """Place and signed weight of a token or pair; a worker digests the frequent ones once."""
    d = hashlib.blake2b(text.encode(), digest_size=8).digest()
    return int.from_bytes(d[:4], "big"), (1 - 2 * (d[4] & 1)) * (1 + min(len(text), 12) / 12)


def hash_embedding(c: Column, dimension: int = 128) -> Column:
    """Signed hashing of tokens and adjacent pairs into an L2-normalised vector, rounded to 6; blank text is null."""
    if dimension < 8:
        raise ValueError("dimension must be >= 8")

    def embed(text: str | None) -> list[float] | None:
        text = re.sub(r"\s+", " ", (text or "").strip().lower())
        if not text:
            return None
        words = re.findall("[a-z0-9]+|[一-鿿]", text)
        vector = [0.0] * dimension
        for f in [*words, *(f"{a}_{b}" for a, b in zip(words, words[1:], strict=False))] or [text]:
            place, weight = _feature(f)
            vector[place % dimension] += weight
        norm = math.sqrt(sum(x * x for x in vector))
        return [round(x / norm, 6) for x in vector] if norm else vector

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(embed)

    return run(c)


def keywords(queries: DataFrame, id_col: str, text_col: str, top: int = 8, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(id, token, hits, rank): most frequent tokens of each text, ties by first appearance."""
    t = queries.select(F.col(id_col), F.posexplode(T.tokens(F.col(text_col))).alias("pos", "token")).where(~F.col("token").isin(*stop_words) & (F.length("token") > 1))
    g = t.groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("hits"), F.min("pos").alias("first_pos"))
    ranked = g.withColumn("rank", F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("hits"), "first_pos")))
    return ranked.where(F.col("rank") <= top).select(id_col, "token", "hits", "rank")


def is_complex(q: Column) -> Column:
    marks = F.length(q) - F.length(F.regexp_replace(q, "[?？]", ""))
    return (F.length(q) >= 40) | (marks >= 2)


def decompose(q: Column) -> Column:
    parts = F.filter(F.transform(F.split(q, "[？?；;]"), T.strip), lambda x: F.length(x) >= 6)
    return F.slice(parts, 1, 3)


def expand(q: Column, words: Column) -> Column:
    """Ordered distinct queries: the text itself, its joined keywords, and its parts if it is complex."""
    every = F.concat(F.array(T.strip(q)), F.array(F.array_join(words, " ")), F.when(is_complex(q), decompose(q)).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda x: x != ""))


def bm25(docs: DataFrame, queries: DataFrame, k: int, doc_id: str = "doc_id", query_id: str = "item_id", text_col: str = "text") -> DataFrame:
    """(query_id, doc_id, score, rank): exact Okapi BM25 top k per query, through a segment index made for this call.

    Documents without a query token score 0, below positive and above negative scores; ties rank by id. A corpus that is
    searched more than once keeps its index (`segments.SegmentIndex`).
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    index = SegmentIndex(docs.sparkSession, f"{shared_folder(docs.sparkSession)}/factloom/index-{uuid.uuid4().hex}", kind).add(docs, doc_id, text_col)
    return index.search(queries, k, query_id, text_col, doc_id)


def fuse(ranked: DataFrame, query_id: str, doc_id: str, top: int = 30, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, rrf, rank) from (query_id, list_no, doc_id, rank): reciprocal ranks summed, ties by first seen."""
    k = max(1, k)
    g = ranked.groupBy(query_id, doc_id).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"), F.min(F.struct("list_no", "rank")).alias("seen"))
    out = g.withColumn("rank", F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("rrf"), "seen", doc_id)))
    return out.where(F.col("rank") <= top).select(query_id, doc_id, "rrf", "rank")


def expanded(queries: DataFrame, query_id: str, text_col: str, stop_words: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, part, text): each query's ordered distinct expansions, from the text itself (part 0) on."""
    words = keywords(queries, query_id, text_col, stop_words=stop_words).groupBy(query_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias("words"))
    met = queries.select(query_id, text_col).join(words, query_id, "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    return met.select(query_id, F.posexplode(expand(F.col(text_col), F.col("words"))).alias("part", "text"))


def reranked(hits: DataFrame, by: str, score: Column, k: int) -> DataFrame:
    """The k hits of greatest `score` of each `by`, stable on their former rank."""
    scored = hits.withColumn("score", score).withColumnRenamed("rank", "old")
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round("score", 6)), "old")))
    return ranked.where(F.col("rank") <= k).drop("old")


#: Most expansions of a query, its text and keywords included.
MOST_PARTS = 16


@dataclass(frozen=True)
class RetrievalRun:
    """Rows of a retrieval and what it counted while it ran."""

    rows: DataFrame
    counted: dict[str, Observation]

    def metrics(self) -> dict[str, int | list[int]]:
        """Queries, hits of each expansion by vector and by words, candidates of fusion and reranking, results.

        The counts come with the run itself; `results` waits until `rows` has been used up by an action.
        """
        got = {name: o.get for name, o in self.counted.items()}
        lists = got.get("lists", {})
        per = {f"{kind}_hits": [lists[f"{kind}_{i}"] for i in range(MOST_PARTS) if lists[f"part_{i}"]] for kind in ("dense", "sparse") if lists}
        return per | {k: v for name, m in got.items() if name != "lists" for k, v in m.items()}


def hybrid(docs: DataFrame, queries: DataFrame, k: int, **how: object) -> DataFrame:
    """(item_id, doc_id, score, rank): the rows of `retrieve`."""
    return retrieve(docs, queries, k, **how).rows  # type: ignore[arg-type]


def retrieve(
    docs: DataFrame, queries: DataFrame, k: int, depth: int = 50, top: int = 30, reranker: str = "embedding", expand_queries: bool = True,
    embed: Callable[[DataFrame], DataFrame] | None = None, task_id: str | None = None, dense_only: bool = False, index: SegmentIndex | None = None,
) -> RetrievalRun:
    """Hybrid retrieval of queries (item_id, text[, vector]) over documents (doc_id, text, vector[, task_id]).

    Each expansion of a query is searched by its own vector and by BM25 to `depth`; the lists are fused by reciprocal rank,
    and the `top` of each query are reranked: by cosine, or by token recall for any other `reranker`. `embed` gives
    (item_id, part, text) a column `vector`; without it texts are embedded by hashing. A query's own `vector`, where it has one,
    is that of its part 0. `task_id` keeps the search inside one task's documents; `dense_only` searches the queries themselves
    by vector alone. `index` is the words' index of just these documents; without it one is made.
    Documents without a vector have no dense hits and a cosine of 0. k <= 0: no rows. A blank query fails the job.
    """
    spark = docs.sparkSession
    if task_id is not None:
        docs = docs.where(F.col("task_id") == task_id)
    if k <= 0:
        kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((queries, "item_id"), (docs, "doc_id"))]
        return RetrievalRun(spark.createDataFrame([], f"{kinds[0]}, {kinds[1]}, score double, rank int"), {})
    depth = max(depth, k)
    text = T.strip(F.coalesce("text", F.lit("")))
    queries = queries.withColumn("text", F.when(text == "", F.raise_error(F.lit("a query may not be blank"))).otherwise(text))
    parts = expanded(queries, "item_id", "text") if expand_queries and not dense_only else queries.select("item_id", F.lit(0).alias("part"), "text")
    parts = embed(parts) if embed else parts.withColumn("vector", hash_embedding(F.col("text")))
    if "vector" in queries.columns:
        own = queries.select("item_id", F.lit(0).alias("part"), F.col("vector").alias("given"))
        parts = parts.join(own, ["item_id", "part"], "left").withColumn("vector", F.coalesce("given", "vector")).drop("given")
    seen, counted = Observation(), {}
    counted["asked"] = seen
    parts = parts.observe(seen, F.count_if(F.col("part") == 0).alias("queries"), F.count(F.lit(1)).alias("expansions"))
    parts = staged(parts.withColumn("part_id", F.monotonically_increasing_id()), "parts")
    vectors = docs.select(F.col("doc_id").alias("vec_id"), F.col("vector").alias("embedding"))
    dense = batch_knn(vectors, parts.select(F.col("part_id").alias("vec_id"), F.col("vector").alias("embedding")), k if dense_only else depth)
    dense = parts.select("part_id", "item_id", "part").join(dense.withColumnRenamed("query_id", "part_id"), "part_id").withColumnRenamed("vec_id", "doc_id")
    results = Observation()
    counted["results"] = results
    if dense_only:
        rows = dense.select("item_id", "doc_id", F.round("score", 4).alias("score"), "rank")
        return RetrievalRun(rows.observe(results, F.count(F.lit(1)).alias("results")), counted)
    dense = dense.select("item_id", F.col("part").alias("list_no"), "doc_id", "rank")
    asked = parts.select("part_id", "text")
    sparse = (index.search(asked, depth, "part_id") if index else bm25(docs, asked, depth, query_id="part_id")).join(parts.select("part_id", "item_id", "part"), "part_id")
    lists = dense.unionByName(sparse.select("item_id", (F.col("part") + MOST_PARTS).alias("list_no"), "doc_id", "rank"))
    hits = Observation()
    counted["lists"] = hits
    many = lambda name, *numbers: F.count_if(F.col("list_no").isin(*numbers)).alias(name)
    each = [m for i in range(MOST_PARTS) for m in (many(f"dense_{i}", i), many(f"sparse_{i}", i + MOST_PARTS), many(f"part_{i}", i, i + MOST_PARTS))]
    lists = staged(lists.observe(hits, *each), "lists")
    fusing = Observation()
    counted["fused"] = fusing
    fused = staged(fuse(lists, "item_id", "doc_id", top).observe(fusing, F.count(F.lit(1)).alias("fusion_candidates")), "fused")
    own_vectors = parts.where("part = 0").select("item_id", F.col("text").alias("asked"), F.col("vector").alias("own"))
    docs = docs.join(fused.select("doc_id").distinct(), "doc_id", "left_semi")  # goes below the joins that `docs` is made of, so only these texts move
    met = fused.select("item_id", "doc_id", "rank").join(docs.select("doc_id", F.col("text").alias("found"), F.col("vector").alias("theirs")), "doc_id").join(own_vectors, "item_id")
    score = F.coalesce(cosine(F.col("own"), F.col("theirs")), F.lit(0.0)) if reranker == "embedding" else overlap_recall(F.col("asked"), F.col("found"))
    ranked = reranked(met, "item_id", score, k).select("item_id", "doc_id", F.round("score", 4).alias("score"), "rank")
    return RetrievalRun(ranked.observe(results, F.count(F.lit(1)).alias("results")), counted)


def overlap_recall(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that the text has; 0 for a query without tokens."""
    q = T.token_set(query)
    return F.size(F.array_intersect(q, T.token_set(text))) / F.greatest(F.size(q), F.lit(1))
