"""Centroid clustering (k-means) in exact integers, screened by the norms of segments.

Components become integers floor(scale * x). Each vector is stored once with the norms of its segments, a vector of
`SEGMENTS` numbers. By Cauchy-Schwarz a segment's share of a squared distance is at least the square of the difference of the
two norms, so the sum over segments is a lower bound of the distance, computed from the short vectors alone. A vector's
exact distance to the centroid of least bound is taken first; of the others, only those whose bound isn't above it get an
exact integer distance. Bounds are lowered by more than their rounding error, so the nearest centroid is never pruned.

A round sends the centroids (k * dimension integers) out and brings one sum per task, cluster and component back together.

Vectors of another dimension, null vectors and vectors with a null or non-finite component are left out. Components beyond
2^26 are held at it, so that distances fit 64 bits. Null ids: kept, last among those that may become first centroids.
Repeated rows: each counts. Ties: the smaller cluster number. Fewer vectors than clusters: as many clusters as vectors.
Empty table: empty result. Extra columns: ignored. There are no texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import drop_table, materialize

SEGMENTS, LARGEST, ROWS = 8, 1 << 26, 2048
FAR = np.iinfo(np.int64).max


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, dimension: int, scale: int) -> DataFrame:
    """(vec_id, v): the rows that are kept, with integer components."""
    x = F.col("x").cast("array<double>")
    rows = df.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("x")).where(F.size("x") == dimension)
    # null is neither below nor above anything, so exists() of the complement is avoided
    sound = F.forall(F.transform(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False))), lambda ok: ok)
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    return rows.where(sound).select("vec_id", whole.alias("v"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors of least sha256 of "seed:id", in that order: `clusters` rows."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["v"]) for r in vectors.select(digest.alias("digest"), "v").orderBy(F.asc_nulls_last("digest"), "v").limit(clusters).collect()]


def segment_norms(x: np.ndarray, segments: int = SEGMENTS) -> np.ndarray:
    """Euclidean norm of each of the vectors' `segments` (at most one a component) stretches of components."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)[:-1]
    return np.sqrt(np.add.reduceat(np.square(x, dtype=np.float64), cuts, axis=1))


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, number of exact distances) of each vector."""
    theirs = segment_norms(centroids)
    bound = np.square(norms[:, None, :] - theirs[None, :, :]).sum(axis=2)
    bound -= 1 + 1e-12 * (np.square(norms).sum(axis=1)[:, None] + np.square(theirs).sum(axis=1)[None, :])
    every = np.arange(len(x))
    likely = bound.argmin(axis=1)
    exact = np.full(bound.shape, FAR)
    exact[every, likely] = np.square(x - centroids[likely]).sum(axis=1)
    open_ = bound <= exact[every, likely][:, None]
    open_[every, likely] = False
    rows, cols = np.nonzero(open_)
    for at in range(0, len(rows), 8 * ROWS):
        r, c = rows[at : at + 8 * ROWS], cols[at : at + 8 * ROWS]
        exact[r, c] = np.square(x[r] - centroids[c]).sum(axis=1)
    cluster = exact.argmin(axis=1)
    return cluster, exact[every, cluster], open_.sum(axis=1) + 1


def _stored(vectors: DataFrame, dimension: int) -> DataFrame:
    """(vec_id, v, norms) as packed 32-bit integers and doubles, written once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(-1, dimension)
            norms = segment_norms(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in norms], pa.binary())], ["vec_id", "v", "norms"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return materialize(vectors.mapInArrow(work, f"vec_id {kind}, v binary, norms binary"), "vectors")


def _blocks(batch: pa.RecordBatch, dimension: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS):
        some = batch.slice(at, ROWS)
        x = np.frombuffer(b"".join(some.column("v").to_pylist()), "<i4").reshape(-1, dimension).astype(np.int64)
        yield some, x, np.frombuffer(b"".join(some.column("norms").to_pylist()), np.float64).reshape(len(x), -1)


def _moved(stored: DataFrame, centroids: list[list[int]], dimension: int) -> list[list[int]]:
    """Each centroid replaced by floor(sum / count) of its vectors; empty ones stay."""
    k = len(centroids)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sums, counts = np.array(centroids, np.int64), np.zeros((k, dimension), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x, norms in _blocks(batch, dimension):
                cluster, _, _ = nearest(x, norms, held)
                counts += np.bincount(cluster, minlength=k)
                for c in np.unique(cluster):
                    sums[c] += x[cluster == c].sum(axis=0)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = stored.select("v", "norms").mapInArrow(work, "cluster int, n long, sums array<long>")
    wide = [F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dimension)]
    out = list(centroids)
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *wide).collect():  # at most k rows
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dimension)]
    return out


def centroid_clusters(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", clusters: int = 40, rounds: int = 5, dimension: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, exact_distances) per kept vector.

    `exact_distances`: to how many centroids the last assignment took an exact distance; the rest were pruned.
    """
    spark = df.sparkSession
    vectors = integer_vectors(df, id_col, vector_col, dimension, scale)
    stored = _stored(vectors, dimension)
    centroids = first_centroids(vectors, clusters, seed)
    for _ in range(rounds if centroids else 0):
        centroids = _moved(stored, centroids, dimension)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.array(centroids, np.int64)
        for batch in batches:
            for some, x, norms in _blocks(batch, dimension):
                cluster, distance, exact = nearest(x, norms, held)
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(exact.astype(np.int32))], ["vec_id", "cluster", "distance", "exact_distances"])

    kind = stored.schema["vec_id"].dataType.simpleString()
    placed = materialize(stored.mapInArrow(work, f"vec_id {kind}, cluster int, distance long, exact_distances int"), "clusters")
    drop_table(stored)
    inertia = {r["cluster"]: int(r["d"]) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}  # at most k rows
    rows = [(c, d, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, d in inertia.items()]
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "exact_distances")


def oracle(clusters: int = 40, rounds: int = 5, dimension: int = 64, scale: int = 256, seed: int = 2) -> str:
    """The same rows in SQL, one pair of tables a round, every distance computed."""

    def assigned(r: int) -> str:
        pairs = f"SELECT v.rid, c.cluster, CAST(sum((v.x - c.x) * (v.x - c.x)) AS BIGINT) AS distance FROM parts v JOIN c{r} c ON v.pos = c.pos GROUP BY v.rid, c.cluster"
        return f"a{r} AS MATERIALIZED (SELECT rid, cluster, distance FROM ({pairs}) QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1)"

    def moved(r: int) -> str:
        sums = f"SELECT a.cluster, v.pos, CAST(sum(v.x) AS BIGINT) AS s, count(*) AS n FROM a{r - 1} a JOIN parts v ON a.rid = v.rid GROUP BY a.cluster, v.pos"
        return f"c{r} AS MATERIALIZED (SELECT o.cluster, o.pos, coalesce((s - ((s % n) + n) % n) // n, o.x) AS x FROM c{r - 1} o LEFT JOIN ({sums}) m ON o.cluster = m.cluster AND o.pos = m.pos)"

    steps = [step for r in range(1, rounds + 1) for step in (moved(r), assigned(r))]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, [CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS v FROM embeddings
  WHERE len(embedding) = {dimension} AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e)]) = {dimension}),
parts AS MATERIALIZED (SELECT rid, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM kept),
firsts AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, v) - 1 AS cluster, v FROM kept QUALIFY cluster < {clusters}),
c0 AS MATERIALIZED (SELECT cluster, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM firsts),
{assigned(0)},
{", ".join(steps)},
digests AS (SELECT cluster, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT k.vec_id, CAST(a.cluster AS INTEGER) AS cluster, a.distance, CAST(sum(a.distance) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, d.centroid_sha256
FROM a{rounds} a JOIN kept k ON a.rid = k.rid JOIN digests d ON a.cluster = d.cluster"""
