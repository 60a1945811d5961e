"""Task-scoped reads and keyed updates of the research tables, ingest of sources, and run settings."""

from __future__ import annotations

import hashlib
import math
import uuid
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import strip
from factloom.operators import chunking
from factloom.operators.inverted import InvertedFile
from factloom.operators.numbering import numbered
from factloom.operators.search import batch_knn, hash_embedding
from factloom.sources.staging import shared_folder

#: Order of each table's rows inside a task.
TASK_ORDER = {"sources": ("created_at", "source_id"), "chunks": ("source_id", "chunk_index"), "facts": ("created_at", "fact_id"), "verdicts": ("created_at", "fact_id")}
CLAIMABLE = ("created", "failed")


def of_task(rows: DataFrame, task_id: str, kind: str) -> DataFrame:
    """A task's rows of a table in its order; the filter is a predicate on the partition column."""
    return rows.where(F.col("task_id") == task_id).orderBy(*TASK_ORDER[kind])


def recent_tasks(tasks: DataFrame, limit: int) -> DataFrame:
    """Newest tasks first, 1 to 200 of them."""
    return tasks.orderBy(F.desc("updated_at"), "task_id").limit(max(1, min(limit, 200)))


def owned(tasks: DataFrame, sessions: DataFrame, user: str) -> DataFrame:
    """Tasks whose session belongs to the user."""
    return tasks.join(sessions.where(F.col("user_id") == user).select("session_id"), "session_id", "left_semi")


def claimed(tasks: DataFrame, task_id: str) -> DataFrame:
    """Tasks with one set to running, if it could be claimed: only created and failed tasks can."""
    free = (F.col("task_id") == task_id) & F.col("status").isin(*CLAIMABLE)
    return tasks.withColumn("status", F.when(free, "running").otherwise(F.col("status"))).withColumn("claimed", F.coalesce(free, F.lit(False)))


def merged_cache(existing: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Live entries, and the existing ones of keys that have none."""
    return live.unionByName(existing.join(live.select(key).distinct(), key, "left_anti"))


def numbered_events(events: DataFrame, task: str, order: list[str]) -> DataFrame:
    """Events with their place in their task, as a snapshot shows them."""
    return numbered(events, [F.asc(c) for c in order], "seq", [task])


def ingest(sources: DataFrame, strategy: str = "section_aware", size: int = 1600, overlap: int = 300) -> DataFrame:
    """(task_id, source_id, chunk_index, text, metadata): chunks of sources' raw_content, each with its source's attributes."""
    chunks = chunking.chunk(F.col("raw_content"), strategy, size, overlap)
    rows = sources.select("task_id", "source_id", F.struct("title", "url", "source_type", "credibility").alias("source"), F.explode(chunks).alias("c"))
    meta = F.struct(F.col("source.title").alias("source_title"), F.col("source.url").alias("source_url"), F.col("source.source_type").alias("source_type"), F.col("source.credibility").alias("credibility"), F.lit(strategy).alias("strategy"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"))
    return rows.select("task_id", "source_id", F.col("c.chunk_index").alias("chunk_index"), F.col("c.text").alias("text"), meta.alias("metadata"))


def embedded(chunks: DataFrame, dimension: int = 128) -> DataFrame:
    """Chunks with their vector and the fingerprint of what was embedded; a blank text fails the job."""
    text = strip(F.regexp_replace(F.lower("text"), r"(?U)\s+", " "))
    checked = F.when(text != "", text).otherwise(F.raise_error(F.lit("a blank text has no vector")))
    tag = F.concat(F.lit(f"local-hash-v1-dim{dimension}-"), F.substring(F.sha2(checked, 256), 1, 16))
    return chunks.withColumns({"embedding": hash_embedding(F.col("text"), dimension), "embedding_id": tag})


def reindexed(stored: DataFrame, batch: DataFrame, key: str = "task_id") -> DataFrame:
    """An index with the vectors of the batch's tasks replaced by the batch."""
    return stored.join(batch.select(key).distinct(), key, "left_anti").unionByName(batch)


def mock_embedding(c: Column, dimension: int = 8) -> Column:
    """A vector from the digest of a text, for tests; blank text is null."""

    def embed(text: str | None) -> list[float] | None:
        text = (text or "").strip()
        if not text:
            return None
        d = hashlib.sha256(text.encode()).digest()
        pairs = ((d[i % 32], d[(i + 1) % 32]) for i in range(dimension))
        turns = ((a, 2.0 * 3.141592 * (256 * a + b) / 65535.0) for a, b in pairs)
        return [round(0.5 * math.sin(t) + 0.5 * math.cos(2.0 * t) * (a / 255.0 - 0.5), 6) for a, t in turns]

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(embed)

    return run(c)


def mock_embedding_id(text: Column, dimension: int = 8) -> Column:
    """Fingerprint of what a mock vector was made from; a blank text fails the job."""
    plain = strip(F.coalesce(text, F.lit("")))
    checked = F.when(plain != "", plain).otherwise(F.raise_error(F.lit("a blank text has no vector")))
    return F.concat(F.lit(f"mock-emb-v1-dim{dimension}-"), F.substring(F.sha2(checked, 256), 1, 12))


def knn_of_json(vectors: DataFrame, queries: DataFrame, k: int, dimension: int, vector_col: str = "embedding_json") -> DataFrame:
    """batch_knn over vectors stored as JSON text; a vector of another dimension fails the job."""
    def parsed(df: DataFrame) -> DataFrame:
        v = F.from_json(vector_col, "array<double>")
        return df.select("vec_id", F.when(v.isNull() | (F.size(v) == dimension), v).otherwise(F.raise_error(F.lit(f"a vector's dimension isn't {dimension}"))).alias("embedding"))

    return batch_knn(parsed(vectors), parsed(queries), k)


def approximate_knn(vectors: DataFrame, queries: DataFrame, k: int, recall: float = 0.98) -> DataFrame:
    """(query_id, vec_id, score, rank): cosine top k through an inverted file fitted for this call; a corpus searched more than once keeps its file."""
    path = f"{shared_folder(vectors.sparkSession)}/factloom/vectors-{uuid.uuid4().hex}"
    return InvertedFile(vectors.sparkSession, path).fit(vectors, recall=recall, k=max(1, k)).search(queries, k)


@dataclass
class Settings:
    """Run settings with overrides on top; a provider without its key is refused when it is chosen."""

    values: dict[str, object] = field(default_factory=dict)
    overrides: dict[str, object] = field(default_factory=dict)
    keys_needed: dict[str, str] = field(default_factory=dict)

    def effective(self, name: str) -> object:
        return self.overrides[name] if self.overrides.get(name) is not None else self.values[name]

    def override(self, name: str, value: object) -> None:
        if name not in self.values:
            raise KeyError(name)
        self.overrides[name] = value

    def provider(self, name: str) -> str:
        """The provider, if the setting that it needs is there."""
        key = self.keys_needed.get(name)
        if key and not self.values.get(key):
            raise ValueError(f"provider {name} needs the setting {key}")
        return name
