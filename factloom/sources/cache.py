"""Cached results by key with a time to live and a budget of bytes.

Entries live in a versioned table, so readers keep what they opened while others put and evict. A put replaces its keys,
hides what is too old, and evicts the oldest entries until the rest fits the budget. How much fits is a running sum
over the times of puts, newest first; only the entries of the one time at which the budget runs out are ordered by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.sources.commits import VersionedTable

SCHEMA = "key string, value string, stored_at double, bytes long"


class ResultCache:
    """(key, value) rows under `path`; times are seconds given by the caller's clock."""

    def __init__(self, spark: SparkSession, path: str, ttl_seconds: float, budget_bytes: int) -> None:
        self.table, self.ttl, self.budget = VersionedTable(spark, path, SCHEMA, "key"), ttl_seconds, budget_bytes

    def get(self, keys: DataFrame, now: float) -> DataFrame:
        """(key, value) of the keys that are held and fresh."""
        fresh = self.table.read().where(F.col("stored_at") > now - self.ttl).select("key", "value")
        return fresh.join(keys.select("key").distinct(), "key", "left_semi")

    def missing(self, keys: DataFrame, now: float) -> DataFrame:
        return keys.join(self.get(keys, now).select("key"), "key", "left_anti")

    def put(self, rows: DataFrame, now: float) -> int:
        """Store (key, value), the greatest value of a repeated key; expired and surplus entries go. The number of the last commit."""
        fresh = rows.where("key IS NOT NULL").groupBy("key").agg(F.max("value").alias("value"))
        self.table.upsert(fresh.select("key", "value", F.lit(float(now)).alias("stored_at"), F.coalesce(F.octet_length("value"), F.lit(0)).cast("long").alias("bytes")))
        return self.table.delete(self.surplus(now))

    def surplus(self, now: float) -> DataFrame:
        """(key) of entries that are expired or no longer fit, the oldest first to go, of one time the greatest keys."""
        live = self.table.read()
        fresh = live.where(F.col("stored_at") > now - self.ttl)
        newest = Window.orderBy(F.desc("stored_at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        times = fresh.groupBy("stored_at").agg(F.sum("bytes").alias("size")).withColumn("upto", F.sum("size").over(newest))  # a row a put
        placed = fresh.join(times, "stored_at")
        whole = placed.where(F.col("upto") - F.col("size") > self.budget).select("key")
        inside = Window.partitionBy("stored_at").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edge = placed.where((F.col("upto") > self.budget) & (F.col("upto") - F.col("size") <= self.budget))
        edge = edge.withColumn("at", F.col("upto") - F.col("size") + F.sum("bytes").over(inside)).where(F.col("at") > self.budget).select("key")
        return live.join(fresh.select("key"), "key", "left_anti").select("key").unionByName(whole).unionByName(edge)

    def compact(self) -> int:
        return self.table.compact()
