"""A versioned table: immutable Parquet parts named by numbered manifests, each created only if nobody else has created it.

A commit reads the latest manifest, works out a change and creates the next number. Whoever comes second finds the number
taken, reads the new manifest and works its change out again, so checks inside a change always hold for the version that
they are committed on. Readers keep the snapshot of the version that they opened. Parts are never rewritten: an upsert
adds its rows and the list of its keys, which hides older rows; `compact` writes the live rows as one part.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(Exception):
    """Another writer kept winning."""


class Refused(Exception):
    """A change that may not be committed on the version that it met."""


def _local(path: str) -> str | None:
    """The plain path of a local folder; None in another store."""
    return path.removeprefix("file://") if path.startswith(("file://", "/")) else path.removeprefix("file:") if path.startswith("file:") else None


class CommitLog:
    """Numbered JSON manifests under `path`/_commits. A number exists once, whoever writes."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.folder = f"{self.path}/_commits"
        jvm = spark.sparkContext._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed numbers, ascending; a listing of names, nothing is read."""
        if not self._fs.exists(self._at(self.folder)):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._at(self.folder)))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def read(self, version: int) -> dict:
        stream = self._fs.open(self._at(f"{self.folder}/{version:020d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode("utf-8"))
        finally:
            stream.close()

    def latest(self) -> tuple[int, dict]:
        """(number, manifest); (0, {}) before the first commit."""
        found = self.versions()
        return (found[-1], self.read(found[-1])) if found else (0, {})

    def create(self, version: int, manifest: dict) -> bool:
        """Whether this call created the version: written aside and put in place in one step that fails where the name exists."""
        final, aside = f"{self.folder}/{version:020d}.json", f"{self.folder}/.{uuid.uuid4().hex}.tmp"
        body = json.dumps(manifest, sort_keys=True).encode("utf-8")
        plain = _local(self.folder)
        if plain is not None:
            os.makedirs(plain, exist_ok=True)
            with open(_local(aside), "xb") as f:
                f.write(body)
            try:
                os.link(_local(aside), _local(final))
            except FileExistsError:
                return False
            finally:
                os.unlink(_local(aside))
            return True
        self._fs.mkdirs(self._at(self.folder))
        out = self._fs.create(self._at(aside), False)
        out.write(bytearray(body))
        out.close()
        placed = self._fs.rename(self._at(aside), self._at(final))  # a rename onto a name that exists fails in a file system with atomic renames
        if not placed:
            self._fs.delete(self._at(aside), False)
        return bool(placed)

    def commit(self, change: Callable[[int, dict], dict], tries: int = 50) -> int:
        """Commit `change(version, manifest)`; it runs again on the newer manifest if another writer was first."""
        for _ in range(tries):
            version, manifest = self.latest()
            if self.create(version + 1, change(version, manifest)):
                return version + 1
        raise Conflict(f"{tries} other commits came first")


@dataclass(frozen=True)
class Snapshot:
    """What a version holds: parts of rows and lists of hidden keys as (folder, sequence), and facts about the table."""

    version: int
    parts: tuple[tuple[str, int], ...] = ()
    masks: tuple[tuple[str, int], ...] = ()
    facts: dict = field(default_factory=dict)


class VersionedTable:
    """Rows with one key column under a commit log; a vector column's dimension is locked by the first write."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, vector: str | None = None) -> None:
        self.spark, self.log, self.schema, self.key, self.vector = spark, CommitLog(spark, path), schema, key, vector

    def snapshot(self, version: int | None = None) -> Snapshot:
        number, m = self.log.latest() if version is None else (version, self.log.read(version))
        return Snapshot(number, tuple(map(tuple, m.get("parts", []))), tuple(map(tuple, m.get("masks", []))), m.get("facts", {}))

    def _written(self, df: DataFrame) -> str:
        name = f"part-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(f"{self.log.path}/{name}")
        return name

    def read(self, at: Snapshot | int | None = None) -> DataFrame:
        """Rows of a version. A row is hidden by a mask that came after it and has its key."""
        snap = at if isinstance(at, Snapshot) else self.snapshot(at)
        rows = self.spark.createDataFrame([], self.schema).withColumn("_seq", F.lit(0))
        for name, seq in snap.parts:
            rows = rows.unionByName(self.spark.read.schema(self.schema).parquet(f"{self.log.path}/{name}").withColumn("_seq", F.lit(seq)))
        if snap.masks:
            keys = None
            for name, seq in snap.masks:
                part = self.spark.read.parquet(f"{self.log.path}/{name}").select(F.col(self.key).alias("_key"), F.lit(seq).alias("_until"))
                keys = part if keys is None else keys.unionByName(part)
            until = keys.groupBy("_key").agg(F.max("_until").alias("_until"))
            rows = rows.join(until, rows[self.key] == until["_key"], "left").where("_until IS NULL OR _seq >= _until").drop("_key", "_until")
        return rows.drop("_seq")

    def _dimension(self, batch: DataFrame) -> int | None:
        """The one dimension of a batch's vectors; None without rows. Mixed ones are refused."""
        low, high = batch.where(F.col(self.vector).isNotNull()).agg(F.min(F.size(self.vector)), F.max(F.size(self.vector))).first()
        if low != high:
            raise Refused(f"a batch has vectors of dimension {low} and {high}")
        return low

    def upsert(self, batch: DataFrame, check: Callable[[Snapshot], None] | None = None) -> int:
        """Rows of `batch` replace those of their keys; `check` may refuse on the version that the commit builds on.

        Keys of a batch must be unique and not null. A batch of another dimension than the stored one is refused, unless no row is left.
        """
        columns = batch.select(*self.spark.createDataFrame([], self.schema).columns)
        data = self._written(columns)
        stored = self.spark.read.schema(self.schema).parquet(f"{self.log.path}/{data}")
        rows, keys, named = stored.agg(F.count(F.lit(1)), F.countDistinct(self.key), F.count(self.key)).first()
        if rows != keys or rows != named:
            raise Refused("keys of a batch must be unique and not null")
        dimension = self._dimension(stored) if self.vector else None
        hidden = self._written(stored.select(self.key))

        def change(version: int, manifest: dict) -> dict:
            snap = self.snapshot(version) if version else Snapshot(0)
            if check:
                check(snap)
            facts = dict(snap.facts)
            held = facts.get("dimension")
            if dimension is not None and held not in (None, dimension) and not self.read(snap).isEmpty():
                raise Refused(f"vectors have dimension {held}, not {dimension}")
            if dimension is not None:
                facts["dimension"] = dimension
            masks = [*snap.masks, (hidden, version + 1)] if snap.parts else list(snap.masks)
            return {"parts": [*snap.parts, (data, version + 1)], "masks": masks, "facts": facts}

        return self.log.commit(change)

    def delete(self, keys: DataFrame) -> int:
        """Hide the rows of these keys from the next version on."""
        hidden = self._written(keys.select(self.key).distinct())
        return self.log.commit(lambda version, m: {**m, "masks": [*m.get("masks", []), (hidden, version + 1)], "parts": m.get("parts", []), "facts": m.get("facts", {})})

    def compact(self) -> int:
        """The live rows as one part. Another commit meanwhile makes it start again, so nothing is lost."""

        def change(version: int, manifest: dict) -> dict:
            return {"parts": [(self._written(self.read(version)), version + 1)] if version else [], "masks": [], "facts": manifest.get("facts", {})}

        return self.log.commit(change)


def claim(tasks: VersionedTable, task_id: str, free: tuple[str, ...] = ("created", "failed")) -> bool:
    """Set a task to running if its status is one of `free`; of claimers that start together exactly one gets True."""

    def change(version: int, manifest: dict) -> dict:
        snap = tasks.snapshot(version) if version else Snapshot(0)
        mine = tasks.read(snap).where((F.col(tasks.key) == task_id) & F.col("status").isin(*free))
        if mine.isEmpty():
            raise Refused(f"{task_id} can't be claimed")
        fresh = {"status": F.lit("running")} | ({"error_message": F.lit(None).cast("string")} if "error_message" in mine.columns else {})
        running = tasks._written(mine.withColumns(fresh))
        hidden = tasks._written(mine.select(tasks.key))
        return {"parts": [*snap.parts, (running, version + 1)], "masks": [*snap.masks, (hidden, version + 1)], "facts": snap.facts}

    try:
        tasks.log.commit(change)
    except Refused:
        return False
    return True
