"""Writes that replace by key, and the purge of a task's outputs, over partitioned Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from factloom.sources.commits import VersionedTable

#: Fixed value: outputs of a task from the last made to the first, the order in which they are purged.
OUTPUTS = ("reports", "verification_results", "extracted_facts", "evidence_chunks", "sources")


def replace_partitions(rows: DataFrame, path: str, keys: tuple[str, ...] = ("task_id", "source_id")) -> None:
    """Write `rows`; every (task, source) that they hold is replaced as a whole, others stay. Safe to run again."""
    rows.repartition(*keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def purge_task(tables: dict[str, DataFrame], task_id: str) -> dict[str, DataFrame]:
    """Each output table without the rows of a task, in purge order; a filter on the partition column."""
    return {name: tables[name].where((tables[name]["task_id"] != task_id) | tables[name]["task_id"].isNull()) for name in OUTPUTS if name in tables}


def purge(tables: dict[str, VersionedTable], task_id: str) -> dict[str, int]:
    """Hide a task's rows in each output table, in purge order, a commit each; the version of each table. Readers keep their snapshots."""
    done = {}
    for name in OUTPUTS:
        if name in tables:
            rows = tables[name].read()
            done[name] = tables[name].delete(rows.where(rows["task_id"] == task_id))
    return done


def claim(status: str) -> str:
    """Status of a task once claimed; only created and failed tasks can be."""
    if status not in ("created", "failed"):
        raise ValueError(f"a task that is {status} can't be claimed")
    return "running"
