"""Row numbers over a whole table or a key without gathering either in one task.

Rows are sorted by range over all tasks; a row's number is its place in its task plus what the tasks before hold, and inside a key
the number of the key's first row is taken off. A key with a third of all rows is sorted by as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.sources.staging import staged

_BITS = 33  # monotonically_increasing_id: the task above, the place in it below


def numbered(df: DataFrame, order: list[Column], name: str = "seq", by: list[str] | None = None, kind: str = "int") -> DataFrame:
    """`df` with `name`, counting from 1 in `order` over the table or inside each `by`; `order` should leave no ties."""
    by = by or []
    keys = [*map(F.col, by), *order]
    rows = staged(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    task = F.shiftright("_id", _BITS)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = rows.groupBy(task.alias("_task")).agg(F.count(F.lit(1)).alias("_n")).select("_task", before.alias("_before"))  # a row a task
    place = F.col("_before") + F.col("_id") - F.shiftleft("_task", _BITS) + 1
    out = rows.withColumn("_task", task).join(F.broadcast(starts), "_task").withColumn(name, place)
    if by:
        firsts = rows.groupBy(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)]).agg(F.min("_id").alias("_id"))
        firsts = firsts.withColumn("_task", F.shiftright("_id", _BITS)).join(F.broadcast(starts), "_task").select(*[f"_by{i}" for i in range(len(by))], (place - 1).alias("_off"))
        same = F.lit(True)
        for i, c in enumerate(by):
            same = same & out[c].eqNullSafe(firsts[f"_by{i}"])
        out = out.join(firsts, same).withColumn(name, F.col(name) - F.col("_off"))
    return out.select(*df.columns, F.col(name).cast(kind).alias(name))
