"""Conversation memory: count-triggered extraction and the fold of memory operations, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.numbering import numbered

MIN_NEW = 4


def triggers(messages: DataFrame, session: str = "conv_id", order: str = "turn", min_new: int = MIN_NEW) -> DataFrame:
    """(session, latest_count, new_messages): messages counted one at a time fire at every `min_new`-th since the mark.

    The mark moves to the count at which it fires, so in batch these are the multiples of `min_new`.
    """
    counted = numbered(messages.select(session, order), [F.asc(order)], "latest_count", [session]).drop(order)
    return counted.where(F.col("latest_count") % min_new == 0).withColumn("new_messages", F.lit(min_new))


def recent(messages: DataFrame, session: str, order: str, last: int) -> DataFrame:
    """The last messages of each session, in order."""
    n = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(order)))
    return messages.withColumn("_n", n).where(F.col("_n") <= last).drop("_n")


def extracted_operation(user_text: Column) -> Column:
    """struct<op, memory_type, key, value> by rule; texts without a lasting preference give NOOP."""
    def operation(kind: str, name: str | None, key: str | None, value: str | None) -> Column:
        pairs = zip(("op", "memory_type", "key", "value"), (kind, name, key, value), strict=True)
        return F.struct(*[F.lit(v).cast("string").alias(k) for k, v in pairs])

    text = F.coalesce(user_text, F.lit(""))
    return (
        F.when(F.contains(text, F.lit("现金流")), operation("ADD", "risk_focus", "focus", "现金流风险"))
        .when(F.contains(text, F.lit("简洁")), operation("ADD", "user_preference", "report_style", "简洁"))
        .otherwise(operation("NOOP", None, None, None))
    )


def violations(op: Column, memory_type: Column, key: Column, value: Column, reason: Column) -> Column:
    """array of what an operation lacks for its kind."""
    def lacks(c: Column, name: str) -> Column:
        return F.when(F.coalesce(F.trim(c), F.lit("")) == "", name)

    need = F.when(op.isin("ADD", "UPDATE"), F.array(lacks(memory_type, "memory_type"), lacks(key, "key"), lacks(value, "value"), lacks(reason, "reason")))
    need = need.when(op == "DELETE", F.array(lacks(memory_type, "memory_type"), lacks(key, "key"), lacks(reason, "reason"), F.lit(None).cast("string")))
    return F.array_compact(F.coalesce(need, F.array().cast("array<string>")))


def fold(operations: DataFrame, identity: list[str], order: str = "pos") -> DataFrame:
    """Active memories after all operations (identity, op, value, confidence, pos): (identity, value, confidence, pos).

    ADD overwrites, also with an empty value; UPDATE keeps the value when its own is empty; DELETE deactivates;
    NOOP does nothing. The last effective operation and the value it leaves are grouped maxima over the operations
    since the last DELETE, so a busy key folds by partial aggregates and no history is gathered.
    """
    real = operations.where(F.col("op").isin("ADD", "UPDATE", "DELETE"))
    died = real.groupBy(*identity).agg(F.max(F.when(F.col("op") == "DELETE", F.col(order))).alias("died"))
    alive = real.join(died, identity).where((F.col("op") != "DELETE") & (F.col("died").isNull() | (F.col(order) > F.col("died"))))
    # an ADD sets its value; an UPDATE only if it has one; a memory that starts with an empty UPDATE is empty
    sets = (F.col("op") == "ADD") | (F.coalesce("value", F.lit("")) != "")
    out = alive.groupBy(*identity).agg(
        F.coalesce(F.max_by("value", F.when(sets, F.col(order))), F.lit("")).alias("value"), F.max_by("confidence", order).alias("confidence"), F.max(order).alias(order)
    )
    return out
