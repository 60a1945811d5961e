"""Queries on conversations: compliance, grounding, memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import compliance as C
from factloom.operators import memory as M
from factloom.plans.registry import query, table

#: The fixtures are European prose, so the queries scan for words that occur in it.
LEXICON = (("determiner", "rewrite", ("for the", "the")), ("advice", "refuse", ("sell", "que la")), ("promise", "rewrite", ("under", "mente")))


def _category(keywords: tuple[str, ...]) -> str:
    tests = (f"WHEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_]){k}($|[^\\p{{L}}\\p{{N}}_])') THEN '{k}'" if k.isalpha() else f"WHEN contains(t, '{k}') THEN '{k}'" for k in keywords)
    return f"CASE {' '.join(tests)} END"


SCANNED = f"""
low AS (SELECT conv_id, turn, text, lower(coalesce(text, '')) AS t FROM conversations),
scanned AS (SELECT *, {_category(LEXICON[0][2])} AS k1, {_category(LEXICON[1][2])} AS k2, {_category(LEXICON[2][2])} AS k3 FROM low)
"""


@query("compliance_scan", f"WITH {SCANNED} SELECT conv_id, turn, CASE WHEN k2 IS NOT NULL THEN 'refuse' WHEN k1 IS NOT NULL OR k3 IS NOT NULL THEN 'rewrite' ELSE 'allow' END AS action, concat_ws(',', k1, k2, k3) AS keywords FROM scanned")
def compliance_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", C.hits(F.col("text"), LEXICON).alias("h"))
    return s.select("conv_id", "turn", C.action(F.col("h")).alias("action"), F.array_join(F.transform("h", lambda x: x["keyword"]), ",").alias("keywords"))


@query(
    "compliance_apply",
    f"""
WITH {SCANNED}, r AS (SELECT *, CASE WHEN k1 IS NULL THEN text ELSE replace(text, k1, '{C.REMOVED}') END AS one FROM scanned)
SELECT conv_id, turn, CASE WHEN k2 IS NOT NULL THEN '{C.BLOCKED}' WHEN k1 IS NULL AND k3 IS NULL THEN text
  ELSE CASE WHEN k3 IS NULL THEN one ELSE replace(one, k3, '{C.REMOVED}') END || '{C.NOTICE}' END AS shown FROM r
""",
)
def compliance_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", C.hits(F.col("text"), LEXICON).alias("h"))
    return s.select("conv_id", "turn", C.applied(F.col("text"), F.col("h")).alias("shown"))


#: What is put before each turn's own text, in turn; and which of the texts are bad answers, by hand.
ANSWERS = (("The report DOES  not contain it. ", True), ("报告中没有该数据", True), ("Verified, but insufficient. ", False), ("verified ", False), ("verified / insufficient: ", True), ("", False), ("核心发现与证据缺口", True), ("No datab", False))


@query("bad_answer_detect", "SELECT conv_id, turn, turn % 8 IN (0, 1, 4, 6) OR regexp_matches(text, '(?i)does\\s+not\\s+contain|not\\s+included|\\bno\\s+data\\b') AS ungrounded FROM conversations")
def bad_answer_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.element_at(F.array(*[F.lit(t) for t, _ in ANSWERS]), (F.col("turn") % len(ANSWERS) + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", C.ungrounded(F.concat(lead, F.coalesce("text", F.lit("")))).alias("ungrounded"))


@query("recent_messages", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.recent(table(spark, sf_dir, "conversations"), "conv_id", "turn", 6).select("conv_id", "turn", "role")


@query("message_watermark_trigger", "SELECT conv_id, CAST(n AS INTEGER) AS latest_count, 4 AS new_messages FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n % 4 = 0")
def message_watermark_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.triggers(table(spark, sf_dir, "conversations"))


OPS = """
ops AS (SELECT conv_id % 20 AS user_id, role AS memory_type, CASE turn % 4 WHEN 0 THEN 'ADD' WHEN 1 THEN 'UPDATE' WHEN 2 THEN CASE WHEN conv_id % 3 = 0 THEN 'DELETE' ELSE 'UPDATE' END ELSE 'NOOP' END AS op,
  CASE WHEN (conv_id + turn) % 3 = 0 THEN '' ELSE 'v' || (conv_id * 10 + turn) END AS value, turn / 10.0 AS confidence, conv_id * 100 + turn AS pos FROM conversations)
"""


@query(
    "memory_fold",
    f"""
WITH {OPS}, d AS (SELECT user_id, memory_type, max(pos) FILTER (op = 'DELETE') AS died FROM ops GROUP BY ALL),
a AS (SELECT o.* FROM ops o JOIN d USING (user_id, memory_type) WHERE op IN ('ADD', 'UPDATE') AND (died IS NULL OR pos > died))
SELECT user_id, memory_type, coalesce(arg_max(value, pos) FILTER (op = 'ADD' OR value <> ''), '') AS value, round(arg_max(confidence, pos), 2)::DOUBLE AS confidence, max(pos) AS pos FROM a GROUP BY ALL
""",
)
def memory_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = F.col("conv_id"), F.col("turn")
    op = F.when(t % 4 == 0, "ADD").when(t % 4 == 1, "UPDATE").when(t % 4 == 2, F.when(c % 3 == 0, "DELETE").otherwise("UPDATE")).otherwise("NOOP")
    value = F.when((c + t) % 3 == 0, "").otherwise(F.concat(F.lit("v"), (c * 10 + t).cast("string")))
    ops = table(spark, sf_dir, "conversations").select((c % 20).alias("user_id"), F.col("role").alias("memory_type"), op.alias("op"), value.alias("value"), F.round(t / 10.0, 2).alias("confidence"), (c * 100 + t).alias("pos"))
    return M.fold(ops, ["user_id", "memory_type"])
