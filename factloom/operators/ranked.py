"""Extraction from the best chunks first, a chunk a group a round, until a group has what it asked for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.search import cosine
from factloom.operators.selection import in_families
from factloom.sources.staging import staged

#: Words that a chunk needs to be looked at, and the most chunks of a group.
FINANCIAL = "研发|利润|收入|费用|资产|负债|现金流|净利|营收|成本|损益|每股收益|毛利率|净利率|产能|产量|销量"
MOST_ROUNDS = 10


def candidates(groups: DataFrame, chunks: DataFrame, by: str = "task_id", most: int = MOST_ROUNDS, score: Column | None = None) -> DataFrame:
    """(by, chunk_id, text, round): a group's chunks with a financial word, best cosine to its vector first, ties by `pos`."""
    met = chunks.where(F.col("text").rlike(FINANCIAL)).join(groups.select(by, F.col("vector").alias("_asked")), by)
    met = met.withColumn("_score", F.coalesce(cosine(F.col("_asked"), F.col("vector")) if score is None else score, F.lit(0.0)))
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("_score"), "pos"))
    return met.withColumn("round", place).where(F.col("round") <= most).select(by, "chunk_id", "text", "round")


def ranked_extraction(groups: DataFrame, chunks: DataFrame, extract: Callable[[DataFrame], DataFrame], by: str = "task_id", most: int = MOST_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(facts, attempts) of groups (by, vector, wanted, strict) over chunks (by, chunk_id, text, vector, pos).

    `extract` gives facts (by, chunk_id, metric_name, claim, ...) of chunks. A round hands it the next chunk of every group that is still
    open; groups close when a fact fits (strict ones with families: one of these families; others: any fact) or run out
    of chunks. The open groups are a table that shrinks from round to round, so no group costs more rounds than it needs
    and none is looped over on the driver. attempts: (by, attempts, matched).
    """
    frontier = staged(candidates(groups, chunks, by, most), "candidates")
    open_ = staged(groups.select(by, "wanted", "strict").join(frontier.select(by).distinct(), by, "left_semi"), "open")
    facts, closed = None, None
    for r in range(1, most + 1):
        if open_.isEmpty():
            break
        now = frontier.where(F.col("round") == r).join(open_.select(by), by, "left_semi")
        got = staged(extract(now.select(by, "chunk_id", "text")).withColumn("round", F.lit(r)), "round")
        facts = got if facts is None else facts.unionByName(got)
        fits = F.when(F.col("strict") & (F.size("wanted") > 0), in_families(F.col("metric_name"), F.col("claim"), F.col("wanted"))).otherwise(True)
        hit = got.join(open_, by).where(fits).select(by).distinct().withColumn("matched", F.lit(True))
        tried = now.select(by).join(hit, by, "left").select(by, F.lit(r).alias("attempts"), F.coalesce("matched", F.lit(False)).alias("matched"))
        tried = staged(tried, "tried")
        closed = tried if closed is None else closed.unionByName(tried)
        # groups without a chunk for the next round close as they are
        more = frontier.where(F.col("round") == r + 1).select(by)
        open_ = staged(open_.join(tried.where("matched"), by, "left_anti").join(more, by, "left_semi"), "open")
    if facts is None:
        facts = extract(frontier.select(by, "chunk_id", "text")).withColumn("round", F.lit(0))
        closed = groups.select(by, F.lit(0).alias("attempts"), F.lit(False).alias("matched")).limit(0)
    ends = closed.groupBy(by).agg(F.max("attempts").alias("attempts"), F.bool_or("matched").alias("matched"))
    attempts = groups.select(by).join(ends, by, "left").select(by, F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("matched", F.lit(False)).alias("matched"))
    return facts, attempts
