"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two grouped minima and two joins, so no node's neighbours are ever gathered in one task. The minima are
written before they are joined: both join sides are then plain shuffles, and a hub that holds a third of all links
is a skewed side, which adaptive execution splits. Rounds grow with the logarithm of the longest chain. Each round is
written to the shared folder and the one before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import drop_table, materialize


def _stars(links: DataFrame) -> DataFrame:
    both = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
    low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "low")
    stars = materialize(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "stars")
    drop_table(low)
    return stars


def _shrink(links: DataFrame) -> DataFrame:
    low = materialize(links.groupBy("a").agg(F.min("b").alias("m")), "low")
    moved = links.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    step = materialize(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
    drop_table(low)
    return step


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link to another; component is its smallest reachable node.

    Self links and nulls are ignored, repeated links count once; no links give an empty table.
    """
    links = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    links = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        stars = _stars(links)
        step = _shrink(stars)
        drop_table(stars)
        drop_table(links)
        now = step.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        links = step
        if tuple(now) == state or now[0] == 0:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        state = tuple(now)
