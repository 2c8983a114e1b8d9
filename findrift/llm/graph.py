"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over the links; the links stay in the cluster and
only their number and a checksum come to the driver, to see whether a round changed anything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star step over links (u, v): neighbours move to the least one around."""
    if large:
        sides = pairs.select("u", "v").unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        return sides.join(least, "u").where("v > u and v <> m").select(F.col("m").alias("u"), "v").distinct()
    down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return (
        moved.where("v <> m").select(F.col("m").alias("u"), "v").unionAll(moved.select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """Links (u long, v long) to (node, root): the least node reachable, for nodes that have a link.

    Links of a node with itself and repeated links don't matter; nulls are ignored.
    """
    pairs = checkpoint(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        pairs = checkpoint(_star(_star(pairs, True), False))
    nodes = pairs.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return nodes.unionAll(pairs.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()
