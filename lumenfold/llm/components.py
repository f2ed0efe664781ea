"""Connected components of a link table by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each step
is one minimum per vertex, map-side combined, joined back to the links, so a hub
vertex is never gathered in one task. Every round is written to the shared
folder, and the one before is deleted; nothing is collected but one count and one hash sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mark, release


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(u, root) for every linked vertex that is not its component's smallest; ``links`` has long columns u and v.

    An empty table gives an empty result; loops and repeated links change nothing.
    """
    start = mark()
    now = cut(links.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(now)
    for _ in range(max_rounds if before[0] else 0):
        now = cut(small_star(large_star(now)))
        after = _state(now)
        release(links.sparkSession, start, keep=1)  # the round before
        if after == before:
            break
        before = after
    return now.select("u", F.col("v").alias("root"))
