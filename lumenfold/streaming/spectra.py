"""Lomb-Scargle power of a stream of observations from additive sums.

Phases are counted from a fixed epoch, so the sums of a frequency only grow as
points arrive; centring happens in the projection, from the same sums.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_sums(stream: DataFrame, frequencies: list[float], epoch: float = 0.0, watermark: str | None = None) -> DataFrame:
    """Sums per (object_id, k) of a static or streaming DataFrame with object_id, t and y; for update or complete mode."""
    if watermark:
        stream = stream.withWatermark("ts", watermark)
    df = stream.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(len(frequencies) - 1)))).withColumn("f", F.get(F.array(*map(F.lit, frequencies)), F.col("k")))
    df = df.withColumn("th", F.lit(2 * math.pi) * F.col("f") * (F.col("t") - F.lit(epoch)))
    y, c, s = F.col("y"), F.cos("th"), F.sin("th")
    return df.groupBy("object_id", "k", "f").agg(
        F.count("*").alias("n"), F.sum(y).alias("y1"), F.sum(y * y).alias("y2"), F.sum(c).alias("c"), F.sum(s).alias("s"), F.sum(y * c).alias("yc"), F.sum(y * s).alias("ys"),
        F.sum(F.cos(2 * F.col("th"))).alias("c2"), F.sum(F.sin(2 * F.col("th"))).alias("s2"),
    )


def power(sums: DataFrame) -> DataFrame:
    """Floating-mean power from ``running_sums``."""
    n = F.col("n")
    c, s, m = F.col("c") / n, F.col("s") / n, F.col("y1") / n
    yc, ys, yy = F.col("yc") / n - m * c, F.col("ys") / n - m * s, F.col("y2") / n - m * m
    cc, ss, cs = (1 + F.col("c2") / n) / 2 - c * c, (1 - F.col("c2") / n) / 2 - s * s, F.col("s2") / n / 2 - c * s
    d = yy * (cc * ss - cs * cs)
    p = (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / F.nullif(d, F.lit(0.0))
    return sums.select("object_id", "k", "f", "n", F.when((n > 3) & (d > 0) & (p > 0), F.least(p, F.lit(1.0))).otherwise(F.lit(0.0)).alias("power"))


def session_groups(stream: DataFrame, gap: str = "12 hours", watermark: str = "1 day") -> DataFrame:
    """Visits: points and mean value per object and session of a timestamp column ``ts``."""
    s = stream.withWatermark("ts", watermark).groupBy("object_id", F.session_window("ts", gap).alias("visit"))
    return s.agg(F.count("*").alias("n"), F.avg("y").alias("mean"))
