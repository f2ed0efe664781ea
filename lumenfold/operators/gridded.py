"""Lomb-Scargle spectra of objects that no task can hold: points are gridded where they are, Spark sums the grids, and an FFT follows.

A spectrum is three sums of exponentials over an object's points, and the grid of
a sum (``nufft.spread``) is additive: an object's points are dealt to parts of about
``PART`` points, each part spreads its own and returns blocks of cells, blocks with
the same place are added up, and one FFT a slab of ``SLAB`` trials ends the search.
No task holds more than a part of the points, or three grids of one slab.

Defined results: the same powers as ``kernels.gls`` within 1e-9; objects without a
row in the grid table, without a baseline, or with one value only give power zero
or no row, as there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import kernels, nufft

#: Points of a part, trials of a slab, cells of a block that is added up at once, slabs that one call spreads to.
PART = 2_000_000
SLAB = 1 << 17
BLOCK = 1 << 13
SLABS_AT_ONCE = 2
#: Objects of more points than this go this way in ``periodogram``.
LARGE = 5_000_000
#: Points that are spread at once.
STEP = 1 << 16


def _statistics(obs: DataFrame) -> DataFrame:
    """n, first time, and weighted sums of each object, about its plain mean, so that large levels cancel no digits."""
    iv = F.when(F.col("dy").isNull(), F.lit(1.0)).otherwise(1.0 / (F.col("dy") * F.col("dy")))
    first = obs.groupBy("object_id").agg(F.count("*").alias("n"), F.min("t").alias("tmin"), F.max("t").alias("tmax"), F.avg("y").alias("level"), F.max(F.abs("y")).alias("largest"), F.bool_or(F.col("dy").isNull()).alias("plain"))
    rows = obs.join(F.broadcast(first), "object_id").withColumn("iv", F.when(F.col("plain"), 1.0).otherwise(iv)).withColumn("d", F.col("y") - F.col("level"))
    sums = rows.groupBy("object_id").agg(F.sum("iv").alias("s0"), F.sum(F.col("iv") * F.col("d")).alias("s1"), F.sum(F.col("iv") * F.col("d") * F.col("d")).alias("s2"))
    out = first.join(sums, "object_id").withColumn("mean", F.col("level") + F.col("s1") / F.col("s0"))
    return out.withColumn("yy", F.greatest(F.col("s2") / F.col("s0") - F.pow(F.col("s1") / F.col("s0"), 2), F.lit(0.0))).select("object_id", "n", "tmin", "tmax", "plain", "s0", "mean", "yy", "largest")


def spectrum(obs: DataFrame, grid: DataFrame, fit_mean: bool = True, part: int = PART, slab: int = SLAB) -> DataFrame:
    """object_id, k, f and power of every trial. ``grid`` has object_id, f0, df and nf.

    Meant for few objects of many points: tables with one row an object are broadcast.
    """
    known = _statistics(obs).join(grid.select("object_id", "f0", "df", "nf"), "object_id").where("tmax > tmin")
    known = known.withColumns({"parts": F.ceil(F.col("n") / F.lit(part)).cast("int"), "slabs": F.ceil(F.col("nf") / F.lit(slab)).cast("int")})
    points = obs.select("object_id", "t", "y", "dy", "rid").join(F.broadcast(known), "object_id")
    points = points.withColumn("part", F.pmod(F.xxhash64("rid", "t", "y"), F.col("parts")).cast("int"))
    points = points.withColumn("first", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1, F.lit(SLABS_AT_ONCE))))

    def lay(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        tau, y = pdf["t"].to_numpy(float) - r["tmin"], pdf["y"].to_numpy(float)
        w = (np.ones(len(y)) if r["plain"] else 1.0 / pdf["dy"].to_numpy(float) ** 2) / r["s0"]
        rows = []
        for s in range(int(r["first"]), min(int(r["first"]) + SLABS_AT_ONCE, int(r["slabs"]))):
            nf = min(slab, int(r["nf"]) - s * slab)
            f0, cells = r["f0"] + s * slab * r["df"], nufft.grid_size(nf)
            grids = np.zeros((3, cells), dtype=complex)
            for a in range(0, len(tau), STEP):
                b = slice(a, a + STEP)
                grids[:2] += nufft.spread(tau[b], np.stack([w[b], w[b] * (y[b] - r["mean"])]), f0, r["df"], nf)
                grids[2:] += nufft.spread(2 * tau[b], w[b], f0, r["df"], nf)
            for i in range(0, cells, BLOCK):
                rows.append((r["object_id"], s, i // BLOCK, grids[:, i : i + BLOCK].tobytes()))
        return pd.DataFrame(rows, columns=["object_id", "slab", "block", "cells"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(x, dtype=complex) for x in pdf["cells"])
        return pd.DataFrame([(pdf["object_id"].iloc[0], pdf["slab"].iloc[0], pdf["block"].iloc[0], total.tobytes())], columns=list(pdf.columns))

    def end(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        r = pdf.iloc[0]
        s = int(r["slab"])
        nf = min(slab, int(r["nf"]) - s * slab)
        k = s * slab + np.arange(nf)
        if r["yy"] <= (64 * np.finfo(float).eps * r["largest"]) ** 2:
            p = np.zeros(nf)
        else:
            once, data, twice = nufft.transform(np.concatenate([np.frombuffer(x, dtype=complex).reshape(3, -1) for x in pdf["cells"]], axis=1), nf)
            p = kernels.power_of_sums(kernels.weight_terms(once, twice, fit_mean), data, r["yy"])
        return pd.DataFrame({"object_id": r["object_id"], "k": k, "f": r["f0"] + r["df"] * k, "power": p})

    schema = "object_id string, slab int, block int, cells binary"
    laid = points.groupBy("object_id", "part", "first").applyInPandas(lay, schema)
    added = laid.groupBy("object_id", "slab", "block").applyInPandas(add, schema)
    whole = added.join(F.broadcast(known.select("object_id", "f0", "df", "nf", "yy", "largest")), "object_id")
    return whole.groupBy("object_id", "slab").applyInPandas(end, "object_id string, k long, f double, power double")


def best_periods(obs: DataFrame, grid: DataFrame, n: int = 1, separation: int = 15, part: int = PART, slab: int = SLAB) -> DataFrame:
    """The ``n`` best trials of each object, no two within ``separation`` of each other: object_id, rank, k, period, f and power."""
    # a taken trial excludes its neighbours only, so the n-th best is among that many of the highest, and of its slab's highest
    most = (n - 1) * (2 * separation - 1) + 1
    s = spectrum(obs, grid, part=part, slab=slab).withColumn("score", F.round("power", 9)).withColumn("slab", F.floor(F.col("k") / slab))
    order = Window.partitionBy("object_id", "slab").orderBy(F.col("score").desc(), "k")
    few = s.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)

    def strongest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "k"], ascending=[False, True])
        k, taken = pdf["k"].to_numpy(), []
        free = np.ones(len(k), dtype=bool)
        while len(taken) < n and free.any():
            i = int(np.argmax(free))
            taken.append(i)
            free &= np.abs(k - k[i]) >= separation
        out = pdf.iloc[taken]
        return pd.DataFrame({"object_id": out["object_id"], "rank": np.arange(1, len(out) + 1), "k": out["k"], "period": 1 / out["f"], "f": out["f"], "power": out["power"]})

    return few.groupBy("object_id").applyInPandas(strongest, "object_id string, rank long, k long, period double, f double, power double")
