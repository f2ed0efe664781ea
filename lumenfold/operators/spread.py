"""How grouped kernels are dealt to tasks: by work (points times trials), not by bytes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points times trials aimed at per task, and the most tasks of one call.
WORK = 100_000_000
MOST_TASKS = 200_000
#: Rows of points beside trials that a task holds.
ROWS = 1_000_000
#: Objects in a task of grouped calls.
OBJECTS = 100
#: Objects that a call takes together in ``in_blocks``, and points from which it takes no more.
BLOCK = 64
BLOCK_POINTS = 200_000
#: Fixed value: an automatic grid has about this many trials for each point of its object (5 samples a peak up to 2.5 N/T).
TRIALS_PER_POINT = 12.5

# The C library gives freed memory back beyond twice the largest piece that it has seen freed, and that is little in a
# new worker: a kernel's arrays were mapped and cleared anew for each chunk of trials. After 24 MB it keeps up to 48.
np.empty(3 << 20)


def tasks(total: float, parallelism: int, work: float = WORK) -> int:
    """Tasks for a total of points times trials: every core has some, and none has much more than ``work``."""
    return int(min(max(total / work, 2 * parallelism, 1), MOST_TASKS))


def estimated_work(obs: DataFrame, nf: int | None = None) -> float:
    """Points times trials of all objects; without ``nf``, on grids of the usual size. One count by object, no sort and no grid."""
    n = obs.groupBy("object_id").agg(F.count("*").cast("double").alias("n"))
    return float(n.agg(F.sum(F.col("n") * (nf or TRIALS_PER_POINT * F.col("n")))).first()[0] or 0.0)


def deal(df: DataFrame, total: float, *keys: str | Column) -> DataFrame:
    """``df`` hashed by keys to tasks for that much work. A stated number of partitions is kept: adaptive execution joins small partitions by bytes, and a curve of a few kB may be seconds of work."""
    return df.repartition(tasks(total, df.sparkSession.sparkContext.defaultParallelism), *keys)


def deal_trials(obs: DataFrame, nf: int) -> DataFrame:
    """Points hashed by object for plans that put a row a trial beside each: a task has ROWS such rows or so, whatever the size of the table, and fits its aggregates and sorts in memory."""
    return obs.repartition(tasks(float(obs.count()) * nf, obs.sparkSession.sparkContext.defaultParallelism, ROWS), "object_id")


def deal_objects(df: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """``df`` hashed by object for grouped calls that take far longer than their bytes tell: as many tasks as shuffles have partitions here, two a core at least, and none is joined to others.

    With ``counted``, a table of the same objects that is cheap to read, there is also a task for every OBJECTS of them, so that the longest task does not grow with the table.
    """
    spark = df.sparkSession
    n = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if counted is not None:
        n = min(max(n, math.ceil(counted.agg(F.approx_count_distinct("object_id")).first()[0] / OBJECTS)), MOST_TASKS)
    return df.repartition(n, "object_id")


def in_blocks(dealt: DataFrame, run: Callable[[list[pd.DataFrame]], pd.DataFrame], schema: str, block: int = BLOCK) -> DataFrame:
    """``run`` on the frames of up to ``block`` objects at once, for points dealt by object: small steps of many objects cost little more than those of one.

    A task's points are sorted by object and streamed, so it holds the points of a block and not those of its objects.
    """

    def whole(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []  # the points so far of the last object
        for pdf in frames:
            key = pdf["object_id"].to_numpy(object)
            ends = np.flatnonzero(key[1:] != key[:-1]) + 1
            if held and len(key) and held[-1]["object_id"].iloc[-1] != key[0]:
                ends = np.r_[0, ends]
            if len(ends):
                cuts = np.r_[0, ends]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    yield pd.concat([*held, pdf.iloc[a:b]]) if held else pdf.iloc[a:b]
                    held = []
                pdf = pdf.iloc[ends[-1] :]
            if len(pdf):
                held.append(pdf)
        if held:
            yield pd.concat(held) if len(held) > 1 else held[0]

    def stream(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        objects: list[pd.DataFrame] = []
        for one in whole(frames):
            objects.append(one)
            if len(objects) == block or sum(map(len, objects)) >= BLOCK_POINTS:
                yield run(objects)
                objects = []
        if objects:
            yield run(objects)

    return dealt.sortWithinPartitions("object_id").mapInPandas(stream, schema)
