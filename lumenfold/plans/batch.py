"""Catalogue runs into resumable sinks.

A sink is a folder with the request's manifest (one JSON row), a Parquet
dataset of results, and one of failures. A resumed run skips finished
(object, method) pairs with an anti join, may add methods, and refuses changed
settings. Spark's commit protocol keeps half-written parts out of the dataset.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import grids, kernels, prewhitening
from ..sources import observations


def _manifest(spark: SparkSession, sink: str) -> dict | None:
    try:
        return json.loads(spark.read.json(f"{sink}/manifest").first()["request"])
    except AnalysisException:
        return None


def _results(spark: SparkSession, sink: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{sink}/results")  # a damaged part fails the run; nothing is searched again without a word
    except AnalysisException:
        return None


def check_request(stored: dict | None, methods: list[str], settings: dict) -> dict:
    """The merged request; changed settings of a stored one are refused."""
    if stored and stored["settings"] != settings:
        raise ValueError(f"the sink was made with other settings: {stored['settings']}")
    return {"methods": sorted({*methods, *(stored or {}).get("methods", [])}), "settings": settings}


def failures(obs: DataFrame, min_points: int = 4) -> DataFrame:
    """Objects that cannot be searched, and why."""
    n = observations.usable_counts(obs.withColumn("dy", F.coalesce("dy", F.lit(1.0))))
    reason = F.when(F.col("n_finite") == 0, "no finite point").when(F.col("n_usable") == 0, "no usable error").when(F.col("n_usable") < min_points, "too few points").when(F.col("baseline") <= 0, "no time baseline")
    return n.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("object_id", "reason")


def run(obs: DataFrame, methods: list[str], sink: str, nf: int | None = None, n_best: int = 3, min_points: int = 4) -> DataFrame:
    """Best periods of all objects by all methods, appended to ``sink``; returns everything the sink holds.

    Each object is searched on the method's automatic grid, or on ``nf`` trials. Objects that cannot be searched are listed under failures.
    """
    spark = obs.sparkSession
    settings = {"nf": nf, "n_best": n_best, "min_points": min_points}
    request = check_request(_manifest(spark, sink), methods, settings)
    spark.createDataFrame([(json.dumps(request, sort_keys=True),)], "request string").coalesce(1).write.mode("overwrite").json(f"{sink}/manifest")
    bad = failures(obs, min_points)
    bad.write.mode("overwrite").parquet(f"{sink}/failures")
    usable = observations.clean(obs).join(bad, "object_id", "left_anti")
    for method in methods:
        done, todo = _results(spark, sink), usable
        if done is not None:
            todo = usable.join(done.where(F.col("method") == method).select("object_id").distinct(), "object_id", "left_anti")
        grid = None if nf else grids.default_grid(todo, method, oversized="skip")
        found = kernels.best_periods(todo, method, nf, n_best, grid=grid)
        if grid is not None:
            grids.without_trials(todo, grid).withColumn("reason", F.concat(F.lit(f"{method}: "), "reason")).write.mode("append").parquet(f"{sink}/failures")
        found.withColumn("method", F.lit(method)).write.mode("append").partitionBy("method").parquet(f"{sink}/results")
    return _results(spark, sink)


def prewhiten_run(obs: DataFrame, sink: str, chunks: int = 1, only: list[int] | None = None, **settings) -> DataFrame:
    """Components of all objects (``prewhitening.prewhiten``), appended to ``sink`` chunk by chunk; resumable.

    Rows say how many their object has; an object is done when its newest attempt holds as many. Others are done again,
    and only the newest attempt is returned. ``only``: the chunks (objects by a hash of their name) to do in this call.
    """
    spark = obs.sparkSession
    request = check_request(_manifest(spark, sink), ["prewhiten"], settings)
    spark.createDataFrame([(json.dumps(request, sort_keys=True),)], "request string").coalesce(1).write.mode("overwrite").json(f"{sink}/manifest")
    schema = f"{prewhitening.COMPONENTS}, of long, attempt long"

    def newest() -> DataFrame | None:
        try:
            rows = spark.read.schema(schema).parquet(f"{sink}/components")
        except AnalysisException:
            return None
        return rows.join(rows.groupBy("object_id").agg(F.max("attempt").alias("attempt")), ["object_id", "attempt"])

    for chunk in range(chunks) if only is None else only:
        rows, todo, attempt = newest(), obs.where(F.pmod(F.xxhash64("object_id"), F.lit(chunks)) == chunk), 0
        if rows is not None:
            attempt = (rows.agg(F.max("attempt")).first()[0] or 0) + 1
            todo = todo.join(rows.groupBy("object_id").agg(F.count("*").alias("n"), F.max("of").alias("of")).where("n = of").select("object_id"), "object_id", "left_anti")
        found = prewhitening.prewhiten(todo, **settings).withColumn("of", F.count("*").over(Window.partitionBy("object_id"))).withColumn("attempt", F.lit(attempt).cast("long"))
        found.write.mode("append").parquet(f"{sink}/components")
    return newest().drop("of", "attempt")


def merge(existing: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Existing rows win; rows with new keys are added; columns of both are kept."""
    fresh = new.join(existing.select(*keys).distinct(), list(keys), "left_anti")
    return existing.unionByName(fresh, allowMissingColumns=True)


def with_seeds(objects: DataFrame, seeds: DataFrame, default: float) -> DataFrame:
    """Each object's seed period from a keyed table, or the default."""
    return objects.join(seeds.select("object_id", F.col("period").alias("_seed")), "object_id", "left").withColumn("seed", F.coalesce("_seed", F.lit(default))).drop("_seed")
