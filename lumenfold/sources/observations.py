"""Observation tables: role resolution, readers, cleaning and keys.

The canonical long form is ``object_id STRING, band STRING, t DOUBLE (days),
y DOUBLE, dy DOUBLE, rid BIGINT``; ``rid`` only breaks ties.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Column names that are recognised for a role, in order of preference.
ROLES = {
    "t": ("time", "t", "jd", "hjd", "bjd", "mjd", "date", "ts"),
    "flux": ("flux", "f", "sap_flux", "pdcsap_flux", "value", "y"),
    "magnitude": ("mag", "magnitude", "m", "vmag", "gmag"),
    "dy": ("err", "error", "e", "sigma", "mag_err", "magerr", "flux_err", "fluxerr", "dy"),
    "band": ("band", "filter", "fid", "passband", "filt"),
}
#: Days from 1970-01-01 to the epoch of the driver's event times, 2024-01-01.
EPOCH_2024 = 19723.0


def resolve_roles(columns: list[str], domain: str | None = None, **given: str) -> dict[str, str]:
    """Role -> column. Explicit names win; flux names come before magnitude names unless ``domain`` is magnitude.

    The error column is looked for as ``<value>_err``, ``e_<value>``, ``d<value>`` first.
    """
    lower = {c.lower(): c for c in reversed(columns)}
    find = lambda names: next((lower[n] for n in names if n in lower), None)
    out = {role: lower[name.lower()] for role, name in given.items() if name.lower() in lower}
    out.setdefault("t", find(ROLES["t"]))
    if "y" not in out:
        kinds = ("magnitude", "flux") if domain == "magnitude" else ("flux", "magnitude")
        out["y"] = next((c for k in kinds if (c := find(ROLES[k]))), None)
    if out["t"] is None or out["y"] is None:
        raise ValueError(f"no time or value column among {columns}")
    v = out["y"].lower()
    error = find((f"{v}_err", f"{v}_error", f"e_{v}", f"d{v}")) or find(ROLES["dy"])
    for role, name in (("dy", error), ("band", find(ROLES["band"]))):
        if role not in out and name:
            out[role] = name
    return out


def infer_domain(value_column: str) -> str:
    """``flux`` or ``magnitude`` from a value column's name; magnitude if the name says nothing."""
    name = value_column.lower()
    return "flux" if name in ROLES["flux"] or any(x in name for x in ("flux", "flx", "count", "rate")) else "magnitude"


def days(column: Column, kind: str) -> Column:
    """A time column as double days: numbers as they are, timestamps as modified Julian days."""
    if kind.startswith("timestamp"):
        return F.unix_micros(column.cast("timestamp")).cast("double") / 86400e6 + 40587.0
    if kind == "date":
        return F.unix_date(column).cast("double") + 40587.0
    return column.cast("double")


def observations(df: DataFrame, object_column: str, domain: str | None = None, **roles: str) -> DataFrame:
    """Any table as canonical observations of the objects in ``object_column``."""
    names, kinds = resolve_roles(df.columns, domain, **roles), dict(df.dtypes)
    return df.select(
        F.col(object_column).cast("string").alias("object_id"),
        (F.col(names["band"]).cast("string") if "band" in names else F.lit(None).cast("string")).alias("band"),
        days(F.col(names["t"]), kinds[names["t"]]).alias("t"),
        F.col(names["y"]).cast("double").alias("y"),
        (F.col(names["dy"]).cast("double") if "dy" in names else F.lit(None).cast("double")).alias("dy"),
        F.monotonically_increasing_id().alias("rid"),
    )


def read_files(spark: SparkSession, path: str, domain: str | None = None, **roles: str) -> DataFrame:
    """Observation files by suffix (parquet, fits, csv, tsv, dat, txt and the texts' gz or bz2 forms); the object is the file's stem.

    Equal stems in different folders are told apart by the folder's name.
    """
    stem = path.lower().removesuffix(".gz").removesuffix(".bz2")
    if stem.endswith((".fits", ".fit", ".fts")):
        from .fits import read_fits

        return read_fits(spark, path, domain=domain, **roles)
    if stem.endswith((".csv", ".tsv", ".tab", ".dat", ".txt", ".ecsv")):
        sep = "," if stem.endswith((".csv", ".ecsv")) else "\t" if stem.endswith((".tsv", ".tab")) else " "
        df = spark.read.csv(path, header=True, inferSchema=True, sep=sep, comment="#", ignoreLeadingWhiteSpace=True)
        df = df.toDF(*[c.removeprefix("﻿").strip() for c in df.columns])
    else:
        df = spark.read.parquet(path)
    file = F.col("_metadata.file_path")
    named = lambda d: d.withColumn("_stem", F.regexp_extract(file, r"([^/]+?)(\.[^/.]+)*$", 1)).withColumn("_folder", F.regexp_extract(file, r"([^/]+)/[^/]+$", 1))
    # stems that clash are found from the file names alone, no observation is moved for it
    clashing = named(df).select("_stem", "_folder").distinct().groupBy("_stem").count().where("count > 1").select("_stem", F.lit(True).alias("_clash"))
    out = named(df).join(clashing, "_stem", "left")
    return observations(out.withColumn("_key", F.when(F.col("_clash"), F.concat_ws("/", "_folder", "_stem")).otherwise(F.col("_stem"))), "_key", domain, **roles)


def from_curves(spark: SparkSession, curves: Iterable[tuple]) -> DataFrame:
    """Observations of curves that are at hand in the driver: (key, t, y), (key, t, y, dy) or (key, t, y, dy, band) of equally long arrays.

    Times may be datetimes, masked or missing entries become nulls, and a repeated key becomes ``key#2``. For a few
    curves; a catalogue is read from files by tasks.
    """
    frames, met = [], Counter()
    for key, t, y, *more in curves:
        met[str(key)] += 1
        name = str(key) if met[str(key)] == 1 else f"{key}#{met[str(key)]}"
        times = np.asarray(t)
        if times.dtype.kind == "M":
            times = times.astype("datetime64[us]").astype(np.int64) / 86400e6 + 40587.0
        cols = [np.ma.filled(np.ma.asarray(x, dtype=float), np.nan) for x in (times, y, *more[:1])]
        if len({len(c) for c in cols}) != 1:
            raise ValueError(f"the arrays of {name} differ in length")
        dy = cols[2] if len(cols) > 2 else np.full(len(cols[0]), np.nan)
        frames.append(pd.DataFrame({"object_id": name, "band": str(more[1]) if len(more) > 1 else None, "t": cols[0], "y": cols[1], "dy": dy}))
    whole = pd.concat(frames, ignore_index=True) if frames else pd.DataFrame({c: [] for c in ("object_id", "band", "t", "y", "dy")})
    schema = "object_id string, band string, t double, y double, dy double"
    rows = spark.createDataFrame(whole.astype(object).where(whole.notna(), None).values.tolist(), schema) if len(whole) else spark.createDataFrame([], schema)
    return rows.withColumn("rid", F.monotonically_increasing_id())


def from_nested(df: DataFrame, object_column: str, nested: str, **fields: str) -> DataFrame:
    """One row per object with an array of structs -> canonical observations."""
    inner = df.select(F.col(object_column).alias("_object"), F.posexplode(nested).alias("_at", "_p")).select("_object", "_p.*")
    return observations(inner, "_object", **fields)


def to_nested(obs: DataFrame) -> DataFrame:
    """One row per object with its time-ordered points packed in ``points``."""
    return obs.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("t", "rid", "y", "dy", "band"))).alias("points"))


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))


def clean(obs: DataFrame) -> DataFrame:
    """Points with finite time and value, and an error that is absent or finite and positive."""
    return obs.where(_finite("t") & _finite("y") & (F.col("dy").isNull() | (_finite("dy") & (F.col("dy") > 0))))


def usable_counts(obs: DataFrame) -> DataFrame:
    """Per object: points, points with finite time and value, those whose error is usable as well, and the time these span."""
    point = _finite("t") & _finite("y")
    usable = F.when(point & _finite("dy") & (F.col("dy") > 0), F.col("t"))
    return obs.groupBy("object_id").agg(
        F.count("*").alias("n_rows"),
        F.count_if(point).alias("n_finite"),
        F.count_if(point & _finite("dy") & (F.col("dy") > 0)).alias("n_usable"),
        (F.max(usable) - F.min(usable)).alias("baseline"),
    )


def unique_keys(df: DataFrame, key: str, order: str) -> DataFrame:
    """Repeated keys become ``key#2``, ``key#3`` in the given order."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("_rn", rn).withColumn(key, F.when(F.col("_rn") == 1, F.col(key).cast("string")).otherwise(F.concat(F.col(key).cast("string"), F.lit("#"), F.col("_rn").cast("string")))).drop("_rn")


def csv_safe(c: Column) -> Column:
    """A cell that a spreadsheet would run as a formula gets a quote in front."""
    return F.when(c.rlike(r"^[=+@\t\r-]"), F.concat(F.lit("'"), c)).otherwise(c)


#: Files that a batch run writes itself; they are never its inputs.
OWN_OUTPUTS = ("results", "failures", "manifest")


def list_inputs(spark: SparkSession, inputs: str | list[str]) -> list[str]:
    """Paths from a path, a list of them, or a manifest (a .lst file with one path a line, relative to its folder); each once, own outputs left out."""
    out: dict[str, None] = {}
    for path in [inputs] if isinstance(inputs, str) else inputs:
        if path.endswith(".lst"):
            folder = path.rsplit("/", 1)[0] if "/" in path else "."
            names = [r.value.strip() for r in spark.read.text(path).collect()]  # one line a file, not a row a point
            out.update((n if "://" in n or n.startswith("/") else f"{folder}/{n}", None) for n in names if n and not n.startswith("#"))
        else:
            out[path] = None
    return [p for p in out if p.rstrip("/").rsplit("/", 1)[-1] not in OWN_OUTPUTS]


def read_inputs(spark: SparkSession, inputs: str | list[str], domain: str | None = None, **roles: str) -> DataFrame:
    """Observations of all inputs. Inputs of one kind are read together; ``source`` is the path that a row came from."""
    kinds: dict[str, list[str]] = {}
    for p in list_inputs(spark, inputs):
        kinds.setdefault(p.lower().removesuffix(".gz").removesuffix(".bz2").rsplit(".", 1)[-1], []).append(p)
    if not kinds:
        raise ValueError("no inputs")
    parts = [read_files(spark, p, domain, **roles).withColumn("source", F.lit(p)) for paths in kinds.values() for p in paths]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.withColumn("rid", F.monotonically_increasing_id())


def classify_sink(sink: str | None) -> str:
    """memory (none given), file (a table format by suffix) or directory."""
    if sink is None:
        return "memory"
    return "file" if sink.lower().rsplit("/", 1)[-1].endswith((".csv", ".csv.gz", ".tsv")) else "directory"


def write_rows(rows: DataFrame, sink: str | None, mode: str = "errorifexists") -> DataFrame:
    """Rows as Parquet below a directory, as one CSV folder of safe cells for a file sink, or as they are; returns what is there."""
    kind = classify_sink(sink)
    if kind == "memory":
        return rows
    if kind == "directory":
        rows.write.mode(mode).parquet(sink)
        return rows.sparkSession.read.parquet(sink)
    safe = rows.select(*[csv_safe(F.col(c)).alias(c) if k == "string" else F.col(c) for c, k in rows.dtypes])
    sep = "\t" if sink.lower().endswith(".tsv") else ","
    safe.write.mode(mode).csv(sink, header=True, sep=sep, compression="gzip" if sink.lower().endswith(".gz") else "none")
    return rows.sparkSession.read.csv(sink, header=True, sep=sep, schema=safe.schema)
