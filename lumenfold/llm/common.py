"""Shared helpers: the cluster's shared folder, lineage cuts, text constants."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of every word definition here: space and U+0009..U+000D.
SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_local_dirs: dict[str, str] = {}
#: Folders that ``cut`` made and nobody released, oldest first.
_cuts: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names, in a folder of the running application.

    Only a local master may run without that setting; it then gets a temporary
    folder of its own. A cluster without it is refused, as its executors do not
    see each other's local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_dirs.setdefault("base", "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return f"{base.rstrip('/')}/lumenfold-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: computed once, no lineage.

    The table stays until ``release``: what is derived from it is computed later.
    """
    path = shared_dir(df.sparkSession)
    _cuts.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the list of stored tables, for ``release``."""
    return len(_cuts)


def release(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Deletes the stored tables made after ``mark`` gave ``since``, but for the last ``keep``. Nothing may read them any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    end = len(_cuts) - keep
    for path in _cuts[since:end]:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(conf).delete(folder, True)
    del _cuts[since:end]


def ascii_lower(text: Column) -> Column:
    """Only A-Z become lower case. Pure-ASCII texts take the built-in's fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def content_key(*columns: str | Column) -> tuple[Column, Column]:
    """Two hashes, 128 bits together, of some columns of a row; a null differs from any value and from a null in another place."""
    parts = [x for c in (F.col(c) if isinstance(c, str) else c for c in columns) for x in (c.isNull(), c)]
    return F.xxhash64(F.lit(1), *parts), F.xxhash64(F.lit(2), *parts, F.lit(3))
