"""``python -m lumenfold INPUT SINK --methods gls,pdm``: a catalogue run over observation files."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .plans import batch
from .sources import observations


def main() -> None:
    p = argparse.ArgumentParser(prog="lumenfold", description=__doc__)
    p.add_argument("input", help="file, folder or glob of observations")
    p.add_argument("sink", help="folder of the resumable results")
    p.add_argument("--methods", default="gls", help="comma-separated")
    p.add_argument("--nf", type=int, default=1000, help="trial frequencies")
    p.add_argument("--object", help="column of the object; by default one object per file")
    p.add_argument("--domain", choices=("flux", "magnitude"))
    a = p.parse_args()
    spark = SparkSession.builder.appName("lumenfold").getOrCreate()
    obs = observations.observations(spark.read.parquet(a.input), a.object, a.domain) if a.object else observations.read_files(spark, a.input, a.domain)
    batch.run(obs, a.methods.split(","), a.sink, a.nf).groupBy("method").count().show()


if __name__ == "__main__":
    main()
