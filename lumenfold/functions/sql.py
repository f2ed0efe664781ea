"""SQL functions over packed light curves: ``ls_power`` and ``best_period`` on arrays, for nested tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf


def register(spark: SparkSession) -> None:
    """Registers ``ls_power(t, y, f0, df, nf)`` -> array<double> and ``best_period(t, y, nf, method)`` -> double."""
    from ..operators import kernels

    def curve(t, y):
        ok = np.isfinite(t := np.asarray(t, float)) & np.isfinite(y := np.asarray(y, float))
        t, y = t[ok], y[ok]
        order = np.argsort(t, kind="stable")
        return (t[order] - t.min(initial=np.inf), y[order]) if len(t) > 3 else None

    @pandas_udf("array<double>")
    def ls_power(t: pd.Series, y: pd.Series, f0: pd.Series, df: pd.Series, nf: pd.Series) -> pd.Series:
        out = []
        for a, b, start, step, n in zip(t, y, f0, df, nf, strict=True):
            c = curve(a, b)
            out.append(np.full(int(n), np.nan) if c is None else kernels.gls(c[0], c[1], None, start + step * np.arange(int(n))))
        return pd.Series(out)

    @pandas_udf("double")
    def best_period(t: pd.Series, y: pd.Series, nf: pd.Series, method: pd.Series) -> pd.Series:
        out = []
        for a, b, n, m in zip(t, y, nf, method, strict=True):
            c = curve(a, b)
            if c is None or c[0][-1] <= 0:
                out.append(np.nan)
                continue
            f = 1 / c[0][-1] + np.arange(int(n)) / (5 * c[0][-1])
            p = kernels.METHODS[m](c[0], c[1], None, f)
            out.append(1 / f[int(np.argmin(p) if m in kernels.MINIMISED else np.argmax(p))])
        return pd.Series(out, dtype=float)

    spark.udf.register("ls_power", ls_power)
    spark.udf.register("best_period", best_period)


def register_table_function(spark: SparkSession, name: str = "periodogram") -> None:
    """Registers the table function ``periodogram(TABLE(points) PARTITION BY (object_id), method[, what[, n]])``.

    ``points`` has columns t and y and may have dy and object_id, which is returned; ``what`` is 'best' (rank, k, period,
    f and power of the ``n`` best periods, 3 by default) or 'spectrum' (k, f and power of
    all trials), which decides the result's columns. Trials as ``methods.local_trials``.
    All methods that are registered at this time can be called; partitions of under four
    usable points, or without a baseline, give no row.
    """
    from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, udtf
    from pyspark.sql.types import DoubleType, LongType, StructType

    from ..operators import methods

    known = {m: methods.get(m) for m in methods.names()}
    also = dict(methods._ALSO)

    class Periodogram:
        def __init__(self) -> None:
            self.points: list[tuple[float, float, float]] = []
            self.arguments, self.key = ("gls", "best", 3), ()

        @staticmethod
        def analyze(points: AnalyzeArgument, method: AnalyzeArgument, what: AnalyzeArgument | None = None, n: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not points.isTable or not {"t", "y"} <= {f.name for f in points.dataType.fields}:
                raise ValueError("the first argument is a table with columns t and y")
            if not method.isConstantExpression:
                raise ValueError("the method is a constant")
            key = methods.normal(str(method.value))
            if also.get(key, key) not in known:
                raise ValueError(f"unknown method {method.value!r}; there are {', '.join(known)}")
            kind = "best" if what is None else str(what.value)
            if kind not in ("best", "spectrum"):
                raise ValueError("the third argument is 'best' or 'spectrum'")
            first = StructType([f for f in points.dataType.fields if f.name == "object_id"])
            schema = first.add("rank", LongType()).add("k", LongType()).add("period", DoubleType()) if kind == "best" else first.add("k", LongType())
            return AnalyzeResult(schema.add("f", DoubleType()).add("power", DoubleType()))

        def eval(self, points, method: str, what: str = "best", n: int = 3) -> None:
            self.arguments = (method, what, n)
            row = points.asDict()
            self.key = (row["object_id"],) if "object_id" in row else ()
            if row["t"] is not None and row["y"] is not None:
                self.points.append((float(row["t"]), float(row["y"]), float(row["dy"]) if row.get("dy") is not None else np.nan))

        def terminate(self):
            method, what, n = self.arguments
            m = known[also.get(methods.normal(method), methods.normal(method))]
            p = np.array(self.points, dtype=float).reshape(-1, 3)
            p = p[np.isfinite(p[:, :2]).all(axis=1)]
            p = p[np.argsort(p[:, 0], kind="stable")]
            f = methods.local_trials(p[:, 0]) if len(p) > 3 else np.zeros(0)
            if len(f):
                power = m.kernel(p[:, 0] - p[0, 0], p[:, 1], p[:, 2] if np.isfinite(p[:, 2]).all() else None, f)
                if what == "best":
                    for r, k in enumerate(m.peaks(f, power, n)):
                        yield *self.key, r + 1, k, float(1 / f[k]), float(f[k]), float(power[k])
                else:
                    yield from ((*self.key, k, x, p) for k, (x, p) in enumerate(zip(f.tolist(), power.tolist(), strict=True)))

    spark.udtf.register(name, udtf(Periodogram))
