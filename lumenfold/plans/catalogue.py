"""Registered period-analysis queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import physics
from ..functions import sql as sql_functions
from ..operators import box_search, boxes, constrained, drift, ephemeris, gridded, grids, kernels, light_time, models, multiband, natural_fit, peaks, period_change, prewhitening, readouts, spacing, spectra, tracking, transit_search, variation, windows
from ..operators import methods as search_methods
from ..operators import period_laws as law_fits
from ..sources import observations as obs_source
from ..streaming import spectra as streaming
from . import batch
from . import period_changes as catalogue_of_changes

#: table -> object, time, value, band, row number
SERIES = {
    "events": ("user_id", "ts", "value", "event_type", "event_id"),
    "lineitem": ("l_suppkey", "l_shipdate", "l_extendedprice", "l_returnflag", "l_orderkey * 10 + l_linenumber"),
    "orders": ("o_custkey", "o_orderdate", "o_totalprice", "o_orderpriority", "o_orderkey"),
}
NF = 100


def series(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A driver table as observations; days since 2024-01-01 and a derived error."""
    key, t, y, band, rid = SERIES[name]
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    days = F.unix_micros(F.col(t).cast("timestamp")).cast("double") / F.lit(86400000000.0) - F.lit(obs_source.EPOCH_2024)
    value = F.col(y).cast("double")
    return df.select(F.col(key).cast("string").alias("object_id"), F.col(band).alias("band"), days.alias("t"), value.alias("y"), (F.lit(0.1) + F.lit(0.01) * value).alias("dy"), F.expr(rid).cast("long").alias("rid"))


def emit(df: DataFrame, keys: str, numbers: str, digits: int = 6) -> DataFrame:
    """Whole-number and text keys as they are (long, string), numbers rounded; -0 becomes 0."""
    kinds = dict(df.dtypes)
    cols = [F.col(c) if kinds[c] == "string" else F.col(c).cast("long").alias(c) for c in keys.split()]
    return df.select(*cols, *[(F.round(c, digits) + F.lit(0.0)).alias(c) for c in numbers.split()])


def _obs_sql(name: str = "events") -> str:
    key, t, y, band, rid = SERIES[name]
    return f"obs AS (SELECT CAST({key} AS VARCHAR) AS object_id, {band} AS band, epoch_us({t})::DOUBLE / 86400000000::DOUBLE - 19723::DOUBLE AS t, {y}::DOUBLE AS y, 0.1::DOUBLE + 0.01::DOUBLE * {y}::DOUBLE AS dy, {rid} AS rid FROM {name})"


def _r(c: str, digits: int = 6) -> str:
    return f"round({c}, {digits}) + 0::DOUBLE"


def _centred(weighted: bool, by: str = "object_id", src: str = "obs", over: str = "object_id") -> str:
    raw = "1::DOUBLE / (dy * dy)" if weighted else "1::DOUBLE"
    return (
        f"c0 AS (SELECT *, min(t) OVER (PARTITION BY {over}) AS tmin, max(t) OVER (PARTITION BY {over}) - min(t) OVER (PARTITION BY {over}) AS baseline, count(*) OVER (PARTITION BY {by}) AS n, {raw} AS w0 FROM {src}), "
        f"c1 AS (SELECT *, sum(w0) OVER (PARTITION BY {by}) AS wsum, w0 / sum(w0) OVER (PARTITION BY {by}) AS w, t - tmin AS tau FROM c0), "
        f"c2 AS (SELECT *, y - sum(w * y) OVER (PARTITION BY {by}) AS yc FROM c1), "
        f"cent AS (SELECT * FROM (SELECT *, sum(w * yc * yc) OVER (PARTITION BY {by}) AS yy FROM c2) WHERE baseline > 0)"
    )


def _grid(nf: int = NF, src: str = "cent") -> str:
    return f"grid AS (SELECT {src}.*, r.k, 1::DOUBLE / baseline + r.k * (1::DOUBLE / (5::DOUBLE * baseline)) AS f FROM {src}, range({nf}) r(k))"


def _trig(by: str = "object_id, k", src: str = "grid", tau: str = "tau") -> str:
    th = f"(6.283185307179586::DOUBLE * f * {tau})"
    return (
        f"trig AS (SELECT {by}, min(f) AS f, min(yy) AS yy, min(n) AS n, min(baseline) AS baseline, min(wsum) AS wsum, sum(w * cos{th}) AS c, sum(w * sin{th}) AS s, "
        f"sum(w * yc * cos{th}) AS yc_, sum(w * yc * sin{th}) AS ys_, sum(w * cos(2 * {th})) AS c2, sum(w * sin(2 * {th})) AS s2 FROM {src} GROUP BY {by})"
    )


def _power(fit_mean: bool = True) -> str:
    c, s = ("c", "s") if fit_mean else ("0::DOUBLE", "0::DOUBLE")
    cc, ss, cs = f"((1 + c2) / 2 - {c} * {c})", f"((1 - c2) / 2 - {s} * {s})", f"(s2 / 2 - {c} * {s})"
    d = f"(yy * ({cc} * {ss} - {cs} * {cs}))"
    p = f"(({ss} * yc_ * yc_ + {cc} * ys_ * ys_ - 2 * {cs} * yc_ * ys_) / {d})"
    return f"CASE WHEN yy > 0 AND abs({d}) > 1e-12 * yy AND {p} > 0 THEN least({p}, 1) ELSE 0 END"


def _gls_sql(weighted: bool = True, fit_mean: bool = True, name: str = "events", nf: int = NF) -> str:
    return f"WITH {_obs_sql(name)}, {_centred(weighted)}, {_grid(nf)}, {_trig()}, spec AS (SELECT object_id, k, f, {_power(fit_mean)} AS power, n, baseline FROM trig)"


_PHASE = "tau / (1::DOUBLE / f) - floor(tau / (1::DOUBLE / f))"


def _pdm_sql(by: str = "object_id", nf: int = NF) -> str:
    return (
        f"{_centred(False, by)}, {_grid(nf)}, fine AS (SELECT *, least(greatest(floor(({_PHASE}) * 30), 0), 29)::BIGINT AS b FROM grid), "
        f"hist AS (SELECT {by}, k, b, min(f) AS f, min(yy) AS yy, min(n) AS n, count(*) AS m, sum(yc) AS sy, sum(yc * yc) AS syy FROM fine GROUP BY {by}, k, b), "
        f"coarse AS (SELECT {by}, k, c, ((b + c) % 30) // 3 AS j, min(f) AS f, min(yy) AS yy, min(n) AS n, sum(m) AS m, sum(sy) AS sy, sum(syy) AS syy FROM hist, range(3) q(c) GROUP BY {by}, k, c, ((b + c) % 30) // 3), "
        f"th AS (SELECT {by}, k, min(f) AS f, min(yy) AS yy, min(n) AS n, sum(syy - sy * sy / m) AS ssd, count(*) AS filled FROM coarse GROUP BY {by}, k), "
        f"spec AS (SELECT {by}, k, f, n, CASE WHEN yy * n / (n - 1) <= 0 THEN 1 WHEN n * 3 - filled <= 0 THEN 'inf'::DOUBLE ELSE ssd / (n * 3 - filled) / (yy * n / (n - 1)) END AS power FROM th WHERE n > 1)"
    )


def _ce_sql(by: str = "object_id", nf: int = NF) -> str:
    return (
        f"{_centred(False, by)}, lev AS (SELECT *, CASE WHEN hi > lo THEN least(greatest(floor((y - lo) / (hi - lo) * 10), 0), 9) ELSE 0 END::BIGINT AS i FROM (SELECT *, min(y) OVER (PARTITION BY {by}) AS lo, max(y) OVER (PARTITION BY {by}) AS hi FROM cent)), "
        f"{_grid(nf, 'lev')}, cells AS (SELECT {by}, k, i, least(greatest(floor(({_PHASE}) * 10), 0), 9)::BIGINT AS j, min(f) AS f, min(n) AS n, count(*) AS m FROM grid GROUP BY ALL), "
        f"tot AS (SELECT *, sum(m) OVER (PARTITION BY {by}, k, j) AS mj FROM cells), spec AS (SELECT {by}, k, min(f) AS f, min(n) AS n, sum(m * ln(mj::DOUBLE / m)) / min(n) AS power FROM tot GROUP BY {by}, k)"
    )


def _sl_sql(by: str = "object_id", nf: int = NF) -> str:
    return (
        f"{_centred(False, by)}, lev AS (SELECT *, CASE WHEN hi > lo THEN (y - lo) / (hi - lo) * 0.5::DOUBLE - 0.25::DOUBLE ELSE 0 END AS m FROM (SELECT *, min(y) OVER (PARTITION BY {by}) AS lo, max(y) OVER (PARTITION BY {by}) AS hi FROM cent)), "
        f"{_grid(nf, 'lev')}, ph AS (SELECT *, {_PHASE} AS phi FROM grid), "
        f"seg AS (SELECT {by}, k, f, n, phi - coalesce(lag(phi) OVER w, last_value(phi) OVER v - 1) AS dphi, m - coalesce(lag(m) OVER w, last_value(m) OVER v) AS dm FROM ph WINDOW w AS (PARTITION BY {by}, k ORDER BY phi, rid), v AS (PARTITION BY {by}, k ORDER BY phi, rid ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), "
        f"spec AS (SELECT {by}, k, min(f) AS f, min(n) AS n, sum(sqrt(dphi * dphi + dm * dm)) AS power FROM seg GROUP BY {by}, k)"
    )


_MAXIMA = "maxima AS (SELECT * FROM (SELECT *, lag(power) OVER (PARTITION BY object_id ORDER BY k) AS pv, lead(power) OVER (PARTITION BY object_id ORDER BY k) AS nx FROM spec) WHERE (pv IS NULL OR power > pv) AND (nx IS NULL OR power >= nx) AND (pv IS NOT NULL OR nx IS NOT NULL))"
_TOP = (
    "cand AS (SELECT object_id, k, f, power, row_number() OVER (PARTITION BY object_id ORDER BY -round(power, 9), k) AS i FROM maxima), "
    "walk AS (SELECT object_id, i, [k] AS ks, true AS took FROM cand WHERE i = 1 UNION ALL SELECT c.object_id, c.i, "
    "CASE WHEN len(w.ks) < 3 AND list_min(list_transform(w.ks, lambda x: abs(x - c.k))) >= 15 THEN list_append(w.ks, c.k) ELSE w.ks END, len(w.ks) < 3 AND list_min(list_transform(w.ks, lambda x: abs(x - c.k))) >= 15 "
    "FROM walk w JOIN cand c ON c.object_id = w.object_id AND c.i = w.i + 1), "
    "top AS (SELECT c.object_id, row_number() OVER (PARTITION BY c.object_id ORDER BY c.i) AS rank, c.k, c.f, c.power FROM walk w JOIN cand c USING (object_id, i) WHERE w.took)"
)


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _bins_sql(n_bins: int, nf: int) -> str:
    return (
        f"b0 AS (SELECT *, 1::DOUBLE / (dy * dy) AS iv, min(t) OVER g AS tmin, max(t) OVER g - min(t) OVER g AS baseline FROM obs WINDOW g AS (PARTITION BY object_id)), "
        f"b1 AS (SELECT *, t - tmin AS tau, y - sum(iv * y) OVER g / sum(iv) OVER g AS yc FROM b0 WINDOW g AS (PARTITION BY object_id)), cent AS (SELECT * FROM b1 WHERE baseline > 0), {_grid(nf)}, "
        f"hist AS (SELECT object_id, k, least(floor(({_PHASE}) * {n_bins}), {n_bins - 1})::BIGINT AS b, min(1::DOUBLE / f) AS p, sum(iv * yc) AS a, sum(iv) AS iv FROM grid GROUP BY ALL), "
        f"frame AS (SELECT object_id, k, min(p) AS p, sum(a) AS a_all, sum(iv) AS iv_all FROM hist GROUP BY object_id, k), "
        f"bins AS (SELECT fr.object_id, fr.k, q.b, fr.p, a_all, iv_all, coalesce(h.a, 0) AS a, coalesce(h.iv, 0) AS iv FROM frame fr CROSS JOIN range({n_bins}) q(b) LEFT JOIN hist h ON h.object_id = fr.object_id AND h.k = fr.k AND h.b = q.b)"
    )


_BLS = (
    "wrapped AS (SELECT * FROM bins UNION ALL SELECT * REPLACE (b + 50 AS b) FROM bins WHERE b < 5), "
    + ", ".join(f"x{w} AS (SELECT * FROM (SELECT *, sum(a) OVER f{w} AS sa, sum(iv) OVER f{w} AS si, {w} AS width FROM wrapped WINDOW f{w} AS (PARTITION BY object_id, k ORDER BY b ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)) WHERE b < 50)" for w in (1, 2, 5))
    + ", box0 AS (SELECT * FROM x1 UNION ALL SELECT * FROM x2 UNION ALL SELECT * FROM x5), box AS (SELECT *, (a_all - sa) / (iv_all - si) - sa / si AS depth FROM box0 WHERE si > 1e-9 * iv_all AND iv_all - si > 1e-9 * iv_all), "
    "sn AS (SELECT *, depth / sqrt(1 / si + 1 / (iv_all - si)) AS snr FROM box WHERE depth >= 0), best AS (SELECT *, row_number() OVER (PARTITION BY object_id, k ORDER BY -round(snr, 6), width, b) AS rn FROM sn) "
)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(map(str, r)) + ")" for r in rows)


def _tls_sql() -> str:
    t = [(w, j, f"{round(g, 9)}::DOUBLE") for w in (2, 4, 6) for j, g in enumerate(boxes.limb_darkened(w))]
    return (
        f"tpl(width, j, g) AS (VALUES {_values(t)}), s0 AS (SELECT object_id, k, width, (b - j + 64) % 64 AS start, min(p) AS p, min(iv_all) AS iv_all, sum(g * a) AS num, sum(g * iv) AS cw, sum(g * g * iv) AS den FROM bins, tpl GROUP BY ALL), "
        "s1 AS (SELECT *, den - cw * cw / iv_all AS d FROM s0), s2 AS (SELECT *, num * num / d AS sr, -num / d AS depth FROM s1 WHERE num < 0 AND den > 1e-300 AND d > 1e-9 * den), "
        "best AS (SELECT *, row_number() OVER (PARTITION BY object_id, k ORDER BY -round(sr, 6), width, start) AS rn FROM s2) "
    )


Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and its SQL under a name."""

    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _spectrum_query(name: str, build: Callable[[DataFrame], DataFrame], sql: str, numbers: str = "f power", source: str = "events") -> None:
    out = ", ".join(f"{_r(c)} AS {c}" for c in numbers.split())
    query(name, f"{sql} SELECT object_id, k, {out} FROM spec")(lambda s, d: emit(build(series(s, d, source)), "object_id k", numbers))


_spectrum_query("gls_weighted", lambda o: spectra.gls(o, NF), _gls_sql())
_spectrum_query("gls_unweighted", lambda o: spectra.gls(o, NF, True, False), _gls_sql(False))
_spectrum_query("gls_fixed_mean", lambda o: spectra.gls(o, NF, False, True), _gls_sql(True, False))
_spectrum_query("gls_lattice_times", lambda o: spectra.gls(o, 40), _gls_sql(name="lineitem", nf=40), source="lineitem")
_spectrum_query("spectral_window", lambda o: spectra.spectral_window(o, NF), f"WITH {_obs_sql()}, {_centred(False)}, {_grid()}, {_trig()}, spec AS (SELECT object_id, k, f, sqrt(c * c + s * s) AS power FROM trig)")
_LS = "(((1 + c2) / 2) * ((1 - c2) / 2) - (s2 / 2) * (s2 / 2))"
_spectrum_query(
    "amplitude_spectrum",
    lambda o: spectra.amplitude_spectrum(o, NF),
    f"WITH {_obs_sql()}, {_centred(False)}, {_grid()}, {_trig()}, ab AS (SELECT *, CASE WHEN abs({_LS}) > 1e-9 THEN (yc_ * (1 - c2) / 2 - ys_ * s2 / 2) / {_LS} ELSE 0 END AS a, CASE WHEN abs({_LS}) > 1e-9 THEN (ys_ * (1 + c2) / 2 - yc_ * s2 / 2) / {_LS} ELSE 0 END AS b FROM trig), spec AS (SELECT object_id, k, f, sqrt(a * a + b * b) AS amplitude FROM ab)",
    "f amplitude",
)
_spectrum_query("dft_amplitude", lambda o: spectra.amplitude_spectrum(o, NF, False), f"WITH {_obs_sql()}, {_centred(False)}, {_grid()}, {_trig()}, spec AS (SELECT object_id, k, f, 2 * sqrt(yc_ * yc_ + ys_ * ys_) AS amplitude FROM trig)", "f amplitude")
_spectrum_query("aov_one_harmonic", lambda o: spectra.aov(o, NF), _gls_sql(False).replace("spec AS", "gl AS") + ", spec AS (SELECT object_id, k, f, (power / 2) / (greatest(1 - power, 1e-12) / (n - 3)) AS power FROM gl WHERE n > 3)")
_spectrum_query("pdm", lambda o: spectra.pdm(o, NF), f"WITH {_obs_sql()}, {_pdm_sql()}")
_spectrum_query("conditional_entropy", lambda o: spectra.conditional_entropy(o, NF), f"WITH {_obs_sql()}, {_ce_sql()}")
_spectrum_query("string_length", lambda o: spectra.string_length(o, NF), f"WITH {_obs_sql()}, {_sl_sql()}")
_PAIR = ("object_id", "band")
_POOL = ", pool AS (SELECT object_id, k, min(f) AS f, sum({w} * power) / sum({w}) AS power FROM {src} WHERE {w} > 0 GROUP BY object_id, k)"
_spectrum_query("multiband_pdm", lambda o: spectra.pooled(spectra.pdm(o, 40, by=_PAIR).where("n >= 12"), F.greatest(F.col("n") - 10, F.lit(1))), f"WITH {_obs_sql()}, {_pdm_sql('object_id, band', 40).replace('spec AS', 'sp AS')}, sq AS (SELECT * FROM sp WHERE n >= 12)" + _POOL.format(w="greatest(n - 10, 1)", src="sq").replace("pool AS", "spec AS"))
_spectrum_query("multiband_entropy", lambda o: spectra.pooled(spectra.conditional_entropy(o, 40, by=_PAIR).where("n >= 10"), F.col("n")), f"WITH {_obs_sql()}, {_ce_sql('object_id, band', 40).replace('spec AS', 'sp AS')}, sq AS (SELECT * FROM sp WHERE n >= 10)" + _POOL.format(w="n", src="sq").replace("pool AS", "spec AS"))
_spectrum_query("multiband_string_length", lambda o: spectra.pooled(spectra.string_length(o, 40, by=_PAIR).where("n >= 8"), F.col("n")), f"WITH {_obs_sql()}, {_sl_sql('object_id, band', 40).replace('spec AS', 'sp AS')}, sq AS (SELECT * FROM sp WHERE n >= 8)" + _POOL.format(w="n", src="sq").replace("pool AS", "spec AS"))
_spectrum_query("gls_per_band", lambda o: spectra.gls_per_band(o, 40), f"WITH {_obs_sql()}, {_centred(True, 'object_id, band')}, {_grid(40)}, {_trig('object_id, band, k')}, sp AS (SELECT object_id, k, f, yy * wsum AS wt, {_power()} AS power FROM trig)" + _POOL.format(w="wt", src="sp").replace("pool AS", "spec AS"))
_OFF = "(cc * ss - cs * cs)"
_spectrum_query(
    "gls_shared_offsets",
    lambda o: spectra.gls_offsets(o, 40),
    f"WITH {_obs_sql()}, {_centred(True, 'object_id, band')}, tot AS (SELECT object_id, sum(w0) AS wall FROM cent GROUP BY object_id), ce AS (SELECT cent.* REPLACE (w * wsum / wall AS w, yy * wsum / wall AS yy, wsum / wall AS wsum) FROM cent JOIN tot USING (object_id)), {_grid(40, 'ce')}, {_trig('object_id, band, k')}, "
    "o AS (SELECT object_id, k, min(f) AS f, sum(yy) AS yy, sum((wsum + c2) / 2 - c * c / wsum) AS cc, sum((wsum - c2) / 2 - s * s / wsum) AS ss, sum(s2 / 2 - c * s / wsum) AS cs, sum(yc_) AS y1, sum(ys_) AS y2 FROM trig GROUP BY object_id, k), "
    f"spec AS (SELECT object_id, k, f, CASE WHEN yy > 0 AND abs(yy * {_OFF}) > 1e-12 * yy AND (ss * y1 * y1 + cc * y2 * y2 - 2 * cs * y1 * y2) / (yy * {_OFF}) > 0 THEN least((ss * y1 * y1 + cc * y2 * y2 - 2 * cs * y1 * y2) / (yy * {_OFF}), 1) ELSE 0 END AS power FROM o)",
)


#: The automatic grid of Lomb-Scargle searches; none of the driver's event times lie on a lattice, whole days do.
_AUTO = (
    "st AS (SELECT object_id, count(*) AS n, max(t) - min(t) AS baseline FROM obs GROUP BY object_id HAVING max(t) > min(t)), "
    "ag AS (SELECT object_id, 1::DOUBLE / baseline AS f0, 1::DOUBLE / (5::DOUBLE * baseline) AS df, 2.5::DOUBLE * n / baseline AS fmax, floor((2.5::DOUBLE * n / baseline - 1::DOUBLE / baseline) / (1::DOUBLE / (5::DOUBLE * baseline)) + 0.5 - 1e-6)::BIGINT + 1 AS nf, n, baseline FROM st)"
)


def _auto_sql(weighted: bool = True) -> str:
    grid = "grid AS (SELECT cent.*, r.k, f0 + r.k * df AS f FROM (SELECT cent.*, f0, df, nf FROM cent JOIN ag USING (object_id)) cent, LATERAL (SELECT unnest(range(nf)) AS k) r)"
    return f"WITH {_obs_sql()}, {_AUTO}, {_centred(weighted)}, {grid}, {_trig()}, spec AS (SELECT object_id, k, f, {_power()} AS power, n, baseline FROM trig)"


@query("gls_best_period", f"{_auto_sql()}, b AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY -round(power, 9), k) AS rn FROM spec) SELECT object_id, k, {_r('f')} AS f, {_r('power')} AS power, {_r('1::DOUBLE / f')} AS period FROM b WHERE rn = 1")
def gls_best_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(kernels.periodogram(series(spark, sf_dir), "gls"), "object_id k", "f power period")


@query("gls_short_grid_best", f"{_gls_sql()}, b AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY -round(power, 9), k) AS rn FROM spec) SELECT object_id, k, {_r('f')} AS f, {_r('power')} AS power, {_r('1::DOUBLE / f')} AS period FROM b WHERE rn = 1")
def gls_short_grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(peaks.best_peak(spectra.gls(series(spark, sf_dir), NF)), "object_id k", "f power period")


@query("default_grid_gls", f"WITH {_obs_sql()}, {_AUTO} SELECT object_id, n, nf, {_r('f0')} AS f0, {_r('df', 9)} AS df, {_r('fmax')} AS fmax FROM ag")
def default_grid_gls(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = grids.gls_grid(series(spark, sf_dir))
    return emit(g, "object_id n nf", "f0 fmax").join(g.select("object_id", (F.round("df", 9) + F.lit(0.0)).alias("df")), "object_id")


_VISITS = (
    "gp AS (SELECT *, t - lag(t) OVER w AS gap FROM obs WINDOW w AS (PARTITION BY object_id ORDER BY t, rid)), gm AS (SELECT *, quantile_cont(CASE WHEN gap > 0 THEN gap END, 0.5) OVER (PARTITION BY object_id) AS mg FROM gp), "
    "gv AS (SELECT *, CASE WHEN gap > 10 * mg THEN 1 ELSE 0 END AS nw FROM gm), vi AS (SELECT *, sum(nw) OVER (PARTITION BY object_id ORDER BY t, rid ROWS UNBOUNDED PRECEDING) AS visit FROM gv), vs AS (SELECT *, count(*) OVER (PARTITION BY object_id, visit) AS size FROM vi), "
    "stt AS (SELECT object_id, visit, min(t) AS st FROM vs GROUP BY ALL), sg AS (SELECT object_id, st - lag(st) OVER (PARTITION BY object_id ORDER BY visit) AS b FROM stt), vg AS (SELECT object_id, quantile_cont(b, 0.5) FILTER (WHERE b > 0) AS vgap FROM sg GROUP BY object_id), "
    "pn AS (SELECT object_id, count(*) AS n, max(t) - min(t) AS baseline, min(mg) AS mg, count(*) FILTER (WHERE gap > 0) AS gaps, count(*) FILTER (WHERE nw = 0 AND gap > 0 AND size <= 10) AS inside FROM vs GROUP BY object_id), "
    "fm AS (SELECT object_id, n, baseline, CASE WHEN gaps = 0 THEN 5::DOUBLE WHEN 2.5::DOUBLE / mg * baseline <= 100000 OR inside * 2 < gaps THEN 2.5::DOUBLE / mg ELSE least(2.5::DOUBLE / mg, greatest(100000::DOUBLE / baseline, coalesce(2.5::DOUBLE / vgap, 0))) END AS fmax FROM pn JOIN vg USING (object_id))"
)


@query("default_grid_fold", f"WITH {_obs_sql('lineitem')}, {_VISITS} SELECT object_id, n, greatest(ceil((fmax - 1 / baseline) * 5::DOUBLE * baseline) + 1, 1)::BIGINT AS nf, {_r('1 / baseline')} AS f0, {_r('fmax')} AS fmax FROM fm WHERE baseline > 0 AND fmax > 1 / baseline")
def default_grid_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(grids.fold_grid(series(spark, sf_dir, "lineitem")), "object_id n nf", "f0 fmax")


@query("visit_ceiling", f"WITH obs AS (SELECT CAST(user_id AS VARCHAR) AS object_id, floor((epoch_us(ts)::DOUBLE / 86400000000::DOUBLE - 19723::DOUBLE) * 2) / 2 + (event_id % 3) * 1e-5::DOUBLE AS t, event_id AS rid FROM events), {_VISITS} SELECT object_id, n, {_r('fmax', 4)} AS fmax FROM fm")
def visit_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times pulled together to half days with triplets of exposures."""
    o = series(spark, sf_dir).withColumn("t", F.floor(F.col("t") * 2) / 2 + (F.col("rid") % 3) * F.lit(1e-5))
    return emit(grids.pseudo_nyquist(o), "object_id n", "fmax", 4)


_LATTICE = (
    "gp AS (SELECT *, t - lag(t) OVER w AS gap FROM obs WINDOW w AS (PARTITION BY object_id ORDER BY t, rid)), gm AS (SELECT *, quantile_cont(CASE WHEN gap > 0 THEN gap END, 0.5) OVER (PARTITION BY object_id) AS mg FROM gp), "
    "dv AS (SELECT object_id, d, avg(CASE WHEN abs(gap * d / mg - round(gap * d / mg)) <= 0.01 THEN 1::DOUBLE ELSE 0 END) AS share, count(*) AS gaps FROM gm, range(1, 11) q(d) WHERE gap > 0 GROUP BY object_id, d), "
    "ch AS (SELECT object_id, min(d) AS d FROM dv WHERE gaps >= 8 AND share >= 0.9 GROUP BY object_id), "
    "ix AS (SELECT gm.object_id, t - min(t) OVER (PARTITION BY gm.object_id) AS o, d, sum(coalesce(round(gap * d / mg), 0)) OVER (PARTITION BY gm.object_id ORDER BY t, rid ROWS UNBOUNDED PRECEDING) AS i FROM gm JOIN ch USING (object_id)), "
    "ft AS (SELECT object_id, min(d) AS d, regr_slope(o, i) AS step, regr_intercept(o, i) AS c FROM ix GROUP BY object_id), "
    "co AS (SELECT ix.object_id, min(ft.d) AS d, min(step) AS step, sqrt(avg(cos(6.283185307179586::DOUBLE * (o - c - step * i) / step)) ^ 2 + avg(sin(6.283185307179586::DOUBLE * (o - c - step * i) / step)) ^ 2) AS coherence FROM ix JOIN ft USING (object_id) WHERE step > 0 GROUP BY ix.object_id)"
)


@query("lattice_nyquist", f"WITH {_obs_sql('lineitem')}, {_LATTICE} SELECT object_id, d AS divisor, {_r('step')} AS step, {_r('coherence')} AS coherence, {_r('0.5::DOUBLE / step')} AS nyquist FROM co WHERE coherence >= 0.9")
def lattice_nyquist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(grids.lattice_nyquist(series(spark, sf_dir, "lineitem")), "object_id divisor", "step coherence nyquist")


@query("box_segments", f"WITH {_obs_sql()}, s AS (SELECT object_id, max(t) - min(t) AS b, least(100::DOUBLE, (max(t) - min(t)) / 2) AS pm FROM obs GROUP BY object_id), g AS (SELECT object_id, segment, b, 0.2::DOUBLE * pow(2::DOUBLE, segment) AS p_lo, least(0.4::DOUBLE * pow(2::DOUBLE, segment), pm) AS p_hi FROM s, range(12) q(segment) WHERE pm > 0.2 AND segment <= ceil(ln(pm / 0.2) / ln(2::DOUBLE) - 1e-9) - 1) SELECT object_id, segment, ceil((1 / p_lo - 1 / p_hi) / (0.05::DOUBLE / (2 * b)))::BIGINT AS nf, {_r('p_lo')} AS p_lo, {_r('p_hi')} AS p_hi FROM g")
def box_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(grids.box_segments(series(spark, sf_dir)), "object_id segment nf", "p_lo p_hi")


@query("transit_grid", f"WITH {_obs_sql()}, s AS (SELECT object_id, count(*) AS n, max(t) - min(t) AS b, least(100::DOUBLE, (max(t) - min(t)) / 2) AS pm FROM obs GROUP BY object_id) SELECT object_id, n, ceil((2::DOUBLE - 1 / pm) / (0.02::DOUBLE / (2 * b)))::BIGINT AS nf, {_r('1 / pm')} AS f0 FROM s WHERE pm > 0.5")
def transit_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(grids.transit_grid(series(spark, sf_dir)), "object_id n nf", "f0")


@query("log_periods", f"WITH {_obs_sql()}, o AS (SELECT DISTINCT object_id FROM obs) SELECT object_id, k, {_r('exp(ln(0.5::DOUBLE) + k * (ln(20::DOUBLE) - ln(0.5::DOUBLE)) / 24)')} AS period FROM o, range(25) q(k)")
def log_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(grids.log_periods(series(spark, sf_dir), 0.5, 20.0, 25), "object_id k", "period")


def _auto_best(method: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = series(spark, sf_dir)
        return emit(kernels.best_periods(o, method, grid=grids.gls_grid(o)), "object_id k", "period f power")

    return f


def _auto_fold_sql(spec_sql: str, smallest: bool = True) -> str:
    body = spec_sql.replace("FROM cent, range(100) r(k)", "FROM (SELECT cent.*, nf FROM cent JOIN ag USING (object_id)) cent, LATERAL (SELECT unnest(range(nf)) AS k) r").replace("FROM lev, range(100) r(k)", "FROM (SELECT lev.*, nf FROM lev JOIN ag USING (object_id)) lev, LATERAL (SELECT unnest(range(nf)) AS k) r")
    body = body.replace(f"WITH {_obs_sql()}, ", f"WITH {_obs_sql()}, {_AUTO}, ", 1)
    sign = "" if smallest else "-"
    return f"{body}, b AS (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY {sign}round(power, 9), k) AS rn FROM spec) SELECT object_id, k, {_r('1 / f')} AS period, {_r('f')} AS f, {_r('power')} AS power FROM b WHERE rn = 1"


query("auto_best_pdm", _auto_fold_sql(f"WITH {_obs_sql()}, {_pdm_sql()}"))(_auto_best("pdm"))
query("auto_best_ce", _auto_fold_sql(f"WITH {_obs_sql()}, {_ce_sql()}"))(_auto_best("ce"))
query("auto_best_sl", _auto_fold_sql(f"WITH {_obs_sql()}, {_sl_sql()}"))(_auto_best("sl"))
query("auto_best_mhaov")(_auto_best("mhaov"))


@query("local_maxima", f"{_gls_sql()}, {_MAXIMA} SELECT object_id, k, {_r('power')} AS power FROM maxima")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(peaks.local_maxima(spectra.gls(series(spark, sf_dir), NF)), "object_id k", "power")


@query("top_peaks", _recursive(f"{_gls_sql()}, {_MAXIMA}, {_TOP} SELECT object_id, rank, k, {_r('f')} AS f, {_r('power')} AS power FROM top"))
def top_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(peaks.top_peaks(spectra.gls(series(spark, sf_dir), NF)), "object_id rank k", "f power")


@query("wide_rows", _recursive(f"{_gls_sql()}, {_MAXIMA}, {_TOP} SELECT object_id, " + ", ".join(f"{_r(f'max(CASE WHEN rank = {r} THEN 1::DOUBLE / f END)')} AS period_{r}, {_r(f'max(CASE WHEN rank = {r} THEN power END)')} AS power_{r}" for r in (1, 2, 3)) + " FROM top GROUP BY object_id"))
def wide_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(peaks.wide_rows(peaks.top_peaks(spectra.gls(series(spark, sf_dir), NF))), "object_id", "period_1 power_1 period_2 power_2 period_3 power_3")


def _related_sql(x: str, y: str) -> str:
    """peaks.alias_related within 0.01."""
    close = lambda a, b, m=1: f"abs({a} - {b}) <= {m} * 0.01::DOUBLE"
    tests = [close(x, y)] + [t for m in range(2, 9) for t in (close(x, f"{m} * {y}", m), close(f"{m} * {x}", y, m))]
    tests += [t for day, _ in peaks.CLASSIC_WINDOW[:2] for m in (1, 2) for t in (close(x, f"({y} + {m} * {day}::DOUBLE)"), close(x, f"abs({y} - {m} * {day}::DOUBLE)"))]
    year = f"{peaks.CLASSIC_WINDOW[3][0]}::DOUBLE"
    return " OR ".join([*tests, close(x, f"({y} + {year})"), close(x, f"({y} - {year})")])


_FREE = f"len(w.fs) < 3 AND len(list_filter(w.fs, lambda y: {_related_sql('c.f', 'y')})) = 0"
_DIVERSE = _TOP.replace("[k] AS ks", "[f] AS fs").replace("CASE WHEN len(w.ks) < 3 AND list_min(list_transform(w.ks, lambda x: abs(x - c.k))) >= 15 THEN list_append(w.ks, c.k) ELSE w.ks END", f"CASE WHEN {_FREE} THEN list_append(w.fs, c.f) ELSE w.fs END").replace("len(w.ks) < 3 AND list_min(list_transform(w.ks, lambda x: abs(x - c.k))) >= 15 FROM", f"{_FREE} FROM")


@query("diverse_peaks", _recursive(f"{_gls_sql()}, {_MAXIMA}, {_DIVERSE} SELECT object_id, rank, k, {_r('f')} AS f, {_r('power')} AS power FROM top"))
def diverse_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(peaks.diverse_peaks(spectra.gls(series(spark, sf_dir), NF)), "object_id rank k", "f power")


@query("downsampled_spectrum", f"{_gls_sql()}, b AS (SELECT *, k * 20 // 100 AS bin FROM spec), c AS (SELECT *, row_number() OVER (PARTITION BY object_id, bin ORDER BY -round(power, 9), k) AS rn FROM b) SELECT object_id, bin, k, {_r('f')} AS f, {_r('power')} AS power FROM c WHERE rn = 1")
def downsampled_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(peaks.downsample(spectra.gls(series(spark, sf_dir), NF)), "object_id bin k", "f power")


@query("refined_peaks", f"{_gls_sql()}, n AS (SELECT *, lag(power) OVER w AS a, lead(power) OVER w AS c, lead(f) OVER w - f AS df FROM spec WINDOW w AS (PARTITION BY object_id ORDER BY k)) SELECT object_id, k, {_r('f + CASE WHEN a - 2 * power + c <> 0 THEN 0.5::DOUBLE * (a - c) / (a - 2 * power + c) ELSE 0 END * df')} AS f_refined FROM n WHERE power > a AND power >= c AND power > 0.05")
def refined_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(peaks.refined(spectra.gls(series(spark, sf_dir), NF)).where("power > 0.05"), "object_id k", "f_refined")


@query("detection_efficiency", f"{_gls_sql()} SELECT object_id, k, {_r('(power - avg(power) OVER w) / nullif(stddev_pop(power) OVER w, 0)')} AS sde FROM spec WINDOW w AS (PARTITION BY object_id)")
def detection_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(peaks.detection_efficiency(spectra.gls(series(spark, sf_dir), NF)), "object_id k", "sde")


@query(
    "noise_level",
    f"WITH {_obs_sql()}, {_centred(False)}, {_grid()}, {_trig()}, spec AS (SELECT object_id, k, f, 2 * sqrt(yc_ * yc_ + ys_ * ys_) AS amplitude FROM trig) SELECT object_id, k, {_r('avg(amplitude) OVER w')} AS noise, count(amplitude) OVER w AS n_noise FROM spec WINDOW w AS (PARTITION BY object_id ORDER BY f RANGE BETWEEN 0.51::DOUBLE PRECEDING AND 0.51::DOUBLE FOLLOWING)",
)
def noise_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(peaks.noise_level(spectra.amplitude_spectrum(series(spark, sf_dir), NF, False), 0.51), "object_id k n_noise", "noise")


@query(
    "alias_matches",
    f"{_gls_sql()}, {_MAXIMA}, best AS (SELECT object_id, f FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY -round(power, 9), k) AS rn FROM spec) WHERE rn = 1), "
    f"fw(fw, name) AS (VALUES {', '.join(f'({v}::DOUBLE, {chr(39)}{n}{chr(39)})' for v, n in peaks.CLASSIC_WINDOW)}), "
    "cand AS (SELECT object_id, name || ' ' || sg || m AS kind, abs(f + (sg || '1')::BIGINT * m * fw) AS predicted FROM best, fw, (VALUES (1), (2)) ms(m), (VALUES ('+'), ('-')) ss(sg) UNION ALL SELECT object_id, 'harmonic ' || h, f * h FROM best, (VALUES (2), (3)) hs(h) UNION ALL SELECT object_id, 'subharmonic ' || h, f / h FROM best, (VALUES (2), (3)) hs(h)), "
    "j AS (SELECT c.object_id, kind, predicted, m.f AS f_peak, power, row_number() OVER (PARTITION BY c.object_id, kind ORDER BY round(abs(m.f - predicted), 9), m.f) AS rn FROM cand c JOIN maxima m ON m.object_id = c.object_id AND abs(m.f - predicted) <= 3::DOUBLE / baseline) "
    f"SELECT object_id, kind, {_r('predicted')} AS predicted, {_r('f_peak')} AS f_peak, {_r('power')} AS power FROM j WHERE rn = 1",
)
def alias_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectra.gls(series(spark, sf_dir), NF)
    return emit(peaks.match_aliases(s, peaks.alias_candidates(peaks.best_peak(s))), "object_id kind", "predicted f_peak power")


_TOP5 = _TOP.replace("len(w.ks) < 3", "len(w.ks) < 5").replace(">= 15", ">= 3")
_VECTORS = ", ".join(f"({a}, {b})" for a in range(-2, 3) for b in range(-2, 3) if (a or b) and abs(a) + abs(b) > 1)


@query(
    "component_combinations",
    _recursive(
        f"{_gls_sql()}, {_MAXIMA}, {_TOP5}, pr AS (SELECT a.object_id, a.rank AS r1, a.f AS f1, b.rank AS r2, b.f AS f2 FROM top a JOIN top b ON a.object_id = b.object_id AND a.rank < b.rank UNION ALL SELECT object_id, rank, f, rank, 0::DOUBLE FROM top), "
        f"v(n1, n2) AS (VALUES {_VECTORS}), h AS (SELECT c.object_id, c.rank, c.f, r1, r2, n1, n2, n1 * f1 + n2 * f2 AS value FROM top c JOIN pr ON pr.object_id = c.object_id AND r1 < c.rank AND r2 < c.rank, v WHERE (r1 <> r2 OR n2 = 0) AND abs(n1 * f1 + n2 * f2 - c.f) <= 0.02), "
        f"o AS (SELECT *, row_number() OVER (PARTITION BY object_id, rank ORDER BY abs(n1) + abs(n2), round(abs(value - f), 9), r1, r2, n1, n2) AS rn FROM h) SELECT object_id, rank, r1, r2, n1, n2, {_r('f')} AS f, {_r('value')} AS value FROM o WHERE rn = 1"
    ),
)
def component_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = peaks.top_peaks(spectra.gls(series(spark, sf_dir), NF), n=5, separation=3)
    return emit(peaks.combinations(top, 0.02), "object_id rank r1 r2 n1 n2", "f value")


@query("bls_box_search", f"WITH {_obs_sql()}, {_bins_sql(50, 20)}, {_BLS} SELECT object_id, k, width, {_r('p', 5)} AS p, {_r('snr', 5)} AS power FROM best WHERE rn = 1")
def bls_box_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(boxes.bls(series(spark, sf_dir)), "object_id k width", "p power", 5)


@query("tls_transit_search", f"WITH {_obs_sql()}, {_bins_sql(64, 10)}, {_tls_sql()} SELECT object_id, k, width, {_r('p', 5)} AS p, {_r('sr', 4)} AS power FROM best WHERE rn = 1")
def tls_transit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = boxes.tls(series(spark, sf_dir), nf=10)
    return df.select("object_id", F.col("k").cast("long").alias("k"), F.col("width").cast("long").alias("width"), (F.round("p", 5) + F.lit(0.0)).alias("p"), (F.round("power", 4) + F.lit(0.0)).alias("power"))


@query("object_statistics", f"WITH {_obs_sql('orders')} SELECT object_id, count(*) AS n, {_r('min(t)')} AS tmin, {_r('max(t) - min(t)')} AS baseline, {_r("avg(y)")} AS mean, {_r("stddev_samp(y)")} AS std FROM obs GROUP BY object_id")
def object_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectra.object_stats(series(spark, sf_dir, "orders"))
    return s.select("object_id", "n", *[(F.round(c, d) + F.lit(0.0)).alias(c) for c, d in (("tmin", 6), ("baseline", 6), ("mean", 6), ("std", 6))])


@query("cleaned_points", f"WITH {_obs_sql()}, d AS (SELECT *, CASE WHEN rid % 7 = 0 THEN -1::DOUBLE WHEN rid % 11 = 0 THEN 'nan'::DOUBLE ELSE dy END AS e FROM obs) SELECT object_id, count(*) AS n_rows, count(*) AS n_finite, count(*) FILTER (WHERE e > 0 AND NOT isnan(e)) AS n_usable FROM d GROUP BY object_id")
def cleaned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("rid") % 7 == 0, F.lit(-1.0)).when(F.col("rid") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("dy"))
    return emit(obs_source.usable_counts(series(spark, sf_dir).withColumn("dy", bad)), "object_id n_rows n_finite n_usable", "")


@query("magnitudes", f"WITH {_obs_sql()} SELECT object_id, rid, {_r('CASE WHEN y > 0 THEN -2.5::DOUBLE * log10(y) + 25 END')} AS mag, {_r('CASE WHEN y > 0 THEN 1.0857362047581296::DOUBLE * dy / y END')} AS mag_err, {_r('CASE WHEN y > 0 THEN pow(10::DOUBLE, -0.4::DOUBLE * (-2.5::DOUBLE * log10(y) + 25 - 25)) END', 4)} AS flux FROM obs")
def magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series(spark, sf_dir).withColumn("mag", physics.magnitude(F.col("y"), 25.0)).withColumn("mag_err", physics.magnitude_error(F.col("y"), F.col("dy")))
    out = emit(df.withColumn("flux", physics.flux(F.col("mag"), 25.0)), "object_id rid", "mag mag_err flux")
    return out.withColumn("flux", F.round("flux", 4) + F.lit(0.0))


@query("cadence", f"WITH {_obs_sql()}, g AS (SELECT object_id, t - lag(t) OVER (PARTITION BY object_id ORDER BY t, rid) AS gap FROM obs) SELECT object_id, count(*) AS n_gaps, {_r('quantile_cont(gap, 0.5)')} AS median_gap, {_r('0.5::DOUBLE / quantile_cont(gap, 0.5)')} AS pseudo_nyquist FROM g WHERE gap > 0 GROUP BY object_id")
def cadence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(windows.cadence(series(spark, sf_dir)), "object_id n_gaps", "median_gap pseudo_nyquist")


_SPANS = f"SELECT object_id, subset, count(*) AS n, {_r('min(t)')} AS first, {_r('max(t)')} AS last FROM p GROUP BY object_id, subset"


@query("gap_partition", f"WITH {_obs_sql()}, g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY object_id ORDER BY t, rid) > 0.7::DOUBLE THEN 1 ELSE 0 END AS nw FROM obs), p AS (SELECT *, sum(nw) OVER (PARTITION BY object_id ORDER BY t, rid ROWS UNBOUNDED PRECEDING)::BIGINT AS subset FROM g) {_SPANS}")
def gap_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(windows.subset_spans(windows.gap_partition(series(spark, sf_dir), 0.7)), "object_id subset n", "first last")


@query("chunk_partition", f"WITH {_obs_sql()}, p AS (SELECT *, floor((t - min(t) OVER (PARTITION BY object_id)) / 5::DOUBLE)::BIGINT AS subset FROM obs) {_SPANS}")
def chunk_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(windows.subset_spans(windows.chunk_partition(series(spark, sf_dir), 5.0)), "object_id subset n", "first last")


@query("range_partition", f"WITH {_obs_sql()}, p AS (SELECT *, ((t >= 10)::BIGINT + (t >= 20)::BIGINT)::BIGINT AS subset FROM obs) {_SPANS}")
def range_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(windows.subset_spans(windows.range_partition(series(spark, sf_dir), [10.0, 20.0])), "object_id subset n", "first last")


@query(
    "label_runs",
    f"WITH {_obs_sql()}, g AS (SELECT *, CASE WHEN band IS NOT DISTINCT FROM lag(band) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS c FROM obs WINDOW w AS (PARTITION BY object_id ORDER BY t, rid)), p AS (SELECT *, sum(c) OVER (PARTITION BY object_id ORDER BY t, rid ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM g) SELECT object_id, run, min(band) AS band, count(*) AS n, {_r('min(t)')} AS first, {_r('max(t)')} AS last FROM p GROUP BY object_id, run",
)
def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(windows.runs(series(spark, sf_dir)), "object_id run band n", "first last")


_LAB = "lb AS (SELECT *, 'N' || dense_rank() OVER (PARTITION BY object_id ORDER BY subset) AS label, 1::DOUBLE AS weight FROM p)"
_GAPS7 = "g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY object_id ORDER BY t, rid) > 0.7::DOUBLE THEN 1 ELSE 0 END AS nw FROM obs), p AS (SELECT *, sum(nw) OVER (PARTITION BY object_id ORDER BY t, rid ROWS UNBOUNDED PRECEDING)::BIGINT AS subset FROM g)"
_SHOW = f"SELECT object_id, subset, label, count(*) AS n, {_r('min(t)')} AS first, {_r('max(weight)')} AS weight FROM {{}} GROUP BY object_id, subset, label"


def _shown(points: DataFrame) -> DataFrame:
    return emit(points.groupBy("object_id", "subset", "label").agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("weight").alias("weight")), "object_id subset label n", "first weight")


def _labelled_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.labelled(windows.gap_partition(series(spark, sf_dir), 0.7))


@query("crossed_partition", f"WITH {_obs_sql()}, {_GAPS7}, {_LAB}, bs AS (SELECT *, dense_rank() OVER (PARTITION BY object_id ORDER BY band) - 1 AS bsub FROM lb), x AS (SELECT object_id, t, dense_rank() OVER (PARTITION BY object_id ORDER BY subset, bsub) - 1 AS subset, label || '/' || 'B' || (bsub + 1) AS label, 2::DOUBLE AS weight FROM bs) {_SHOW.format('x')}")
def crossed_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _labelled_gaps(spark, sf_dir)
    bands = windows._renumbered(series(spark, sf_dir), "band")
    return _shown(windows.crossed(o, windows.labelled(bands, "B").withColumn("weight", F.lit(2.0))))


@query("merged_subsets", f"WITH {_obs_sql()}, {_GAPS7}, {_LAB}, has AS (SELECT object_id, count(*) FILTER (WHERE subset = 1) > 0 AND count(*) FILTER (WHERE subset = 2) > 0 AS pair FROM lb GROUP BY object_id), x AS (SELECT lb.object_id, t, weight, CASE WHEN pair AND subset IN (1, 2) THEN 1 WHEN pair AND subset > 2 THEN subset - 1 ELSE subset END AS subset, CASE WHEN pair AND subset IN (1, 2) THEN 'N2+N3' ELSE label END AS label FROM lb JOIN has USING (object_id)) {_SHOW.format('x')}")
def merged_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(windows.merged(_labelled_gaps(spark, sf_dir), 2, 1))


@query("split_subsets", f"WITH {_obs_sql()}, {_GAPS7}, {_LAB}, c AS (SELECT *, min(t) OVER w < 12.5 AND max(t) OVER w >= 12.5 AS cut FROM lb WINDOW w AS (PARTITION BY object_id, subset)), x AS (SELECT object_id, t, weight, dense_rank() OVER (PARTITION BY object_id ORDER BY subset, CASE WHEN cut AND t >= 12.5 THEN 1 ELSE 0 END) - 1 AS subset, CASE WHEN cut THEN label || CASE WHEN t >= 12.5 THEN 'b' ELSE 'a' END ELSE label END AS label FROM c) {_SHOW.format('x')}")
def split_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(windows.split_at(_labelled_gaps(spark, sf_dir), 12.5))


@query("weighted_subsets", f"WITH {_obs_sql()}, {_GAPS7}, {_LAB}, x AS (SELECT object_id, t, subset, CASE WHEN subset = 0 THEN 'first' ELSE label END AS label, CASE WHEN subset % 2 = 1 THEN 0.5::DOUBLE ELSE weight END AS weight FROM lb) {_SHOW.format('x')}")
def weighted_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _labelled_gaps(spark, sf_dir)
    odd = o.where("subset % 2 = 1").select("object_id", "subset").distinct().withColumn("weight", F.lit(0.5))
    return _shown(windows.with_weights(windows.renamed(o, 0, "first"), odd))


@query("merged_small_subsets")
def merged_small_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(windows.subset_spans(windows.merged_small(windows.gap_partition(series(spark, sf_dir), 0.7), 10)), "object_id subset n", "first last")


@query("joined_runs")
def joined_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(windows.subset_spans(windows.joined_runs(windows.gap_partition(series(spark, sf_dir), 0.3), 6.0)), "object_id subset n", "first last")


@query("suggested_partitions")
def suggested_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.suggest_partition(series(spark, sf_dir)).select("object_id", *[F.col(c).cast("long").alias(c) for c in ("nights", "seasons", "sectors")], F.coalesce("kind", F.lit("none")).alias("kind"))


def window_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(windows.window_starts(series(spark, sf_dir), 10.0, 5.0).withColumn("is_last", F.col("is_last").cast("int")), "object_id w_idx is_last", "w_start w_end")


@query("period_models", f"WITH {_obs_sql()}, m AS (SELECT object_id, rid, t, 1e-4::DOUBLE AS a FROM obs) SELECT object_id, rid, {_r('t - ln(1 + a * t) / a')} AS delay, {_r('t - (1 - exp(-a * t)) / a')} AS delay_exp, {_r('0.7::DOUBLE * (1 + a * t)')} AS period, {_r('0.7::DOUBLE * exp(a * t)')} AS period_exp, {_r('a * 0.7::DOUBLE * exp(a * t)', 12)} AS rate_exp, {_r('(1 + a * (t + 10)) / (1 + a * t) - 1', 9)} AS change, {_r('exp(a * 10) - 1', 9)} AS change_exp FROM m")
def period_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, a, p = F.col("t"), F.lit(1e-4), F.lit(0.7)
    r = lambda c, d=6: F.round(c, d) + F.lit(0.0)
    return series(spark, sf_dir).select(
        "object_id", "rid", r(physics.delay(t, a)).alias("delay"), r(physics.delay(t, a, "exponential")).alias("delay_exp"), r(physics.period_at(t, p, a)).alias("period"), r(physics.period_at(t, p, a, "exponential")).alias("period_exp"),
        r(physics.pdot_at(t, p, a, "exponential"), 12).alias("rate_exp"), r(physics.fractional_change(t, t + 10, a), 9).alias("change"), r(physics.fractional_change(t, t + 10, a, "exponential"), 9).alias("change_exp"),
    )


@query(
    "detectable_rates",
    f"WITH {_obs_sql()}, x0 AS (SELECT object_id, t, t - avg(t) OVER (PARTITION BY object_id) AS d FROM obs), x1 AS (SELECT object_id, t, max(abs(d)) OVER (PARTITION BY object_id) AS u, d / max(abs(d)) OVER (PARTITION BY object_id) AS x FROM x0), "
    "s AS (SELECT object_id, count(*) AS n, max(t) - min(t) AS baseline, min(u) AS u, sum(x) AS s1, sum(x * x) AS s2, sum(x * x * x) AS s3, sum(x * x * x * x) AS s4 FROM x1 WHERE u > 0 GROUP BY object_id), d AS (SELECT *, n * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) AS det FROM s) "
    f"SELECT object_id, n, {_r('baseline')} AS baseline, {_r('2 * 0.4::DOUBLE * 0.001::DOUBLE * sqrt((n * s2 - s1 * s1) / det) / (u * u)', 10)} AS sigma_rate, {_r('0.4::DOUBLE * 0.001::DOUBLE * sqrt((n * s4 - s2 * s2) / det) / u', 10)} AS sigma_period FROM d WHERE det > 1e-9 * n",
)
def detectable_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = period_change.detectable_rate(series(spark, sf_dir), 0.4, 0.001)
    return d.select("object_id", F.col("n").cast("long").alias("n"), (F.round("baseline", 6) + F.lit(0.0)).alias("baseline"), *[(F.round(c, 10) + F.lit(0.0)).alias(c) for c in ("sigma_rate", "sigma_period")])


_RUNMED = f"WITH {_obs_sql()}, m AS (SELECT *, quantile_cont(y, 0.5) OVER (PARTITION BY object_id) AS whole, quantile_cont(y, 0.5) OVER w AS loc, count(y) OVER w AS c FROM obs WINDOW w AS (PARTITION BY object_id ORDER BY t RANGE BETWEEN 1.5::DOUBLE PRECEDING AND 1.5::DOUBLE FOLLOWING))"


@query("running_median", f"{_RUNMED} SELECT object_id, rid, {_r('CASE WHEN c >= 5 THEN loc ELSE whole END')} AS trend FROM m")
def running_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(windows.running_median(series(spark, sf_dir), 3.0), "object_id rid", "trend")


@query("detrended", f"{_RUNMED} SELECT object_id, rid, {_r('y - CASE WHEN c >= 5 THEN loc ELSE whole END + whole')} AS y FROM m")
def detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(windows.detrend(series(spark, sf_dir), 3.0), "object_id rid", "y")


@query("binned_trend", f"WITH {_obs_sql()}, p AS (SELECT *, floor((t - min(t) OVER (PARTITION BY object_id)) / 2::DOUBLE)::BIGINT AS subset FROM obs) SELECT object_id, subset, count(*) AS n, {_r('quantile_cont(t, 0.5)')} AS t, {_r('quantile_cont(y, 0.5)')} AS y FROM p GROUP BY object_id, subset")
def binned_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(windows.binned_trend(series(spark, sf_dir), 4.0), "object_id subset n", "t y")


_SLIDE = (
    f"WITH {_obs_sql()}, e AS (SELECT object_id, min(t) AS t0, max(t) AS t1, floor((max(t) - min(t) - 10::DOUBLE + 1e-8) / 5::DOUBLE)::BIGINT + 1 AS m FROM obs GROUP BY object_id), "
    "ws AS (SELECT object_id, t1, q.w_idx, t0 + q.w_idx * 5::DOUBLE AS w_start, m + CASE WHEN t1 - (t0 + (m - 1) * 5::DOUBLE + 10) > 2.5 THEN 1 ELSE 0 END AS total FROM e, range(40) q(w_idx) WHERE q.w_idx < m UNION ALL SELECT object_id, t1, m, t1 - 10, m + 1 FROM e WHERE m >= 1 AND t1 - (t0 + (m - 1) * 5::DOUBLE + 10) > 2.5), "
    "sl AS (SELECT obs.object_id, t, y, dy, rid, w_idx, w_start FROM obs JOIN ws USING (object_id) WHERE t >= w_start AND (t < w_start + 10 OR w_idx = total - 1 AND t <= CASE WHEN t1 - (w_start + 10) BETWEEN 0 AND 1e-8 THEN t1 ELSE w_start + 10 END)), "
    f"{_centred(False, 'object_id, w_idx', 'sl', 'object_id, w_idx')}, gr AS (SELECT cent.*, r.k, 0.2::DOUBLE + r.k * 0.02::DOUBLE AS f FROM cent, range(30) r(k) WHERE n >= 8), {_trig('object_id, w_idx, k', 'gr')}, st AS (SELECT object_id, w_idx, min(w_start) AS w_start FROM gr GROUP BY ALL), spec AS (SELECT trig.object_id, trig.w_idx, k, f, w_start + 5 AS mid, {_power()} AS power FROM trig JOIN st ON st.object_id = trig.object_id AND st.w_idx = trig.w_idx)"
)


query("window_starts", _SLIDE.split(", sl AS (")[0] + f" SELECT object_id, w_idx, (w_idx = total - 1)::BIGINT AS is_last, {_r('w_start')} AS w_start, {_r('CASE WHEN w_idx = total - 1 AND t1 - (w_start + 10) BETWEEN 0 AND 1e-8 THEN t1 ELSE w_start + 10 END')} AS w_end FROM ws")(window_starts)


@query("sliding_gls", f"{_SLIDE} SELECT object_id, w_idx, k, {_r('f')} AS f, {_r('power')} AS power, {_r('mid')} AS mid FROM spec")
def sliding_gls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(windows.sliding_gls(series(spark, sf_dir), 10.0, 5.0, 0.2, 0.02, 30), "object_id w_idx k", "f power mid")


@query("period_trend", f"{_SLIDE}, b AS (SELECT *, row_number() OVER (PARTITION BY object_id, w_idx ORDER BY -round(power, 9), k) AS rn FROM spec) SELECT object_id, count(*) AS n, {_r('CASE WHEN count(*) > 1 THEN regr_slope(f, mid) END')} AS slope, {_r('avg(f)')} AS mean_f FROM b WHERE rn = 1 GROUP BY object_id")
def period_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(windows.period_trend(windows.sliding_gls(series(spark, sf_dir), 10.0, 5.0, 0.2, 0.02, 30)), "object_id n", "slope mean_f")


_WWZ_SUMS = "sum(w) AS s0, sum(w * w) AS sq, sum(w * yc) / sum(w) AS sy, sum(w * yc * yc) / sum(w) AS syy, sum(w * cos(z)) / sum(w) AS sc, sum(w * sin(z)) / sum(w) AS ss, sum(w * cos(z) * cos(z)) / sum(w) AS scc, sum(w * sin(z) * sin(z)) / sum(w) AS sss, sum(w * cos(z) * sin(z)) / sum(w) AS scs, sum(w * yc * cos(z)) / sum(w) AS syc, sum(w * yc * sin(z)) / sum(w) AS sys"


@query(
    "wavelet_z",
    f"WITH {_obs_sql()}, e AS (SELECT *, min(t) OVER g AS t0, max(t) OVER g AS t1, y - avg(y) OVER g AS yc FROM obs WINDOW g AS (PARTITION BY object_id)), fs(k, f) AS (VALUES (0, 0.2::DOUBLE), (1, 0.4::DOUBLE), (2, 0.7::DOUBLE)), "
    "x AS (SELECT object_id, i, k, f, yc, t0 + i * (t1 - t0) / 4::DOUBLE AS shift, 6.283185307179586::DOUBLE * f * (t - (t0 + i * (t1 - t0) / 4::DOUBLE)) AS z FROM e, range(5) q(i), fs), xw AS (SELECT *, exp(-0.0125::DOUBLE * z * z) AS w FROM x), "
    f"s AS (SELECT object_id, i, k, min(f) AS f, min(shift) AS shift, {_WWZ_SUMS} FROM xw GROUP BY object_id, i, k), "
    "m AS (SELECT *, s0 * s0 / sq AS neff, scc - sc * sc AS cc, sss - ss * ss AS s2, scs - sc * ss AS cs, syc - sy * sc AS yc, sys - sy * ss AS ys, syy - sy * sy AS vx FROM s), v AS (SELECT *, (s2 * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (cc * s2 - cs * cs) AS vy FROM m WHERE neff >= 3.5 AND cc * s2 - cs * cs > 1e-9 AND vx > 0) "
    f"SELECT object_id, i, k, {_r('neff', 5)} AS neff, {_r('(neff - 3) * vy / (2 * greatest(vx - vy, 1e-12 * vx))', 5)} AS power FROM v",
)
def wavelet_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(windows.wwz(series(spark, sf_dir), 5, [0.2, 0.4, 0.7]), "object_id i k", "neff power", 5)


def _events_oc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return period_change.residuals(series(spark, sf_dir), 0.75)


_OC = (
    f"WITH {_obs_sql()}, a AS (SELECT *, floor((t - min(t) OVER (PARTITION BY object_id)) / 0.75::DOUBLE + 0.5::DOUBLE) AS e FROM obs), "
    "fit AS (SELECT object_id, count(*) AS n, regr_slope(t, e) AS period, regr_intercept(t, e) AS epoch, regr_r2(t, e) AS r2 FROM a GROUP BY object_id HAVING count(*) > 2 AND regr_slope(t, e) IS NOT NULL), oc AS (SELECT a.object_id, a.rid, e, t - epoch - e * period AS oc, period FROM a JOIN fit USING (object_id))"
)


@query("linear_ephemeris", f"{_OC} SELECT object_id, n, {_r('period')} AS period, {_r('epoch')} AS epoch, {_r('r2')} AS r2 FROM fit")
def linear_ephemeris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(period_change.linear_ephemeris(series(spark, sf_dir), 0.75), "object_id n", "period epoch r2")


@query("oc_residuals", f"{_OC} SELECT object_id, rid, {_r('e')} AS e, {_r('oc')} AS oc FROM oc")
def oc_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(_events_oc(spark, sf_dir), "object_id rid", "e oc")


@query(
    "quadratic_drift",
    f"{_OC}, m AS (SELECT *, avg(e) OVER (PARTITION BY object_id) AS em, stddev_pop(e) OVER (PARTITION BY object_id) AS sd FROM oc), x AS (SELECT *, (e - em) / sd AS x FROM m WHERE sd > 0), "
    "s AS (SELECT object_id, count(*) AS n, avg(x * x * x) AS x3, avg(x * x * x * x) AS x4, avg(oc) AS y0, avg(x * oc) AS y1, avg(x * x * oc) AS y2, min(period) AS period, min(sd) AS sd FROM x GROUP BY object_id) "
    f"SELECT object_id, n, {_r('2 * (y2 - y0 - x3 * y1) / (x4 - 1 - x3 * x3) / (sd * sd) / period', 8)} AS pdot FROM s WHERE n > 3 AND x4 - 1 - x3 * x3 > 1e-9",
)
def quadratic_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(period_change.quadratic_drift(_events_oc(spark, sf_dir)), "object_id n", "pdot", 8)


@query("residual_pairs", f"{_OC} SELECT a.object_id, (b.e - a.e)::BIGINT AS lag, count(*) AS pairs, {_r('avg(abs(b.oc - a.oc))')} AS mean_u FROM oc a JOIN oc b ON a.object_id = b.object_id AND b.e > a.e AND b.e <= a.e + 4 GROUP BY ALL")
def residual_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(period_change.eddington_plakidis(_events_oc(spark, sf_dir), 4), "object_id lag pairs", "mean_u")


@query("drift_search", f"WITH {_obs_sql()}, {_centred(False)}, rt(a_idx, a) AS (VALUES (0, -0.001::DOUBLE), (1, 0::DOUBLE), (2, 0.001::DOUBLE)), wp AS (SELECT cent.* REPLACE (CASE WHEN a = 0 THEN tau ELSE ln(1 + a * tau) / a END AS tau), a_idx FROM cent, rt), {_grid(30, 'wp')}, {_trig('object_id, a_idx, k')} SELECT object_id, a_idx, k, {_r('f')} AS f, {_r(_power())} AS power FROM trig")
def drift_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(period_change.drift_search(series(spark, sf_dir), [-0.001, 0.0, 0.001], 30), "object_id a_idx k", "f power")


@query("unit_conversions", f"WITH {_obs_sql()}, p AS (SELECT object_id, rid, y / 1000000 AS v, y AS per FROM obs) SELECT object_id, rid, {_r('v * 86400000::DOUBLE * 365.25::DOUBLE', 4)} AS ms_yr, {_r('v * 365250000::DOUBLE', 4)} AS d_myr, {_r('v * per', 11)} AS d_cycle, {_r('1.5::DOUBLE / 2 * v / per * 365.25::DOUBLE', 9)} AS mass_loss FROM p")
def unit_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, per = F.col("y") / 1000000, F.col("y")
    r = lambda c, d: F.round(c, d) + F.lit(0.0)
    return series(spark, sf_dir).select(
        "object_id", "rid", r(physics.convert_pdot(v, "d/d", "ms/yr"), 4).alias("ms_yr"), r(physics.convert_pdot(v, "d/d", "d/Myr"), 4).alias("d_myr"),
        r(physics.convert_pdot(v, "d/d", "d/cycle", per), 11).alias("d_cycle"), r(physics.mass_loss_rate(v, per, F.lit(1.5)), 9).alias("mass_loss"),
    )


@query("echelle_positions", f"WITH {_obs_sql()} SELECT object_id, rid, {_r('(t / 1.7::DOUBLE - floor(t / 1.7::DOUBLE)) * 1.7::DOUBLE')} AS position FROM obs")
def echelle_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(series(spark, sf_dir).withColumn("position", physics.echelle(F.col("t"), 1.7)), "object_id rid", "position")


@query("unique_keys", f"WITH {_obs_sql()}, r AS (SELECT band, rid, row_number() OVER (PARTITION BY band ORDER BY rid) AS rn FROM obs) SELECT rid, CASE WHEN rn = 1 THEN band ELSE band || '#' || rn END AS band FROM r")
def unique_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs_source.unique_keys(series(spark, sf_dir).select("band", "rid"), "band", "rid").select("rid", "band")


@query("csv_safe_cells", "SELECT event_id AS rid, CASE WHEN regexp_matches(c, '^[=+@\\t\\r-]') THEN '''' || c ELSE c END AS cell FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '=' || event_type WHEN event_id % 3 = 1 THEN '-' || event_type ELSE event_type END AS c FROM events)")
def csv_safe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("rid") % 3 == 0, F.concat(F.lit("="), "band")).when(F.col("rid") % 3 == 1, F.concat(F.lit("-"), "band")).otherwise(F.col("band"))
    return series(spark, sf_dir).select("rid", obs_source.csv_safe(c).alias("cell"))


for _m, _sql in (
    ("gls", _gls_sql()),
    ("pdm", SQL["pdm"].split(" SELECT object_id, k, round")[0]),
    ("ce", SQL["conditional_entropy"].split(" SELECT object_id, k, round")[0]),
    ("sl", SQL["string_length"].split(" SELECT object_id, k, round")[0]),
):
    _spectrum_query(f"kernel_{_m}", lambda o, m=_m: kernels.spectrum(o, m, NF), _sql)
_spectrum_query("kernel_mhaov_one", lambda o: kernels.spectrum(o, "mhaov", NF, harmonics=1), SQL["aov_one_harmonic"].split(" SELECT object_id, k, round")[0])


def _kernel_best(method: str, nf: int):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return emit(kernels.best_periods(series(spark, sf_dir), method, nf), "object_id rank", "period f power")

    return f


for _m, _n in (("mhaov", 200), ("bls", 30), ("tls", 200), ("supersmoother", 60)):
    query(f"kernel_best_{_m}")(_kernel_best(_m, _n))


@query("kernel_best_gls_fap")
def kernel_best_gls_fap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(kernels.best_periods(series(spark, sf_dir), "gls", 300, 3), "object_id rank", "period power fap")


@query("prewhitened_components")
def prewhitened_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prewhitening.prewhiten(series(spark, sf_dir), 2.0, 4, min_snr=2.5, max_fap=0.5, min_gain=0.0)
    return emit(found, "object_id rank status", "frequency amplitude phase snr fap delta_bic")


@query("streamable_sums", f"WITH {_obs_sql()}, fs(k, f) AS (VALUES (0, 0.1::DOUBLE), (1, 0.33::DOUBLE), (2, 0.9::DOUBLE)), c0 AS (SELECT *, t AS tau, 1::DOUBLE / count(*) OVER (PARTITION BY object_id) AS w, count(*) OVER (PARTITION BY object_id) AS n, 0::DOUBLE AS baseline, 0::DOUBLE AS wsum, y - avg(y) OVER (PARTITION BY object_id) AS yc, var_pop(y) OVER (PARTITION BY object_id) AS yy FROM obs), gr AS (SELECT c0.*, k, f FROM c0, fs), {_trig('object_id, k', 'gr')} SELECT object_id, k, n, {_r(_power())} AS power FROM trig WHERE n > 3")
def streamable_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(streaming.power(streaming.running_sums(series(spark, sf_dir), [0.1, 0.33, 0.9])).where("n > 3"), "object_id k n", "power")


@query("unsearchable_objects", f"WITH {_obs_sql('orders')}, n AS (SELECT object_id, count(*) AS c, max(t) - min(t) AS b FROM obs GROUP BY object_id) SELECT object_id, CASE WHEN c < 4 THEN 'too few points' ELSE 'no time baseline' END AS reason FROM n WHERE c < 4 OR b <= 0")
def unsearchable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch.failures(series(spark, sf_dir, "orders"))


@query("resumed_rows", f"WITH {_obs_sql()} SELECT object_id, rid, CASE WHEN rid % 2 = 0 THEN 'old' ELSE 'new' END AS origin FROM obs")
def resumed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = series(spark, sf_dir).select("object_id", "rid")
    return batch.merge(df.where("rid % 2 = 0").withColumn("origin", F.lit("old")), df.withColumn("origin", F.lit("new")), "object_id", "rid").select("object_id", "rid", "origin")


@query("seeded_objects", "WITH o AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS object_id FROM orders), s AS (SELECT CAST(c_custkey AS VARCHAR) AS object_id, c_acctbal::DOUBLE AS period FROM customer WHERE c_acctbal > 0) SELECT o.object_id, coalesce(round(period, 4), 1.5::DOUBLE) AS seed FROM o LEFT JOIN s USING (object_id)")
def seeded_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("object_id"), F.round(F.col("c_acctbal").cast("double"), 4).alias("period"))
    return batch.with_seeds(series(spark, sf_dir, "orders").select("object_id").distinct(), seeds, 1.5).select("object_id", "seed")


_PEAKS = f"{_gls_sql(False)}, best AS (SELECT object_id, f AS frequency FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY -round(power, 9), k) AS rn FROM spec) WHERE rn = 1)"


def _one_component(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = series(spark, sf_dir)
    best = peaks.best_peak(spectra.gls(o, NF, True, False))
    return o, best.select("object_id", F.col("f").alias("frequency"), F.lit(10.0).alias("amplitude"), F.lit(0.5).alias("phase"))


@query("model_values", f"{_PEAKS} SELECT object_id, rid, {_r('10::DOUBLE * sin(6.283185307179586::DOUBLE * frequency * (t - 15) + 0.5::DOUBLE)')} AS model FROM obs JOIN best USING (object_id)")
def model_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _one_component(spark, sf_dir)
    return emit(models.evaluate(o, c, 15.0), "object_id rid", "model")


@query("analytic_uncertainties", f"{_PEAKS}, st AS (SELECT object_id, count(*) AS n, max(t) - min(t) AS b, stddev_samp(y) AS s FROM obs GROUP BY object_id) SELECT object_id, {_r('sqrt(2::DOUBLE / n) * s')} AS amplitude_error, {_r('sqrt(2::DOUBLE / n) * s / 10')} AS phase_error, {_r('sqrt(6::DOUBLE / n) * s / (3.141592653589793::DOUBLE * b * 10)')} AS frequency_error FROM best JOIN st USING (object_id)")
def analytic_uncertainties(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = _one_component(spark, sf_dir)
    return emit(models.analytic_uncertainties(c, spectra.object_stats(o).withColumnRenamed("std", "sigma")), "object_id", "amplitude_error phase_error frequency_error")


@query("correlation_factor", f"WITH {_obs_sql()}, d AS (SELECT *, y - avg(y) OVER (PARTITION BY object_id) AS residual FROM obs), r AS (SELECT *, CASE WHEN residual >= -1e-9::DOUBLE * max(abs(residual)) OVER (PARTITION BY object_id) THEN 1 ELSE -1 END AS s FROM d), g AS (SELECT *, CASE WHEN s = lag(s) OVER (PARTITION BY object_id ORDER BY t, rid) THEN 0 ELSE 1 END AS nw FROM r) SELECT object_id, sum(nw)::BIGINT AS n_runs, {_r('greatest(count(*)::DOUBLE / sum(nw) / 2, 1)')} AS factor FROM g GROUP BY object_id")
def correlation_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = series(spark, sf_dir)
    return emit(models.correlation_factor(o.withColumn("residual", F.expr("y - avg(y) OVER (PARTITION BY object_id)"))), "object_id n_runs", "factor")


@query("comb_response", f"WITH {_obs_sql()}, sp(k, s) AS (VALUES (0, 0.9::DOUBLE), (1, 1.3::DOUBLE), (2, 2.1::DOUBLE)) SELECT object_id, k, {_r('(sum(y * cos(6.283185307179586::DOUBLE * t / s)) ^ 2 + sum(y * sin(6.283185307179586::DOUBLE * t / s)) ^ 2) / sum(y) ^ 2')} AS power FROM obs, sp GROUP BY object_id, k")
def comb_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = series(spark, sf_dir).select("object_id", F.col("t").alias("x"), F.col("y").alias("a"))
    return emit(models.comb_response(v, [0.9, 1.3, 2.1]), "object_id k", "power")


@query("subset_weights", f"WITH {_obs_sql()}, r AS (SELECT *, y - avg(y) OVER (PARTITION BY object_id) AS e FROM obs), s AS (SELECT object_id, band, count(*) AS n, sqrt(avg(e * e)) AS rms FROM r GROUP BY object_id, band) SELECT object_id, band, n, {_r('rms')} AS rms, {_r('1 / (rms * rms) / avg(1 / (rms * rms)) OVER (PARTITION BY object_id)')} AS weight FROM s WHERE rms > 0")
def subset_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = series(spark, sf_dir).withColumn("residual", F.expr("y - avg(y) OVER (PARTITION BY object_id)"))
    return emit(models.subset_weights(o), "object_id band n", "rms weight")


@query("balanced_intervals", f"WITH {_obs_sql()}, r AS (SELECT *, floor((row_number() OVER (PARTITION BY object_id ORDER BY t, rid) - 1) * 6 / count(*) OVER (PARTITION BY object_id))::BIGINT AS interval_no FROM obs) SELECT object_id, interval_no, count(*) AS n, {_r('min(t)')} AS first FROM r GROUP BY object_id, interval_no")
def balanced_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = models.balanced_intervals(series(spark, sf_dir), 6).groupBy("object_id", F.col("interval").alias("interval_no")).agg(F.count("*").alias("n"), F.min("t").alias("first"))
    return emit(df, "object_id interval_no n", "first")


@query("folded_points", f"WITH {_obs_sql()} SELECT object_id, rid, {_r('t / 1.3::DOUBLE - floor(t / 1.3::DOUBLE) + c')} AS phase FROM obs, range(2) q(c)")
def folded_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(models.fold(series(spark, sf_dir), 1.3), "object_id rid", "phase")


@query("robust_scatter", f"WITH {_obs_sql()}, d AS (SELECT object_id, band, abs(y - quantile_cont(y, 0.5) OVER (PARTITION BY object_id, band)) AS d FROM obs) SELECT object_id, band, {_r('1.4826::DOUBLE * quantile_cont(d, 0.5)')} AS scatter FROM d GROUP BY object_id, band")
def robust_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(models.robust_scatter(series(spark, sf_dir)), "object_id band", "scatter")


@query("standardised_values", f"WITH {_obs_sql()}, d AS (SELECT *, avg(y) OVER w AS m, stddev_pop(y) OVER w AS s FROM obs WINDOW w AS (PARTITION BY object_id, band)) SELECT object_id, rid, {_r('(y - m) / s')} AS y FROM d WHERE s > 0")
def standardised_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(models.standardised(series(spark, sf_dir)), "object_id rid", "y")


@query("drift_rate_profile", SQL["drift_search"].split(" SELECT object_id, a_idx, k")[0] + f", pr AS (SELECT object_id, a_idx, {_power()} AS power FROM trig) SELECT object_id, a_idx, {_r('max(power)')} AS power FROM pr GROUP BY object_id, a_idx")
def drift_rate_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(models.rate_profile(period_change.drift_search(series(spark, sf_dir), [-0.001, 0.0, 0.001], 30), "a_idx"), "object_id a_idx", "power")


@query("period_laws", f"WITH {_obs_sql('lineitem')}, s AS (SELECT object_id, count(*) AS n, avg(y) AS mean, regr_slope(y, t) AS slope, var_pop(y) AS v, regr_r2(y, t) AS r2 FROM obs GROUP BY object_id) SELECT object_id, n, CASE WHEN n * ln(v * (1 - r2)) + 2 * ln(n) < n * ln(v) + ln(n) THEN 'linear' ELSE 'constant' END AS law, {_r('mean', 4)} AS mean, {_r('slope', 4)} AS slope FROM s WHERE n > 2 AND v > 0")
def period_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(models.period_law(series(spark, sf_dir, "lineitem").withColumnRenamed("y", "period")), "object_id n law", "mean slope", 4)


_spectrum_query("kernel_shared_offsets", lambda o: multiband.spectrum(o, "offsets", 40), SQL["gls_shared_offsets"].split(" SELECT object_id, k, round")[0].replace("WHERE baseline > 0)", "WHERE baseline > 0 AND n >= 3)"))  # multiband.METHODS: bands of three points or more


def _multiband(method: str, nf: int):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return emit(multiband.spectrum(series(spark, sf_dir), method, nf), "object_id k", "f power")

    return f


for _m, _n in (("flexible", 20), ("mhaov", 40), ("supersmoother", 15), ("bls", 15)):
    query(f"multiband_{_m}")(_multiband(_m, _n))


@query("bootstrap_significance")
def bootstrap_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(multiband.bootstrap_fap(series(spark, sf_dir), 40, 19), "object_id", "power fap level_10")


@query("phase_track")
def phase_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(tracking.track(series(spark, sf_dir), 0.75, 4), "object_id segment n", "mid delay delay_error")


@query("period_profile")
def period_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(tracking.profile(series(spark, sf_dir), 0.75, 20), "object_id interval n", "mid period period_error")


@query("period_law_ladder")
def period_law_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(tracking.law_ladder(series(spark, sf_dir)), "object_id rank law", "bic chi2", 3)


@query("cyclic_residuals")
def cyclic_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    oc = _events_oc(spark, sf_dir).select("object_id", "t", F.col("oc").alias("y"), F.lit(None).cast("double").alias("dy"), "rid")
    return emit(tracking.cyclic(oc), "object_id", "outer_period amplitude delta_bic tail", 5)


_BEST = "best AS (SELECT object_id, f AS bf FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY -round(power, 9), k) AS rn FROM spec) WHERE rn = 1)"


@query("spectrum_readings", f"{_gls_sql()}, w(wanted) AS (VALUES (0.2::DOUBLE), (0.471::DOUBLE)), j AS (SELECT object_id, wanted, k, f, power, row_number() OVER (PARTITION BY object_id, wanted ORDER BY round(abs(f - wanted), 12), k) AS rn FROM spec, w) SELECT object_id, k, {_r('wanted')} AS wanted, {_r('f')} AS f, {_r('power')} AS power FROM j WHERE rn = 1")
def spectrum_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = series(spark, sf_dir)
    wanted = o.select("object_id").distinct().withColumn("wanted", F.explode(F.array(F.lit(0.2), F.lit(0.471))))
    return emit(readouts.readings(spectra.gls(o, NF), wanted), "object_id k", "wanted f power")


@query("unblocked_samples", f"{_gls_sql()}, {_BEST} SELECT object_id, k, {_r('power')} AS power FROM spec JOIN best USING (object_id) WHERE abs(f - bf) > 0.1")
def unblocked_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spectra.gls(series(spark, sf_dir), NF)
    return emit(readouts.unblocked(s, peaks.best_peak(s), 0.1), "object_id k", "power")


@query("dispersion_scores", f"WITH {_obs_sql()}, {_pdm_sql()} SELECT object_id, k, {_r('(max(power) OVER w - power) / (max(power) OVER w - min(power) OVER w)')} AS score FROM spec WINDOW w AS (PARTITION BY object_id)")
def dispersion_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(readouts.peak_score(spectra.pdm(series(spark, sf_dir), NF), "min"), "object_id k", "score")


_TOPW = _TOP.replace(">= 15", ">= 5")


@query("window_peaks", _recursive(SQL["spectral_window"].split(" SELECT object_id, k, round")[0] + f", {_MAXIMA}, {_TOPW} SELECT object_id, rank, k, {_r('f')} AS f, {_r('power')} AS power FROM top"))
def window_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(readouts.window_peaks(spectra.spectral_window(series(spark, sf_dir), NF)), "object_id rank k", "f power")


_RIDGE = SQL["wavelet_z"].split(" SELECT object_id, i, k, ")[0].replace("v AS (SELECT *,", "v AS (SELECT *, sqrt(((s2 * yc - cs * ys) / (cc * s2 - cs * cs)) ^ 2 + ((cc * ys - cs * yc) / (cc * s2 - cs * cs)) ^ 2) AS amplitude,")
_RIDGE += ", z AS (SELECT *, (neff - 3) * vy / (2 * greatest(vx - vy, 1e-12 * vx)) AS power FROM v), rd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY object_id, i ORDER BY -round(power, 9), k) AS rn FROM z) WHERE rn = 1)"


@query("wavelet_ridge", f"{_RIDGE} SELECT object_id, i, {_r('f', 5)} AS f, {_r('power', 5)} AS power, {_r('amplitude', 5)} AS amplitude FROM rd")
def wavelet_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(readouts.ridge(windows.wwz(series(spark, sf_dir), 5, [0.2, 0.4, 0.7])), "object_id i", "f power amplitude", 5)


@query("wavelet_trend", f"{_RIDGE} SELECT object_id, count(*) AS n, {_r('regr_slope(f, shift)')} AS slope, {_r('avg(f)')} AS mean_f FROM rd GROUP BY object_id HAVING count(*) > 1")
def wavelet_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(readouts.ridge_trend(readouts.ridge(windows.wwz(series(spark, sf_dir), 5, [0.2, 0.4, 0.7]))).where("n > 1"), "object_id n", "slope mean_f")


_DRIFT = SQL["drift_search"].split(" SELECT object_id, a_idx, k")[0] + f", pr AS (SELECT object_id, a_idx, k, f, {_power()} AS power FROM trig)"


@query("drift_frequency_profile", f"{_DRIFT} SELECT object_id, k, {_r('max(f)')} AS f, {_r('max(power)')} AS power FROM pr GROUP BY object_id, k")
def drift_frequency_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(readouts.frequency_profile(period_change.drift_search(series(spark, sf_dir), [-0.001, 0.0, 0.001], 30)), "object_id k", "f power")


@query("drift_zero_rate", f"{_DRIFT} SELECT object_id, k, {_r('f')} AS f, {_r('power')} AS power FROM pr WHERE a_idx = 1")
def drift_zero_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = [-0.001, 0.0, 0.001]
    return emit(readouts.zero_rate(period_change.drift_search(series(spark, sf_dir), rates, 30), rates), "object_id k", "f power")


@query("mixed_domains", f"WITH {_obs_sql()}, d AS (SELECT *, rid % 2 = 0 AS isflux, CASE WHEN rid % 2 = 0 THEN y ELSE 20 + y / 100 END AS v FROM obs) SELECT object_id, rid, {_r('CASE WHEN NOT isflux THEN v WHEN v > 0 THEN -2.5::DOUBLE * log10(v) + 25 END')} AS y, {_r('CASE WHEN NOT isflux THEN dy WHEN v > 0 THEN 1.0857362047581296::DOUBLE * dy / v END')} AS dy FROM d")
def mixed_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    flux = F.col("rid") % 2 == 0
    o = series(spark, sf_dir).withColumn("domain", F.when(flux, "flux").otherwise("magnitude")).withColumn("y", F.when(flux, F.col("y")).otherwise(20 + F.col("y") / 100))
    return emit(readouts.in_domain(o, "magnitude"), "object_id rid", "y dy")


@query("weighted_epochs", f"WITH {_obs_sql()} SELECT object_id, {_r('sum(t / (dy * dy)) / sum(1 / (dy * dy))')} AS epoch FROM obs GROUP BY object_id")
def weighted_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(readouts.weighted_epoch(series(spark, sf_dir)), "object_id", "epoch")


@query("centred_bands", f"WITH {_obs_sql()} SELECT object_id, rid, {_r('y - quantile_cont(y, 0.5) OVER (PARTITION BY object_id, band)')} AS y, {_r('t - min(t) OVER (PARTITION BY object_id)')} AS tau FROM obs")
def centred_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(readouts.centred_bands(series(spark, sf_dir)), "object_id rid", "y tau")


@query("used_points", f"WITH {_obs_sql()}, {_GAPS7} SELECT object_id, rid, subset FROM p WHERE rid % 5 <> 0 AND subset <> 1")
def used_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = windows.gap_partition(series(spark, sf_dir), 0.7)
    return emit(readouts.unused_removed(p, p.where("rid % 5 = 0"), p.where("subset = 1")), "object_id rid subset", "")


@query("spacing_lines", f"{_gls_sql()}, {_MAXIMA}, sp AS (SELECT object_id, 1 / f AS period, lead(1 / f) OVER (PARTITION BY object_id ORDER BY 1 / f) - 1 / f AS spacing FROM maxima) SELECT object_id, count(*) AS n, {_r('regr_intercept(spacing, period)')} AS a, {_r('regr_slope(spacing, period)')} AS b FROM sp WHERE spacing IS NOT NULL GROUP BY object_id HAVING regr_slope(spacing, period) IS NOT NULL")
def spacing_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = peaks.local_maxima(spectra.gls(series(spark, sf_dir), NF)).select("object_id", (1.0 / F.col("f")).alias("period"))
    return emit(readouts.spacing_line(m), "object_id n", "a b")


@query("third_masses", f"WITH {_obs_sql()}, m AS (SELECT object_id, rid, pow(y * 1e-5 * {readouts.AU_PER_LIGHT_DAY}::DOUBLE, 3) / pow((1000 + t) / 365.25::DOUBLE, 2) AS f FROM obs) SELECT object_id, rid, {_r('f', 9)} AS f, 1::DOUBLE AS closed FROM m")
def third_masses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mass function, and whether the least third mass put into it gives it back."""
    o = series(spark, sf_dir).withColumn("f", readouts.mass_function(F.col("y") * 1e-5, 1000 + F.col("t")))
    o = o.withColumn("m", readouts.minimum_third_mass(F.col("f"), F.lit(1.2)))
    back = F.pow("m", F.lit(3.0)) / F.pow(F.col("m") + 1.2, F.lit(2.0))
    closed = F.when(F.col("f") == 0, (back == 0).cast("double")).otherwise(back / F.nullif(F.col("f"), F.lit(0.0)))
    return o.select("object_id", "rid", (F.round("f", 9) + F.lit(0.0)).alias("f"), F.round(closed, 6).alias("closed"))


@query("line_quality", f"WITH {_obs_sql()}, s AS (SELECT object_id, count(*) AS n, var_pop(y) * count(*) * (1 - regr_r2(y, t)) AS rss FROM obs GROUP BY object_id) SELECT object_id, n, {_r('rss / (n - 2)', 4)} AS reduced_chi2, {_r('n * ln(rss / n) + 2 * ln(n)', 4)} AS bic, {_r('n * ln(rss / n) + 4', 4)} AS aic FROM s WHERE n > 2 AND rss > 0")
def line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series(spark, sf_dir).groupBy("object_id").agg(F.count("*").alias("n"), (F.var_pop("y") * F.count("*") * (1 - F.regr_r2("y", "t"))).alias("rss")).where("n > 2 and rss > 0")
    q = readouts.model_quality(s.withColumn("parameters", F.lit(2)), False)
    return q.select("object_id", F.col("n").cast("long").alias("n"), (F.col("rss") / (F.col("n") - 2)).alias("r"), "bic", "aic").select("object_id", "n", (F.round("r", 4) + F.lit(0.0)).alias("reduced_chi2"), *[(F.round(c, 4) + F.lit(0.0)).alias(c) for c in ("bic", "aic")])


@query("partition_spectra", f"WITH {_obs_sql()}, p AS (SELECT *, floor((t - min(t) OVER (PARTITION BY object_id)) / 10::DOUBLE)::BIGINT AS subset FROM obs), {_centred(False, 'object_id, subset', 'p', 'object_id, subset')}, gr AS (SELECT cent.*, r.k, 0.2::DOUBLE + r.k * 0.02::DOUBLE AS f FROM cent, range(20) r(k) WHERE n >= 8), {_trig('object_id, subset, k', 'gr')} SELECT object_id, subset, k, {_r('f')} AS f, {_r(_power())} AS power FROM trig")
def partition_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(windows.partition_gls(windows.chunk_partition(series(spark, sf_dir), 10.0), 0.2, 0.02, 20), "object_id subset k", "f power")


@query("ephemeris_lines", f"{_OC}, s AS (SELECT object_id, count(*) AS n, regr_intercept(oc, e) AS c0, regr_slope(oc, e) AS c1, var_pop(oc) * count(*) * (1 - coalesce(regr_r2(oc, e), 0)) AS chi2 FROM oc GROUP BY object_id) SELECT object_id, n, {_r('c0', 7)} AS c0, {_r('c1', 7)} AS c1, {_r('chi2', 5)} AS chi2, {_r('n * ln(chi2 / n) + 2 * ln(n)', 4)} AS bic FROM s")
def ephemeris_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = ephemeris.fits(_events_oc(spark, sf_dir)).where("degree = 1")
    r = lambda c, d: (F.round(c, d) + F.lit(0.0)).alias(c)
    return f.select("object_id", F.col("n").cast("long").alias("n"), r("c0", 7), r("c1", 7), r("chi2", 5), r("bic", 4))


@query("ephemeris_degrees")
def ephemeris_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ephemeris.fits(_events_oc(spark, sf_dir))
    return emit(ephemeris.best_fit(found).withColumn("rate_error", ephemeris.scaled_error()), "object_id degree n", "c0 c1 chi2 f_ratio p_value rate_error")


@query("profile_changes")
def profile_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(readouts.total_change(tracking.profile(series(spark, sf_dir), 0.75, 20)), "object_id n", "first last change")


def _seeds(o: DataFrame) -> DataFrame:
    return kernels.best_periods(o, "gls", grid=grids.gls_grid(o)).select("object_id", "f")


@query("harmonic_fits")
def harmonic_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = series(spark, sf_dir)
    return emit(constrained.harmonic_fits(o, _seeds(o), 2, band_offsets=True), "object_id component parameters", "frequency amplitude rss bic", 5)


@query("resampled_errors")
def resampled_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = series(spark, sf_dir)
    return emit(constrained.harmonic_fits(o, _seeds(o), 1, resamples=50), "object_id component", "frequency amplitude frequency_error amplitude_error", 5)


@query("drift_rates")
def drift_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = series(spark, sf_dir)
    return emit(period_change.rate_search(o, _seeds(o)), "object_id", "f rate power steady_power correlation", 5)


@query("multiband_joint_bls")
def multiband_joint_bls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _multiband("joint_bls", 15)(spark, sf_dir)


def _long_periods(method: str, grid):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = series(spark, sf_dir)
        return emit(kernels.best_periods(o, method, grid=grid(o, shortest=2.0)), "object_id k", "period f power", 5)

    return f


def _box_search_sql(objective: str) -> str:
    """box_search.search of periods from 4 days on, boxes of 2, 3 and 5 bins of a fortieth of each segment's shortest period."""
    value = "ina * ina / (inv * (total - inv))" if objective == "snr" else "ina * ina / (inv * (total - inv) * (total - inv))"
    power = "depth / depth_err" if objective == "snr" else "0.5::DOUBLE * inv * depth * depth"
    return (
        f"WITH {_obs_sql()}, c0 AS (SELECT *, 1::DOUBLE / (dy * dy) AS iv, min(t) OVER g AS tmin, max(t) OVER g - min(t) OVER g AS baseline, count(*) OVER g AS n FROM obs WINDOW g AS (PARTITION BY object_id)), "
        "cent AS (SELECT *, t - tmin AS tau, y - sum(iv * y) OVER g / sum(iv) OVER g AS yc, sum(iv) OVER g AS total FROM c0 WHERE n >= 4 WINDOW g AS (PARTITION BY object_id)), "
        "sg AS (SELECT object_id, baseline, s AS segment, 4::DOUBLE * pow(2, s) AS p_lo, least(8::DOUBLE * pow(2, s), least(100, baseline / 2)) AS p_hi FROM (SELECT DISTINCT object_id, baseline FROM cent), range(6) q(s) WHERE 4::DOUBLE * pow(2, s) < least(100, baseline / 2) - 1e-9), "
        "g1 AS (SELECT *, 1 / p_hi AS f0, 0.05::DOUBLE / (2 * baseline) AS df FROM sg), tr AS (SELECT object_id, segment, k, p_lo, 1 / (f0 + df * k) AS p, 0.05::DOUBLE * p_lo / 2 AS width FROM (SELECT *, unnest(range(ceil((1 / p_lo - f0) / df)::BIGINT)) AS k FROM g1) WHERE 1 / (f0 + df * k) > p_lo), "
        "hist AS (SELECT object_id, segment, k, p, width, ceil(p / width)::BIGINT AS nb, floor((tau % p) / width)::BIGINT + 1 AS b, sum(yc * iv) AS a, sum(iv) AS v, min(total) AS total, min(tmin) AS tmin FROM cent JOIN tr USING (object_id) GROUP BY ALL), "
        "wr AS (SELECT * FROM hist WHERE b < nb UNION ALL SELECT * REPLACE (nb + b - 1 AS b) FROM hist WHERE b <= 2), "
        "box AS (SELECT object_id, segment, k, p, width, nb, tmin, total, kd, b - q AS i, sum(a) AS ina, sum(v) AS inv FROM wr, (VALUES (2), (3), (5)) w(kd), range(1, 6) r(q) WHERE q <= kd AND b - q >= 0 AND b - q <= nb + 2 - kd GROUP BY ALL), "
        f"val AS (SELECT *, {value} AS v FROM box WHERE ina <= 0 AND inv > 1e-12 * total AND total - inv > 1e-12 * total), top AS (SELECT *, max(v) OVER (PARTITION BY object_id, segment, k) AS most FROM val), "
        f"one AS (SELECT *, row_number() OVER (PARTITION BY object_id, segment, k ORDER BY kd, i) AS rn FROM top WHERE v >= most * (1 - {box_search.TIE})), "
        "fld AS (SELECT *, -ina / (total - inv) - ina / inv AS depth, sqrt(1 / inv + 1 / (total - inv)) AS depth_err, kd * width AS duration FROM one WHERE rn = 1), "
        f"spec AS (SELECT tr.object_id, tr.segment, tr.k, tr.p AS period, {power} AS power, depth, depth_err, duration, tmin + (i * f.width + duration / 2) % f.p AS t0 FROM tr JOIN (SELECT DISTINCT object_id FROM cent) USING (object_id) LEFT JOIN fld f USING (object_id, segment, k)), "
        "m AS (SELECT *, count(*) OVER o AS trials, avg(coalesce(power, 0)) OVER o AS mean, stddev_pop(coalesce(power, 0)) OVER o AS sd, row_number() OVER (PARTITION BY object_id ORDER BY round(power, 9) DESC NULLS LAST, period) AS rn FROM spec WINDOW o AS (PARTITION BY object_id)) "
        f"SELECT object_id, trials, segment::BIGINT AS segment, k, {', '.join(f'{_r(c, 5)} AS {c}' for c in ('period', 'power', 'depth', 'depth_err', 'duration', 't0'))}, {_r('CASE WHEN sd > 0 THEN (coalesce(power, 0) - mean) / sd ELSE 0 END', 5)} AS sde FROM m WHERE rn = 1"
    )


def _box_search(objective: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = series(spark, sf_dir)
        found = box_search.search(o, grids.box_segments(o, shortest=4.0), objective, oversample=2, shares=(0.05, 0.12, 3))
        return emit(found, "object_id trials segment k", "period power depth depth_err duration t0 sde", 5)

    return f


query("box_search_snr", _box_search_sql("snr"))(_box_search("snr"))
query("box_search_likelihood", _box_search_sql("likelihood"))(_box_search("likelihood"))


@query("box_search_default")
def box_search_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(box_search.search(series(spark, sf_dir)), "object_id trials segment k", "period power depth depth_snr duration t0 log_likelihood sde")


_SCAN_PERIODS = 8


def _floating_scan_sql() -> str:
    """light_time.scan of the event O-C tables at eight outer periods: each column is made orthogonal to those before it, and so is the O-C."""
    columns = ["q0", "q1", "q2", "q3", "q4"]
    raw = ["1::DOUBLE", "x", "x * x", "cos(6.283185307179586::DOUBLE * f * x * half)", "sin(6.283185307179586::DOUBLE * f * x * half)"]
    steps, before = [], "base"
    for i, (q, v) in enumerate(zip([*columns, "r"], [*raw, "oc"], strict=True)):
        less = "".join(f" - sum({v} * {c}) OVER g / nullif(sum({c} * {c}) OVER g, 0) * {c}" for c in columns[:i])
        steps.append(f"s{i}a AS (SELECT *, {v}{less} AS {q}_ FROM {before} WINDOW g AS (PARTITION BY object_id, k))")
        again = "".join(f" - sum({q}_ * {c}) OVER g / nullif(sum({c} * {c}) OVER g, 0) * {c}" for c in columns[:i])
        steps.append(f"s{i} AS (SELECT *, {q}_{again} AS {q} FROM s{i}a WINDOW g AS (PARTITION BY object_id, k))")
        before = f"s{i}"
    gain = "sum(oc * q3) * sum(oc * q3) / sum(q3 * q3) + sum(oc * q4) * sum(oc * q4) / sum(q4 * q4)"
    return (
        f"{_OC}, tt AS (SELECT oc.*, obs.t FROM oc JOIN obs USING (object_id, rid)), u AS (SELECT *, min(t) OVER o AS t0, max(t) OVER o - min(t) OVER o AS span, avg(t) OVER o AS mid, count(*) OVER o AS n FROM tt WINDOW o AS (PARTITION BY object_id)), "
        f"base AS (SELECT object_id, oc, n, k, (t - mid) / (span / 2) AS x, span / 2 AS half, 1 / span + k * (1 / (span * 0.25::DOUBLE) - 1 / span) / {_SCAN_PERIODS - 1} AS f FROM u, range({_SCAN_PERIODS}) q(k) WHERE n >= 20), "
        + ", ".join(steps)
        + f", z AS (SELECT object_id, k, min(1 / f) AS outer_period, ({gain}) / ((sum(r * r)) / (min(n) - 6)) AS gain FROM s5 GROUP BY object_id, k) SELECT object_id, k, {_r('outer_period', 4)} AS outer_period, {_r('gain', 4)} AS f_like FROM z"
    )


@query("floating_scan", _floating_scan_sql())
def floating_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gain of a circular orbit over the parabola in units of what the fit leaves, at eight outer periods from the baseline to its quarter."""
    oc = _events_oc(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("object_id"))).where("n >= 20")
    return emit(light_time.fixed_scan(oc.select("object_id", "t", F.col("oc").alias("y")), _SCAN_PERIODS, 0.25), "object_id k", "outer_period f_like", 4)


@query("light_time_orbits")
def light_time_orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = light_time.orbits(light_time.from_track(tracking.track(series(spark, sf_dir), 0.25, 12)), 0.25, degree=1)
    return emit(found, "object_id reason n epochs parameters", "outer_period amplitude chi2 null_chi2 delta_bic", 4)


@query("eccentric_orbits")
def eccentric_orbits(spark: SparkSession, sf_dir: str) -> DataFrame:
    track = light_time.from_track(tracking.track(series(spark, sf_dir), 0.25, 14))
    return emit(light_time.orbits(track, 0.25, degree=1, eccentric=True), "object_id reason n parameters", "outer_period amplitude eccentricity chi2", 3)


@query("light_time_predictions")
def light_time_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = series(spark, sf_dir)
    fits = light_time.orbits(light_time.from_track(tracking.track(o, 0.25, 12)), 0.25, degree=1)
    return emit(light_time.predict(fits, o, 0.25).withColumn("t_micros", F.round(F.col("t") * 86400e6)), "object_id t_micros", "secular cyclic apparent_period", 5)


@query("gridded_gls", f"{_gls_sql()} SELECT object_id, k, {_r('f')} AS f, {_r('power')} AS power FROM spec")
def gridded_gls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object in parts of 20 points and slabs of 64 trials, as one too large for a task is."""
    o = series(spark, sf_dir)
    grid = o.groupBy("object_id").agg((F.max("t") - F.min("t")).alias("b")).where("b > 0").select("object_id", (1 / F.col("b")).alias("f0"), (1 / (5 * F.col("b"))).alias("df"), F.lit(NF).cast("long").alias("nf"))
    return emit(gridded.spectrum(o, grid, part=20, slab=64), "object_id k", "f power")


_HELD = 0.37


def _variation_sql(tail: str) -> str:
    """variation.compute of one held frequency, mode both, an offset a band: bands are separate fits but for the common variance."""
    c = "sum(w * (s - sm) * (s - sm)) AS ss, sum(w * (c - cm) * (c - cm)) AS cc, sum(w * (s - sm) * (c - cm)) AS sc, sum(w * (s - sm) * (y - ym)) AS sy, sum(w * (c - cm) * (y - ym)) AS cy, sum(w * (y - ym) * (y - ym)) AS yy"
    return (
        f"WITH {_obs_sql()}, o AS (SELECT *, 1 / (dy * dy) AS w, sin(6.283185307179586::DOUBLE * {_HELD}::DOUBLE * (t - avg(t) OVER q)) AS s, cos(6.283185307179586::DOUBLE * {_HELD}::DOUBLE * (t - avg(t) OVER q)) AS c, count(*) OVER q AS n FROM obs WINDOW q AS (PARTITION BY object_id)), "
        "m AS (SELECT *, sum(w * s) OVER b / sum(w) OVER b AS sm, sum(w * c) OVER b / sum(w) OVER b AS cm, sum(w * y) OVER b / sum(w) OVER b AS ym FROM o WINDOW b AS (PARTITION BY object_id, band)), "
        f"z AS (SELECT object_id, band, min(n) AS n, count(*) AS nb, avg(t) AS mid, {c} FROM m GROUP BY object_id, band), "
        "ok AS (SELECT object_id FROM z GROUP BY object_id HAVING count(*) >= 2 AND min(nb) >= 5 AND min(n) >= count(*) * 3 + 2), "
        "f AS (SELECT z.*, ss * cc - sc * sc AS d, (cc * sy - sc * cy) / (ss * cc - sc * sc) AS bs, (ss * cy - sc * sy) / (ss * cc - sc * sc) AS bc FROM z JOIN ok USING (object_id)), "
        "g AS (SELECT *, yy - bs * sy - bc * cy AS chi, sqrt(bs * bs + bc * bc) AS a FROM f), "
        "h AS (SELECT *, count(*) OVER q AS g, sum(chi) OVER q AS chi_all FROM g WINDOW q AS (PARTITION BY object_id)), "
        "e AS (SELECT *, chi_all / (n - 3 * g) AS unit, (bs * bs * cc - 2 * bs * bc * sc + bc * bc * ss) / (d * a * a) * chi_all / (n - 3 * g) AS va, (bc * bc * cc + 2 * bs * bc * sc + bs * bs * ss) / (d * a * a * a * a) * chi_all / (n - 3 * g) AS vp FROM h) " + tail
    )


def _held_components(o: DataFrame) -> DataFrame:
    return o.select("object_id").distinct().select("object_id", F.lit(0).alias("component"), F.lit(_HELD).alias("f"))


@query("subset_variation", _variation_sql(f"SELECT object_id, band AS subset, nb AS n, {_r('mid', 5)} AS mid, {_r('a', 5)} AS amplitude, {_r('sqrt(va)', 5)} AS amplitude_error, {_r('atan2(bc, bs)', 5)} AS phase, {_r('sqrt(vp)', 5)} AS phase_error FROM e"))
def subset_variation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = series(spark, sf_dir)
    found = variation.subset_variation(o, _held_components(o), offsets=True).where("subset IS NOT NULL")
    return emit(found, "object_id subset n", "mid amplitude amplitude_error phase phase_error", 5)


@query("subset_tests", _variation_sql(
    "SELECT object_id, min(n) AS n, round(sum(a * a / va) - sum(a / va) * sum(a / va) / sum(1 / va), 4) + 0::DOUBLE AS amplitude_statistic, round(min(n) * ln(min(chi_all) / (sum(yy) - (sum(cc) * sum(sy) * sum(sy) - 2 * sum(sc) * sum(sy) * sum(cy) + sum(ss) * sum(cy) * sum(cy)) / (sum(ss) * sum(cc) - sum(sc) * sum(sc)))) + (2 * count(*) - 2) * ln(min(n)), 4) + 0::DOUBLE AS delta_bic FROM e GROUP BY object_id"
))
def subset_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = series(spark, sf_dir)
    found = variation.subset_variation(o, _held_components(o), offsets=True).where("subset IS NULL AND reason IS NULL")
    return emit(found, "object_id n", "amplitude_statistic delta_bic", 4)


def _subset_mode(mode: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        o = series(spark, sf_dir)
        return emit(variation.subset_variation(o, _held_components(o), mode=mode), "object_id component subset n reason", "amplitude amplitude_error phase phase_error amplitude_p phase_p delta_bic", 4)

    return f


query("subset_amplitudes")(_subset_mode("amplitude"))
query("subset_phases")(_subset_mode("phase"))


@query("period_law_ladder")
def period_law_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = tracking.profile(series(spark, sf_dir), 0.25, 6).selectExpr("object_id", "mid AS t", "period AS y", "period_error AS dy")
    return emit(law_fits.ladder(profile, (*law_fits.AUTO, "power")), "object_id rank law n parameters", "period chi2 bic_scaled", 3)


@query("mode_spacings")
def mode_spacings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = series(spark, sf_dir)
    modes = kernels.best_periods(o, "gls", n=12, separation=6, grid=grids.gls_grid(o)).selectExpr("object_id", "period", "power AS amplitude")
    return emit(spacing.series(modes), "object_id n_modes n_members", "comb_spacing mean_spacing intercept slope rms", 5)


def _noise_sql(level: str) -> str:
    """peaks.noise_curve with windows of 0.07 cycles per day, ten samples at least."""
    return (
        f"WITH {_obs_sql()}, {_centred(False)}, {_grid()}, {_trig()}, spec AS (SELECT object_id, k, f, 2 * sqrt(yc_ * yc_ + ys_ * ys_) AS a FROM trig), "
        "b AS (SELECT *, count(*) OVER g AS n, count(*) OVER near AS box FROM spec WINDOW g AS (PARTITION BY object_id), near AS (PARTITION BY object_id ORDER BY f RANGE BETWEEN 0.07::DOUBLE PRECEDING AND 0.07::DOUBLE FOLLOWING)), "
        f"v AS (SELECT *, {level}(a) OVER (PARTITION BY object_id ORDER BY f RANGE BETWEEN 0.07::DOUBLE PRECEDING AND 0.07::DOUBLE FOLLOWING) AS wide, {level}(a) OVER (PARTITION BY object_id ORDER BY k ROWS BETWEEN 20 PRECEDING AND 19 FOLLOWING) AS few, "
        f"{level}(a) FILTER (WHERE k < 40) OVER (PARTITION BY object_id) AS head, {level}(a) FILTER (WHERE k >= n - 40) OVER (PARTITION BY object_id) AS tail FROM b) "
        f"SELECT object_id, k, {_r('CASE WHEN box >= least(40, n) THEN wide WHEN k <= 20 OR n <= 40 THEN head WHEN k - 20 > n - 40 THEN tail ELSE few END')} AS noise FROM v"
    )


def _noise_curve(estimator: str):
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return emit(peaks.noise_curve(spectra.amplitude_spectrum(series(spark, sf_dir), NF, False), 0.07, estimator, 40), "object_id k", "noise")

    return f


query("noise_curve", _noise_sql("avg"))(_noise_curve("mean"))
query("noise_curve_median", _noise_sql("median"))(_noise_curve("median"))


@query("prewhiten_grid", f"WITH {_obs_sql()}, s AS (SELECT object_id, max(t) - min(t) AS b FROM obs GROUP BY object_id HAVING max(t) > min(t)) SELECT object_id, ceil((50 - 1 / b) * 10 * b)::BIGINT + 1 AS nf, {_r('1 / b')} AS f0, 50::DOUBLE AS fmax FROM s")
def prewhiten_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(prewhitening.default_grid(series(spark, sf_dir)), "object_id nf", "f0 fmax")


@query("prewhitened_own_grid")
def prewhitened_own_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = series(spark, sf_dir)
    found = prewhitening.prewhiten(o, grid=grids.gls_grid(o, 10.0), limit=4, min_snr=2.5, max_fap=0.5, min_gain=0.0)
    return emit(found, "object_id rank status", "frequency amplitude snr delta_bic", 4)


@query("period_changes")
def period_change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = catalogue_of_changes.tagged_rows(series(spark, sf_dir), n_rates=3, segments=10, per_interval=8)
    return emit(catalogue_of_changes.table(rows, "summary"), "object_id status n seed_source law n_segments n_intervals", "search_period search_power track_pdot track_chi2 orbit_period", 3)


@query("drift_by_folding")
def drift_by_folding(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = series(spark, sf_dir)
    return emit(drift.rate_search(o, _seeds(o), "pdm", n_rates=4, reach=5.0), "object_id reason n rates", "f rate power steady_power", 5)


@query("several_methods")
def several_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search_methods.search(series(spark, sf_dir), ["Lomb-Scargle", "PDM", "Conditional-Entropy"], n=2, settings={"pdm": {"n_bins": 8}})
    return emit(found, "object_id method rank k", "period f power")


@query("table_function")
def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL table function over all objects."""
    sql_functions.register_table_function(spark)
    series(spark, sf_dir).createOrReplaceTempView("lumenfold_points")
    return emit(spark.sql("SELECT * FROM periodogram(TABLE(SELECT object_id, t, y, dy FROM lumenfold_points) PARTITION BY (object_id), 'gls', 'best', 2)"), "object_id rank k", "period f power")


@query(
    "interpolated_trend",
    f"WITH {_obs_sql()}, b0 AS (SELECT *, floor((t - min(t) OVER (PARTITION BY object_id)) / 2::DOUBLE)::BIGINT AS bin FROM obs), nd AS (SELECT object_id, median(t) AS nt, median(y) AS ny FROM b0 GROUP BY object_id, bin HAVING count(*) >= 2), "
    "cnt AS (SELECT object_id, count(*) AS m FROM nd GROUP BY object_id), lo AS (SELECT o.object_id, o.rid, max_by(ny, nt) AS y0, max(nt) AS t0 FROM obs o JOIN nd ON nd.object_id = o.object_id AND nt <= t GROUP BY o.object_id, o.rid), "
    "hi AS (SELECT o.object_id, o.rid, min_by(ny, nt) AS y1, min(nt) AS t1 FROM obs o JOIN nd ON nd.object_id = o.object_id AND nt > t GROUP BY o.object_id, o.rid), md AS (SELECT object_id, median(y) AS my FROM obs GROUP BY object_id) "
    f"SELECT o.object_id, o.rid, {_r('CASE WHEN coalesce(m, 0) < 2 THEN my WHEN t0 IS NULL THEN y1 WHEN t1 IS NULL THEN y0 ELSE y0 + (y1 - y0) / (t1 - t0) * (t - t0) END')} AS trend FROM obs o JOIN md USING (object_id) LEFT JOIN cnt USING (object_id) LEFT JOIN lo USING (object_id, rid) LEFT JOIN hi USING (object_id, rid)",
)
def interpolated_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(windows.interpolated_trend(series(spark, sf_dir), 4.0, 2), "object_id rid", "trend")


@query("measured_window")
def measured_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(readouts.measured_window_peaks(series(spark, sf_dir)), "object_id rank", "f amplitude ratio", 5)


@query("alias_report")
def alias_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = series(spark, sf_dir)
    return emit(readouts.alias_report(o, spectra.gls(o, NF)), "object_id kind", "predicted f_peak power relative", 5)


@query("wavelets_own_frequencies")
def wavelets_own_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(windows.wwz(series(spark, sf_dir), 4, fmax=0.5), "object_id i k", "f power amplitude", 5)


@query("amplitude_floor")
def amplitude_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = series(spark, sf_dir).select("object_id", "t", F.col("dy").alias("sigma"))
    return emit(ephemeris.amplitude_floor(times, [5.0, 12.0, 30.0]).where("sigma < double('inf')"), "object_id", "outer_period sigma", 4)


@query("multiband_chances")
def multiband_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(multiband.bootstrap_fap(series(spark, sf_dir), 60, 19, model="mhaov"), "object_id", "power fap level_10", 5)


@query("bounded_fits")
def bounded_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each object's best frequency and its double, offsets by band, frequencies within a width of their start."""
    o = series(spark, sf_dir)
    seeds = _seeds(o)
    both = seeds.select("object_id", F.lit(0).alias("component"), "f").unionByName(seeds.select("object_id", F.lit(1).alias("component"), (2 * F.col("f")).alias("f")))
    return emit(natural_fit.fit_objects(o, both, constrained.Constraints(offsets=True), subset="band"), "object_id component parameters", "frequency amplitude rss", 4)


def _transit_search_sql() -> str:
    """transit_search.search with periods from 5 days on, 64 bins, shapes of 2, 4 and 6 bins."""
    t = [(w, j, f"{g!r}::DOUBLE") for w in (2, 4, 6) for j, g in enumerate(boxes.limb_darkened(w))]
    return (
        f"WITH {_obs_sql()}, tpl(width, j, g) AS (VALUES {_values(t)}), c0 AS (SELECT *, 1 / (dy * dy) AS w, min(t) OVER o AS tmin, max(t) OVER o - min(t) OVER o AS b, count(*) OVER o AS n FROM obs WINDOW o AS (PARTITION BY object_id)), "
        "cent AS (SELECT *, t - tmin AS tau, y - sum(w * y) OVER o / sum(w) OVER o AS yc, sum(w) OVER o AS total FROM c0 WHERE n >= 4 AND least(100, b / 2) > 5 WINDOW o AS (PARTITION BY object_id)), "
        "gr AS (SELECT DISTINCT object_id, 1 / least(100, b / 2) AS f0, 0.02::DOUBLE / (2 * b) AS df FROM cent), tr AS (SELECT object_id, k, 1 / (f0 + df * k) AS p FROM (SELECT *, unnest(range(ceil((0.2::DOUBLE - f0) / df)::BIGINT)) AS k FROM gr)), "
        "h AS (SELECT object_id, k, p, least(floor((tau / p - floor(tau / p)) * 64), 63)::BIGINT AS b, sum(w * yc) AS a, sum(w) AS v, min(total) AS total FROM cent JOIN tr USING (object_id) GROUP BY ALL), "
        "s0 AS (SELECT object_id, k, p, total, width, (b - j + 64) % 64 AS start, sum(g * a) AS num, sum(g * v) AS cw, sum(g * g * v) AS den FROM h, tpl GROUP BY ALL), s1 AS (SELECT *, den - cw * cw / total AS d FROM s0), "
        "s2 AS (SELECT *, num * num / d AS sr FROM s1 WHERE num < 0 AND den > 1e-12 * total AND d > 1e-9 * den), m AS (SELECT *, max(sr) OVER (PARTITION BY object_id, k) AS most FROM s2), "
        "o AS (SELECT *, row_number() OVER (PARTITION BY object_id, k ORDER BY width, start) AS rn FROM m WHERE sr >= most * (1 - 1e-9)), sp AS (SELECT tr.object_id, tr.k, tr.p AS period, coalesce(sr, 0) AS power, -num / d AS depth FROM tr LEFT JOIN o ON o.object_id = tr.object_id AND o.k = tr.k AND rn = 1), "
        "z AS (SELECT *, count(*) OVER q AS trials, avg(power) OVER q AS mean, stddev_pop(power) OVER q AS sd, row_number() OVER (PARTITION BY object_id ORDER BY -round(power, 6), period) AS rn FROM sp WINDOW q AS (PARTITION BY object_id)) "
        f"SELECT object_id, trials, k, {', '.join(f'{_r(c, 4)} AS {c}' for c in ('period', 'power', 'depth'))}, {_r('CASE WHEN sd > 0 THEN (power - mean) / sd ELSE 0 END', 4)} AS sde FROM z WHERE rn = 1"
    )


@query("transit_search", _transit_search_sql())
def transit_search_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = series(spark, sf_dir)
    return emit(transit_search.search(o, grids.transit_grid(o, shortest=5.0), 64, [2, 4, 6]), "object_id trials k", "period power depth sde", 4)


@query("transit_search_default")
def transit_search_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return emit(transit_search.search(series(spark, sf_dir)), "object_id trials k", "period power depth duration t0 sde", 4)


query("long_period_boxes")(_long_periods("bls", grids.box_grid))
query("long_period_transits")(_long_periods("tls", grids.transit_grid))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
