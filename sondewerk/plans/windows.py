"""Queries of the window kernels, each with SQL that works it out from sums: Fourier sums, filters and runs over windows of 64 samples."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondewerk.functions import composer, kernels
from sondewerk.operators import frames, inference
from sondewerk.plans.analytics import _U, _UNITS, _units, query
from sondewerk.plans.grammar import BASE, whole_windows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
N = 64
PLACES = 5


def checked(sql: str | None = None) -> Callable:
    return query(sql, QUERIES, ORACLES)


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_windows(spark, sf_dir).filter(F.size("x") == N)


_X = BASE + f", w64 as (select window_id from s group by 1 having count(*) = {N}), x as (select s.window_id, s.i, s.v, avg(s.v) over (partition by s.window_id) as m from s semi join w64 using (window_id))"


def _fourier(name: str, source: str, term: str) -> str:
    """A relation of |F(k)|^2 (p) per window and k = 0..N/2 for the series term of a relation with window_id and i."""
    parts = ", ".join(f"sum(({term}) * {f}(2 * pi() * i * k / {N})) as {a}" for f, a in (("cos", "re"), ("sin", "im")))
    return f", {name} as (select window_id, k, re * re + im * im as p from (select window_id, k, {parts} from {source}, range(0, {N // 2 + 1}) r(k) group by all))"


def _kernel_query(name: str, doc: str, kernel: Callable[[np.ndarray], np.ndarray], columns: list[str], sql: str) -> None:
    """A kernel over windows as a query, rounded to PLACES like its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = frames.map_series(_windows(spark, sf_dir), ["window_id"], "x", kernel, columns)
        return out.select("window_id", *[(F.round(c, PLACES) + 0.0).alias(c) for c in columns])

    run.__name__, run.__doc__ = name, doc
    checked(sql)(run)


def _rounded(values: dict[str, str]) -> str:
    return ", ".join(f"round({v}, {PLACES}) + 0.0 as {k}" for k, v in values.items())


_METRICS = kernels.profile_metrics
_kernel_query("window_concentration", "Share of the strongest frequency.", lambda x: _METRICS(x)[:, :1], ["concentration"], _X + _fourier("f", "x", "v - m") + " select window_id, " + _rounded({"concentration": "max(p) / (sum(p) + 1e-12)"}) + " from f group by 1")
_kernel_query("window_noise", "Usual step against the spread.", lambda x: _METRICS(x)[:, 1:2], ["noise"], _X + ", d as (select window_id, v, abs(v - lag(v) over (partition by window_id order by i)) as d from x) select window_id, " + _rounded({"noise": "median(d) / (stddev_pop(v) + 1e-12)"}) + " from d group by 1")
_kernel_query("window_drift", "Difference of the first and the last quarter in level and spread.", lambda x: _METRICS(x)[:, 2:3], ["drift"], _X + ", q as (select window_id, avg(v) filter (where i < 16) as a, avg(v) filter (where i >= 48) as b, stddev_pop(v) filter (where i < 16) as c, stddev_pop(v) filter (where i >= 48) as d from x group by 1) select window_id, " + _rounded({"drift": "abs(a - b) + abs(c - d)"}) + " from q")
_kernel_query("window_impulsiveness", "Largest against usual size.", lambda x: _METRICS(x)[:, 3:], ["impulsiveness"], _X + " select window_id, " + _rounded({"impulsiveness": "max(abs(v)) / (avg(abs(v)) + 1e-12)"}) + " from x group by 1")

# one periodic Hann segment as long as the window; inner bins count twice
_WELCH = _X + _fourier("h", "x", f"(v - m) * (0.5 - 0.5 * cos(2 * pi() * i / {N}))") + f", w as (select window_id, k, p * case when k in (0, {N // 2}) then 1 else 2 end / (select sum((0.5 - 0.5 * cos(2 * pi() * i / {N})) ** 2) from range(0, {N}) t(i)) as p from h), q as (select window_id, k, p, p / (sum(p) over (partition by window_id) + 1e-12) as q from w)"
_kernel_query("window_psd_slope", "Slope of log power over log frequency.", lambda x: kernels.psd_slope(x)[:, None], ["slope"], _WELCH + " select window_id, " + _rounded({"slope": f"regr_slope(ln(p + 1e-20), ln(k / {N}.0))"}) + " from q where k > 0 group by 1")
_kernel_query("window_centroid", "Mean frequency of the power.", lambda x: kernels.welch_descriptors(x)[:, :1], ["centroid"], _WELCH + " select window_id, " + _rounded({"centroid": f"sum(q * k / {N})"}) + " from q group by 1")
_kernel_query("window_spectral_entropy", "Entropy of the power.", lambda x: kernels.welch_descriptors(x)[:, 1:2], ["entropy"], _WELCH + " select window_id, " + _rounded({"entropy": f"-sum(q * ln(q + 1e-12)) / ln({N // 2 + 1})"}) + " from q group by 1")
_kernel_query("window_upper_share", "Share of the power above the middle frequency.", lambda x: kernels.welch_descriptors(x)[:, 2:], ["upper"], _WELCH + " select window_id, " + _rounded({"upper": f"sum(q) filter (where k > {N // 4})"}) + " from q group by 1")

# the analytic signal from its Fourier sums, then its length
_ENVELOPE = _X + f""", f as (select window_id, k, sum(v * cos(2 * pi() * i * k / {N})) as re, -sum(v * sin(2 * pi() * i * k / {N})) as im from x, range(0, {N // 2 + 1}) r(k) group by all),
a as (select window_id, i, sum(h * (re * cos(2 * pi() * i * k / {N}) - im * sin(2 * pi() * i * k / {N}))) / {N} as re, sum(h * (re * sin(2 * pi() * i * k / {N}) + im * cos(2 * pi() * i * k / {N}))) / {N} as im
      from (select *, case when k in (0, {N // 2}) then 1 else 2 end as h from f), range(0, {N}) t(i) group by all),
e as (select window_id, i, sqrt(re * re + im * im) as v, avg(sqrt(re * re + im * im)) over (partition by window_id) as m from a)"""
_kernel_query("window_envelope_bands", "Shares of five bands of the envelope's spectrum.", kernels.envelope_bands, [f"band{j}" for j in range(5)], _ENVELOPE + _fourier("g", "e", "v - m") + ", gb as (select window_id, p, (k - 1) // 3 as band, sum(p) over (partition by window_id) as total from g where k between 1 and 15) select window_id, " + _rounded({f"band{j}": f"sum(p) filter (where band = {j}) / (any_value(total) + 1e-12)" for j in range(5)}) + " from gb group by 1")
_kernel_query("window_envelope_kurtosis", "Kurtosis of the envelope.", lambda x: kernels.envelope_kurtosis(x)[:, None], ["kurtosis"], _ENVELOPE + " select window_id, " + _rounded({"kurtosis": "avg((v - m) ** 4) / (avg((v - m) ** 2) ** 2 + 1e-12)"}) + " from e group by 1")

_FILTER = "t as (select unnest(range(0, 8)) as j, unnest([" + ", ".join(map(repr, kernels.DB4)) + "]::double[]) as lo, unnest([" + ", ".join(repr(v * (-1) ** j) for j, v in enumerate(kernels.DB4[::-1])) + "]::double[]) as hi)"


def _wavelet_sql(levels: int) -> str:
    sql, n = _X + ", " + _FILTER + ", a0 as (select window_id, i, v from x)", N
    for j in range(1, levels + 1):
        sql += f", l{j} as (select a.window_id, o.i, sum(a.v * t.lo) as v, sum(a.v * t.hi) as d from range(0, {n // 2}) o(i), t, a{j - 1} a where a.i = (2 * o.i + t.j) % {n} group by all), a{j} as (select window_id, i, v from l{j})"
        n //= 2
    parts = [f"select window_id, 'd{j}' as name, sum(d * d) as e from l{j} group by 1" for j in range(1, levels + 1)] + [f"select window_id, 'a{levels}' as name, sum(v * v) as e from a{levels} group by 1"]
    return sql + f", y as ({' union all '.join(parts)}), z as (select *, sum(e) over (partition by window_id) + 1e-12 as total from y)"


_WAVES = ["d1", "d2", "d3", "a3"]
_kernel_query("window_wavelet_shares", "Relative energies of three levels of the wavelet.", lambda x: kernels.wavelet_energies(x, 3), _WAVES, _wavelet_sql(3) + " select window_id, " + _rounded({c: f"sum(e) filter (where name = '{c}') / any_value(total)" for c in _WAVES}) + " from z group by 1")
_kernel_query("window_wavelet_entropy", "Entropy of these energies.", lambda x: kernels.wavelet_entropy(x, 3)[:, None], ["entropy"], _wavelet_sql(3) + " select window_id, " + _rounded({"entropy": "-sum(e / total * ln(e / total + 1e-12))"}) + " from z group by 1")

_TREND = _X + ", r as (select window_id, regr_slope(v, i) as b, avg(i) as c from x group by 1), d as (select window_id, i, v - m - b * (i - c) as v from x join r using (window_id)), l as (select *, lag(v) over (partition by window_id order by i) as u from d)"
_kernel_query("window_ar1", "Lag-one correlation of the detrended window.", lambda x: kernels.slowing(x)[:, :1], ["ar1"], _TREND + " select window_id, " + _rounded({"ar1": "sum(u * v) / (sum(v * v) + 1e-12)"}) + " from l group by 1")
_kernel_query("window_log_variance", "Logarithm of the detrended window's variance.", lambda x: kernels.slowing(x)[:, 1:], ["log_var"], _TREND + " select window_id, " + _rounded({"log_var": "log10(var_pop(v) + 1e-12)"}) + " from l group by 1")
_kernel_query("window_rms", "Root mean square.", lambda x: kernels.rms_kurtosis(x)[:, :1], ["rms"], _X + " select window_id, " + _rounded({"rms": "sqrt(avg(v * v))"}) + " from x group by 1")
_kernel_query("window_max_acf", "Largest autocorrelation at any lag.", lambda x: kernels.max_acf(x)[:, None], ["acf"], _X + ", g as (select a.window_id, b.i - a.i as lag, abs(sum((a.v - a.m) * (b.v - b.m))) as c from x a join x b on a.window_id = b.window_id and b.i > a.i group by all), e as (select window_id, sum((v - m) ** 2) + 1e-12 as e from x group by 1) select window_id, " + _rounded({"acf": "max(c / e)"}) + " from g join e using (window_id) group by 1")
_kernel_query("window_resampled", "The window on half as many points by its Fourier sum: its first and second moment.", lambda x: (lambda y: np.stack([y.mean(axis=1), (y * y).mean(axis=1)], axis=1))(kernels.resample_fourier(x, N // 2)), ["level", "square"],
    _X + f", f as (select window_id, k, sum(v * cos(2 * pi() * i * k / {N})) as re, -sum(v * sin(2 * pi() * i * k / {N})) as im from x, range(0, {N // 4 + 1}) r(k) group by all), y as (select window_id, i, sum(h * (re * cos(2 * pi() * i * k / {N // 2}) - im * sin(2 * pi() * i * k / {N // 2}))) / {N} as v from (select *, case when k = 0 then 1 when k = {N // 4} then 1 else 2 end as h from f), range(0, {N // 2}) t(i) group by all) select window_id, " + _rounded({"level": "avg(v)", "square": "avg(v * v)"}) + " from y group by 1")

# recurrence: delay vectors of 3 samples 5 apart, the closest tenth of all pairs recur, lines are runs along diagonals and columns
_P = N - 2 * 5
_RECUR = _X + f""", v as (select a.window_id, a.i, a.v as v0, b.v as v1, c.v as v2 from x a join x b on b.window_id = a.window_id and b.i = a.i + 5 join x c on c.window_id = a.window_id and c.i = a.i + 10),
d as (select a.window_id, a.i, b.i as j, greatest(abs(a.v0 - b.v0), abs(a.v1 - b.v1), abs(a.v2 - b.v2)) as d from v a join v b using (window_id)),
q as (select window_id, quantile_cont(d, 0.1) as eps from d group by 1), rec as (select d.* from d join q using (window_id) where d.d < eps),
dl as (select window_id, count(*) as n from (select window_id, j - i as k, i - row_number() over (partition by window_id, j - i order by i) as run from rec where j > i) group by window_id, k, run),
vl as (select window_id, count(*) as n from (select window_id, j, i - row_number() over (partition by window_id, j order by i) as run from rec) group by window_id, j, run)"""
_LINES = {
    "rqa_rr": f" select w64.window_id, round(coalesce(count(rec.i), 0) / {float(_P * _P - _P)}, {PLACES}) + 0.0 as rqa_rr from w64 left join rec on rec.window_id = w64.window_id and rec.i <> rec.j group by 1",
    "rqa_det": f" select w64.window_id, round(coalesce(sum(n) filter (where n >= 2) / sum(n), 0), {PLACES}) + 0.0 as rqa_det from w64 left join dl using (window_id) group by 1",
    "rqa_lam": f" select w64.window_id, round(coalesce(sum(n) filter (where n >= 2) / sum(n), 0), {PLACES}) + 0.0 as rqa_lam from w64 left join vl using (window_id) group by 1",
    "rqa_entr": f", c as (select window_id, n, count(*) as k from dl where n >= 2 group by all), pr as (select window_id, k / sum(k) over (partition by window_id) as p from c) select w64.window_id, round(coalesce(-sum(p * ln(p)), 0), {PLACES}) + 0.0 as rqa_entr from w64 left join pr using (window_id) group by 1",
    "rqa_lmean": f" select w64.window_id, round(coalesce(avg(n) filter (where n >= 2), 0), {PLACES}) + 0.0 as rqa_lmean from w64 left join dl using (window_id) group by 1",
    "rqa_tt": f" select w64.window_id, round(coalesce(avg(n) filter (where n >= 2), 0), {PLACES}) + 0.0 as rqa_tt from w64 left join vl using (window_id) group by 1",
}
for _j, _name in enumerate(kernels.RQA_NAMES):
    _kernel_query(f"window_{_name}", f"Recurrence: {_name}.", lambda x, j=_j: kernels.rqa(x)[:, j : j + 1], [_name], _RECUR + _LINES[_name])


# ------------------------------------------------------------------ composer
_SPANS = {s: max(composer.LEAST, int(N * share)) for s, share in composer.SCALES.items()}


def _view_query(view: str, per_span: Callable[[int], str]) -> None:
    """The deviation of a view at every scale; per_span: SQL of (window_id, u) for the last span samples."""
    names = list(composer.SCALES)
    parts = " union all ".join(f"select window_id, '{s}' as scale, stddev_pop(u) as d from ({per_span(n)}) group by 1" for s, n in _SPANS.items())
    _kernel_query(f"composer_{view}", f"Deviation of the view {view} at every scale.", lambda x: composer.table(x, [composer.Measure(view, 0, s, "std") for s in names]), names, _X + f", z as ({parts}) select window_id, " + _rounded({s: f"max(d) filter (where scale = '{s}')" for s in names}) + " from z group by 1")


def _span(n: int) -> str:
    return f"(select window_id, i - {N - n} as i, v from x where i >= {N - n})"


def _mean_of(n: int) -> str:
    k = int(np.clip(n // 16, 2, 8))
    return f"select window_id, avg(abs(v)) over (partition by window_id order by i rows between {k - 1} preceding and current row) as u, i from {_span(n)} qualify i >= {k - 1}"


_view_query("raw", lambda n: f"select window_id, v as u from {_span(n)}")
_view_query("diff", lambda n: f"select window_id, v - lag(v) over (partition by window_id order by i) as u from {_span(n)}")
_view_query("lag", lambda n: f"select window_id, v - lag(v, {composer.LAG}) over (partition by window_id order by i) as u from {_span(n)}")
_view_query("envelope", _mean_of)
_view_query("spectrum", lambda n: f"select window_id, sqrt(sum(v * cos(2 * pi() * i * k / {n})) ** 2 + sum(v * sin(2 * pi() * i * k / {n})) ** 2) as u from {_span(n)}, range(0, {n // 2 + 1}) r(k) group by window_id, k")


# ------------------------------------------------------------------ intervals
def _cumulative(k: int) -> float:
    return sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))


_DRAW = " + ".join(f"(u >= {_cumulative(k)!r})::int" for k in range(9))


@checked(_UNITS + f""", m as (select y, b, score as v, {_U.format('g')} as u from r, range(1, 201) t(b) where score is not null), d as (select y, b, sum(({_DRAW}) * v) / nullif(sum({_DRAW}), 0) as m from m group by all)
select y, (select round(avg(score), {PLACES}) from r where r.y = d.y) as mean, round(quantile_cont(m, 0.025), {PLACES}) as lo, round(quantile_cont(m, 0.975), {PLACES}) as hi from d group by 1""")
def score_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of the mean recording score per label."""
    b = inference.bootstrap_mean(_units(spark, sf_dir), "g", "score", 200, keys=["y"])
    return b.select("y", *[F.round(c, PLACES).alias(c) for c in ("mean", "lo", "hi")])
