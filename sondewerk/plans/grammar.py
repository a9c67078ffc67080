"""Queries of the series grammar over bank_windows, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondewerk.functions import series


def whole_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(window_id, g, y, split, x): windows without a null or NaN sample, as doubles."""
    w = spark.read.parquet(f"{sf_dir}/bank_windows.parquet")
    whole = F.col("windows").isNotNull() & F.forall("windows", lambda v: v.isNotNull() & ~F.isnan(v)) & (F.size("windows") > 0)
    return w.filter(whole).select("window_id", "g", "y", "split", F.col("windows").cast("array<double>").alias("x"))


def _transform_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = whole_windows(spark, sf_dir).select("window_id", series.TRANSFORMS[name](F.col("x")).alias("t"))
        weighted = series.total(F.transform("t", lambda v, i: v * (i + 1)))
        return t.select("window_id", F.size("t").cast("bigint").alias("n"), F.round(series.total(F.col("t").cast("array<double>")), 6).alias("total"), F.round(weighted, 5).alias("weighted"))

    return run


def _pool_query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return whole_windows(spark, sf_dir).select("window_id", F.round(series.finite(series.POOLS[name](F.col("x"))), 6).alias("value"))

    return run


BASE = """
with b as (select window_id, g, y, split, windows from bank_windows where windows is not null and len(windows) > 0 and len(list_filter(windows, lambda v: v is null or isnan(v))) = 0),
s as (select window_id, unnest(windows)::double as v, generate_subscripts(windows, 1) - 1 as i from b)"""

_W = "over (partition by window_id order by i)"
_STEPS = {
    "id": "select window_id, i, v from s",
    "diff": f"select window_id, i, v - lag(v) {_W} as v from s qualify lag(v) {_W} is not null",
    "diff2": f"select window_id, i, v - 2 * lag(v) {_W} + lag(v, 2) {_W} as v from s qualify lag(v, 2) {_W} is not null",
    "abs": "select window_id, i, abs(v) as v from s",
    "sign": "select window_id, i, sign(v) as v from s",
    "rank": "select window_id, i, (row_number() over (partition by window_id order by v, i) - 1)::double / count(*) over (partition by window_id) as v from s",
    "sq": "select window_id, i, v * v as v from s",
    "tanh": "select window_id, i, tanh(v) as v from s",
    "rollstd": "select window_id, i, sqrt(greatest(avg(v * v) over w - (avg(v) over w) ** 2, 0)) as v from s window w as (partition by window_id order by i rows 15 preceding) qualify i >= 15",
    "env": "select window_id, i, avg(abs(v)) over (partition by window_id order by i rows 7 preceding) as v from s qualify i >= 7",
    "cumsum": "select window_id, i, c / (max(abs(c)) over (partition by window_id) + 1e-12) as v from (select window_id, i, sum(v - m) over (partition by window_id order by i rows unbounded preceding) as c from (select *, avg(v) over (partition by window_id) as m from s))",
    "clip": "select s.window_id, i, least(greatest(v, lo), hi) as v from s join (select window_id, quantile_cont(v, 0.05) as lo, quantile_cont(v, 0.95) as hi from s group by 1) q using (window_id)",
}

_SIDES = f", d as (select *, sign(v - median(v) over (partition by window_id)) as sg from s), c as (select *, sg <> lag(sg) {_W} as ch from d)"
_RUNS = _SIDES + ", r as (select window_id, run, count(*)::double as len from (select window_id, sum(case when ch then 1 else 0 end) over (partition by window_id order by i rows unbounded preceding) as run from c) group by all)"
_GAPS = ", gap as (select window_id, i - lag(i) over (partition by window_id order by i) as d from pk)"
_GAP_CV = " select b.window_id, round(case when count(gap.d) < 2 then 0 else stddev_pop(gap.d) / (avg(gap.d) + 1e-12) end, 6) as value from b left join gap using (window_id) group by 1"
_POWER = """, n as (select window_id, count(*) as n from s group by 1),
f as (select window_id, n, unnest(range(0, n // 2 + 1)) as k from n),
p as (select window_id, k, sum(v * cos(2 * pi() * (k * i % n) / n)) ** 2 + sum(v * sin(2 * pi() * (k * i % n) / n)) ** 2 as p from f join s using (window_id) group by all),
q as (select *, count(*) over (partition by window_id) as bins from p)"""
_POOLS = {
    "std": " select window_id, round(stddev_pop(v), 6) as value from s group by 1",
    "meanabs": " select window_id, round(avg(abs(v)), 6) as value from s group by 1",
    "iqr90": " select window_id, round(quantile_cont(v, 0.95) - quantile_cont(v, 0.05), 6) as value from s group by 1",
    "hent": ", e as (select window_id, min(v) as lo, max(v) as hi, count(*) as n from s group by 1), h as (select window_id, n, case when hi > lo then least(15, floor((v - lo) * (16.0::double / (hi - lo)))) else 8 end as c, count(*) as k from s join e using (window_id) group by all) select window_id, round(-sum(k / n * ln(k / n)), 6) + 0.0 as value from h group by 1",
    "zcr": _SIDES + " select window_id, round(avg(ch::int), 6) as value from c where ch is not null group by 1",
    "acf1": f", m as (select *, v - avg(v) over (partition by window_id) as z from s), l as (select *, lag(z) {_W} as y from m) select window_id, round(case when sum(z * z) > 0 then sum(z * y) / sum(z * z) else 0 end, 6) as value from l group by 1",
    "runmean": _RUNS + " select window_id, round(avg(len), 6) as value from r group by 1",
    "runcv": _RUNS + " select window_id, round(stddev_pop(len) / (avg(len) + 1e-12), 6) as value from r group by 1",
    "peakcv": f", pk as (select window_id, i from s qualify v > lag(v) {_W} and v > lead(v) {_W})" + _GAPS + _GAP_CV,
    "specratio": _POWER + " select window_id, round(sum(case when k >= bins // 4 then p end) / (sum(case when k < bins // 4 then p else 0 end) + 1e-12), 6) as value from q group by 1",
    "speccent": _POWER + " select window_id, round(sum(k * p) / (sum(p) + 1e-12) / max(bins), 6) as value from q group by 1",
    "crest": " select window_id, round(max(abs(v)) / (avg(abs(v)) + 1e-12), 6) as value from s group by 1",
    "ordtrans": f", u as (select window_id, i, (lag(v) {_W} < v)::int as up from s), o as (select window_id, i, lag(up) {_W} * 2 + up as st from u), t as (select window_id, lag(st) {_W} * 4 + st as mv from o), h as (select window_id, mv, count(*) as k from t where mv is not null group by all), n as (select *, sum(k) over (partition by window_id) as n from h) select window_id, round(-sum(k / n * ln(k / n)), 6) + 0.0 as value from n group by 1",
    "lcross": f", pk as (select window_id, i from s qualify lag(v) {_W} < 1 and v >= 1)" + _GAPS + _GAP_CV,
    "acflag": ", m as (select *, v - avg(v) over (partition by window_id) as z from s), a as (select b.window_id, k, coalesce(sum(x.z * y.z), 0) as ac from b, range(2, 65) r(k) left join m y on y.window_id = b.window_id and y.i >= k left join m x on x.window_id = b.window_id and x.i = y.i - k group by all) select window_id, round(arg_max(k, ac) / 64.0::double, 6) as value from (select * from a order by window_id, k) group by 1",
    "specflat": _POWER + " select window_id, round(exp(avg(ln(p + 1e-20))) / avg(p + 1e-20), 6) as value from q group by 1",
}

QUERIES = {f"series_{n}": _transform_query(n) for n in series.TRANSFORMS} | {f"pool_{n}": _pool_query(n) for n in series.POOLS}
ORACLES = {f"series_{n}": f"{BASE}, t as ({sql}), k as (select *, row_number() {_W} as j from t) select window_id, count(*) as n, round(sum(v), 6) as total, round(sum(v * j), 5) as weighted from k group by 1" for n, sql in _STEPS.items()}
ORACLES |= {f"pool_{n}": BASE + sql for n, sql in _POOLS.items()}
