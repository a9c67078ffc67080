"""Queries of the picking and labelling operators, of composer expressions and rankings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondewerk.functions import composer, grammar
from sondewerk.operators import detector, frames, picks, watch
from sondewerk.plans import distill
from sondewerk.plans.grammar import BASE, whole_windows
from sondewerk.plans.problems import table
from sondewerk.sources import simulator

_RUNS = """with e as (select node_id, row_number() over (partition by node_id order by emb_id) - 1 as i, case when energy_rms is null or not isfinite(energy_rms) then 1 else 0 end as bad from frame_embeddings where node_id is not null),
r as (select *, sum(bad) over (partition by node_id order by i rows unbounded preceding) as run from e), f as (select node_id, run, min(i) as start, count(*) as length from r where bad = 0 group by all)"""


def finite_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.finite_runs(table(spark, sf_dir, "frame_embeddings").filter("node_id is not null"), ["node_id"], ["emb_id"], "energy_rms", 4)


def first_finite_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.first_finite_run(table(spark, sf_dir, "frame_embeddings").filter("node_id is not null"), ["node_id"], ["emb_id"], "energy_rms", 10)


def even_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.even_picks(table(spark, sf_dir, "bank_windows").filter("g is not null").select("window_id", "g"), ["g"], ["window_id"], 4)


def life_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.life_stage(table(spark, sf_dir, "bank_windows").filter("g is not null").select("window_id", "g"), ["g"], ["window_id"])


def relative_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "frame_embeddings").filter("node_id is not null and energy_rms > 0 and energy_rms < double('Infinity')").select("emb_id", "node_id", "energy_rms")
    return picks.relative_to_first(e, ["node_id"], ["emb_id"], "energy_rms").select("emb_id", F.round("ratio", 6).alias("ratio"))


def error_terciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks.quantile_labels(table(spark, sf_dir, "frame_embeddings").select("emb_id", "recon_error"), "recon_error").groupBy("label").agg(F.count("*").alias("n"))


def episode_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = watch.onsets(watch.kp_bins(table(spark, sf_dir, "geomag_watch")))
    return picks.episode_plan(o, ["watcher"], "onset", (-24, -12, -6), 12)


def energy_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "frame_embeddings").filter("node_id is not null and energy_rms is not null and abs(energy_rms) < double('Infinity') and not isnan(energy_rms)")
    return picks.peak_window(e, ["node_id"], ["emb_id"], "energy_rms", 8).select("node_id", F.round("spread", 4).alias("spread"))


def window_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = picks.exact_duplicates(table(spark, sf_dir, "bank_windows").filter("windows is not null and g is not null"), "g", watch.digest(F.col("windows")))
    return d.groupBy("groups", "rows").agg(F.count("*").alias("values"))


def composer_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw view under every statistic."""
    exprs = [composer.Measure("raw", 0, "full", s) for s in composer.STATS]
    f = frames.map_series(whole_windows(spark, sf_dir), ["window_id"], "x", lambda x: composer.table(x, exprs), list(composer.STATS))
    return f.select("window_id", *[F.round(s, 6).alias(s) for s in composer.STATS])


def composer_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deviation of the phase at every scale (the other views have SQL, in the queries of the windows)."""
    exprs = [composer.Measure("phase", 0, s, "std") for s in composer.SCALES]
    return frames.map_series(whole_windows(spark, sf_dir), ["window_id"], "x", lambda x: composer.table(x, exprs), list(composer.SCALES))


def distill_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole gated catalogue by the ANOVA F of the programs' recording means."""
    w = whole_windows(spark, sf_dir).filter("g is not null and y is not null").withColumn("y", F.lower("y"))
    programs = grammar.gate(grammar.catalogue(), w.select("g").distinct().count())
    return distill.ranking(distill.matrix(w, programs), programs).select("program", "f")


def catalogue_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue in its order."""
    return spark.createDataFrame([(i, p.name, p.pool, *p.complexity[:3]) for i, p in enumerate(grammar.catalogue())], "place int, program string, pool string, depth int, pool_cost int, transform_cost int").groupBy("depth", "pool_cost").agg(F.count("*").alias("programs"))


def reconstruction_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of every whole window under the leading directions of the healthy fit windows."""
    w = whole_windows(spark, sf_dir).filter(F.size("x") == 64)
    m = detector.Reconstruction.fit(w.filter("split = 'fit' and lower(y) = 'normal'"), "x", 8)
    return frames.map_series(w, ["window_id"], "x", lambda x: m.embed(x)[1][:, None], ["error"])


def simulated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulator.frames(spark, 256).groupBy("sensor_class").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (finite_runs, first_finite_run, even_picks, life_stages, relative_energy, error_terciles, episode_points, energy_peaks, window_duplicates, composer_statistics, composer_phase, distill_ranking, catalogue_programs, reconstruction_errors, simulated_frames)}
_PLACED = "with p as (select window_id, g, row_number() over (partition by g order by window_id) - 1 as i, count(*) over (partition by g) as n from bank_windows where g is not null)"
ORACLES = {
    "finite_runs": _RUNS + " select node_id, start, length from f where length >= 4",
    "first_finite_run": _RUNS + " select node_id, min(start) as start, arg_min(length, start) as length from f where length >= 10 group by 1",
    "even_picks": _PLACED + " select distinct window_id, g from p, range(0, 4) r(j) where n <= 4 or i = floor(j * (n - 1) / 3)",
    "life_stages": _PLACED + " select window_id, g, least(i // greatest(n // 3, 1), 2)::int as stage from p",
    "relative_energy": "select emb_id, round(energy_rms / first(energy_rms) over (partition by node_id order by emb_id), 6) as ratio from frame_embeddings where node_id is not null and energy_rms > 0 and isfinite(energy_rms)",
    "error_terciles": "with e as (select recon_error as v from frame_embeddings where recon_error is not null and not isnan(recon_error)), q as (select quantile_cont(v, 1.0::double / 3) as a, quantile_cont(v, 2.0::double / 3) as b from e) select (v > a)::int + (v > b)::int as label, count(*) as n from e, q group by 1",
    "energy_peaks": "with s as (select node_id, stddev_pop(energy_rms) over w as sd, count(*) over w as n from frame_embeddings where node_id is not null and energy_rms is not null and isfinite(energy_rms) window w as (partition by node_id order by emb_id rows 7 preceding)) select node_id, round(max(sd), 4) as spread from s where n = 8 group by 1",
    "window_duplicates": "with d as (select windows, count(distinct g) as groups, count(*) as rows from bank_windows where windows is not null and g is not null group by 1) select groups, rows, count(*) as values from d where groups > 1 group by all",
    "composer_statistics": BASE + ", n as (select window_id, max(i) as m, count(*) as n, sum(abs(v) + 1e-12) as mass from s group by 1) select s.window_id, round(avg(abs(v)), 6) as meanabs, round(stddev_pop(v), 6) as std, round(quantile_cont(v, 0.9) - quantile_cont(v, 0.1), 6) as iqr, round(regr_slope(v, i), 6) as slope, round(-sum((abs(v) + 1e-12) / mass * ln((abs(v) + 1e-12) / mass)) / ln(any_value(n)), 6) as entropy from s join n using (window_id) group by 1",
    "episode_points": """with b as (select watcher, latest.time_tag::timestamp as t, max(latest.kp) as kp from geomag_watch where latest.kp between 0 and 9 and latest.time_tag is not null and watcher is not null group by all),
w as (select *, lag(kp) over (partition by watcher order by t) as p, max(kp) over (partition by watcher order by t rows between 8 preceding and 1 preceding) as m from b), o as (select watcher, t, lag(t) over (partition by watcher order by t) as before from w where kp >= 5 and p < 5 and m < 5)
select watcher, epoch(t)::bigint as episode, h::int as offset_h, (epoch(t) + h * 3600)::bigint as at from o, (select unnest([-24, -12, -6]) as h) x where before is null or epoch(t) + h * 3600 >= epoch(before) + 12 * 3600""",
    "simulated_frames": "select unnest(range(0, 8))::int as sensor_class, 32::bigint as n",
}
