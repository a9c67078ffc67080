"""The queries of the general data problems (p1, p3, p4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondewerk.operators import anomaly, dedup, regrid
from sondewerk.util import materialize


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.redelivered(table(spark, sf_dir, "frames"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = (
        ("frames", anomaly.bad_frames(table(spark, sf_dir, "frames")), "delivery_id"),
        ("frame_embeddings", anomaly.bad_energies(table(spark, sf_dir, "frame_embeddings")), "emb_id"),
        ("geomag_watch", anomaly.bad_polls(table(spark, sf_dir, "geomag_watch")), "poll_id"),
    )
    out = [df.select(F.lit(name).alias("tbl"), F.col(key).alias("row_id")) for name, df, key in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def p3_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale, threshold and number of hits of every wavelet level of every node's payloads."""
    return anomaly.frame_levels(table(spark, sf_dir, "frames"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = regrid.frame_series(table(spark, sf_dir, "frames"), table(spark, sf_dir, "nodes"), only_missing=True)
    polls = regrid.poll_series(table(spark, sf_dir, "geomag_watch"), only_missing=True)
    named = [df.filter("missing").select(F.lit(t).alias("tbl"), "src", "period_us") for t, df in (("frames", frames), ("geomag_watch", polls))]
    return named[0].unionByName(named[1])


def p4_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every period of every source: readings, whether it is missing, whether it could be estimated, never both a value and an estimate."""
    frames = regrid.frame_series(table(spark, sf_dir, "frames"), table(spark, sf_dir, "nodes"))
    polls = regrid.poll_series(table(spark, sf_dir, "geomag_watch"))
    named = [df.select(F.lit(t).alias("tbl"), "src", "period_us", "readings", "missing", "value", "estimate") for t, df in (("frames", frames), ("geomag_watch", polls))]
    return named[0].unionByName(named[1])


def p4_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: periods, missing ones, readings, and periods that are both read and estimated (none)."""
    s = p4_series(spark, sf_dir)
    mixed = F.count_if(F.col("estimate").isNotNull() & ~F.col("missing"))
    return s.groupBy("tbl", "src").agg(F.count("*").alias("periods"), F.count_if("missing").alias("missing"), F.sum("readings").alias("readings"), mixed.alias("mixed"))


def p1_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deliveries kept when the later half of the batches comes to the stored messages of the earlier half."""
    frames = table(spark, sf_dir, "frames")
    half = frames.agg(F.expr("(min(batch_id) + max(batch_id)) div 2").alias("b")).first()["b"]
    if half is None:
        return frames.select("delivery_id").limit(0)
    stored = materialize(dedup.kept(frames.filter(F.col("batch_id") <= half)))
    late = dedup.admit(frames.filter(F.col("batch_id") > half).select("delivery_id", "node_id", "seq", "ts_us", "received_at"), stored)
    named = late.filter("delivery_id is not null and node_id is not null and seq is not null and ts_us is not null")
    return stored.select(F.col("kept_id").alias("delivery_id")).unionByName(named.select("delivery_id"))


QUERIES = {f.__name__: f for f in (p1_found, p1_admitted, p3_found, p3_levels, p4_found, p4_series, p4_sources)}

_MESSAGES = """
with d as (select *, ts_us - lag(ts_us) over (partition by node_id, seq order by ts_us, delivery_id) as gap
           from frames where node_id is not null and seq is not null and ts_us is not null),
m as (select *, sum(case when gap is null or gap > 2000000 then 1 else 0 end)
             over (partition by node_id, seq order by ts_us, delivery_id rows unbounded preceding) as msg from d)"""

ORACLES = {
    "p1_found": _MESSAGES + """,
r as (select delivery_id, row_number() over (partition by node_id, seq, msg order by received_at nulls last, delivery_id) as rn from m)
select delivery_id from r where rn > 1""",
    "p3_found": _MESSAGES + """,
f as (select delivery_id, node_id, payload, list_min(payload) as lo, list_max(payload) as hi from frames
      where node_id is not null and payload is not null and len(payload) > 0),
s as (select node_id, unnest(payload) as x from f),
c as (select node_id, median(x) as med from s group by node_id),
reach as (select f.*, greatest(hi - med, med - lo) as r from f join c using (node_id)),
usual as (select node_id, greatest(median(r), 4) as u from reach group by node_id),
flatm as (select node_id, seq, msg, max(case when list_min(payload) = list_max(payload) then 1 else 0 end) as flat
          from m where payload is not null and len(payload) > 0 group by all),
share as (select node_id, avg(flat) as s from flatm group by node_id),
again as (select node_id, payload from (select distinct node_id, payload, seq, msg from m where payload is not null) group by all having count(*) > 1),
fr as (select delivery_id from f where lo < -2048 or hi > 2047
       union select delivery_id from reach join usual using (node_id) where r > 8 * u
       union select f.delivery_id from f join share using (node_id) left join again a on a.node_id = f.node_id and a.payload = f.payload
             where s < 0.5 and (lo = hi or a.node_id is not null)),
mr as (select node_id, median(energy_rms) as ur from frame_embeddings where isfinite(energy_rms) and energy_rms > 0 group by 1),
mp as (select node_id, median(energy_peak) as up from frame_embeddings where isfinite(energy_peak) and energy_peak > 0 group by 1),
stuck as (select node_id, energy_rms from frame_embeddings where isfinite(energy_rms) and node_id is not null group by all having count(distinct seq) >= 5),
em as (select emb_id from frame_embeddings where energy_rms < 0 or not isfinite(energy_rms) or energy_peak < 0 or not isfinite(energy_peak) or energy_peak < energy_rms
       union select emb_id from frame_embeddings e join mr using (node_id) where isfinite(energy_rms) and energy_rms > 0 and (energy_rms > 8 * ur or energy_rms * 8 < ur)
       union select emb_id from frame_embeddings e join mp using (node_id) where isfinite(energy_peak) and energy_peak > 0 and (energy_peak > 8 * up or energy_peak * 8 < up)
       union select emb_id from frame_embeddings e join stuck s on s.node_id = e.node_id and s.energy_rms = e.energy_rms),
g as (select poll_id, watcher, latest.kp as kp, epoch(try_cast(latest.time_tag as timestamp))::bigint as bin from geomag_watch),
b as (select watcher, bin, max(kp) as kp from g where kp between 0 and 9 and watcher is not null and bin is not null group by all),
w as (select *, lag(kp) over o as pk, lead(kp) over o as nk, lag(bin) over o as pb, lead(bin) over o as nb from b window o as (partition by watcher order by bin)),
rn as (select *, sum(case when pk <> kp then 1 else 0 end) over (partition by watcher order by bin rows unbounded preceding) as run from w),
ln as (select *, count(*) over (partition by watcher, run) as len from rn),
hit as (select watcher, bin from ln where len >= 12 or (bin - pb = 10800 and nb - bin = 10800 and ((kp - pk > 4 and kp - nk > 4) or (pk - kp > 4 and nk - kp > 4)))),
ge as (select poll_id from g where not (kp between 0 and 9) union select poll_id from g join hit using (watcher, bin) where kp between 0 and 9)
select 'frames' as tbl, delivery_id as row_id from fr union all select 'frame_embeddings', emb_id from em union all select 'geomag_watch', poll_id from ge""",
    "p4_found": """
with r as (select node_id::varchar as src, grid_s * 1000000::bigint as len, (ts_us - ts_us % (grid_s * 1000000::bigint)) as p
           from frames join nodes using (node_id) where ts_us >= 1577836800000000),
g as (select watcher as src, 3600000000::bigint as len, epoch_us(try_cast(utc as timestamptz)) as t from geomag_watch where utc is not null and latest is not null),
a as (select 'frames' as tbl, src, len, p from r union select 'geomag_watch', src, len, t - t % len from g),
e as (select tbl, src, len, min(p) as a, max(p) as b from a group by all),
s as (select tbl, src, unnest(range(a, b, len)) as period_us from e)
select s.tbl, s.src, s.period_us from s anti join a on a.tbl = s.tbl and a.src = s.src and a.p = s.period_us""",
    "p4_sources": """
with r as (select node_id::varchar as src, grid_s * 1000000::bigint as len, (ts_us - ts_us % (grid_s * 1000000::bigint)) as p
           from frames join nodes using (node_id) where ts_us >= 1577836800000000),
g as (select watcher as src, 3600000000::bigint as len, epoch_us(try_cast(utc as timestamptz)) as t from geomag_watch where utc is not null and latest is not null),
a as (select 'frames' as tbl, src, len, p from r union all select 'geomag_watch', src, len, t - t % len from g where t is not null and src is not null)
select tbl, src, (max(p) - min(p)) // any_value(len) + 1 as periods, (max(p) - min(p)) // any_value(len) + 1 - count(distinct p) as missing, count(*) as readings, 0 as mixed from a group by 1, 2""",
    "p1_admitted": """
with b as (select (min(batch_id) + max(batch_id)) // 2 as half from frames),
d as (select f.*, f.batch_id <= b.half as early from frames f, b where node_id is not null and seq is not null and ts_us is not null and batch_id is not null),
e as (select *, ts_us - lag(ts_us) over (partition by node_id, seq, early order by ts_us, delivery_id) as gap, ts_us - lag(ts_us) over (partition by node_id, seq order by ts_us, delivery_id) as gap_all from d),
m as (select *, sum((gap is null or gap > 2000000)::int) over (partition by node_id, seq, early order by ts_us, delivery_id rows unbounded preceding) as msg,
             sum((gap_all is null or gap_all > 2000000)::int) over (partition by node_id, seq order by ts_us, delivery_id rows unbounded preceding) as whole from e),
r as (select *, row_number() over (partition by node_id, seq, early, msg order by received_at nulls last, delivery_id) as rn, bool_or(early) over (partition by node_id, seq, whole) as known from m)
select delivery_id from r where rn = 1 and (early or not known)""",
}
