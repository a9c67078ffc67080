"""Queries of the frame, detector, inference, coupling and watch operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondewerk.functions import grammar, kernels, series
from sondewerk.operators import coupling, detector, frames, inference, vectors, watch
from sondewerk.plans.grammar import BASE, whole_windows
from sondewerk.plans.problems import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, queries: dict = QUERIES, oracles: dict = ORACLES):
    """Decorator: make a function a query, with its SQL."""

    def add(f):
        queries[f.__name__] = f
        if sql:
            oracles[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ frames
@query("""select delivery_id, node_id, seq, ts_us, sr_hz, len(payload)::int as n, coalesce(sensor_class, 0)::smallint as sensor_class, list_sum(payload)::double as total
from frames where not is_spectrum and payload is not null and node_id is not null and seq is not null and ts_us is not null and sr_hz is not null""")
def frame_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames encoded to the wire and decoded again."""
    f = table(spark, sf_dir, "frames").filter("not is_spectrum and payload is not null")
    wire = f.select("delivery_id", frames.encode(F.col("node_id"), F.col("seq"), F.col("ts_us"), F.col("sr_hz"), F.col("payload"), F.coalesce("sensor_class", F.lit(0))).alias("frame")).filter("frame is not null")
    d = frames.good(frames.decode(wire, keep=["delivery_id"]))
    return d.select("delivery_id", "node_id", "seq", F.col("ts_us").cast("bigint").alias("ts_us"), "sr_hz", "n", "sensor_class", series.total(F.col("payload").cast("array<double>")).alias("total"))


_GAPS = """with f as (select delivery_id, node_id, seq, received_at, lag(seq) over (partition by node_id order by received_at, delivery_id) as p from frames where node_id is not null and seq is not null and received_at is not null),
g as (select delivery_id, node_id, seq, ((seq - p - 1) % 4294967296 + 4294967296) % 4294967296 as d from f)"""


@query(_GAPS + " select delivery_id, node_id, seq, case when d is null or d >= 2147483648 then 0 else d end::bigint as lost, coalesce(d >= 2147483648, false) as late from g")
def frame_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.seq_gaps(table(spark, sf_dir, "frames"))


@query(_GAPS + " select node_id, count(*) as deliveries, sum(case when d is null or d >= 2147483648 then 0 else d end)::bigint as lost, sum((coalesce(d >= 2147483648, false))::int)::bigint as late from g group by 1")
def frame_gap_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = frames.seq_gaps(table(spark, sf_dir, "frames"))
    return g.groupBy("node_id").agg(F.count("*").alias("deliveries"), F.sum("lost").alias("lost"), F.sum(F.col("late").cast("bigint")).alias("late"))


@query("""with s as (select delivery_id, payload, list_sum(payload)::bigint as sm, list_sum(list_transform(payload, lambda x: x::bigint * x))::bigint as sq,
 list_max(list_transform(payload, lambda x: abs(x::int))) as pk, len(payload) as n from frames where payload is not null and len(payload) > 0)
select delivery_id, n::int as "count", (sign(sm) * (abs(sm) // n))::bigint as mean, floor(sqrt(sq // n))::bigint as rms, pk::int as peak,
 (select count(*) from range(2, n + 1) r(i) where (payload[i] < 0) <> (payload[i - 1] < 0))::int as crossings from s""")
def frame_edge_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "frames").filter("payload is not null and size(payload) > 0")
    return f.select("delivery_id", *[c.alias(n) for n, c in frames.edge_stats(F.col("payload")).items()])


@query("select delivery_id, round(sqrt(list_avg(list_transform(payload, lambda x: x::double * x))), 6) as energy_rms, list_max(list_transform(payload, lambda x: abs(x::double))) as energy_peak from frames where payload is not null and len(payload) > 0")
def frame_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("payload").cast("array<double>")
    return table(spark, sf_dir, "frames").filter("payload is not null and size(payload) > 0").select("delivery_id", F.round(F.sqrt(series.mean(series.square(x))), 6).alias("energy_rms"), F.array_max(series.absolute(x)).alias("energy_peak"))


@query()
def frame_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit-norm log magnitude spectrum (16 bins), rms and peak of every frame."""
    f = table(spark, sf_dir, "frames").filter("payload is not null")

    def kernel(x):
        import numpy as np

        mag, _, rms, peak = kernels.spectral_shape(x, 16)
        return np.concatenate([mag, rms[:, None], peak[:, None]], axis=1)

    wide = frames.map_series(f, ["delivery_id"], "payload", kernel, [*[f"m{i}" for i in range(16)], "rms", "peak"])
    return wide.select("delivery_id", F.array(*[f"m{i}" for i in range(16)]).alias("mag"), "rms", "peak")


@query("select delivery_id, k, total from (select delivery_id, unnest(range(0, len(payload) // 16))::int as k, payload from frames where payload is not null), lateral (select list_sum(payload[k * 16 + 1 : k * 16 + 16])::bigint as total)")
def frame_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads cut in windows of 16 samples, the rest dropped."""
    w = frames.framed(table(spark, sf_dir, "frames").filter("payload is not null"), ["delivery_id"], "payload", 16)
    return w.select("delivery_id", "k", F.aggregate("x", F.lit(0).cast("bigint"), lambda a, v: a + v).alias("total"))


@query("""with r as (select node_id, energy_rms as v, row_number() over (partition by node_id order by emb_id) - 1 as i from frame_embeddings where node_id is not null and energy_rms is not null and isfinite(energy_rms))
select node_id, i // 16 as k, round(avg(v), 6) as mean from r group by all having count(*) = 16""")
def energy_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy readings of a node gathered by 16s."""
    e = table(spark, sf_dir, "frame_embeddings").filter("node_id is not null and energy_rms is not null and not isnan(energy_rms) and abs(energy_rms) < double('Infinity')")
    w = frames.rows_to_windows(e, ["node_id"], ["emb_id"], "energy_rms", 16)
    return w.select("node_id", "k", F.round(series.mean(F.col("x")), 6).alias("mean"))


@query("""with e as (select emb_id, node_id, energy_rms as v from frame_embeddings where node_id is not null and energy_rms is not null and isfinite(energy_rms)),
w as (select emb_id, v, count(*) over o as n, avg(v) over o as m, avg(v * v) over o as q from e window o as (partition by node_id order by emb_id rows unbounded preceding)),
s as (select emb_id, v, m, case when n > 1 and q - m * m > 1e-6 * q then sqrt(q - m * m) else 1.0 end as sd from w)
select emb_id, round((v - m) / sd, 4) as z from s""")
def energy_running_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """z of each energy against all readings of its node so far, itself included."""
    e = table(spark, sf_dir, "frame_embeddings").filter("node_id is not null and energy_rms is not null and not isnan(energy_rms) and abs(energy_rms) < double('Infinity')")
    return frames.running_z(e.select("emb_id", "node_id", "energy_rms"), ["node_id"], ["emb_id"], "energy_rms").select("emb_id", F.round("z", 4).alias("z"))


# ------------------------------------------------------------------ detector
@query("select case when score >= 8 then 'alarm' when score >= 4 then 'warn' when score is not null then 'ok' end as severity, count(*) as n, avg((score >= 4)::int) as alert_rate from frame_embeddings where score is null or not isnan(score) group by 1")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "frame_embeddings").filter("score is null or not isnan(score)")
    return e.groupBy(detector.severity(F.col("score")).alias("severity")).agg(F.count("*").alias("n"), F.avg((F.col("score") >= 4).cast("int")).alias("alert_rate"))


@query("with n as (select node_id, count(*) as windows, sum(alert::int)::bigint as alerts from frame_embeddings where node_id is not null group by 1) select *, round(alerts / windows, 6) as rate, round(sum(alerts) over () / sum(windows) over (), 6) as total_rate from n")
def node_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "frame_embeddings").filter("node_id is not null").groupBy("node_id").agg(F.count("*").alias("windows"), F.sum(F.col("alert").cast("bigint")).alias("alerts"))
    total = n.agg((F.sum("alerts") / F.sum("windows")).alias("t"))
    return n.crossJoin(F.broadcast(total)).select("*", F.round(F.col("alerts") / F.col("windows"), 6).alias("rate"), F.round("t", 6).alias("total_rate")).drop("t")


#: std is left out: windows are normed, so it is constant by construction and its scale is rounding noise.
FEATURES = ("meanabs", "crest", "acf1", "zcr")
_FEATURES = BASE + """,
z as (select *, avg(v) over (partition by window_id) as mu, median(v) over (partition by window_id) as md from s),
l as (select *, lag(v - mu) over (partition by window_id order by i) as pv, lag(sign(v - md)) over (partition by window_id order by i) as ps from z),
ft as (select window_id, stddev_pop(v) as std, avg(abs(v)) as meanabs, max(abs(v)) / (avg(abs(v)) + 1e-12) as crest,
  case when sum((v - mu) ** 2) > 0 then sum((v - mu) * pv) / sum((v - mu) ** 2) else 0 end as acf1, avg((sign(v - md) <> ps)::int) as zcr from l group by 1),
f as (select ft.*, g, split, lower(y) as y from ft join b using (window_id))"""


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    programs = [grammar.Program("id", "id", p) for p in FEATURES]
    w = whole_windows(spark, sf_dir).withColumn("y", F.lower("y"))
    return frames.map_series(w, ["window_id", "g", "split", "y"], "x", lambda x: kernels.program_matrix(x, programs), list(FEATURES))


@query(_FEATURES + f" select window_id, {', '.join(f'round({c}, 6) as {c}' for c in FEATURES)} from f")
def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("window_id", *[F.round(c, 6).alias(c) for c in FEATURES])


_BASELINE = _FEATURES + """,
u as (unpivot (select meanabs, crest, acf1, zcr from f where split = 'fit' and y = 'normal') on meanabs, crest, acf1, zcr into name feature value v),
md as (select feature, median(v) as med, count(*) as n from u group by 1),
base as (select feature, any_value(med) as med, median(abs(v - med)) * 1.4826 as mad, any_value(n) as n from u join md using (feature) group by 1)"""


@query(_BASELINE + " select feature, round(med, 6) as med, round(mad, 6) as mad, n from base")
def detector_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = detector.robust_baseline(_features(spark, sf_dir).filter("split = 'fit' and y = 'normal'"), FEATURES)
    return b.select("feature", F.round("med", 6).alias("med"), F.round("mad", 6).alias("mad"), "n")


_SCORES = _BASELINE + """,
a as (unpivot f on meanabs, crest, acf1, zcr into name feature value v),
sc as (select window_id, any_value(g) as g, any_value(split) as split, any_value(y) as y, max(abs(v - med) / mad) as score from a join base using (feature) group by 1)"""


def _scored(spark: SparkSession, sf_dir: str) -> tuple[detector.RobustDetector, DataFrame]:
    from sondewerk.util import materialize

    f = materialize(_features(spark, sf_dir))
    det = detector.RobustDetector.fit(f.filter("split = 'fit' and y = 'normal'"), FEATURES)
    return det, f.withColumn("score", det.score())


@query(_SCORES + " select window_id, round(score, 5) as score from sc")
def detector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[1].select("window_id", F.round("score", 5).alias("score"))


@query(_SCORES + """, th as (select greatest(quantile_cont(score, 0.99) * 3, 1e-6) as t from sc where split = 'fit' and y = 'normal')
select split, y, case when score >= 2 * t then 'alarm' when score >= t then 'warn' else 'ok' end as severity, count(*) as n from sc, th group by all""")
def detector_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by split, label and severity of a detector fitted on healthy windows."""
    det, s = _scored(spark, sf_dir)
    return s.groupBy("split", "y", detector.severity(F.col("score"), det.threshold).alias("severity")).agg(F.count("*").alias("n"))


_UNITS = _SCORES + ", r as (select g, y, avg(score) as score from sc where g is not null and y is not null and split <> 'fit' group by all)"


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[1].filter("g is not null and y is not null and split <> 'fit'").groupBy("g", "y").agg(F.avg("score").alias("score")).withColumn("pos", F.col("y") == "anomaly")


@query(_UNITS + """, k as (select *, y = 'anomaly' as pos from r), c as (select sum(case when p.score > n.score then 1 when p.score = n.score then 0.5 else 0 end) as w from k p, k n where p.pos and not n.pos)
select (select count(*) from k where pos) as n_pos, (select count(*) from k where not pos) as n_neg, round(w / ((select count(*) from k where pos) * (select count(*) from k where not pos)), 6) as auc,
 case when w / ((select count(*) from k where pos) * (select count(*) from k where not pos)) >= 0.5 then 'aligned' else 'inverted' end as verdict from c""")
def detector_checkup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC over held-out recordings and its direction."""
    return detector.checkup(_units(spark, sf_dir), "score", "pos").withColumn("auc", F.round("auc", 6))


@query(_UNITS + """, c as (select score as cut from r), j as (select cut, (select avg((score >= cut)::int) from r where y = 'anomaly') - (select avg((score >= cut)::int) from r where y <> 'anomaly') as j from c)
select round(min(cut), 5) as cut, round(max(j), 6) as j from j where j >= (select max(j) from j) - 1e-9""")
def detector_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.best_cut(_units(spark, sf_dir), "score", "pos").select(F.round("cut", 5).alias("cut"), F.round("j", 6).alias("j"))


@query(_UNITS + ", t as (select avg((score >= 3)::int) filter (y = 'anomaly') as h, avg((score >= 3)::int) filter (y <> 'anomaly') as f from r) select round(h, 6) as hit_rate, round(f, 6) as false_rate, round(h - f, 6) as gap from t")
def detector_alarm_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = inference.alarm_gap(_units(spark, sf_dir), "score", "pos", 3.0)
    return g.select(*[F.round(c, 6).alias(c) for c in g.columns])


@query(_UNITS + " select g, round((row_number() over (order by score, g) - 1) / greatest(count(*) over () - 1, 1), 6) as pct_rank from r")
def score_percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.percentile_rank(_units(spark, sf_dir), "score", ["g"]).select("g", F.round("pct_rank", 6).alias("pct_rank"))


@query(_UNITS + " select count(*) as k, round(avg((y = 'anomaly')::int), 6) as precision from (select * from r order by score desc, g limit 10)")
def score_precision_at_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.precision_at(_units(spark, sf_dir), "score", "pos", "g", 10).withColumn("precision", F.round("precision", 6))


# ------------------------------------------------------------------ inference
@query(_FEATURES + """, a as (unpivot (select g, y, meanabs, crest, acf1, zcr from f where g is not null and y is not null) on meanabs, crest, acf1, zcr into name feature value v),
m as (select feature, g, avg(v) as m, min(y) as y from a group by all), t as (select feature, avg(m) as mu, stddev_pop(m) as sd, count(*) as r, count(distinct y) as k from m group by 1),
c as (select feature, y, avg(m) as c, var_pop(m) as v, count(*) as n from m group by all)
select feature, round(case when any_value(sd) > 1e-9 then (sum(n * ((c - mu) / (sd + 1e-12)) ** 2) / greatest(any_value(k) - 1, 1)) / ((sum(n * v / (sd + 1e-12) ** 2) + 1e-12) / greatest(any_value(r) - any_value(k), 1)) else -1 end, 5) as f from c join t using (feature) group by 1""")
def feature_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir).filter("g is not null and y is not null")
    long = f.unpivot(["g", "y"], list(FEATURES), "feature", "v")
    return inference.anova_f(long, "feature", "v", "y", "g").select("feature", F.round("f", 5).alias("f"))


_U = "(('0x' || substr(md5('0-' || b || '-' || {0}), 1, 8))::bigint / 4294967296.0)"


@query(f"""with e as (select emb_id as u, recon_error as v from frame_embeddings where recon_error is not null and isfinite(recon_error)),
m as (select b, u, v, {_U.format('u')} as x from e, range(1, 101) r(b)),
w as (select b, v, case when x >= 0.9999988747 then 8 when x >= 0.99998975080 then 8 else 0 end as z, x from m) select count(*) as n, round(avg(x), 9) as mean_draw, round(max(x), 9) as max_draw from w""")
def hash_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash's draws, the same in any engine: 100 for every row."""
    e = table(spark, sf_dir, "frame_embeddings").filter("recon_error is not null and not isnan(recon_error) and abs(recon_error) < double('Infinity')").select("emb_id")
    m = e.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(100)))).withColumn("x", inference.hash_uniform(0, F.col("b"), F.col("emb_id")))
    return m.agg(F.count("*").alias("n"), F.round(F.avg("x"), 9).alias("mean_draw"), F.round(F.max("x"), 9).alias("max_draw"))


@query(_UNITS + f""", k as (select g, score as v, (y = 'anomaly')::int as y from r), o as (select sum(y * v) / sum(y) - sum((1 - y) * v) / sum(1 - y) as s, sum(y) as n from k),
m as (select b, g, v, {_U.format('g')} as u from k, range(1, 201) t(b)), q as (select b, v, (row_number() over (partition by b order by u, g) <= n)::int as y, s from m, o),
d as (select b, sum(y * v) / sum(y) - sum((1 - y) * v) / sum(1 - y) as t, any_value(s) as s from q group by 1)
select round(any_value(s), 6) as observed, sum((abs(t) >= abs(s) - 1e-12)::int)::bigint as hits, round((sum((abs(t) >= abs(s) - 1e-12)::int) + 1) / 201.0, 6) as p from d""")
def score_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = inference.permutation_p(_units(spark, sf_dir), "g", "score", "pos", 200)
    return r.select(F.round("observed", 6).alias("observed"), "hits", F.round("p", 6).alias("p"))


@query("with n as (select node_id, count(*) as c from frame_embeddings where node_id is not null group by 1), p as (select node_id, 1.0 / c as p from n), o as (select *, row_number() over (order by p, node_id) as i, count(*) over () as m from p), s as (select *, max(least(1, p * (m - i + 1))) over (order by i) as h from o) select node_id, round(p, 9) as p, round(h, 9) as p_holm, h <= 0.05 as rejected from s")
def holm_correction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step-down correction of one p per node (here one over its number of rows)."""
    p = table(spark, sf_dir, "frame_embeddings").filter("node_id is not null").groupBy("node_id").agg((F.lit(1.0) / F.count("*")).alias("p"))
    return inference.holm(p, "p", "node_id").select("node_id", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"), "rejected")


@query("""with e as (select node_id, recon_error as a, score as b from frame_embeddings where node_id is not null and recon_error is not null and score is not null),
r as (select node_id, rank() over (partition by node_id order by a) + (count(*) over (partition by node_id, a) - 1) / 2.0 as ra, rank() over (partition by node_id order by b) + (count(*) over (partition by node_id, b) - 1) / 2.0 as rb from e)
select node_id, count(*) as n, round(corr(ra, rb), 6) as rho from r group by 1""")
def score_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = inference.spearman(table(spark, sf_dir, "frame_embeddings").filter("node_id is not null"), "recon_error", "score", ["node_id"])
    return s.withColumn("rho", F.round("rho", 6))


@query("""with v as (select node_id, 'rms' as voter, max(energy_rms) as s from frame_embeddings where node_id is not null and isfinite(energy_rms) group by 1 union all select node_id, 'score', max(score) from frame_embeddings where node_id is not null and isfinite(score) group by 1),
r as (select *, row_number() over (partition by voter order by s desc, node_id) - 1 as r from v), c as (select voter, count(*) as n from v group by 1), i as (select distinct node_id from v),
f as (select i.node_id, coalesce(r.r, c.n) as r from i cross join c left join r on r.node_id = i.node_id and r.voter = c.voter), a as (select node_id, min(r)::bigint as best, sum(r)::bigint as total from f group by 1)
select *, row_number() over (order by best, total, node_id)::int as place from a""")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "frame_embeddings").filter("node_id is not null")
    part = lambda c, n: e.filter(f"{c} is not null and not isnan({c}) and abs({c}) < double('Infinity')").groupBy("node_id").agg(F.max(c).alias("s")).withColumn("voter", F.lit(n))
    return inference.fuse_rankings(part("energy_rms", "rms").unionByName(part("score", "score")), "voter", "node_id", "s")


# ------------------------------------------------------------------ coupling
CHANNELS = ("recon_error", "energy_rms", "energy_peak", "score")
_CHANNELS = """with c as (select emb_id as t, ln(recon_error) as recon_error, ln(energy_rms) as energy_rms, ln(energy_peak) as energy_peak, score from frame_embeddings
 where recon_error > 0 and energy_rms > 0 and energy_peak > 0 and isfinite(recon_error) and isfinite(energy_rms) and isfinite(energy_peak) and score is not null and isfinite(score)),
l as (select t, unnest(['recon_error', 'energy_rms', 'energy_peak', 'score']) as ch, unnest([recon_error, energy_rms, energy_peak, score]) as v from c),
p as (select * from (values ('recon_error', 'energy_rms'), ('recon_error', 'energy_peak'), ('recon_error', 'score'), ('energy_rms', 'energy_peak'), ('energy_rms', 'score'), ('energy_peak', 'score')) v(a, b))"""


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "frame_embeddings")
    for c in CHANNELS[:3]:
        e = e.filter(f"{c} > 0 and {c} < double('Infinity')").withColumn(c, F.log(c))
    return coupling.aligned(e.filter("abs(score) < double('Infinity')").withColumnRenamed("emb_id", "t"), "t", CHANNELS)


@query(_CHANNELS + " select p.a, p.b, round(corr(x.v, y.v), 6) as r from p join l x on x.ch = p.a join l y on y.ch = p.b and y.t = x.t group by all")
def coupling_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.correlations(_channels(spark, sf_dir), CHANNELS).withColumn("r", F.round("r", 6))


@query(_CHANNELS + """, e as (select ch, min(v) as lo, max(v) as hi from l group by 1), k as (select t, ch, least(11, floor((v - lo) / (hi - lo) * 12)) as c from l join e using (ch)),
j as (select p.a, p.b, x.c as x, y.c as y, count(*) as n from p join k x on x.ch = p.a join k y on y.ch = p.b and y.t = x.t group by all),
w as (select *, sum(n) over (partition by a, b) as tt, sum(n) over (partition by a, b, x) as nx, sum(n) over (partition by a, b, y) as ny from j)
select a, b, round(greatest(sum(n / tt * ln(n * tt / (nx * ny))), 0), 6) as mi from w group by all""")
def coupling_mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.mutual_information(_channels(spark, sf_dir), CHANNELS).withColumn("mi", F.round("mi", 6))


@query(_CHANNELS + """, q as (select a as cause, b as effect from p union all select b, a from p), n as (select t, ch, v, lead(v) over (partition by ch order by t) as f from l), u as (select * from n where f is not null),
e as (select ch, min(v) as lo, max(v) as hi, min(f) as flo, max(f) as fhi from u group by 1), k as (select t, ch, least(7, floor((v - lo) / (hi - lo) * 8)) as c, least(7, floor((f - flo) / (fhi - flo) * 8)) as d from u join e using (ch)),
j as (select cause, effect, y.d as i, y.c as j, x.c as k, count(*) as n from q join k x on x.ch = cause join k y on y.ch = effect and y.t = x.t group by all),
w as (select *, sum(n) over (partition by cause, effect) as tt, sum(n) over (partition by cause, effect, j) as nj, sum(n) over (partition by cause, effect, j, k) as njk, sum(n) over (partition by cause, effect, i, j) as nij from j)
select cause, effect, round(greatest(sum(n / tt * ln(n * nj / (njk * nij))), 0), 6) as score from w group by all""")
def causal_transfer_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.transfer_entropy(_channels(spark, sf_dir), "t", CHANNELS).withColumn("score", F.round("score", 6))


@query(_CHANNELS + """, q as (select recon_error as a, energy_rms as b, score as z from c), m as (select corr(a, b) as ab, corr(a, z) as az, corr(b, z) as bz from q)
select 'recon_error' as a, 'energy_rms' as b, round((ab - az * bz) / sqrt((1 - az ** 2) * (1 - bz ** 2)), 6) as r from m""")
def coupling_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = coupling.partial_correlations(_channels(spark, sf_dir), ["recon_error", "energy_rms"], ["score"])
    return spark.createDataFrame(rows, "a string, b string, r double").withColumn("r", F.round("r", 6))


@query()
def causal_granger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.edges(_channels(spark, sf_dir), "t", CHANNELS, "granger")


@query()
def causal_var_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every directed edge in the vector autoregression."""
    return coupling.edges(_channels(spark, sf_dir), "t", CHANNELS, "var")


@query()
def causal_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.localize(_channels(spark, sf_dir), "t", CHANNELS)


@query()
def coupling_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coupling.couplings(_channels(spark, sf_dir), CHANNELS, ["score"])


# ------------------------------------------------------------------ windows, premium families
@query(BASE + """, r as (select window_id, avg(v) as m, regr_slope(v, i) as b, avg(i) as c from s group by 1), d as (select window_id, i, v - m - b * (i - c) as v from s join r using (window_id)),
n as (select window_id, i, (v - avg(v) over (partition by window_id)) / (stddev_pop(v) over (partition by window_id) + 1e-12) as v from d)
select window_id, round(sum(v * (i + 1)), 5) as weighted, round(sum(v * v * v), 4) as cubes from n group by 1""")
def window_detrended(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = whole_windows(spark, sf_dir).select("window_id", frames.detrended(F.col("x")).alias("z"))
    return d.select("window_id", F.round(series.total(F.transform("z", lambda v, i: v * (i + 1))), 5).alias("weighted"), F.round(series.total(F.transform("z", lambda v: v * v * v)), 4).alias("cubes"))


@query(BASE + ", q as (select window_id, i // 4 as k, avg(v) as v from s group by all) select window_id, count(*) as n, round(stddev_pop(v), 6) as spread from q group by 1")
def window_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = whole_windows(spark, sf_dir).select("window_id", frames.mean_pooled(F.col("x"), 4).alias("z"))
    return d.select("window_id", F.size("z").cast("bigint").alias("n"), F.round(series.std(F.col("z")), 6).alias("spread"))


def _premium(kernel, names):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frames.map_series(whole_windows(spark, sf_dir), ["window_id"], "x", kernel, names)

    return run


QUERIES |= {
    "window_rqa": _premium(kernels.rqa, kernels.RQA_NAMES),
    "window_moments": _premium(lambda x: __import__("numpy").stack([kernels.kurtosis(x), kernels.skewness(x)], axis=1), ["kurtosis", "skewness"]),
}
ORACLES["window_moments"] = BASE + ", z as (select window_id, v - avg(v) over (partition by window_id) as v from s) select window_id, avg(v ** 4) / (avg(v * v) ** 2 + 1e-12) as kurtosis, avg(v ** 3) / (avg(v * v) ** 1.5 + 1e-12) as skewness from z group by 1"


@query(BASE + """, u as (select window_id, i, (lag(v) over (partition by window_id order by i) < v)::int as up from s), o as (select window_id, lag(up) over (partition by window_id order by i) * 2 + up as st from u),
h as (select window_id, st, count(*) as k from o where st is not null group by all), n as (select *, sum(k) over (partition by window_id) as n from h) select window_id, round(-sum(k / n * ln(k / n)) / ln(4), 6) + 0.0 as value from n group by 1""")
def window_permutation_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole_windows(spark, sf_dir).select("window_id", F.round(series.permutation_entropy(F.col("x")), 6).alias("value"))


@query(BASE + """, d as (select *, v - lag(v) over o as d1, v - 2 * lag(v) over o + lag(v, 2) over o as d2 from s window o as (partition by window_id order by i)), t as (select window_id, stddev_pop(v) as a, stddev_pop(d1) as b, stddev_pop(d2) as c from d group by 1)
select window_id, round(b / a, 6) as mobility, round(c * a / (b * b), 6) as complexity from t where a > 1e-9 and b > 1e-9""")
def window_hjorth(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = whole_windows(spark, sf_dir).filter((series.std(F.col("x")) > 1e-9) & (series.std(series.diff(F.col("x"))) > 1e-9))
    m, c = series.hjorth(F.col("x"))
    return w.select("window_id", F.round(m, 6).alias("mobility"), F.round(c, 6).alias("complexity"))


@query()
def grammar_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window under every program of the gated catalogue: (window_id, features)."""
    w = whole_windows(spark, sf_dir)
    n = w.select("g").filter("g is not null").distinct().count()
    programs = grammar.gate(grammar.catalogue(), n)
    return frames.map_vectors(w, ["window_id"], "x", lambda x: kernels.program_matrix(x, list(programs)), len(programs))


# ------------------------------------------------------------------ banks
@query("""select bank, count(*) as windows, count(distinct g) as recordings, sum(list_count(list_filter(windows, lambda v: v is not null and isfinite(v)))) / nullif(sum(len(windows)), 0) as finite_fraction, median(len(windows)) as length from bank_windows where windows is not null group by 1""")
def bank_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "bank_windows").filter("windows is not null")
    fine = F.size(F.filter("windows", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    return w.groupBy("bank").agg(F.count("*").alias("windows"), F.count_distinct("g").alias("recordings"), F.try_divide(F.sum(fine), F.sum(F.size("windows"))).alias("finite_fraction"), F.median(F.size("windows")).alias("length"))


@query("""with h as (select distinct md5(array_to_string(windows, ',')) as d, windows, split from bank_windows where windows is not null), f as (select distinct windows from h where split = 'fit')
select b.bank, b.split, count(*) as leaked from bank_windows b semi join f on f.windows = b.windows where b.split <> 'fit' group by all""")
def bank_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held windows whose digest stands in the fit split, too."""
    w = table(spark, sf_dir, "bank_windows").filter("windows is not null").withColumn("digest", watch.digest(F.col("windows")))
    fit = w.filter("split = 'fit'").select("digest").distinct()
    return w.filter("split <> 'fit'").join(fit, "digest", "left_semi").groupBy("bank", "split").agg(F.count("*").alias("leaked"))


@query("select g, count(distinct lower(y)) as labels, count(*) filter (y is null) as unlabelled, min(lower(y)) as label from bank_windows where g is not null group by 1 having count(distinct lower(y)) <> 1 or count(*) filter (y is null) > 0")
def bank_label_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings without exactly one label."""
    w = table(spark, sf_dir, "bank_windows").filter("g is not null").groupBy("g").agg(F.count_distinct(F.lower("y")).alias("labels"), F.count_if(F.col("y").isNull()).alias("unlabelled"), F.min(F.lower("y")).alias("label"))
    return w.filter("labels <> 1 or unlabelled > 0")


@query("select split, count(*) as n from bank_windows where contains(lower(y), 'normal') group by 1")
def bank_healthy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose label contains the healthy word, whatever its case."""
    return table(spark, sf_dir, "bank_windows").filter(watch.label_contains(F.col("y"), "normal")).groupBy("split").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ point store
@query("select (node_id << 32) | (seq & 4294967295) as point_id, emb_id, score from (select *, row_number() over (partition by node_id, seq order by ts_us desc, emb_id desc) as rn from frame_embeddings where node_id is not null and seq is not null and node_id < 2147483648) where rn = 1")
def point_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "frame_embeddings").filter("node_id is not null and seq is not null and node_id < 2147483648").select("emb_id", "node_id", "seq", F.struct("ts_us", "emb_id").alias("version"), "score")
    out = vectors.upsert(e.limit(0), e, ["node_id", "seq"], "version")
    return out.select(vectors.point_id(F.col("node_id"), F.col("seq")).alias("point_id"), "emb_id", "score")


@query("select emb_id, node_id, score from frame_embeddings where score is null or not isnan(score) order by coalesce(score, 0) desc, emb_id limit 20")
def point_top_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "frame_embeddings").filter("score is null or not isnan(score)").select("emb_id", "node_id", "score", "vector")
    return vectors.top_anomalies(e, "score", "emb_id", 20)


@query("select emb_id, node_id, seq from frame_embeddings where node_id = 7")
def point_of_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.node_points(table(spark, sf_dir, "frame_embeddings").select("emb_id", "node_id", "seq", "vector"), 7)


@query("""with r as (select emb_id, embedding from (select vec_id as emb_id, embedding::double[64] as embedding from embeddings)),
s as (select q.emb_id as vec_id, array_cosine_similarity(q.embedding, r.embedding) as c, row_number() over (partition by q.emb_id order by array_cosine_similarity(q.embedding, r.embedding) desc) as rn from r q, r where q.emb_id % 100 = 0)
select vec_id, round(1 - avg(c), 5) as novelty from s where rn <= 5 group by 1""")
def point_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Novelty of every vector whose id is divisible by 100 against all vectors (itself among them)."""
    e = table(spark, sf_dir, "embeddings")
    n = vectors.novelty(e.filter("vec_id % 100 = 0"), e, "vec_id", "embedding")
    return n.select("vec_id", F.round("novelty", 5).alias("novelty"))


@query()
def point_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.project_2d(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


@query("select emb_id, 'signal,node=' || node_id || ' ' || array_to_string(list_filter([case when energy_rms is not null then 'energy_rms=' || printf('%.6f', energy_rms) end, case when score is not null then 'anomaly_score=' || printf('%.6f', score) end], lambda x: x is not null), ',') || ' ' || (ts_us * 1000) as line from frame_embeddings where node_id is not null and isfinite(coalesce(energy_rms, 0)) and isfinite(coalesce(score, 0)) and ts_us < 9000000000000000")
def point_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "frame_embeddings").filter("node_id is not null and coalesce(abs(energy_rms) < double('Infinity'), true) and coalesce(abs(score) < double('Infinity'), true) and ts_us < 9000000000000000")
    return e.select("emb_id", vectors.ilp_line("signal", F.col("node_id"), {"energy_rms": F.col("energy_rms"), "anomaly_score": F.col("score")}, F.col("ts_us")).alias("line"))


# ------------------------------------------------------------------ Kp watch
_BINS = "with b as (select watcher, latest.time_tag::timestamp as t, max(latest.kp) as kp from geomag_watch where latest.kp between 0 and 9 and latest.time_tag is not null and watcher is not null group by all)"


@query(_BINS + """, w as (select *, lag(kp) over (partition by watcher order by t) as p, max(kp) over (partition by watcher order by t rows between 8 preceding and 1 preceding) as m from b)
select watcher, strftime(t, '%Y-%m-%d %H:%M:%S') as onset, kp from w where kp >= 5 and p < 5 and m < 5""")
def kp_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.onsets(watch.kp_bins(table(spark, sf_dir, "geomag_watch"))).withColumn("onset", F.date_format("onset", "yyyy-MM-dd HH:mm:ss"))


@query(_BINS + """, c as (select *, sum((kp >= 3)::int) over (partition by watcher order by t rows unbounded preceding) as r from b), q as (select watcher, r, min(t) as start, count(*) as bins from c where kp < 3 group by all)
select watcher, strftime(start, '%Y-%m-%d %H:%M:%S') as start, bins from q where bins >= 16""")
def kp_quiet_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.quiet_runs(watch.kp_bins(table(spark, sf_dir, "geomag_watch"))).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(_BINS + " select watcher, strftime(t, '%Y-%m-%d') as day, max(kp) as kp_max from b group by 1, 2 having count(*) = 8 and max(kp) <= 4")
def kp_quiet_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.quiet_days(watch.kp_bins(table(spark, sf_dir, "geomag_watch")), 4.0).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""with p as (select *, row_number() over (partition by watcher order by poll_id) as i, sum((fetch_error is null)::int) over (partition by watcher order by poll_id rows unbounded preceding) as ok from geomag_watch where watcher is not null)
select poll_id, watcher, (i - min(case when fetch_error is null then i end) over (partition by watcher, ok))::bigint as streak from p where false union all
select poll_id, watcher, (sum((fetch_error is not null)::int) over (partition by watcher, ok order by poll_id rows unbounded preceding))::bigint as streak from p""")
def poll_blackouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many polls in a row have failed, at every poll."""
    return watch.blackout_streaks(table(spark, sf_dir, "geomag_watch"))


@query("""with p as (select poll_id, watcher, latest.kp as kp, lag(latest.kp ignore nulls) over (partition by watcher order by poll_id) as prev, onset_kp_threshold as th from geomag_watch where watcher is not null)
select poll_id, watcher, kp from p where prev < th and kp >= th""")
def poll_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watch.crossings(table(spark, sf_dir, "geomag_watch"))


@query("with d as (select watcher, time_bucket(interval '1 day', (utc::timestamptz at time zone 'UTC')) as day, count(*) as polls, count(fetch_error) as failed from geomag_watch where utc is not null and watcher is not null group by all) select watcher, strftime(day, '%Y-%m-%d') as day, polls, failed from d")
def poll_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "geomag_watch").filter("utc is not null and watcher is not null")
    return p.groupBy("watcher", F.date_format(F.expr("try_cast(utc as timestamp)"), "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("polls"), F.count("fetch_error").alias("failed"))
