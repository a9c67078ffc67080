"""Queries of the detector's parts and of the checkup, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondewerk.operators import detector, inference
from sondewerk.plans.analytics import _SCORES, _U, _UNITS, FEATURES, _scored, _units, query
from sondewerk.plans.windows import _DRAW
from sondewerk.util import exact_quantile

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def checked(sql: str | None = None) -> Callable:
    return query(sql, QUERIES, ORACLES)


_TH = ", th as (select greatest(quantile_cont(score, 0.99) * 3, 1e-6) as t from sc where split = 'fit' and y = 'normal')"


@checked(_SCORES + _TH + " select round(t, 6) as threshold, round(t / 9, 6) as inverse from th")
def detector_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alarm threshold from healthy scores, and the one of an inverted detector."""
    det, _ = _scored(spark, sf_dir)
    return spark.createDataFrame([(round(det.threshold, 6), round(det.inverse_threshold, 6))], "threshold double, inverse double")


def _decided(direction: int | None, cut: float | None) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        det, s = _scored(spark, sf_dir)
        det.direction, det.cut = direction, cut
        return s.groupBy("y", det.decide(F.col("score")).alias("decision")).agg(F.count("*").alias("n"))

    return run


for _name, _direction, _cut, _rule in (("forward", 1, None, "score >= t"), ("inverted", -1, None, "score <= t / 9"), ("cut", 1, 2.0, "score >= 2"), ("refused", None, None, "")):
    _run = _decided(_direction, _cut)
    _run.__name__, _run.__doc__ = f"decisions_{_name}", f"Decisions per label, {_name}."
    _case = f"case when {_rule} then 'ALARM' else 'QUIET' end" if _rule else "'REFUSED'"
    checked(_SCORES + _TH + f" select y, {_case} as decision, count(*) as n from sc, th group by all")(_run)


@checked(_SCORES + _TH + " select window_id, score >= t as alert from sc, th")
def detector_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each window is over the threshold."""
    det, s = _scored(spark, sf_dir)
    return s.select("window_id", det.alert(F.col("score")).alias("alert"))


@checked(_SCORES + ", zz as (select window_id, feature, abs(v - med) / mad as z from a join base using (feature)), top as (select window_id, arg_max(feature, z) as feature from zz group by 1) select feature, count(*) as hits from top group by 1")
def detector_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each feature drives the score."""
    det, s = _scored(spark, sf_dir)
    return det.drivers(s)


@checked(_SCORES + " select window_id, round(score, 5) as score from sc")
def detector_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a detector that was saved and loaded."""
    det, s = _scored(spark, sf_dir)
    again = detector.RobustDetector.from_json(det.to_json())
    return s.select("window_id", F.round(again.score(), 5).alias("score"))


@checked(_SCORES + " select window_id, round(abs(v - med) / mad, 5) as z from a join base using (feature) where feature = 'crest'")
def detector_feature_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The robust z of one feature."""
    det, s = _scored(spark, sf_dir)
    return s.select("window_id", F.round(det.z()[FEATURES.index("crest")], 5).alias("z"))


@checked(_UNITS + ", t as (select avg((score >= 3)::int) filter (y = 'anomaly') as h, avg((score >= 3)::int) filter (y <> 'anomaly') as f from r) select round(h, 6) as hit_rate, round(f, 6) as false_rate from t")
def checkup_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate and false-alarm rate over held-out recordings."""
    c = detector.checkup(_units(spark, sf_dir), "score", "pos", threshold=3.0)
    return c.select(F.round("hit_rate", 6).alias("hit_rate"), F.round("false_rate", 6).alias("false_rate"))


@checked(_UNITS + f""", uu as (select b, score, (y = 'anomaly')::int as y, {_U.format('g')} as u from r, range(1, 201) t(b)), ww as (select b, score, y, {_DRAW} as w from uu), cc as (select b, score, sum(w * y) as p, sum(w * (1 - y)) as n from ww group by all),
kk as (select b, p, n, sum(n) over (partition by b order by score) - n / 2 as below from cc), d as (select b, sum(p * below) / nullif(sum(p) * sum(n), 0) as a from kk group by 1)
select round(quantile_cont(a, 0.025), 6) as ci_lo, round(quantile_cont(a, 0.975), 6) as ci_hi from d""")
def checkup_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of the AUC over held-out recordings."""
    c = detector.checkup(_units(spark, sf_dir), "score", "pos", unit="g")
    return c.select(F.round("ci_lo", 6).alias("ci_lo"), F.round("ci_hi", 6).alias("ci_hi"))


@checked("select node_id, round(quantile_cont(energy_rms, 0.9), 6) as q from frame_embeddings where node_id is not null and energy_rms is not null and not isnan(energy_rms) and isfinite(energy_rms) group by 1")
def energy_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact 90 % quantile of the energy per node."""
    e = spark.read.parquet(f"{sf_dir}/frame_embeddings.parquet").filter("node_id is not null and abs(energy_rms) < double('Infinity')")
    return exact_quantile(e, ["node_id"], "energy_rms", 0.9, "q").withColumn("q", F.round("q", 6))


@checked(_UNITS + " select count(*) filter (where y = 'anomaly') as n_pos, count(*) filter (where y <> 'anomaly') as n_neg from r")
def checkup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings of either class in the checkup."""
    return inference.auc(_units(spark, sf_dir), "score", "pos").select("n_pos", "n_neg")
