"""Queries of edge scores, channel combiners, spans and labels, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondewerk.functions import grammar
from sondewerk.operators import coupling, frames, picks, vectors, watch
from sondewerk.plans.analytics import CHANNELS, _channels, query
from sondewerk.plans.analytics import ORACLES as _ANALYTICS
from sondewerk.plans.grammar import BASE, whole_windows
from sondewerk.plans.problems import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def checked(sql: str | None = None) -> Callable:
    return query(sql, QUERIES, ORACLES)


_TE = _ANALYTICS["causal_transfer_entropy"].replace("round(greatest(sum(n / tt * ln(n * nj / (njk * nij))), 0), 6)", "greatest(sum(n / tt * ln(n * nj / (njk * nij))), 0)")


def _te_of(severity: str) -> str:
    return _TE.replace("isfinite(score))", f"isfinite(score) and severity {severity})", 1)


def _edges_of(spark: SparkSession, sf_dir: str, ok: bool) -> DataFrame:
    state = table(spark, sf_dir, "frame_embeddings").filter((F.col("severity") == "ok") if ok else (F.col("severity") != "ok")).select(F.col("emb_id").alias("t")).distinct()
    return coupling.transfer_entropy(_channels(spark, sf_dir).join(state, "t", "left_semi"), "t", CHANNELS)


@checked(f"with e as ({_TE}), s as (select cause as variable, score as s from e union all select effect, -score from e) select variable, round(sum(s), 5) + 0.0 as score from s group by 1")
def te_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outgoing minus incoming transfer entropy of each channel."""
    s = coupling.source_scores(coupling.transfer_entropy(_channels(spark, sf_dir), "t", CHANNELS))
    return s.select("variable", (F.round("score", 5) + 0.0).alias("score"))


_OK, _NOT_OK = "= 'ok'", "<> 'ok'"
_BOTH = f"with b as ({_te_of(_OK)}), f as ({_te_of(_NOT_OK)}), d as (select cause, effect, b.score as baseline, f.score as now from b join f using (cause, effect))"


@checked(_BOTH + ", v as (select cause as variable, abs(baseline - now) as d from d union all select effect, abs(baseline - now) from d) select variable, round(sum(d), 5) as score from v group by 1")
def te_root_cause(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the edges that touch each channel, from rows without to rows with a finding."""
    s = coupling.root_cause(_edges_of(spark, sf_dir, True), _edges_of(spark, sf_dir, False))
    return s.select("variable", F.round("score", 5).alias("score"))


@checked(_BOTH + ' select cause, effect, round(baseline - now, 5) + 0.0 as loss from d')
def te_drops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how much each edge weakens."""
    d = coupling.diagnose(_edges_of(spark, sf_dir, True), _edges_of(spark, sf_dir, False))
    return d.select("cause", "effect", (F.round("drop", 5) + 0.0).alias("loss"))


_HALVES = BASE + ", w64 as (select window_id from s group by 1 having count(*) = 64), h as (select a.window_id, a.i, a.v as a, b.v as b from s a join s b on b.window_id = a.window_id and b.i = a.i + 32 semi join w64 on w64.window_id = a.window_id where a.i < 32)"
_COMBINED = {"ch1": "b", "logratio(0,1)": "ln((abs(a) + 1e-9) / (abs(b) + 1e-9))", "chdiff(0,1)": "a - b", "mean": "(a + b) / 2", "std": "abs(a - b) / 2"}


def _combiner(name: str, term: str) -> None:
    def kernel(x: np.ndarray) -> np.ndarray:
        return grammar.combine(name, x.reshape(len(x), 2, 32)).mean(axis=1)[:, None]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = frames.map_series(whole_windows(spark, sf_dir).filter("size(x) = 64"), ["window_id"], "x", kernel, ["level"])
        return out.select("window_id", (F.round("level", 5) + 0.0).alias("level"))

    run.__name__, run.__doc__ = f"combine_{grammar.parse_combiner(name)[0]}", f"The halves of a window as two channels under the combiner {name}."
    checked(_HALVES + f" select window_id, round(avg({term}), 5) + 0.0 as level from h group by 1")(run)


for _name, _term in _COMBINED.items():
    _combiner(_name, _term)


@checked("select count(*) as names from (select 'ch' || i from range(0, 3) t(i) union all select 'pair' || i || j || k from range(0, 3) t(i), range(0, 3) u(j), range(0, 2) v(k) where i < j union all select unnest(['mean', 'std']))")
def combiner_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combiners of three channels."""
    return spark.createDataFrame([(len(grammar.combiners(3)),)], "names bigint")


@checked("with t as (select distinct received_at as t from frames where received_at is not null), s as (select t, lead(t, 9) over (order by t) as e from t) select epoch_us(t) as start_us, epoch_us(e) - epoch_us(t) as span_us from s where e is not null order by span_us, start_us limit 1")
def densest_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest time in which ten deliveries arrived at different times."""
    t = table(spark, sf_dir, "frames").filter("received_at is not null").select(F.unix_micros("received_at").alias("t")).distinct()
    return watch.densest_span(t, "t", 10).select(F.col("start").alias("start_us"), F.col("span").alias("span_us"))


_PATHS = "with p as (select bank || '/' || y || '_' || g || '.wav' as path, y, bank, g from recordings where bank is not null and y is not null and g is not null)"


@checked(_PATHS + " select path, y as prefix, y || '_' || g as stem, bank as parent from p")
def labels_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by the three rules for file names."""
    p = table(spark, sf_dir, "recordings").filter("bank is not null and y is not null and g is not null").select(F.concat("bank", F.lit("/"), "y", F.lit("_"), F.col("g").cast("string"), F.lit(".wav")).alias("path"))
    return p.select("path", *[watch.label_from_path(F.col("path"), r).alias(r) for r in ("prefix", "stem", "parent")])


@checked("select source, count(*) as n from documents where contains(lower(source), 're') group by 1")
def labels_that_contain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose label contains a text, whatever the case."""
    return table(spark, sf_dir, "documents").filter(watch.label_contains(F.col("source"), "RE")).groupBy("source").agg(F.count("*").alias("n"))


@checked("select emb_id, round((recon_error + 1e-6) * (abs(z_recon) + 1e-6) * (abs(z_energy) + 1e-3), 6) as score from frame_embeddings where recon_error is not null and not isnan(recon_error) and z_recon is not null and not isnan(z_recon) and z_energy is not null and not isnan(z_energy) and abs(recon_error) < 1e3 and abs(z_recon) < 1e3 and abs(z_energy) < 1e3")
def point_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product score of error, distance and energy."""
    e = table(spark, sf_dir, "frame_embeddings")
    for c in ("recon_error", "z_recon", "z_energy"):
        e = e.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e3))
    return e.select("emb_id", F.round(vectors.anomaly_score(F.col("recon_error"), F.abs("z_recon"), F.abs("z_energy")), 6).alias("score"))


@checked("select node_id * 4294967296 + seq % 4294967296 as point_id, count(*) as n from frame_embeddings where node_id is not null and seq is not null group by 1")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of points from node and counter."""
    return table(spark, sf_dir, "frame_embeddings").filter("node_id is not null and seq is not null").groupBy(vectors.point_id(F.col("node_id"), F.col("seq")).alias("point_id")).agg(F.count("*").alias("n"))


@checked("select round(quantile_cont(score, 0.25), 6) as low, round(quantile_cont(score, 0.75), 6) as high from frame_embeddings where score is not null and not isnan(score)")
def score_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles of all scores."""
    e = table(spark, sf_dir, "frame_embeddings").filter("score is not null and not isnan(score)")
    return spark.createDataFrame([tuple(round(v, 6) for v in picks.quantiles(e, "score", (0.25, 0.75)))], "low double, high double")
