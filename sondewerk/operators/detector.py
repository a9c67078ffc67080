"""Detectors fitted on healthy rows: robust z, direction and cut from labelled anchors, decisions, spectral reconstruction."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondewerk.operators import inference
from sondewerk.util import exact_quantile, lookup_join

MAD_SCALE = 1.4826
ENVELOPE, THRESHOLD = 3.0, 4.0
#: Units that calibration holds at most (more are refused, not cut).
MAX_UNITS = 200_000


def robust_baseline(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, med, mad (scaled), n over long or wide rows: exact medians by distinct values, two passes.

    Nulls and NaN are left out; one row per feature.
    """
    long = df.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c).cast("double"))])).alias("feature", "v")).filter("v is not null and not isnan(v)")
    med = exact_quantile(long, ["feature"], "v", 0.5, "med").join(long.groupBy("feature").agg(F.count("*").alias("n")), "feature")
    far = lookup_join(long, med, ["feature"]).withColumn("far", F.abs(F.col("v") - F.col("med")))
    mad = exact_quantile(far, ["feature"], "far", 0.5, "mad")
    return med.join(mad, "feature").select("feature", "med", (F.col("mad") * MAD_SCALE).alias("mad"), "n")


@dataclass
class RobustDetector:
    """Largest robust z over features. Features constant on healthy data are degenerate: their scale is a relative floor."""

    features: list[str]
    med: list[float]
    mad: list[float]
    threshold: float = THRESHOLD
    degenerate: list[bool] = field(default_factory=list)
    direction: int | None = None
    cut: float | None = None

    @classmethod
    def fit(cls, healthy: DataFrame, features: Sequence[str], threshold: float | None = None, envelope: float = ENVELOPE) -> RobustDetector:
        """threshold None: envelope times the 99 % quantile of the healthy scores."""
        base = {r["feature"]: r for r in robust_baseline(healthy, features).collect()}
        med = [base[f]["med"] if f in base else 0.0 for f in features]
        mad = [base[f]["mad"] if f in base else 0.0 for f in features]
        floor = [max(1e-12, 1e-9 * abs(m)) for m in med]
        flat = [a <= b for a, b in zip(mad, floor)]
        det = cls(list(features), med, [b if f else a for a, b, f in zip(mad, floor, flat)], THRESHOLD, flat)
        if threshold is None:
            q = exact_quantile(healthy.withColumn("__all", F.lit(0)), ["__all"], det.score(), 0.99, "q").first()
            threshold = max((q["q"] if q and q["q"] else 0.0) * envelope, 1e-6)
        det.threshold = float(threshold)
        return det

    def z(self) -> list[Column]:
        return [F.abs(F.col(f) - m) / s for f, m, s in zip(self.features, self.med, self.mad)]

    def score(self) -> Column:
        """Largest z; null features are passed over, a row without any scores 0."""
        z = [F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0)) for c in self.z()]
        return F.greatest(*z) if len(z) > 1 else z[0]

    def drivers(self, df: DataFrame) -> DataFrame:
        """feature, hits: how often each feature is the one with the largest z."""
        pairs = F.array_max(F.array(*[F.struct(c.alias("z"), F.lit(f).alias("f")) for c, f in zip(self.z(), self.features)]))
        return df.select(pairs["f"].alias("feature")).groupBy("feature").agg(F.count("*").alias("hits"))

    @property
    def inverse_threshold(self) -> float:
        return self.threshold / 9.0

    def calibrate(self, scored: DataFrame, score: str, positive: str, unit: str, draws: int = 2000, seed: int = 0) -> dict:
        """Direction and cut from labelled anchors, by recordings (unit): the bootstrap interval of the AUC must clear 0.5.

        A unit with both labels, fewer than four units or one class only decides nothing. More than
        MAX_UNITS units are refused.
        """
        units = scored.groupBy(unit).agg(F.avg(score).alias("s"), F.min(F.col(positive).cast("int")).alias("y"), F.max(F.col(positive).cast("int")).alias("y2"))
        rows = units.limit(MAX_UNITS + 1).toPandas()
        if len(rows) > MAX_UNITS:
            raise ValueError(f"more units than calibration may hold ({MAX_UNITS})")
        s, y = rows["s"].to_numpy(float), rows["y"].to_numpy(int)
        out = {"identified": False, "sign": None, "auc": None, "ci_lo": None, "ci_hi": None, "n_anchors": len(rows)}
        self.direction = self.cut = None
        if (rows["y"] != rows["y2"]).any():
            return out | {"reason": "a unit carries both labels"}
        if len(rows) < 4 or len(set(y)) < 2:
            return out | {"reason": "too few anchors or one class only"}
        rng = np.random.default_rng(seed)
        draw = [auc_of(s[i], y[i]) for i in (rng.integers(0, len(y), len(y)) for _ in range(draws))]
        lo, hi = np.nanpercentile(draw, [2.5, 97.5])
        out |= {"auc": auc_of(s, y), "ci_lo": float(lo), "ci_hi": float(hi)}
        if lo <= 0.5 <= hi:
            return out | {"reason": "the interval covers 0.5"}
        self.direction = 1 if lo > 0.5 else -1
        self.cut = youden_cut(s, y, self.direction)
        return out | {"identified": True, "sign": self.direction, "reason": "anomalies score " + ("higher" if self.direction == 1 else "lower")}

    def decide(self, score: Column) -> Column:
        """ALARM, QUIET or, while the direction is unknown, REFUSED."""
        if self.direction is None:
            return F.when(score.isNotNull(), F.lit("REFUSED"))
        cut = self.cut if self.cut is not None else self.threshold if self.direction == 1 else self.inverse_threshold
        hit = score >= cut if self.direction == 1 else score <= cut
        return F.when(hit, F.lit("ALARM")).when(score.isNotNull(), F.lit("QUIET"))

    def alert(self, score: Column) -> Column:
        return score >= self.threshold

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> RobustDetector:
        d = cls(**json.loads(text))
        if d.direction not in (None, 1, -1):
            raise ValueError(f"unknown direction {d.direction!r}")
        if d.cut is not None and not np.isfinite(d.cut):
            raise ValueError("the cut is not finite")
        return d


def auc_of(score: np.ndarray, label: np.ndarray) -> float:
    """Mann-Whitney AUC of small arrays, ties averaged; NaN where a class is missing."""
    pos, neg = score[label == 1], score[label == 0]
    if not len(pos) or not len(neg):
        return float("nan")
    neg = np.sort(neg)
    return float((np.searchsorted(neg, pos, "left") + np.searchsorted(neg, pos, "right")).sum() / (2 * len(pos) * len(neg)))


def youden_cut(score: np.ndarray, label: np.ndarray, sign: int) -> float:
    cuts = np.unique(score[np.isfinite(score)])
    down = np.sort(-sign * score[~np.isnan(score) & (label == 1)]), np.sort(-sign * score[~np.isnan(score) & (label == 0)])
    hit, false = (np.searchsorted(v, -sign * cuts, "right") / (label == c).sum() for v, c in zip(down, (1, 0)))
    return float(cuts[np.argmax(hit - false)])


def severity(score: Column, threshold: float = THRESHOLD) -> Column:
    """ok, warn from the threshold on, alarm from twice the threshold on."""
    return F.when(score >= 2 * threshold, F.lit("alarm")).when(score >= threshold, F.lit("warn")).when(score.isNotNull(), F.lit("ok"))


def stream_score(error: Column, energy: Column, med_r: float, mad_r: float, med_e: float, mad_e: float) -> dict[str, Column]:
    """z_recon (high errors only), z_energy (both sides) and their larger one; a scale of next to nothing counts as 1."""
    zr = (error - med_r) / (mad_r if mad_r > 1e-9 else 1.0)
    ze = F.abs(energy - med_e) / (mad_e if mad_e > 1e-9 else 1.0)
    return {"z_recon": zr, "z_energy": ze, "score": F.greatest(zr, ze)}


class Reconstruction:
    """Linear autoencoder: the leading principal directions of healthy spectra; the error of the rest is the score.

    Stands for a convolutional network that needs a deep-learning library; fitted on the Gram matrix,
    whose size is that of the features and which partitions sum up, so healthy data of any size do.
    """

    def __init__(self, mean: np.ndarray, basis: np.ndarray):
        self.mean, self.basis = mean, basis

    @classmethod
    def fit(cls, df: DataFrame, x: str, latent: int = 32) -> Reconstruction:
        from collections.abc import Iterator

        import pyarrow as pa

        def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                if b.num_rows:
                    m = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
                    m = np.concatenate([np.ones((len(m), 1)), m], axis=1)
                    total = m.T @ m if total is None else total + m.T @ m
            if total is not None:
                yield pa.record_batch([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["g"])

        rows = df.select(x).mapInArrow(gram, "g array<double>")
        flat = rows.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toPandas()["v"].to_numpy()
        if not len(flat):
            raise ValueError("no healthy rows to fit on")
        g = flat.reshape(int(np.sqrt(len(flat))), -1)
        n, mean = g[0, 0], g[0, 1:] / g[0, 0]
        _, vec = np.linalg.eigh(g[1:, 1:] / n - np.outer(mean, mean))
        return cls(mean, vec[:, ::-1][:, :latent])

    def embed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(embedding, mean squared error) of rows."""
        z = (x - self.mean) @ self.basis
        rest = x - self.mean - z @ self.basis.T
        return z, (rest * rest).mean(axis=1)


def checkup(units: DataFrame, score: str, positive: str, unit: str | None = None, threshold: float | None = None, draws: int = 200) -> DataFrame:
    """One row: AUC over recordings and whether scores separate (>= 0.5 aligned, below inverted).

    With unit the 95 % bootstrap interval over units stands beside it (ci_lo, ci_hi), with threshold the
    share of either class that the alarm hits (hit_rate, false_rate).
    """
    out = inference.auc(units, score, positive)
    out = out.withColumn("verdict", F.when(F.col("auc").isNull(), "undetermined").when(F.col("auc") >= 0.5, "aligned").otherwise("inverted"))
    for more in (inference.bootstrap_auc(units, unit, score, positive, draws) if unit else None, inference.alarm_gap(units, score, positive, threshold).drop("gap") if threshold is not None else None):
        if more is not None:  # one row each
            out = out.withColumn("__one", F.lit(1)).join(more.withColumn("__one", F.lit(1)), "__one").drop("__one")
    return out


def guess_healthy(labels: Sequence[str]) -> str | None:
    """The class that names the healthy state, else the only one that names no fault."""
    low = {c.lower(): c for c in labels}
    for name, c in sorted(low.items()):
        if name.startswith("normal") or name in ("healthy", "ok", "good", "baseline"):
            return c
    calm = [c for name, c in low.items() if not any(w in name for w in ("anom", "fault", "bad", "fail", "defect", "abnormal"))]
    return calm[0] if len(calm) == 1 else None
