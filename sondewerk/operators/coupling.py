"""Coupling and causal operators over aligned channels (wide rows: a time column and one column per channel)."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations, permutations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondewerk.operators.inference import fuse_rankings
from sondewerk.util import materialize, numbered

#: A series handed to a kernel as one array has at most so many points; longer ones are refused, not cut.
MAX_POINTS = 2_000_000


def aligned(df: DataFrame, time: str, channels: Sequence[str]) -> DataFrame:
    """Rows with a value in every channel; a row with any null or NaN is dropped as a whole. Needs two channels."""
    if len(channels) < 2:
        raise ValueError("coupling needs at least two channels")
    ok = F.lit(True)
    for c in channels:
        ok &= F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.select(time, *[F.col(c).cast("double").alias(c) for c in channels]).filter(ok)


def correlations(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """a, b, r for every pair in one pass; 0 when a channel is constant."""
    pairs = list(combinations(channels, 2))
    one = df.agg(*[F.coalesce(F.corr(a, b), F.lit(0.0)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.isnan(f"r{i}"), 0.0).otherwise(F.col(f"r{i}")).alias("r")) for i, (a, b) in enumerate(pairs)])).alias("s")).select("s.*")


def binned(df: DataFrame, columns: Sequence[str], bins: int) -> DataFrame:
    """df with an equal-width bin 0..bins-1 per column (b_<column>); the range is one aggregated row, broadcast. A constant column has one bin."""
    ends = df.agg(*[F.min(c).alias(f"lo_{c}") for c in columns], *[F.max(c).alias(f"hi_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(ends))
    for c in columns:
        lo, hi = F.col(f"lo_{c}"), F.col(f"hi_{c}")
        out = out.withColumn(f"b_{c}", F.when(hi > lo, F.least(F.lit(bins - 1), F.floor((F.col(c) - lo) / (hi - lo) * bins).cast("int"))).otherwise(bins // 2))
    return out.drop(*[f"{e}_{c}" for e in ("lo", "hi") for c in columns])


def mutual_information(df: DataFrame, channels: Sequence[str], bins: int = 12) -> DataFrame:
    """a, b, mi (nats) of every pair from its joint histogram; cells are counted map-side."""
    cells = binned(df, channels, bins)
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"b_{a}").alias("x"), F.col(f"b_{b}").alias("y")) for a, b in combinations(channels, 2)])
    joint = cells.select(F.explode(pairs).alias("s")).select("s.*").groupBy("a", "b", "x", "y").count()
    tot = lambda *by: F.sum("count").over(Window.partitionBy("a", "b", *by))
    p = joint.withColumn("n", tot()).withColumn("nx", tot("x")).withColumn("ny", tot("y"))
    term = F.col("count") / F.col("n") * F.log(F.col("count") * F.col("n") / (F.col("nx") * F.col("ny")))
    return p.groupBy("a", "b").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mi"))


def transfer_entropy(df: DataFrame, time: str, channels: Sequence[str], bins: int = 8) -> DataFrame:
    """cause, effect, score: plug-in transfer entropy with history one, in nats, never below 0.

    Future and past are binned by their own ranges, as the past lacks the last point.
    """
    steps = _shifted(df, time, channels, {f"next_{c}": (c, -1) for c in channels})
    b = binned(steps, [*channels, *[f"next_{c}" for c in channels]], bins)
    pairs = F.array(*[F.struct(F.lit(s).alias("cause"), F.lit(t).alias("effect"), F.col(f"b_next_{t}").alias("i"), F.col(f"b_{t}").alias("j"), F.col(f"b_{s}").alias("k")) for s, t in permutations(channels, 2)])
    joint = b.select(F.explode(pairs).alias("s")).select("s.*").groupBy("cause", "effect", "i", "j", "k").count()
    tot = lambda *by: F.sum("count").over(Window.partitionBy("cause", "effect", *by))
    p = joint.withColumn("n", tot()).withColumn("nj", tot("j")).withColumn("njk", tot("j", "k")).withColumn("nij", tot("i", "j"))
    term = F.col("count") / F.col("n") * F.log(F.col("count") * F.col("nj") / (F.col("njk") * F.col("nij")))
    return p.groupBy("cause", "effect").agg(F.greatest(F.sum(term), F.lit(0.0)).alias("score"))


def _moments(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """Gram matrix of (1, columns) by one aggregation; its size is that of the columns, not of the rows."""
    cols = [F.lit(1.0), *[F.col(c) for c in columns]]
    row = df.agg(*[F.sum(cols[i] * cols[j]).alias(f"g{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]).first()
    g = np.zeros((len(cols), len(cols)))
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    return g


def _shifted(df: DataFrame, time: str, channels: Sequence[str], columns: dict[str, tuple[str, int]]) -> DataFrame:
    """channels and, per name, (channel, places back): only rows that have all of them. Rows meet by their place, in equi-joins."""
    placed = materialize(numbered(df.select(time, *channels), [], [time], "__i").select("__i", *channels))
    out = placed
    for k in sorted({k for _, k in columns.values()}):
        moved = placed.select((F.col("__i") + k).alias("__i"), *[F.col(c).alias(n) for n, (c, d) in columns.items() if d == k])
        out = out.join(moved, "__i")
    return out.drop("__i")


def _lagged(df: DataFrame, time: str, channels: Sequence[str], lag: int) -> DataFrame:
    return _shifted(df, time, channels, {f"{c}__{k}": (c, k) for c in channels for k in range(1, lag + 1)})


def granger(df: DataFrame, time: str, channels: Sequence[str], lag: int = 2) -> list[tuple[str, str, float]]:
    """(cause, effect, log ratio of residual sums without and with the cause's past), from one Gram matrix."""
    past = [f"{c}__{k}" for c in channels for k in range(1, lag + 1)]
    g = _moments(_lagged(df, time, channels, lag), [*channels, *past])
    at = {c: i + 1 for i, c in enumerate([*channels, *past])}

    def rss(y: str, xs: list[str]) -> float:
        i = [0, *[at[x] for x in xs]]
        b, *_ = np.linalg.lstsq(g[np.ix_(i, i)], g[i, at[y]], rcond=None)
        return float(g[at[y], at[y]] - 2 * b @ g[i, at[y]] + b @ g[np.ix_(i, i)] @ b)

    out = []
    for s, t in permutations(channels, 2):
        own, other = [f"{t}__{k}" for k in range(1, lag + 1)], [f"{s}__{k}" for k in range(1, lag + 1)]
        a, b = rss(t, own), rss(t, own + other)
        enough = g[0, 0] + lag > 2 * lag + 2
        out.append((s, t, max(0.0, float(np.log(a / b))) if enough and a > 0 and b > 0 else 0.0))
    return out


def var_edges(df: DataFrame, time: str, channels: Sequence[str]) -> list[tuple[str, str, float]]:
    """(cause, effect, |coefficient|) of the joint first-order vector autoregression."""
    past = [f"{c}__1" for c in channels]
    g = _moments(_lagged(df, time, channels, 1), [*channels, *past])
    m = len(channels)
    i = [0, *range(m + 1, 2 * m + 1)]
    b, *_ = np.linalg.lstsq(g[np.ix_(i, i)], g[np.ix_(i, range(1, m + 1))], rcond=None)
    return [(s, t, float(abs(b[1 + channels.index(s), channels.index(t)]))) for s, t in permutations(channels, 2)]


def partial_correlations(df: DataFrame, channels: Sequence[str], confounds: Sequence[str]) -> list[tuple[str, str, float]]:
    """(a, b, correlation left after the linear influence of the confounds), from one Gram matrix."""
    g = _moments(df, [*channels, *confounds])
    m, i = len(channels), [0, *range(len(channels) + 1, len(g))]
    o = list(range(1, m + 1))
    b, *_ = np.linalg.lstsq(g[np.ix_(i, i)], g[np.ix_(i, o)], rcond=None)
    c = g[np.ix_(o, o)] - g[np.ix_(o, i)] @ b
    d = np.sqrt(np.maximum(np.diag(c), 0))
    return [(x, y, float(c[p, q] / (d[p] * d[q])) if d[p] * d[q] > 0 else 0.0) for (p, x), (q, y) in combinations(enumerate(channels), 2)]


def cross_map(library: np.ndarray, target: np.ndarray, dim: int = 3, tau: int = 1, library_size: int | None = None, seed: int = 0, block: int = 512) -> float:
    """Skill (Pearson) of rebuilding target from the delay manifold of library, by dim+1 nearest neighbours; queries go in blocks."""
    t = np.arange((dim - 1) * tau, len(library))
    v, y = np.stack([library[t - k * tau] for k in range(dim)], axis=1), target[t]
    n = len(t)
    if n <= dim + 1:
        raise ValueError("too few embedded points for the neighbours")
    pick = np.sort(np.random.default_rng(seed).choice(n, library_size, replace=False)) if library_size and library_size < n else np.arange(n)
    guess = np.empty(n)
    for a in range(0, n, block):
        q = np.arange(a, min(a + block, n))
        d = np.sqrt(((v[q, None, :] - v[None, pick, :]) ** 2).sum(axis=2))
        d[q[:, None] == pick[None, :]] = np.inf
        near = np.argpartition(d, dim, axis=1)[:, : dim + 1]
        e = np.take_along_axis(d, near, 1)
        w = np.exp(-e / np.maximum(e.min(axis=1, keepdims=True), 1e-12))
        guess[q] = (w * y[pick][near]).sum(axis=1) / np.maximum(w.sum(axis=1), 1e-12)
    return float(np.corrcoef(guess, y)[0, 1]) if guess.std() > 0 and y.std() > 0 else 0.0


def _pairwise(df: DataFrame, time: str, channels: Sequence[str], kernel: Callable[[np.ndarray, np.ndarray], float]) -> DataFrame:
    """cause, effect, score of kernel(cause, effect): one task per ordered pair, each with its two series only."""
    n = df.count()
    if n > MAX_POINTS:
        raise ValueError(f"{n} points are more than one task may hold ({MAX_POINTS}); thin the channels first")
    both = F.array(*[F.struct(F.lit(a).alias("cause"), F.lit(b).alias("effect"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in permutations(channels, 2)])
    rows = df.select(F.col(time).alias("t"), F.explode(both).alias("s")).select("t", "s.*")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("t", kind="stable")
        return pd.DataFrame({"cause": [p["cause"].iloc[0]], "effect": [p["effect"].iloc[0]], "score": [kernel(p["x"].to_numpy(), p["y"].to_numpy())]})

    return rows.groupBy("cause", "effect").applyInPandas(run, "cause string, effect string, score double")


def ccm(df: DataFrame, time: str, channels: Sequence[str], dim: int = 3, tau: int = 1, library_size: int | None = None, seed: int = 0) -> DataFrame:
    """cause, effect, score in [0, 1]: how well the effect's manifold rebuilds the cause."""
    return _pairwise(df, time, channels, lambda x, y: max(0.0, cross_map(y, x, dim, tau, library_size, seed)))


def ccm_convergence(df: DataFrame, time: str, channels: Sequence[str], sizes: Sequence[int] = (50, 150, 400, 1000)) -> DataFrame:
    """cause, effect, library, score at growing libraries."""
    out = None
    for s in sizes:
        part = ccm(df, time, channels, library_size=s).withColumn("library", F.lit(s))
        out = part if out is None else out.unionByName(part)
    return out.select("cause", "effect", "library", "score")


def edges(df: DataFrame, time: str, channels: Sequence[str], method: str) -> DataFrame:
    """cause, effect, score under one voter: ccm, te, granger or var."""
    if method == "ccm":
        return ccm(df, time, channels)
    if method == "te":
        return transfer_entropy(df, time, channels)
    if method in ("granger", "var"):
        rows = granger(df, time, channels) if method == "granger" else var_edges(df, time, channels)
        return df.sparkSession.createDataFrame(rows, "cause string, effect string, score double")
    raise ValueError(f"unknown method {method!r}")


def graph(df: DataFrame, time: str, channels: Sequence[str], least: float = 0.3, libraries: tuple[int, int] = (100, 1000), converging: bool = True) -> DataFrame:
    """cause, effect, strength, converges: edges strong with the large library whose skill did not fall with more data."""
    small, large = (ccm(df, time, channels, library_size=s) for s in libraries)
    both = large.withColumnRenamed("score", "strength").join(small.withColumnRenamed("score", "__small"), ["cause", "effect"])
    kept = both.withColumn("converges", F.col("strength") >= F.col("__small") - 0.05).filter(F.col("strength") >= least)
    return (kept.filter("converges") if converging else kept).drop("__small")


def consensus(df: DataFrame, time: str, channels: Sequence[str], ccm_min: float = 0.3, te_min: float = 0.02) -> DataFrame:
    """cause, effect, ccm, te, agree: whether both voters clear their bounds."""
    both = ccm(df, time, channels).withColumnRenamed("score", "ccm").join(transfer_entropy(df, time, channels).withColumnRenamed("score", "te"), ["cause", "effect"])
    return both.withColumn("agree", (F.col("ccm") >= ccm_min) & (F.col("te") >= te_min))


def source_scores(edge: DataFrame) -> DataFrame:
    """variable, score: outgoing minus incoming strength."""
    return edge.select(F.explode(F.array(F.struct(F.col("cause").alias("variable"), F.col("score").alias("s")), F.struct(F.col("effect").alias("variable"), (-F.col("score")).alias("s")))).alias("e")).groupBy("e.variable").agg(F.sum("e.s").alias("score"))


def root_cause(baseline: DataFrame, fault: DataFrame) -> DataFrame:
    """variable, score: total change of the edges that touch it."""
    d = baseline.join(fault.withColumnRenamed("score", "__f"), ["cause", "effect"]).withColumn("d", F.abs(F.col("score") - F.col("__f")))
    return d.select(F.explode(F.array("cause", "effect")).alias("variable"), "d").groupBy("variable").agg(F.sum("d").alias("score"))


def diagnose(baseline: DataFrame, now: DataFrame) -> DataFrame:
    """cause, effect, baseline, current, drop of every edge."""
    return baseline.withColumnRenamed("score", "baseline").join(now.withColumnRenamed("score", "current"), ["cause", "effect"]).withColumn("drop", F.col("baseline") - F.col("current"))


def localize(df: DataFrame, time: str, channels: Sequence[str], methods: Sequence[str] = ("te", "granger")) -> DataFrame:
    """variable, best, total, place: most likely drivers first, fused over the voters."""
    votes = None
    for m in methods:
        v = source_scores(edges(df, time, channels, m)).withColumn("voter", F.lit(m))
        votes = v if votes is None else votes.unionByName(v)
    return fuse_rankings(votes, "voter", "variable", "score")


def couplings(df: DataFrame, channels: Sequence[str], confounds: Sequence[str] = (), draws: int = 300, alpha: float = 0.05, effect: float = 0.1) -> DataFrame:
    """a, b, raw, mi, adjusted, p, survives for every pair of channels that are no confounds.

    p: two-sided test of the adjusted correlation by its Fisher z, which a permutation test approaches
    for long series; survives: significant and not trivial after the confounds.
    """
    names = [c for c in channels if c not in confounds]
    n = df.count()
    from math import atanh, erfc, sqrt

    rows = []
    for a, b, r in partial_correlations(df, names, list(confounds)):
        z = abs(atanh(max(-0.999999999, min(0.999999999, r)))) * sqrt(max(n - len(confounds) - 3, 1))
        rows.append((a, b, r, erfc(z / sqrt(2))))
    adj = df.sparkSession.createDataFrame(rows, "a string, b string, adjusted double, p double")
    out = correlations(df, names).withColumnRenamed("r", "raw").join(mutual_information(df, names), ["a", "b"]).join(adj, ["a", "b"])
    return out.withColumn("survives", (F.col("p") < alpha) & (F.abs("adjusted") >= effect))
