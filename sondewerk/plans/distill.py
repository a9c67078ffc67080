"""From a bank of windows to a small set of programs: matrix, ranking, nested selection, permutation null, verdict.

The feature matrix of all windows is computed distributed. The means of every program and recording
rank all programs anew for each held-out recording, without it. What the folds need, the columns of
any fold's ``CANDIDATES`` best, is bounded by ``MAX_WINDOWS`` rows and ``MAX_CELLS`` values, and
travels to one task per held-out recording and permutation.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondewerk.functions import grammar, kernels
from sondewerk.functions.learners import Forest, anova_order, logo, nested_fold
from sondewerk.operators import frames
from sondewerk.operators.inference import anova_f, fan_out

#: Programs that fold selection looks at; windows a fold task may hold (a larger bank is refused, not cut).
CANDIDATES, MAX_WINDOWS = 40, 200_000
#: Values of the means, or of the columns of a fold task, that are held at most (more are refused, too).
MAX_CELLS = 50_000_000


def matrix(windows: DataFrame, programs: Sequence[grammar.Program], keys: Sequence[str] = ("window_id", "g", "y")) -> DataFrame:
    """keys and features array<double> of every window."""
    return frames.map_vectors(windows, keys, "x", lambda x: kernels.program_matrix(x, list(programs)), len(programs)).filter("features is not null")


def ranking(features: DataFrame, programs: Sequence[grammar.Program]) -> DataFrame:
    """program, f: programs by the ANOVA F of their recording means."""
    long = features.select("g", "y", F.posexplode("features").alias("i", "v"))
    names = F.array(*[F.lit(p.name) for p in programs])
    return anova_f(long, "i", "v", "y", "g").select(F.element_at(names, F.col("i") + 1).alias("program"), "i", "f")


def recording_means(features: DataFrame, programs: int) -> tuple[np.ndarray, np.ndarray]:
    """(recordings in order, recordings x programs means)."""
    t = features.select("g", F.posexplode("features").alias("i", "v")).groupBy("g", "i").agg(F.avg("v").alias("m")).toArrow()
    recs, at = np.unique(t["g"].to_numpy(), return_inverse=True)
    out = np.zeros((len(recs), programs))
    out[at, t["i"].to_numpy()] = t["m"].to_numpy()
    return recs, out


def fold_orders(means: np.ndarray, label: np.ndarray, candidates: int) -> list[np.ndarray]:
    """Per held-out recording the best programs of all, ranked on the other recordings only."""
    at = np.arange(len(means))
    return [anova_order(means[at != r], label[at != r], at[at != r])[:candidates] for r in at]


def distill(windows: DataFrame, permutations: int = 20, trees: int = 40, seed: int = 0, capacity: int = grammar.CAPACITY, programs: Sequence[grammar.Program] | None = None) -> dict:
    """Deployable programs and the evidence for them; windows (window_id, g, y, x), one label per recording.

    nested: window-level accuracy with ranking (of all programs) and selection inside each held-out
    fold; p: share of group-label permutations that do as well on the deployed programs; null: nested
    accuracy, ranking and selection included, under one permutation of the labels. Included when
    nested beats chance by 0.05, p is at most 0.05 and the null stays within 0.1 of chance.
    """
    from sondewerk.util import materialize

    spark = windows.sparkSession
    began = time.time()
    labelled = windows.filter("g is not null and y is not null")
    shape = labelled.agg(F.count("*").alias("n"), F.count_distinct("g").alias("recs"), F.count_distinct("y").alias("k")).first()
    if not shape["n"] or shape["k"] < 2:
        raise ValueError("two labelled classes are needed")
    if shape["n"] > MAX_WINDOWS:
        raise ValueError(f"{shape['n']} windows are more than a fold task may hold ({MAX_WINDOWS})")
    chosen = grammar.gate(list(programs or grammar.catalogue()), shape["recs"], capacity)
    features = materialize(matrix(labelled, chosen))
    if shape["recs"] * len(chosen) > MAX_CELLS:
        raise ValueError(f"{shape['recs']} recordings are too many to rank {len(chosen)} programs in every fold")
    recs, means = recording_means(features, len(chosen))
    known = {r["g"]: str(r["y"]) for r in labelled.groupBy("g").agg(F.min("y").alias("y")).collect()}
    label = np.array([known[r] for r in recs.tolist()])
    shuffled = lambda t: np.random.default_rng([seed, t]).permutation(label)
    orders = fold_orders(means, label, CANDIDATES) + fold_orders(means, shuffled(0), CANDIDATES)
    deploy = anova_order(means, label, recs)[:CANDIDATES]
    # columns of x, in the order of programs; place: where a program's column is
    order = np.unique(np.concatenate([*orders, deploy]))
    if shape["n"] * len(order) > MAX_CELLS:
        raise ValueError(f"{shape['n']} windows are too many for the {len(order)} programs that the folds look at")
    rows = features.select("g", "y", F.array(*[F.col("features")[int(i)] for i in order]).alias("f")).toPandas()
    x, y, g = np.stack(rows["f"].to_numpy()), rows["y"].to_numpy().astype(str), rows["g"].to_numpy()
    x = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-12)
    place = [np.searchsorted(order, o) for o in orders]
    model = lambda: Forest(trees, seed=seed)
    best = np.searchsorted(order, deploy)
    best = best[nested_fold(np.concatenate([x, x[:1]])[:, best], np.append(y, y[0]), np.append(g.astype(str), "\0none"), "\0none", model)[2]]

    def task(t: int) -> float:
        # right answers on each held-out recording, the same under permuted labels; then permutations: their accuracy
        fake = dict(zip(recs, label if t < len(recs) else shuffled(max(t - 2 * len(recs) + 1, 0))))
        yy = np.array([fake[r] for r in g])
        if t < 2 * len(recs):
            return nested_fold(x[:, place[t]], yy, g, recs[t % len(recs)], model, candidates=CANDIDATES)[0]
        return float(np.mean(list(logo(x[:, best], yy, g, model).values()) or [0.0]))

    got = {r["task"]: r["value"] for r in fan_out(spark, range(2 * len(recs) + permutations), task).collect()}
    nested, null = (sum(got[k * len(recs) + i] for i in range(len(recs))) / len(y) for k in (0, 1))
    observed = float(np.mean(list(logo(x[:, best], y, g, model).values())))
    p = (1 + sum(got[2 * len(recs) + i] >= observed for i in range(permutations))) / (permutations + 1)
    chance = 1 / shape["k"]
    ok = nested > chance + 0.05 and p <= 0.05 and null <= chance + 0.1
    return {"programs": [chosen[int(order[i])].name for i in best], "classes": sorted(set(y)), "recordings": len(recs), "windows": len(y), "budget": len(chosen), "nested": nested, "deploy": observed, "p": p, "null": null, "chance": chance, "verdict": "INCLUDED" if ok else "EXCLUDED", "seconds": time.time() - began}


def report(r: dict) -> str:
    """The result as text."""
    lines = [f"Verdict: {r['verdict']}", f"recordings: {r['recordings']}", f"windows: {r['windows']}", f"budget: {r['budget']}", *[f"{k}: {r[k]:.3f}" for k in ("nested", "deploy", "p", "null", "chance")], "programs:", *[f"- {p}" for p in r["programs"]]]
    return "\n".join(lines)
