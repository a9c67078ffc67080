"""Splits that keep related records together: connected units, then component swap search."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondewerk.util import lookup_join, materialize, release, skew_join

SPLITS, SHARES = ("train", "validation", "test"), (0.8, 0.1, 0.1)
#: A unit with more than 1/HEAVY of all windows is placed first; the others are annealed in shards of about SHARD units.
HEAVY, SHARD = 2_000, 4_000
#: Annealing chains per shard, steps of a chain per unit and at least, weight of a label's deviation against that of the size.
CHAINS, STEPS, LEAST_STEPS, LABEL_WEIGHT = 4, 25, 20_000, 0.5
#: Spellings that name no machine, once lower-cased and stripped.
NO_MACHINE = ("", "unknown", "na")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, unit): the smallest node of the connected component of every node with an edge.

    Large-star and small-star in turn until nothing changes (about the logarithm of the longest path
    in rounds), each round written to the shared folder. A star's centre may hold a third of all edges: minima are combined map-side, joins to
    them are salted, so no task gathers a star.
    """
    e = materialize(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = lookup_join(both.filter("v > u"), low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = lookup_join(large, least, ["u"])
        new = materialize(small.select("u", F.col("m").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u <> v").distinct())
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        release(e)
        e = new
        if now == mark:
            break
        mark = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("unit")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("unit"))).distinct()


def unit_edges(recordings: DataFrame, windows: DataFrame, length: int = 64) -> DataFrame:
    """(a, b): recordings of one unit, as stars around the smallest g of a machine, a parent or a shared window."""
    g = F.col("g").cast("bigint")
    held = recordings.filter("g is not null").select(g.alias("g"), "machine", F.col("parent_g").cast("bigint").alias("parent_g"))
    name = F.regexp_replace(F.lower("machine"), r"[^\p{L}\p{N}]", "")
    machines = held.select("g", name.alias("key")).filter(F.col("key").isNotNull() & ~F.col("key").isin(*NO_MACHINE))
    known = held.select("g").distinct()
    parents = skew_join(held.filter("parent_g is not null").select(F.col("g").alias("a"), F.col("parent_g").alias("b")), known.withColumnRenamed("g", "b"), ["b"]).select("a", "b")
    whole = (F.size("windows") == length) & F.forall("windows", lambda x: x.isNotNull() & ~F.isnan(x))
    plain = F.transform("windows", lambda x: x + F.lit(0.0).cast("float"))
    same = windows.filter(F.col("g").isNotNull() & F.coalesce(whole, F.lit(False))).select(g.alias("g"), F.concat_ws("/", F.xxhash64(plain).cast("string"), F.hash(plain).cast("string")).alias("key")).distinct()
    same = skew_join(same, known, ["g"])

    def star(rows: DataFrame) -> DataFrame:
        rows = rows.distinct()
        centre = rows.groupBy("key").agg(F.min("g").alias("b"), F.count("*").alias("n")).filter("n > 1").drop("n")
        return skew_join(rows, centre, ["key"]).select(F.col("g").alias("a"), "b")

    return star(machines).unionByName(star(same)).unionByName(parents)


def units(recordings: DataFrame, windows: DataFrame) -> DataFrame:
    """(g, unit_g) of every recording that belongs together with another one; unit_g is the smallest g of its unit.

    Null g, unnamed machines, parents that are no recordings and windows with nulls link nothing.
    """
    return components(unit_edges(recordings, windows)).select(F.col("node").alias("g"), F.col("unit").alias("unit_g"))


def anneal(sizes: np.ndarray, start: np.ndarray, targets: np.ndarray, seed: int, steps: int | None = None, label_weight: float = LABEL_WEIGHT) -> tuple[np.ndarray, float]:
    """Move or swap whole units until the deviation from targets is least; the best assignment seen and its cost.

    sizes: units x (windows, windows per label); targets: splits x the same. start: the hashed assignment.
    """
    n, s = len(sizes), len(targets)
    steps = steps or max(LEAST_STEPS, STEPS * n)
    rng = np.random.default_rng(seed)
    weight = np.full(sizes.shape[1], label_weight)
    weight[0] = 1.0
    scale = weight / np.maximum(targets.sum(axis=0), 1e-9)
    at = start.copy()
    load = np.zeros_like(targets)
    np.add.at(load, at, sizes)
    dev = load - targets
    cost = float((np.abs(dev) * scale).sum())
    best, best_cost = at.copy(), cost
    if n == 0:
        return best, best_cost
    pick, other, to, luck, swap = rng.integers(0, n, steps), rng.integers(0, n, steps), rng.integers(0, s, steps), rng.random(steps), rng.random(steps) < 0.5
    hot = float((sizes * scale).sum(axis=1).mean())
    for i in range(steps):
        u, v = pick[i], other[i]
        a = at[u]
        b = at[v] if swap[i] else to[i]
        if a == b:
            continue
        move = sizes[u] - sizes[v] if swap[i] else sizes[u]
        delta = float(((np.abs(dev[a] - move) - np.abs(dev[a]) + np.abs(dev[b] + move) - np.abs(dev[b])) * scale).sum())
        heat = hot * (1 - i / steps) ** 3 + 1e-12
        if delta <= 0 or luck[i] < np.exp(-delta / heat):
            at[u] = b
            if swap[i]:
                at[v] = a
            dev[a] -= move
            dev[b] += move
            cost += delta
            if cost < best_cost - 1e-12:
                best, best_cost = at.copy(), cost
    return best, best_cost


def _chain(left: np.ndarray, labels: Sequence[str], steps: int | None) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """One chain of one shard; the rows carry the shard's part of what is left of each count (t_n, t_label)."""
    cols = ["n", *labels]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("unit")
        shard, chain = int(part["shard"].iloc[0]), int(part["chain"].iloc[0])
        targets = left * part[[f"t_{c}" for c in cols]].iloc[0].to_numpy(dtype=np.float64)
        at, cost = anneal(part[cols].to_numpy(dtype=np.float64), part["start"].to_numpy(), targets, seed=1000 * (shard + 1) + chain, steps=steps)
        return pd.DataFrame({"shard": shard, "chain": chain, "cost": cost, "unit": part["unit"].to_numpy(), "split_no": at})

    return run


def split_units(weights: DataFrame, labels: Sequence[str], shares: Sequence[float] = SHARES, seed: int = 1, chains: int = CHAINS, steps: int | None = None) -> DataFrame:
    """(unit, split_no) for weights (unit, n, one column per label).

    Units above 1/HEAVY of all windows (at most HEAVY of them) are annealed first against the whole
    targets; the rest in hashed shards, each against its part of what is left, so every task holds
    a bounded number of units. Of the parallel chains of a shard the best is kept. Only totals per
    split reach the driver; the shards' parts stay a table.
    """
    cols = ["n", *labels]
    weights = materialize(weights)
    total = weights.agg(F.count("*").alias("units"), *[F.sum(c).alias(c) for c in cols]).first()
    if not total["units"]:
        return weights.sparkSession.createDataFrame([], "unit bigint, split_no int")
    want = np.outer(shares, [float(total[c] or 0) for c in cols])
    heavy = F.col("n") > (total["n"] or 0) / HEAVY
    u = (F.xxhash64(F.lit(seed), "unit").bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40)).cast("double")
    edges = np.cumsum(shares)
    hashed = F.lit(len(shares) - 1)
    for i in range(len(shares) - 2, -1, -1):
        hashed = F.when(u < float(edges[i]), F.lit(i)).otherwise(hashed)
    started = weights.withColumn("start", hashed.cast("int"))

    def best(part: DataFrame, left: np.ndarray) -> DataFrame:
        sums = materialize(part.groupBy("shard").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(f"t_{c}") for c in cols]))
        whole = sums.agg(*[F.sum(f"t_{c}").alias(c) for c in cols]).first()
        parts = sums.select("shard", *[(F.col(f"t_{c}") / max(float(whole[c] or 0), 1e-9)).alias(f"t_{c}") for c in cols])
        many = lookup_join(part, parts, ["shard"]).withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1))))
        tried = materialize(many.groupBy("shard", "chain").applyInPandas(_chain(left, list(labels), steps), "shard int, chain int, cost double, unit bigint, split_no int"))
        winner = tried.groupBy("shard").agg(F.min(F.struct("cost", "chain")).alias("w")).select("shard", F.col("w.chain").alias("chain"))
        return lookup_join(tried, winner, ["shard", "chain"]).select("unit", "split_no")

    if heavy_units := weights.filter(heavy).count():
        first = materialize(best(started.filter(heavy).withColumn("shard", F.lit(-1)), want))
        spent = first.join(weights.filter(heavy), "unit").groupBy("split_no").agg(*[F.sum(c).alias(c) for c in cols]).collect()
    left = want.copy()
    for r in spent if heavy_units else ():
        left[r["split_no"]] -= [float(r[c]) for c in cols]
    count = total["units"] - heavy_units
    if not count:
        return first
    sharded = started.filter(~F.coalesce(heavy, F.lit(False))).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "unit"), F.lit(-(-count // SHARD))).cast("int"))
    rest = best(sharded, left)
    return first.unionByName(rest) if heavy_units else rest


def assign_splits(recordings: DataFrame, windows: DataFrame, shares: Sequence[float] = SHARES, names: Sequence[str] = SPLITS, seed: int = 1, labels: Sequence[str] = ("normal", "anomaly")) -> DataFrame:
    """(g, unit_g, split): every recording with its unit and split, all recordings of a unit in one split.

    Sizes are counted in windows, labels (lower-cased, nulls are none) per window. A recording
    without windows weighs nothing; windows of no recording are left out. Repeated rows of one g count once.
    """
    every = recordings.filter("g is not null").select(F.col("g").cast("bigint").alias("g")).distinct()
    placed = materialize(every.join(units(recordings, windows), "g", "left").select("g", F.coalesce("unit_g", "g").alias("unit")))
    counts = windows.filter("g is not null").groupBy(F.col("g").cast("bigint").alias("g")).agg(F.count("*").alias("n"), *[F.sum((F.lower("y") == c).cast("int")).alias(c) for c in labels])
    weights = placed.join(counts, "g", "left").groupBy("unit").agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("double").alias(c) for c in ("n", *labels)])
    chosen = split_units(weights, labels, shares, seed)
    named = chosen.select("unit", F.element_at(F.array(*[F.lit(x) for x in names]), F.col("split_no") + 1).alias("split"))
    return skew_join(placed, named, ["unit"]).select("g", F.col("unit").alias("unit_g"), "split")
