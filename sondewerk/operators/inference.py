"""Ranking, resampling and tests over score tables; random draws come from a hash, the same at any partitioning."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondewerk.util import lookup_join, numbered, prefix_sums


def auc(df: DataFrame, score: str, positive: str | Column, keys: Sequence[str] = (), out: str = "auc") -> DataFrame:
    """keys, n_pos, n_neg, auc: Mann-Whitney AUC with tie-averaged ranks; null where a class is missing.

    Equal scores are counted first, map-side, so what is ranked is one row per distinct score. Null
    and NaN scores and null labels are left out.
    """
    pos = F.col(positive) if isinstance(positive, str) else positive
    base = df.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).select(*keys, F.col(score).alias("__s"), pos.cast("boolean").alias("__p")).filter("__p is not null")
    c = base.groupBy(*keys, "__s").agg(F.sum(F.col("__p").cast("bigint")).alias("__pos"), F.sum((~F.col("__p")).cast("bigint")).alias("__neg"))
    ranked = prefix_sums(c, keys, ["__s"], {"__upto": F.col("__neg")})
    wins = ranked.withColumn("__w", F.col("__pos") * (F.col("__upto") - F.col("__neg") / 2))
    agg = wins.groupBy(*keys).agg(F.sum("__pos").alias("n_pos"), F.sum("__neg").alias("n_neg"), F.sum("__w").alias("__w"))
    return agg.withColumn(out, F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("__w") / (F.col("n_pos") * F.col("n_neg")))).drop("__w")


def percentile_rank(df: DataFrame, score: str, tie: Sequence[str], keys: Sequence[str] = (), out: str = "pct_rank") -> DataFrame:
    """df with i/(n-1) of each row by score; ties in the order of tie, not averaged."""
    n = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    placed = numbered(df, keys, [score, *tie], "__i")
    both = lookup_join(placed, n, keys) if keys else placed.crossJoin(F.broadcast(n))
    return both.withColumn(out, F.col("__i") / F.greatest(F.col("__n") - 1, F.lit(1))).drop("__i", "__n")


def best_cut(df: DataFrame, score: str, positive: str, sign: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    """keys, cut, j: the smallest score that separates the classes best by Youden's J (scores on the side of sign hit)."""
    base = df.filter(F.abs(F.col(score)) < float("inf")).groupBy(*keys, F.col(score).alias("cut")).agg(F.sum(F.col(positive).cast("double")).alias("__p"), F.sum((~F.col(positive).cast("boolean")).cast("double")).alias("__n"))
    runs = prefix_sums(base, keys, ["cut"], {"__pu": F.col("__p"), "__nu": F.col("__n")})
    tot = base.groupBy(*keys).agg(F.sum("__p").alias("__pt"), F.sum("__n").alias("__nt"))
    both = lookup_join(runs, tot, keys) if keys else runs.crossJoin(F.broadcast(tot))
    hits = lambda c: F.col(f"__{c}t") - F.col(f"__{c}u") + F.col(f"__{c}") if sign == 1 else F.col(f"__{c}u")
    rate = lambda c: F.coalesce(F.try_divide(hits(c), F.col(f"__{c}t")), F.lit(0.0))
    j = both.withColumn("j", rate("p") - rate("n"))
    best = j.groupBy(*keys).agg(F.max(F.struct(F.round("j", 12).alias("j"), (-F.col("cut")).alias("m"))).alias("b"))
    return best.select(*keys, (-F.col("b.m")).alias("cut"), F.col("b.j").alias("j"))


def anova_f(df: DataFrame, feature: str, value: str, label: str, group: str) -> DataFrame:
    """feature, f: between over within variance of the classes on group means; -1 for features that do not vary."""
    m = df.groupBy(feature, group).agg(F.avg(value).alias("__m"), F.min(label).alias("__y"))
    tot = m.groupBy(feature).agg(F.avg("__m").alias("__mu"), F.stddev_pop("__m").alias("__sd"), F.count("*").alias("__r"), F.count_distinct("__y").alias("__k"))
    cls = m.groupBy(feature, "__y").agg(F.avg("__m").alias("__c"), F.var_pop("__m").alias("__v"), F.count("*").alias("__n"))
    both = cls.join(tot, feature)
    s = F.col("__sd") + 1e-12
    sums = both.groupBy(feature).agg(F.sum(F.col("__n") * F.pow((F.col("__c") - F.col("__mu")) / s, 2)).alias("__b"), (F.sum(F.col("__n") * F.col("__v") / (s * s)) + 1e-12).alias("__w"), F.max("__sd").alias("__sd"), F.max("__r").alias("__r"), F.max("__k").alias("__k"))
    f = (F.col("__b") / F.greatest(F.col("__k") - 1, F.lit(1))) / (F.col("__w") / F.greatest(F.col("__r") - F.col("__k"), F.lit(1)))
    return sums.select(feature, F.when(F.col("__sd") > 1e-9, f).otherwise(-1.0).alias("f"))


def hash_uniform(*parts: Column | str | int) -> Column:
    """A uniform draw in [0, 1) from the md5 of its parts; SQL engines give the same."""
    text = F.concat_ws("-", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / float(1 << 32)


def _drawn(df: DataFrame, unit: str, draws: int, seed: int) -> DataFrame:
    """df once per draw (__b), with the Poisson(1) weight (__w) that the hash gives the unit in it."""
    u = hash_uniform(seed, F.col("__b"), F.col(unit))
    steps = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(9)]
    weight = sum(((u >= x).cast("int") for x in steps), F.lit(0))
    return df.withColumn("__b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__w", weight)


def bootstrap_mean(df: DataFrame, unit: str, value: str, draws: int = 1000, seed: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """keys, mean, lo, hi: 95 % percentile bootstrap of the mean over units.

    Every unit gets a Poisson(1) weight per draw from the hash, so a draw needs no second pass over
    the data and partial sums combine map-side; draws are rows, not driver loops.
    """
    many = _drawn(df.select(*keys, unit, F.col(value).alias("__v")).filter("__v is not null"), unit, draws, seed)
    means = many.groupBy(*keys, "__b").agg(F.try_divide(F.sum(F.col("__w") * F.col("__v")), F.sum("__w")).alias("__m"))
    ends = means.groupBy(*keys).agg(F.percentile("__m", F.lit(0.025)).alias("lo"), F.percentile("__m", F.lit(0.975)).alias("hi"))
    point = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(value).alias("mean"))
    return point.join(ends, list(keys)) if keys else point.crossJoin(F.broadcast(ends))


def bootstrap_auc(df: DataFrame, unit: str, score: str, positive: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """One row (ci_lo, ci_hi): 95 % percentile bootstrap of the AUC over units, weighted as in ``bootstrap_mean``; draws that lose a class are left out."""
    base = df.select(unit, F.col(score).cast("double").alias("__s"), F.col(positive).cast("int").alias("__y")).filter("__s is not null and not isnan(__s) and __y is not null")
    c = _drawn(base, unit, draws, seed).groupBy("__b", "__s").agg(F.sum(F.col("__w") * F.col("__y")).alias("__p"), F.sum(F.col("__w") * (1 - F.col("__y"))).alias("__n"))
    runs = prefix_sums(c, ["__b"], ["__s"], {"__upto": F.col("__n")})
    per = runs.groupBy("__b").agg((F.sum(F.col("__p") * (F.col("__upto") - F.col("__n") / 2))).alias("w"), F.sum("__p").alias("p"), F.sum("__n").alias("n"))
    a = per.select(F.try_divide(F.col("w"), F.col("p") * F.col("n")).alias("a"))
    return a.agg(F.percentile("a", F.lit(0.025)).alias("ci_lo"), F.percentile("a", F.lit(0.975)).alias("ci_hi"))


def paired(a: DataFrame, b: DataFrame, unit: str, value: str) -> DataFrame:
    """unit, difference: value of a minus that of b for the units both have."""
    return a.select(unit, F.col(value).alias("__a")).join(b.select(unit, F.col(value).alias("__b")), unit).select(unit, (F.col("__a") - F.col("__b")).alias("difference"))


def permutation_p(df: DataFrame, unit: str, value: str, positive: str, draws: int = 200, seed: int = 0) -> DataFrame:
    """observed, hits, p: two-sided permutation test of the difference of class means over units.

    A draw ranks the units by their hash and calls the first n_pos positive.
    """
    base = df.select(unit, F.col(value).alias("__v"), F.col(positive).cast("int").alias("__y")).filter("__v is not null and __y is not null")
    stat = lambda y: F.sum(y * F.col("__v")) / F.sum(y) - F.sum((1 - y) * F.col("__v")) / F.sum(1 - y)
    seen = base.agg(stat(F.col("__y")).alias("observed"), F.sum("__y").alias("__k"))
    many = base.withColumn("__b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("__u", hash_uniform(seed, F.col("__b"), F.col(unit)))
    ranked = numbered(many, ["__b"], ["__u", unit], "__r").withColumn("__r", F.col("__r") + 1).crossJoin(F.broadcast(seen))  # seen is one row
    null = ranked.groupBy("__b").agg(stat((F.col("__r") <= F.col("__k")).cast("int")).alias("__s"), F.first("observed").alias("observed"))
    return null.agg(F.first("observed").alias("observed"), F.sum((F.abs("__s") >= F.abs("observed") - 1e-12).cast("bigint")).alias("hits")).withColumn("p", (F.col("hits") + 1) / (draws + 1))


def holm(df: DataFrame, p: str, tie: str, alpha: float = 0.05) -> DataFrame:
    """df with the Holm-adjusted p and whether it is rejected; a test table is small by nature."""
    w = Window.partitionBy(F.lit(0)).orderBy(p, tie)
    scaled = df.withColumn("__s", F.least(F.lit(1.0), F.col(p) * (F.count("*").over(Window.partitionBy(F.lit(0))) - F.row_number().over(w) + 1)))
    return scaled.withColumn("p_holm", F.max("__s").over(w)).withColumn("rejected", F.col("p_holm") <= alpha).drop("__s")


def spearman(df: DataFrame, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, n, rho: correlation of tie-averaged ranks."""
    rows = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).alias("__a"), F.col(b).alias("__b"))
    for c in ("__a", "__b"):
        # the rank of a value follows from the counts of the distinct values up to it
        counts = prefix_sums(rows.groupBy(*keys, c).agg(F.count("*").alias("__n")), keys, [c], {"__upto": F.col("__n")})
        ranks = counts.select(*keys, c, (F.col("__upto") - (F.col("__n") - 1) / 2).alias(f"__r{c}"))
        rows = lookup_join(rows, ranks, [*keys, c])
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("__r__a", "__r__b").alias("rho"))


def fuse_rankings(df: DataFrame, voter: str, item: str, score: str) -> DataFrame:
    """item, best, total, place: items by their best rank over the voters, then by the sum of ranks; a voter that lacks an item ranks it last. Voters are few."""
    ordered = df.select(F.col(voter).alias("__voter"), F.col(item).alias("item"), F.col(score).isNull().alias("__none"), (-F.col(score)).alias("__score"))
    ranks = numbered(ordered, ["__voter"], ["__none", "__score", "item"], "__r")
    last = df.groupBy(F.col(voter).alias("__voter")).agg(F.count("*").alias("__n"))
    # what a voter that lacks the item gives: all such places, less those of the voters that have it
    every = last.agg(F.sum("__n").alias("__all"), F.sort_array(F.collect_list(F.struct("__n", "__voter"))).alias("__places"))
    had = lookup_join(ranks, last, ["__voter"]).groupBy("item").agg(F.min("__r").alias("__best"), F.sum(F.col("__r") - F.col("__n")).alias("__less"), F.collect_set("__voter").alias("__by"))
    full = had.crossJoin(F.broadcast(every))  # every is one row
    lacking = F.filter("__places", lambda p: ~F.array_contains("__by", p["__voter"]))
    fused = full.select(F.col("item").alias(item), F.least("__best", F.get(lacking, F.lit(0))["__n"]).cast("bigint").alias("best"), (F.col("__all") + F.col("__less")).cast("bigint").alias("total"))
    return numbered(fused, [], ["best", "total", item], "place").withColumn("place", (F.col("place") + 1).cast("int"))


def alarm_gap(df: DataFrame, score: str, positive: str, threshold: float) -> DataFrame:
    """hit_rate, false_rate, gap of the rule score >= threshold."""
    hit = (F.col(score) >= threshold).cast("double")
    r = df.agg(F.avg(F.when(F.col(positive), hit)).alias("hit_rate"), F.avg(F.when(~F.col(positive), hit)).alias("false_rate"))
    return r.withColumn("gap", F.col("hit_rate") - F.col("false_rate"))


def precision_at(df: DataFrame, score: str, positive: str, tie: str, k: int) -> DataFrame:
    top = df.orderBy(F.desc(score), tie).limit(k)
    return top.agg(F.count("*").alias("k"), F.avg(F.col(positive).cast("double")).alias("precision"))


# ------------------------------------------------------------- small exact tests
def sign_test(differences: Iterable[float], two_sided: bool = False) -> float:
    """Exact sign test of positive differences; zeros are left out."""
    d = [x for x in differences if x != 0]
    n, k = len(d), sum(x > 0 for x in d)
    tail = lambda m: sum(math.comb(n, i) for i in range(m, n + 1)) / 2**n
    return min(1.0, 2 * tail(max(k, n - k))) if two_sided else tail(k)


def wilcoxon(differences: Iterable[float]) -> float:
    """One-sided signed-rank test (positive differences): exact to 20 values, else by the normal approximation."""
    d = np.array([x for x in differences if x != 0])
    n = len(d)
    if not n:
        return 1.0
    r = pd.Series(np.abs(d)).rank().to_numpy()
    w = r[d > 0].sum()
    if n <= 20:
        sums = Counter({0.0: 1})
        for x in r:
            new = Counter(sums)
            for s, c in sums.items():
                new[s + x] += c
            sums = new
        return sum(c for s, c in sums.items() if s >= w - 1e-9) / 2**n
    z = (w - n * (n + 1) / 4 - 0.5) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return 0.5 * math.erfc(z / math.sqrt(2))


def fisher_exact(a: int, b: int, c: int, d: int) -> float:
    """One-sided p of a table at least as lopsided towards a and d."""
    n, row, col = a + b + c + d, a + b, a + c
    return sum(math.comb(row, k) * math.comb(n - row, col - k) for k in range(a, min(row, col) + 1) if 0 <= col - k <= n - row) / math.comb(n, col)


def kendall_tau(x: Sequence[float], y: Sequence[float] | None = None) -> float:
    x = np.asarray(x, float)
    y = np.arange(len(x)) if y is None else np.asarray(y, float)
    i, j = np.triu_indices(len(x), 1)
    s, t = np.sign(x[j] - x[i]), np.sign(y[j] - y[i])
    both = math.sqrt((s != 0).sum() * (t != 0).sum())
    return float((s * t).sum() / both) if both else 0.0


def jaccard_stability(selections: Sequence[set]) -> float:
    """Mean Jaccard similarity of all pairs of selections."""
    pairs = [(a, b) for i, a in enumerate(selections) for b in selections[i + 1 :]]
    return float(np.mean([len(a & b) / max(len(a | b), 1) for a, b in pairs])) if pairs else 1.0


class SmallestP(NamedTuple):
    by_draws: float
    by_design: float
    expected: float


def smallest_p(labels: Sequence, draws: int) -> SmallestP:
    """The least p that a permutation of these group labels can report: for so many draws, for the design, and on average.

    A random order of the labels gives the observed partition, up to the names of the labels, with the
    chance k! n1! ... nk! / n!, and then cannot fall behind what was observed.
    """
    counts = list(Counter(labels).values())
    log = math.lgamma(len(counts) + 1) + sum(math.lgamma(c + 1) for c in counts) - math.lgamma(sum(counts) + 1)
    again = math.exp(min(log, 0.0))
    return SmallestP(1 / (1 + draws), again, (1 + again * draws) / (1 + draws))


def transfer_rate(domains: DataFrame, name: str, direction: str) -> DataFrame:
    """pairs, hits, rate: over ordered pairs of domains with a decided direction, how often both have the same.

    Counted from the number of domains per direction, without forming the pairs.
    """
    c = domains.filter(F.col(direction).isNotNull()).select(name, direction).distinct().groupBy(direction).count()
    t = c.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("count") * (F.col("count") - 1)), F.lit(0)).alias("hits"))
    pairs = F.col("n") * (F.col("n") - 1)
    return t.select(pairs.alias("pairs"), "hits", F.try_divide(F.col("hits"), pairs).alias("rate"))


def predicted_auc(r: float | Column) -> float | Column:
    """The AUC that a standardised distance predicts; of a number or a column."""
    return F.atan(r) * (2 / math.pi) if isinstance(r, Column) else 2 / math.pi * math.atan(r)


def fan_out(spark, tasks: Sequence[int], run: Callable[[int], float], schema: str = "task bigint, value double") -> DataFrame:
    """One Spark task per fold, permutation or configuration; what run needs travels in its closure (keep it small)."""
    def go(batches):
        for b in batches:
            yield pd.DataFrame({"task": b["id"], "value": [float(run(int(t))) for t in b["id"]]})

    ids = spark.createDataFrame([(int(t),) for t in tasks], "id bigint").repartition(max(1, min(len(tasks), 256)))
    return ids.mapInPandas(go, schema)
