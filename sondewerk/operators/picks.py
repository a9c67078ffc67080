"""Choosing and labelling stretches of series: finite runs, even picks, life stages, ratios to the first, episode plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondewerk.util import lookup_join, numbered, prefix_sums

#: Rows of a key in a chunk of a rolling window.
CHUNK = 10_000


def finite_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, least: int = 1) -> DataFrame:
    """keys, start (place of its first row, from 0), length: unbroken runs of finite values of at least ``least`` rows; order must be total."""
    v = F.col(value).cast("double")
    bad = (v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).cast("bigint")
    rows = prefix_sums(df.select(*keys, *order, bad.alias("__bad")), keys, order, {"__upto": F.lit(1).cast("bigint"), "__run": F.col("__bad")})
    return rows.filter("__bad = 0").groupBy(*keys, "__run").agg((F.min("__upto") - 1).alias("start"), F.count("*").alias("length")).filter(F.col("length") >= least).drop("__run")


def first_finite_run(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, least: int) -> DataFrame:
    """The first run of at least ``least`` finite values per key."""
    return finite_runs(df, keys, order, value, least).groupBy(*keys).agg(F.min(F.struct("start", "length")).alias("__s")).select(*keys, "__s.start", "__s.length")


def _places(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """df with the place of each row in its key (order must be total) and the number of rows of the key."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    return lookup_join(numbered(df, keys, order, "__i"), counts, keys)


def even_picks(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """k rows per key at even distances, the first and the last among them; all rows of a key with fewer."""
    i, n = F.col("__i"), F.col("__n")
    # row i is a pick if some j of 0..k-1 has floor(j (n-1) / (k-1)) = i
    j = F.ceil(i * (k - 1) / F.greatest(n - 1, F.lit(1)))
    hit = (j <= k - 1) & (F.floor(j * (n - 1) / max(k - 1, 1)) == i)
    return _places(df, keys, order).filter((n <= k) | hit).drop("__i", "__n")


def life_stage(df: DataFrame, keys: Sequence[str], order: Sequence[str], stages: int = 3, out: str = "stage") -> DataFrame:
    """df with the stage 0..stages-1 of each row's place: stages of n div stages rows, the last takes the rest."""
    size = F.greatest(F.call_function("div", F.col("__n"), F.lit(stages)), F.lit(1))
    return _places(df, keys, order).withColumn(out, F.least(F.call_function("div", F.col("__i"), size), F.lit(stages - 1)).cast("int")).drop("__i", "__n")


def relative_to_first(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "ratio") -> DataFrame:
    """df with value over the first value of its key; null where that is null or 0."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, F.col(value).alias("__first"))).alias("__s")).select(*keys, "__s.__first")
    return lookup_join(df, first, keys).withColumn(out, F.try_divide(F.col(value), F.col("__first"))).drop("__first")


def quantile_labels(df: DataFrame, value: str, cuts: Sequence[float] = (1 / 3, 2 / 3), out: str = "label") -> DataFrame:
    """df with the class 0..len(cuts) of each value by the quantiles of all; nulls and NaN are dropped."""
    good = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    q = quantiles(good, value, cuts)
    return good.withColumn(out, sum(((F.col(value) > x).cast("int") for x in q), F.lit(0)))


def quantiles(df: DataFrame, value: str, cuts: Sequence[float]) -> list[float]:
    """Exact quantiles of all values (not null, not NaN), interpolated between the ranks around; empty without any.

    Distinct values are counted map-side and range-sorted; two values per cut reach the driver.
    """
    counts = prefix_sums(df.groupBy(F.col(value).cast("double").alias("v")).count(), [], ["v"], {"upto": F.col("count")})
    n = counts.agg(F.max("upto")).first()[0]
    if not n:
        return []
    at = [c * (n - 1) for c in cuts]
    wanted = sorted({int(x) for x in at} | {min(int(x) + 1, n - 1) for x in at})
    rank = F.explode(F.filter(F.array(*[F.lit(r) for r in wanted]), lambda r: (r < F.col("upto")) & (r >= F.col("upto") - F.col("count"))))
    have = {r["r"]: r["v"] for r in counts.select("v", rank.alias("r")).collect()}
    return [have[int(x)] + (x - int(x)) * (have[min(int(x) + 1, n - 1)] - have[int(x)]) if x > int(x) else have[int(x)] for x in at]


def episode_plan(episodes: DataFrame, keys: Sequence[str], time: str, hours: Sequence[int], least_gap_hours: int = 0) -> DataFrame:
    """keys, episode, offset_h, at: points at offsets (hours, mostly negative) from each episode.

    A point is planned only if it lies at least ``least_gap_hours`` after the episode before.
    """
    before = F.lag(time).over(Window.partitionBy(*keys).orderBy(time))
    grid = episodes.withColumn("__before", before).withColumn("offset_h", F.explode(F.array(*[F.lit(h) for h in hours])))
    at = (F.unix_seconds(F.col(time).cast("timestamp")) + F.col("offset_h") * 3600).alias("at")
    free = F.col("__before").isNull() | (F.unix_seconds(F.col(time).cast("timestamp")) + F.col("offset_h") * 3600 >= F.unix_seconds(F.col("__before").cast("timestamp")) + least_gap_hours * 3600)
    return grid.filter(free).select(*keys, F.unix_seconds(F.col(time).cast("timestamp")).alias("episode"), "offset_h", at)


def peak_window(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, length: int) -> DataFrame:
    """keys, start, spread: where the rolling population deviation over ``length`` rows is largest (the first among equals)."""
    placed = numbered(df.select(*keys, *order, F.col(value).alias("__v")), keys, order, "__i")
    # a chunk begins with the rows that its first spans reach back to
    chunk = F.call_function("div", F.col("__i"), F.lit(CHUNK))
    homes = F.array_compact(F.array(chunk, F.when(F.col("__i") % CHUNK > CHUNK - length, chunk + 1)))
    rows = placed.withColumn("__c", F.explode(homes))
    span = Window.partitionBy(*keys, "__c").orderBy("__i").rowsBetween(-length + 1, 0)
    s = rows.select(*keys, (F.col("__i") - length + 1).alias("start"), F.stddev_pop("__v").over(span).alias("spread"), (F.col("__i") >= F.col("__c") * CHUNK).alias("__own")).filter("__own and start >= 0 and spread is not null")
    return s.groupBy(*keys).agg(F.max(F.struct(F.round("spread", 9).alias("spread"), (-F.col("start")).alias("__m"))).alias("__b")).select(*keys, (-F.col("__b.__m")).cast("bigint").alias("start"), F.col("__b.spread").alias("spread"))


def exact_duplicates(df: DataFrame, group: str, value: Column) -> DataFrame:
    """digest, groups, rows: values that occur in more than one group."""
    d = df.select(F.col(group).alias("__g"), value.alias("digest"))
    return d.groupBy("digest").agg(F.count_distinct("__g").alias("groups"), F.count("*").alias("rows")).filter("groups > 1")
