"""Operators of a polled index (Kp): bins, onsets, quiet times, crossings, outages; digests and label predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondewerk.util import materialize, numbered


def digest(x: Column) -> Column:
    """sha256 of a numeric array's text, nulls in place; equal arrays have equal digests."""
    return F.sha2(F.to_json(F.struct(x.alias("x"))), 256)


def label_contains(label: Column, part: str) -> Column:
    """Whether the label contains part, whatever the case; an empty part takes every row, a null label none otherwise."""
    return F.lit(True) if not part else F.coalesce(F.lower(label).contains(part.lower()), F.lit(False))


def label_from_path(path: Column, rule: str = "prefix") -> Column:
    """Class from a file name: up to the first underscore (prefix), without extension (stem), or the folder (parent)."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    if rule == "stem":
        return stem
    return F.substring_index(stem, "_", 1) if rule == "prefix" else F.element_at(F.split(path, "/"), -2)


def kp_bins(polls: DataFrame) -> DataFrame:
    """(watcher, t, kp): the largest valid Kp (0..9) of each bin a watcher saw; null watchers and unreadable tags are left out."""
    rows = polls.select("watcher", F.expr("try_cast(latest.time_tag as timestamp_ntz)").alias("t"), F.col("latest.kp").alias("kp"))
    return rows.filter("watcher is not null and t is not null and kp between 0 and 9").groupBy("watcher", "t").agg(F.max("kp").alias("kp"))


def _w() -> Window:
    return Window.partitionBy("watcher").orderBy("t")


def onsets(bins: DataFrame, threshold: float = 5.0, calm: int = 8) -> DataFrame:
    """(watcher, onset, kp): bins at the threshold whose predecessor and last ``calm`` bins are below it."""
    w = bins.withColumn("p", F.lag("kp").over(_w())).withColumn("m", F.max("kp").over(_w().rowsBetween(-calm, -1)))
    return w.filter((F.col("kp") >= threshold) & (F.col("p") < threshold) & (F.col("m") < threshold)).select("watcher", F.col("t").alias("onset"), "kp")


def quiet_runs(bins: DataFrame, below: float = 3.0, least: int = 16) -> DataFrame:
    """(watcher, start, bins): runs of at least ``least`` bins under ``below``."""
    runs = bins.withColumn("r", F.sum((F.col("kp") >= below).cast("int")).over(_w().rowsBetween(Window.unboundedPreceding, 0)))
    return runs.filter(F.col("kp") < below).groupBy("watcher", "r").agg(F.min("t").alias("start"), F.count("*").alias("bins")).filter(F.col("bins") >= least).drop("r")


def quiet_days(bins: DataFrame, most: float = 1.0) -> DataFrame:
    """(watcher, day, kp_max): days with all eight bins, none above ``most``."""
    d = bins.groupBy("watcher", F.to_date("t").alias("day")).agg(F.count("*").alias("n"), F.max("kp").alias("kp_max"))
    return d.filter((F.col("n") == 8) & (F.col("kp_max") <= most)).drop("n")


def blackout_streaks(polls: DataFrame) -> DataFrame:
    """(poll_id, watcher, streak): failed polls in a row up to each poll, in log order; 0 after a success."""
    w = Window.partitionBy("watcher").orderBy("poll_id").rowsBetween(Window.unboundedPreceding, 0)
    bad = F.col("fetch_error").isNotNull().cast("bigint")
    p = polls.filter("watcher is not null").withColumn("__ok", F.sum(1 - bad).over(w))
    return p.select("poll_id", "watcher", F.sum(bad).over(Window.partitionBy("watcher", "__ok").orderBy("poll_id").rowsBetween(Window.unboundedPreceding, 0)).alias("streak"))


def crossings(polls: DataFrame) -> DataFrame:
    """(poll_id, watcher, kp): polls at or above the threshold whose last known Kp was below it."""
    w = Window.partitionBy("watcher").orderBy("poll_id").rowsBetween(Window.unboundedPreceding, -1)
    p = polls.filter("watcher is not null").withColumn("kp", F.col("latest.kp")).withColumn("prev", F.last("kp", ignorenulls=True).over(w))
    return p.filter((F.col("prev") < F.col("onset_kp_threshold")) & (F.col("kp") >= F.col("onset_kp_threshold"))).select("poll_id", "watcher", "kp")


def densest_span(events: DataFrame, time: str, n: int) -> DataFrame:
    """The shortest span that holds n events: its start and length (one row, or none)."""
    placed = materialize(numbered(events.select(F.col(time).alias("start"), F.monotonically_increasing_id().alias("__row")), [], ["start", "__row"], "i")).select("start", "i")
    ends = placed.select(F.col("start").alias("end"), (F.col("i") - (n - 1)).alias("i"))
    s = placed.join(ends, "i").select("start", (F.col("end") - F.col("start")).alias("span"))
    return s.orderBy("span", "start").limit(1)
