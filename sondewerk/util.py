"""Shared plan helpers: materialisation, size-checked lookups, skew-proof joins, exact medians."""

from __future__ import annotations

import atexit
import sys
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: A side of a join is broadcast only up to this many (narrow) rows; beyond it the join shuffles.
BROADCAST_ROWS = 50_000
#: At most this many hot keys are cut when a join is salted; any other key holds under this part of all rows.
HOT_KEYS = 20_000

#: Paths only: modules travel to executors by value, sessions cannot.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``, in plain local mode a temporary one."""
    if d := spark.conf.get("spark.checkpoint.dir", None):
        return d
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not (d := getattr(spark, "_sondewerk_dir", None)):
        d = spark._sondewerk_dir = "file://" + tempfile.mkdtemp(prefix="sondewerk-")
    return d


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df once to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sondewerk-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sondewerk_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a materialised table that no later plan reads."""
    if path := getattr(df, "_sondewerk_path", None):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in _written if spark else ():
        try:
            _delete(spark, path)
        except Exception:  # the session is gone
            return


def worker_cache() -> dict:
    """Per-process store for things that are dear to build (tokenizers, automata)."""
    return sys.__dict__.setdefault("_sondewerk_cache", {})


def floor_div(x: Column, d: int) -> Column:
    """Exact integer floor division, also of negative numbers."""
    return _div(x - F.pmod(x, F.lit(d)), d)


def _div(x: Column, d: int) -> Column:
    return F.call_function("div", x, F.lit(d))


def lookup_join(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner", max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join rows to a table with one row per key.

    The table is materialised and counted. Up to max_rows rows it is broadcast. Beyond that it is a
    ``skew_join``, in which only the table's rows of hot keys are repeated.
    """
    table = materialize(table)
    if table.count() <= max_rows:
        return rows.join(F.broadcast(table), list(keys), how)
    return skew_join(rows, table, keys, how=how)


def hot_keys(df: DataFrame, keys: Sequence[str], min_rows: int) -> list:
    """The keys with more than min_rows rows: at most HOT_KEYS of them, the largest, with their counts."""
    many = df.groupBy(*keys).count().filter(F.col("count") > min_rows)
    return many.orderBy(F.desc("count")).limit(HOT_KEYS).collect()


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], min_rows: int = 20_000, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Equi-join whose hot left keys are cut into blocks of about min_rows rows.

    The right rows of a hot key are repeated once per block; all other keys join as usual. Neither
    side is ever broadcast: the size of what Python operators give out is not known to the planner. The
    list of hot keys (``hot``, if the caller has it) is bounded by HOT_KEYS, a key past that place holds under a HOT_KEYS-th of the rows.
    """
    hot = hot_keys(left, keys, min_rows) if hot is None else hot
    if not hot:
        return left.join(right.hint("merge"), list(keys), how)
    spark = left.sparkSession
    schema = left.select(*keys).schema.add("__blocks", IntegerType())
    blocks = F.broadcast(spark.createDataFrame([(*[r[k] for k in keys], -(-r["count"] // min_rows)) for r in hot], schema))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.coalesce("__blocks", F.lit(1))).cast("int")
    a = left.join(blocks, list(keys), "left").withColumn("__block", spread).drop("__blocks")
    b = right.join(blocks, list(keys), "left").withColumn("__block", F.explode(F.sequence(F.lit(0), F.coalesce("__blocks", F.lit(1)) - 1))).drop("__blocks")
    return a.join(b.hint("merge"), [*keys, "__block"], how).drop("__block")


def _middle(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, count) to one row per key, side (0 lower, 1 upper middle): value and rank within it."""
    w = Window.partitionBy(*keys)
    run = counts.withColumn("__upto", F.sum("count").over(w.orderBy(value))).withColumn("__n", F.sum("count").over(w))
    sides = run.withColumn("__side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("__rank", _div(F.col("__n") - 1 + F.col("__side"), 2) + 1)
    return sides.filter("__rank <= __upto and __rank > __upto - count").select(*keys, "__side", value, (F.col("__rank") - F.col("__upto") + F.col("count")).alias("__rank"))


def median_of_counts(counts: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median per key from (keys, value, count) with a bounded number of values per key."""
    return _middle(counts, keys, value).groupBy(*keys).agg(F.avg(value).alias(out))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median per key of positive finite numbers, with no task that holds a whole key.

    Radix selection on the logarithm: counts of coarse bins per key (combined map-side) give the
    bins of the two middle ranks, only their rows are counted in finer bins, and so on; the last
    step ranks the distinct values within one bin of a 2^-20th octave.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"), F.log2(value).alias("__log"))
    target = None
    for step in (2**6, 2**20, None):
        if target is not None:
            rows_k = rows.withColumn("__bin", F.floor(F.col("__log") * last)).join(target, [*keys, "__bin"])
        else:
            rows_k = rows.withColumn("__side", F.lit(-1)).withColumn("__want", F.lit(-1).cast("bigint"))
        cell = F.col("__v") if step is None else F.floor(F.col("__log") * step)
        counts = rows_k.groupBy(*keys, "__side", "__want", cell.alias("__cell")).count()
        if target is None:
            found = _middle(counts.drop("__side", "__want"), keys, "__cell")
        else:
            w = Window.partitionBy(*keys, "__side").orderBy("__cell")
            found = counts.withColumn("__upto", F.sum("count").over(w)).filter("__want <= __upto and __want > __upto - count").withColumn("__rank", F.col("__want") - F.col("__upto") + F.col("count"))
        target, last = found.select(*keys, "__side", F.col("__cell").alias("__bin"), F.col("__rank").alias("__want")), step
    return target.groupBy(*keys).agg(F.avg("__bin").alias(out))


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """df with running sums (inclusive) of the given expressions per keys in the given order, which must be total.

    No task holds a whole key: rows are range-partitioned by keys and order, summed within the
    partitions, and the totals of the partitions before are added, one row per key and partition.
    Null keys get null sums.
    """
    parts = materialize(df.withColumns({f"__v_{n}": e for n, e in sums.items()}).repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()))
    here = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy(*keys, "__part").agg(*[F.sum(f"__v_{n}").alias(f"__t_{n}") for n in sums])
    offsets = totals.select(*keys, "__part", *[F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in sums])
    local = parts.withColumns({n: F.sum(f"__v_{n}").over(here) for n in sums})
    both = lookup_join(local, offsets, [*keys, "__part"], "left")
    return both.withColumns({n: F.col(n) + F.col(f"__o_{n}") for n in sums}).drop("__part", *[f"{x}_{n}" for n in sums for x in ("__v", "__o")])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """df with the place of each row (from 0) per keys in a total order; see ``prefix_sums``."""
    return prefix_sums(df, keys, order, {out: F.lit(1).cast("bigint")}).withColumn(out, F.col(out) - 1)


def exact_quantile(df: DataFrame, keys: Sequence[str], value: str | Column, p: float, out: str) -> DataFrame:
    """keys, out: the exact quantile of a numeric column per key, interpolated between the ranks around; nulls and NaN are left out.

    Equal values are counted map-side; the distinct ones are range-sorted, so no task holds a key.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*keys, v.alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    runs = prefix_sums(rows.groupBy(*keys, "__v").count(), keys, ["__v"], {"__upto": F.col("count")})
    n = runs.groupBy(*keys).agg(F.max("__upto").alias("__n"))
    both = lookup_join(runs, n, keys).withColumn("__at", (F.col("__n") - 1) * F.lit(float(p)))
    low = F.floor("__at")
    here = lambda rank: F.max(F.when((rank < F.col("__upto")) & (rank >= F.col("__upto") - F.col("count")), F.col("__v")))
    ends = both.groupBy(*keys).agg(here(low).alias("__a"), here(F.least(low + 1, F.col("__n") - 1)).alias("__b"), F.max(F.col("__at") - low).alias("__f"))
    return ends.select(*keys, F.when(F.col("__f") > 0, F.col("__a") + F.col("__f") * (F.col("__b") - F.col("__a"))).otherwise(F.col("__a")).alias(out))
