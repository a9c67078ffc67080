"""Messages delivered at least once: keep exactly one delivery of each.

A message is named by key columns and a device time that may jitter: deliveries with equal keys
whose times are at most ``tolerance`` apart are one message, farther apart they are different ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondewerk.util import floor_div

KEYS = ("node_id", "seq")
TOLERANCE_US = 2_000_000
#: Cells of one tolerance that make up a chunk: with 2 s, a day.
CELLS_PER_CHUNK = 43_200


def _usable(df: DataFrame, keys: Sequence[str], *more: str) -> DataFrame:
    cond = F.lit(True)
    for c in (*keys, *more):
        cond &= F.col(c).isNotNull()
    return df.filter(cond)


def messages(df: DataFrame, keys: Sequence[str] = KEYS, time: str = "ts_us", tolerance: int = TOLERANCE_US, aggs: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """One row per message: keys, ``first_us``, ``last_us``, ``deliveries`` and the wanted aggregates.

    aggs: name -> (min, max or sum, expression over df). Rows with a null key or time are left out.
    Deliveries are first combined map-side in cells of one tolerance, so a group of copies never
    meets in one task; cells are chained within (keys, day), and only chains that touch the edge
    of a day are looked at again across days. A key with a third of all rows is cut by its days.
    """
    aggs = aggs or {}
    comb = {"min": F.min, "max": F.max, "sum": F.sum}
    k = [f"__k{i}" for i in range(len(keys))]
    rows = _usable(df, keys, time).select(*[F.col(c).alias(a) for c, a in zip(keys, k)], F.col(time).cast("bigint").alias("__t"), *[e.alias(f"__a_{n}") for n, (_, e) in aggs.items()])
    rows = rows.withColumn("__cell", floor_div(F.col("__t"), tolerance)).withColumn("__chunk", floor_div(F.col("__cell"), CELLS_PER_CHUNK))
    again = [comb[how](f"__a_{n}").alias(f"__a_{n}") for n, (how, _) in aggs.items()]
    cells = rows.groupBy(*k, "__chunk", "__cell").agg(F.min("__t").alias("__lo"), F.max("__t").alias("__hi"), F.count("*").alias("__n"), *again)

    def chain(part: DataFrame, by: list[str]) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("__lo")
        fresh = F.coalesce((F.col("__lo") - F.lag("__hi").over(w)) > tolerance, F.lit(True)).cast("int")
        runs = part.withColumn("__fresh", fresh).withColumn("__run", F.sum("__fresh").over(w))
        return runs.groupBy(*by, "__run").agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"), F.sum("__n").alias("__n"), *again)

    local = chain(cells, [*k, "__chunk"])
    day = CELLS_PER_CHUNK * tolerance
    edge = (F.col("__lo") - F.col("__chunk") * day <= tolerance) | ((F.col("__chunk") + 1) * day - F.col("__hi") <= tolerance)
    whole = local.filter(~edge).drop("__chunk", "__run").unionByName(chain(local.filter(edge), k).drop("__run"))
    return whole.select(*[F.col(a).alias(c) for c, a in zip(keys, k)], F.col("__lo").alias("first_us"), F.col("__hi").alias("last_us"), F.col("__n").alias("deliveries"), *[F.col(f"__a_{n}").alias(n) for n in aggs])


def kept(df: DataFrame, row_id: str = "delivery_id", arrival: str = "received_at", **how) -> DataFrame:
    """The messages with ``kept_id``: the delivery that arrived first, among equals the smallest id.

    A null arrival counts as later than any other.
    """
    first = F.struct(F.col(arrival).isNull().alias("late"), F.col(arrival).alias("at"), F.col(row_id).alias("id"))
    return messages(df, aggs={"__first": ("min", first)}, **how).withColumn("kept_id", F.col("__first.id")).drop("__first")


def redelivered(df: DataFrame, row_id: str = "delivery_id", keys: Sequence[str] = KEYS, time: str = "ts_us", **how) -> DataFrame:
    """The ids of every delivery but the kept one of its message.

    Rows with a null id, key or time name no message and are never among them. An empty table gives none.
    """
    ids = _usable(df, keys, time, row_id).select(row_id)
    keepers = kept(_usable(df, (row_id,)), row_id=row_id, keys=keys, time=time, **how).select(F.col("kept_id").alias(row_id))
    return ids.join(keepers, row_id, "left_anti").distinct()


def deduplicate(df: DataFrame, row_id: str = "delivery_id", **how) -> DataFrame:
    """df without its redelivered rows; rows that name no message stay as they are."""
    return df.join(redelivered(df, row_id=row_id, **how), row_id, "left_anti")


def admit(batch: DataFrame, stored: DataFrame, row_id: str = "delivery_id", keys: Sequence[str] = KEYS, time: str = "ts_us", tolerance: int = TOLERANCE_US, **how) -> DataFrame:
    """The rows of a new batch that open a message not yet stored, one per message.

    stored: keys, first_us and last_us of the messages so far (``messages`` or ``kept``). A message of
    the batch belongs to a stored one if their spans come within the tolerance of each other,
    whichever of its deliveries does. Rows that name no message pass. Both sides are cut in cells of
    four tolerances, so the join is an equi-join on keys and cell.
    """
    new = kept(_usable(batch, (row_id,)), row_id=row_id, keys=keys, time=time, tolerance=tolerance, **how)
    cell = 4 * tolerance

    def cells(df: DataFrame, wider: int) -> DataFrame:
        lo, hi = floor_div(F.col("first_us") - wider, cell), floor_div(F.col("last_us") + wider, cell)
        return df.withColumn("__cell", F.explode(F.sequence(lo, hi)))

    old = cells(stored.select(*keys, "first_us", "last_us"), tolerance).select(*keys, "__cell", (F.col("first_us") - tolerance).alias("__from"), (F.col("last_us") + tolerance).alias("__to"))
    met = cells(new.select(*keys, "first_us", "last_us", "kept_id"), 0).join(old, [*keys, "__cell"]).filter((F.col("first_us") <= F.col("__to")) & (F.col("last_us") >= F.col("__from"))).select("kept_id")
    opened = new.select("kept_id").join(met, "kept_id", "left_anti").select(F.col("kept_id").alias(row_id))
    names = F.lit(True)
    for c in (*keys, time, row_id):
        names &= F.col(c).isNotNull()
    return batch.filter(names).join(opened, row_id, "left_semi").dropDuplicates([row_id]).unionByName(batch.filter(~names))
