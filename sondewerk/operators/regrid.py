"""Irregular readings onto a regular grid: one row per period of each source, gaps marked.

Missing periods are marked and keep a null value; beside it stands an estimate by iterative
singular-spectrum imputation, which never overwrites a reading.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondewerk.util import floor_div, lookup_join

#: Periods in a chunk and periods of its neighbours that the imputation of a chunk looks at on either side.
CHUNK, HALO = 256, 64
#: Embedding window, rank, and change (in spreads) below which the imputation has converged.
WINDOW, RANK, TOLERANCE = 24, 4, 1e-3
#: Steps that the acceleration of the iteration looks back on, and the step in which spans of readings are cut.
MEMORY, SPAN = 5, 128
#: Steps after which a series keeps its singular vectors.
FREEZE = 100
#: Iterations after which a series counts as one that does not converge; its estimates are null.
ITERATIONS = 2_000


def _projected(z: np.ndarray, window: int, rank: int, weight: np.ndarray, u: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each row's Hankel trajectory projected onto its leading singular vectors (or those given), averaged along the anti-diagonals; and the vectors."""
    cols = z.shape[1] - window + 1
    h = np.lib.stride_tricks.sliding_window_view(z, cols, axis=1)
    if u is None:
        u = np.linalg.eigh(h @ h.transpose(0, 2, 1))[1][:, :, -rank:]
    low = u @ (u.transpose(0, 2, 1) @ h)
    back = np.zeros_like(z)
    for i in range(window):
        back[:, i : i + cols] += low[:, i]
    return back / weight, u


def ssa_impute(x: np.ndarray, window: int = WINDOW, rank: int = RANK, iterations: int = ITERATIONS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Fill the NaN of each row of x (series x time), from its first to its last reading and a little beyond.

    The Hankel trajectory of a series is projected onto its leading singular vectors and averaged
    along the anti-diagonals; the missing entries take these values, until they move by less than
    tolerance times the spread. Steps are combined over the last few, which converges much sooner, and
    after FREEZE of them a series keeps its singular vectors, as they may change places without end.
    Rows with fewer than two windows of readings stay as they are, and so do rows that have not
    converged after so many iterations.
    """
    x = np.array(x, dtype=np.float64)
    known = np.isfinite(x)
    n = x.shape[1]
    # rows are cut to the span of their readings, in whole steps, and rows of one span go together
    first, last = known.argmax(1) // SPAN * SPAN, np.minimum(-(-(n - known[:, ::-1].argmax(1)) // SPAN) * SPAN, n)
    todo = (known.sum(1) >= min(2 * window, n)) & ~known.all(1) & (last - first > window)
    for lo, hi in np.unique(np.stack([first, last], 1)[todo], axis=0):
        rows = np.flatnonzero(todo & (first == lo) & (last == hi))
        x[rows, lo:hi] = _impute(x[rows, lo:hi], window, rank, iterations, tolerance)
    return x


def _impute(x: np.ndarray, window: int, rank: int, iterations: int, tolerance: float) -> np.ndarray:
    k = np.isfinite(x)
    count = k.sum(1)
    mean = np.where(k, x, 0).sum(1) / count
    spread = np.sqrt(np.where(k, (x - mean[:, None]) ** 2, 0).sum(1) / count) + 1e-12
    z = np.where(k, (x - mean[:, None]) / spread[:, None], 0.0)
    weight = np.convolve(np.ones(window), np.ones(x.shape[1] - window + 1))
    live = np.arange(len(x))
    steps: list[np.ndarray] = []
    ends: list[np.ndarray] = []
    least = np.full(len(x), np.inf)
    u = None
    for i in range(iterations):
        back, vectors = _projected(z[live], window, rank, weight, u)
        u = vectors if i >= FREEZE else None
        end = np.where(k[live], z[live], back)
        step = end - z[live]
        open_ = np.abs(step).max(axis=1) > tolerance
        # a series that moves more than twice as much as it did already forgets its last steps
        size = np.linalg.norm(step, axis=1)
        astray = (size > 2 * least[live])[:, None]
        least[live] = np.minimum(least[live], size)
        steps, ends = [*[np.where(astray, step, v) for v in steps], step][-MEMORY - 1 :], [*[np.where(astray, end, v) for v in ends], end][-MEMORY - 1 :]
        new = end
        if len(steps) > 1:
            # Anderson acceleration: the combination of the last steps that is nearest to standing still
            ds, de = np.diff(np.stack(steps, 1), axis=1), np.diff(np.stack(ends, 1), axis=1)
            a = ds @ ds.transpose(0, 2, 1)
            a += np.eye(a.shape[1]) * (1e-10 * np.trace(a, axis1=1, axis2=2)[:, None, None] + 1e-30)
            new = end - (de.transpose(0, 2, 1) @ np.linalg.solve(a, ds @ step[:, :, None]))[:, :, 0]
        z[live] = np.where(open_[:, None], new, end)
        u = None if u is None else u[open_]
        live, steps, ends = live[open_], [v[open_] for v in steps], [v[open_] for v in ends]
        if not len(live):
            break
    out = np.where(k, x, z * spread[:, None] + mean[:, None])
    out[live] = x[live]
    return out


_OUT = "src string, period bigint, readings bigint, value double, missing boolean, estimate double"


def _fill(only_missing: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    width = CHUNK + 2 * HALO

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                c = b.slice(i, 512)
                src, chunk, first, last, cells = (c.column(j) for j in range(5))
                m = c.num_rows
                start = chunk.to_numpy(zero_copy_only=False) * CHUNK
                n, s = np.zeros((m, width), np.int64), np.full((m, width), np.nan)
                size = cells.fill_null([]).value_lengths().to_numpy(zero_copy_only=False) if cells.null_count else cells.value_lengths().to_numpy(zero_copy_only=False)
                flat = cells.flatten()
                row = np.repeat(np.arange(m), size)
                pos = flat.field("pos").to_numpy(zero_copy_only=False) + HALO
                n[row, pos] = flat.field("n").to_numpy(zero_copy_only=False)
                s[row, pos] = flat.field("value").to_numpy(zero_copy_only=False).astype(np.float64)
                own = slice(HALO, HALO + CHUNK)
                period = start[:, None] + np.arange(CHUNK)
                inside = (period >= first.to_numpy(zero_copy_only=False)[:, None]) & (period <= last.to_numpy(zero_copy_only=False)[:, None])
                gone = inside & (n[:, own] == 0)
                est = s.copy()
                if gone.any():
                    gappy = gone.any(axis=1)
                    est[gappy] = ssa_impute(s[gappy])
                n, s, est = n[:, own], s[:, own], est[:, own]
                r, p = np.nonzero(gone if only_missing else inside)
                lost = n[r, p] == 0
                yield pa.record_batch(
                    [src.take(pa.array(r)), pa.array(period[r, p]), pa.array(n[r, p]), pa.array(s[r, p], from_pandas=True), pa.array(lost), pa.array(np.where(lost, est[r, p], np.nan), from_pandas=True)],
                    names=["src", "period", "readings", "value", "missing", "estimate"],
                )

    return run


def regular_series(readings: DataFrame, src: str, time_us: str, length_us: Column | str, value: str, only_missing: bool = False) -> DataFrame:
    """(src, period_us, readings, value, missing, estimate): one row per period between a source's first and last reading.

    Periods start at multiples of their length since 1970. value: mean of the readings of the
    period, null in a period without any (missing) or with null values only. estimate: the imputed value of a
    missing period, null where fewer than two windows of readings stand in its chunk and HALO periods around or it lies outside their span, or
    where the imputation does not converge. Rows with null source, time or
    length are no readings; a source with one reading has one period; an empty table gives none.

    Readings are combined per period map-side, then gathered in chunks of CHUNK periods, so a hot
    source is cut by time; chunks wholly inside a gap are generated, never joined against all rows.
    """
    length = F.col(length_us) if isinstance(length_us, str) else length_us
    rows = readings.select(F.col(src).cast("string").alias("src"), F.col(time_us).cast("bigint").alias("t"), length.cast("bigint").alias("len"), F.col(value).cast("double").alias("v"))
    rows = rows.filter("src is not null and t is not null and len > 0")
    period = F.call_function("div", F.col("t") - F.pmod("t", "len"), F.col("len"))
    cells = rows.groupBy("src", "len", period.alias("period")).agg(F.count("*").alias("n"), F.avg("v").alias("value"))
    chunk = floor_div(F.col("period"), CHUNK)
    # a reading near a border goes to the neighbouring chunk, too
    place = F.col("period") - chunk * CHUNK
    homes = F.array_compact(F.array(chunk, F.when(place < HALO, chunk - 1), F.when(place >= CHUNK - HALO, chunk + 1)))
    spread = cells.withColumn("chunk", F.explode(homes))
    parts = spread.groupBy("src", "len", "chunk").agg(F.collect_list(F.struct((F.col("period") - F.col("chunk") * CHUNK).cast("int").alias("pos"), "n", "value")).alias("cells"))
    ends = cells.groupBy("src", "len").agg(F.min("period").alias("first"), F.max("period").alias("last"))
    grid = ends.withColumn("chunk", F.explode(F.sequence(floor_div(F.col("first"), CHUNK), floor_div(F.col("last"), CHUNK))))
    whole = grid.join(parts.select("src", "len", "chunk", "cells"), ["src", "len", "chunk"], "left")
    named = whole.select(F.concat_ws(",", "src", F.col("len").cast("string")).alias("src"), "chunk", "first", "last", "cells")
    out = named.mapInArrow(_fill(only_missing), _OUT)
    return out.select(F.expr("left(src, length(src) - length(substring_index(src, ',', -1)) - 1)").alias("src"), (F.col("period") * F.substring_index("src", ",", -1).cast("bigint")).alias("period_us"), "readings", "value", "missing", "estimate")


def frame_series(frames: DataFrame, nodes: DataFrame, only_missing: bool = False, since_us: int = 1_577_836_800_000_000) -> DataFrame:
    """The mean payload level of each node on its reporting grid (nodes.grid_s).

    Every delivery with a node and a clock set (from since_us on) is a reading, also one without payload.
    """
    level = F.when(F.size("payload") > 0, F.aggregate("payload", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))) / F.size("payload"))
    rows = frames.filter(F.col("node_id").isNotNull() & (F.col("ts_us") >= since_us)).select("node_id", "ts_us", level.alias("level"))
    grid = nodes.filter("node_id is not null").groupBy("node_id").agg((F.max("grid_s").cast("bigint") * 1_000_000).alias("len"))
    return regular_series(lookup_join(rows, grid, ["node_id"]), "node_id", "ts_us", "len", "level", only_missing)


def poll_series(polls: DataFrame, only_missing: bool = False) -> DataFrame:
    """Kp as each watcher saw it, hourly by the time of the poll (utc in any ISO 8601 form)."""
    utc = F.expr("coalesce(try_cast(utc as timestamp), try_to_timestamp(utc, \"yyyyMMdd'T'HHmmssX\"))")
    rows = polls.filter("utc is not null and latest is not null").select("watcher", F.unix_micros(utc).alias("t"), F.col("latest.kp").alias("kp"), F.lit(3_600_000_000).alias("len"))
    return regular_series(rows, "watcher", "t", "len", "kp", only_missing)
