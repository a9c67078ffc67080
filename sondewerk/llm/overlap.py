"""Same or almost the same windows across splits: minwise-hashed shingles, banded buckets, exact check; windows with gaps are scanned."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from sondewerk.util import materialize, skew_join

#: Samples of a window, shingles of a window, rows of a band, bands, least correlation of a pair.
LENGTH, SHINGLES, ROWS, BANDS, CORRELATION = 64, 256, 12, 40, 0.97
SEED = 20_240_607
#: Windows of a side in a block of the scan of windows with gaps; of them so many at a time against the other block.
SCAN_BLOCK, SCAN_ROWS = 4_096, 128
TRAIN, HELD = ("fit",), ("eval", "replication")
#: Windows of the sample (picked by hash, about so many at most) from which large buckets are told, hits that tell one, and rows that make one large.
SAMPLE, SEEN, HOT_ROWS = 8_192, 8, 20_000


def _plan(length: int, shingles: int, hashes: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Contrasts whose signs are the shingles, and for each minwise hash a random order of all (contrast, sign)."""
    rng = np.random.default_rng(seed)
    contrasts = rng.standard_normal((length, shingles))
    contrasts -= contrasts.mean(axis=0)
    return contrasts, np.argsort(rng.random((hashes, 2 * shingles)), axis=1).astype(np.int32)


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """A list column whose lists all have the given length as doubles, nulls as NaN."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), length)


def minwise(x: np.ndarray, contrasts: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """windows x hashes: the first shingle of each window in the order of each hash.

    A window's shingles are the signs of its contrasts, so the Jaccard similarity of two windows is
    a/(2s-a) for a equal signs of s, and rises with their Pearson correlation. A constant window
    has no shingles and gets -1. Windows hold no gaps here: a filled gap would change the signs.
    """
    z = x - x.mean(axis=1, keepdims=True)
    z /= np.abs(z).max(axis=1, keepdims=True) + 1e-300
    sign = z @ contrasts > 0
    out = np.full((len(x), len(orders)), -1, np.int32)
    live = np.arange(len(x) * len(orders))
    flat = out.reshape(-1)
    h = len(orders)
    for d in range(orders.shape[1]):
        token = orders[live % h, d]
        hit = sign[live // h, token >> 1] == (token & 1)
        flat[live[hit]] = token[hit]
        live = live[~hit]
        if not len(live):
            break
    out[np.abs(z).max(axis=1) < 1e-12] = -1
    return out


def band_keys(x: np.ndarray, seed: int, rows: int, bands: int, shingles: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows that have shingles, their keys x bands): equal keys of two windows are equal rows of one band."""
    contrasts, orders = _plan(x.shape[1], shingles, rows * bands, seed)
    mix = np.random.default_rng(seed + 1).integers(1, 2**62, (bands, rows), dtype=np.int64) | 1
    sig = minwise(x, contrasts, orders).reshape(len(x), bands, rows)
    with np.errstate(over="ignore"):
        key = ((sig.astype(np.int64) + 1) * mix).sum(axis=2)
        key ^= (key >> 29) * np.int64(-7046029254386353131)
    ok = np.flatnonzero(sig[:, 0, 0] >= 0)
    return ok, key[ok]


def _signatures(length: int, seed: int, rows: int, bands: int, shingles: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4096):
                b = whole.slice(i, 4096)
                ok, key = band_keys(matrix(b.column(1), length), seed, rows, bands, shingles)
                yield pa.record_batch([b.column(0).take(pa.array(np.repeat(ok, bands))), pa.array(key.reshape(-1))], names=["rep", "key"])

    return run


def pearson(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson correlation row by row over the positions that both hold; 0 where there is none."""
    both = np.isfinite(x) & np.isfinite(y)
    n = np.maximum(both.sum(1, keepdims=True), 1)
    x, y = np.where(both, x, 0), np.where(both, y, 0)
    x, y = np.where(both, x - x.sum(1, keepdims=True) / n, 0), np.where(both, y - y.sum(1, keepdims=True) / n, 0)
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    return np.divide((x * y).sum(1), norm, out=np.zeros(len(norm)), where=(norm > 0) & (n[:, 0] > 1))


def _correlation(length: int, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = pearson(matrix(b.column(2), length), matrix(b.column(3), length))
            keep = pa.array(np.flatnonzero(r >= least))
            yield pa.record_batch([b.column(0).take(keep), b.column(1).take(keep), pa.array(r).take(keep)], names=["rep_train", "rep_held", "correlation"])

    return run


def alike(x: np.ndarray, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows of x, rows of y) of all pairs that may reach the correlation over the positions both hold.

    Sums over common positions are matrix products. Pairs whose variance is small against the sum of
    squares, where they lose digits, are given out, too, so ``pearson`` must check the pairs.
    """

    def parts(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        has = np.isfinite(v)
        v = np.where(has, v, np.nan)
        v = np.where(has, v - np.nanmedian(np.where(has.any(1)[:, None], v, 0.0), axis=1, keepdims=True), 0.0)
        return has.astype(np.float64), v, v * v

    (mx, vx, qx), (my, vy, qy) = parts(x), parts(y)
    n = np.maximum(mx @ my.T, 1)
    sx, sy, sxx, syy = vx @ my.T, mx @ vy.T, qx @ my.T, mx @ qy.T
    cx, cy = sxx - sx * sx / n, syy - sy * sy / n
    close = vx @ vy.T - sx * sy / n >= (least - 1e-6) * np.sqrt(np.maximum(cx, 0) * np.maximum(cy, 0))
    # for doubtful pairs, see above; where one side has no spread at all there is no correlation
    close |= (cx < 1e-8 * sxx) | (cy < 1e-8 * syy)
    return np.nonzero(close & (sxx > 0) & (syy > 0))


def _scan(length: int, least: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(few: pa.Table, many: pa.Table) -> pa.Table:
        few, many = few.combine_chunks(), many.combine_chunks()
        out = []
        if few.num_rows and many.num_rows:
            y, ids = matrix(many["x"].combine_chunks(), length), many["rep"].to_numpy()
            for i in range(0, few.num_rows, SCAN_ROWS):
                part = few.slice(i, SCAN_ROWS).combine_chunks()
                x, own, held = matrix(part["x"].combine_chunks(), length), part["rep"].to_numpy(), part["held"].to_numpy()
                a, b = alike(x, y, least)
                r = pearson(x[a], y[b])
                a, b, r = a[r >= least], b[r >= least], r[r >= least]
                out.append((np.where(held[a], ids[b], own[a]), np.where(held[a], own[a], ids[b]), r))
        names, types = ("rep_train", "rep_held", "correlation"), (pa.int64(), pa.int64(), pa.float64())
        return pa.table({c: pa.array(np.concatenate([o[k] for o in out]) if out else [], t) for k, (c, t) in enumerate(zip(names, types))})

    return run


def _gap_pairs(data: DataFrame, length: int, least: float) -> DataFrame | None:
    """(rep_train, rep_held, correlation) of every pair of which a window has a gap, or None without such windows.

    Each window with a gap meets every window of the other side, block by block: a task holds two
    blocks of about SCAN_BLOCK windows, and the comparisons are gaps times windows of the other side.
    """
    count = {r["held"]: (r["n"], r["gaps"]) for r in data.groupBy("held").agg(F.count("*").alias("n"), F.count_if("gap").alias("gaps")).collect()}
    (train, train_gaps), (held, held_gaps) = count.get(False, (0, 0)), count.get(True, (0, 0))
    if not train_gaps * held + held_gaps * train:
        return None
    blocks = lambda a, b: F.when(F.col("held"), -(-a // SCAN_BLOCK) or 1).otherwise(-(-b // SCAN_BLOCK) or 1)
    part = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    # held and side: the side of the window with the gap; two windows with gaps meet once, from the training side
    few = data.filter("gap").withColumn("side", F.col("held")).withColumn("i", part(blocks(held_gaps, train_gaps))).withColumn("j", every(blocks(train, held)))
    many = data.filter("held or not gap").withColumn("side", ~F.col("held")).withColumn("j", part(blocks(held, train))).withColumn("i", every(blocks(train_gaps, held_gaps)))
    columns = ["side", "i", "j", "rep", "held", "x"]
    # written at once: Spark would prune the columns of the blocks where a later plan only counts
    return materialize(few.select(columns).groupBy("side", "i", "j").cogroup(many.select(columns).groupBy("side", "i", "j")).applyInArrow(_scan(length, least), "rep_train bigint, rep_held bigint, correlation double"))


def overlaps(windows: DataFrame, window_id: str = "window_id", split: str = "split", samples: str = "windows", length: int = LENGTH, least: float = CORRELATION, rows: int = ROWS, bands: int = BANDS, shingles: int = SHINGLES, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of the windows that stand in the training split and, exactly or almost, in a held one.

    pairs (rep_train, rep_held, correlation) are between representatives of exactly equal windows of
    one side, members (window_id, held, rep) has every window. Windows of any source are compared.
    Null ids, splits and windows and windows of another length are left out; null and NaN samples are
    left out position by position; constant windows correlate with nothing. An empty side gives no pair.

    Copies are collapsed first (map-side), so a group of copies costs one row; buckets that still
    are hot are cut into blocks. Of windows without gaps, a pair with a correlation of 0.97 is a
    candidate with probability 0.998, with 0.99 with 0.99999; a chance pair with 1e-4. Pairs of which
    a window has a gap (a null, NaN or infinite sample) are all compared, so none of them is missed.
    """
    side = F.when(F.col(split).isin(*TRAIN), False).when(F.col(split).isin(*HELD), True)
    base = windows.select(F.col(window_id).cast("bigint").alias("window_id"), side.alias("held"), F.transform(samples, lambda x: F.when(x.isNotNull() & ~F.isnan(x), x + F.lit(0.0).cast("float"))).alias("x"))
    base = base.filter(F.col("window_id").isNotNull() & F.col("held").isNotNull() & (F.size("x") == length))
    named = F.transform("x", lambda v: F.coalesce(v.cast("double"), F.lit(float("inf"))))
    keyed = base.withColumn("h1", F.xxhash64(named)).withColumn("h2", F.hash(named))
    reps = keyed.groupBy("held", "h1", "h2").agg(F.min("window_id").alias("rep"))
    members = skew_join(keyed.select("window_id", "held", "h1", "h2"), reps, ["held", "h1", "h2"]).select("window_id", "held", "rep")
    data = materialize(base.join(reps.select("held", F.col("rep").alias("window_id")), ["held", "window_id"], "left_semi").select(F.col("window_id").alias("rep"), "held", "x", F.exists("x", lambda v: v.isNull() | (F.abs(v) == float("inf"))).alias("gap")).dropDuplicates(["rep", "held"]))
    whole = data.filter("not gap")
    side_keys = lambda which, out: whole.filter(which).select("rep", "x").mapInArrow(_signatures(length, seed, rows, bands, shingles), "rep bigint, key bigint").withColumnRenamed("rep", out)
    # large buckets are told from a sample: they decide on blocks, not on results
    n = whole.filter("not held").count()
    part = -(-n // SAMPLE) or 1
    sample = whole.filter("not held").filter(F.pmod(F.xxhash64("rep"), F.lit(part)) == 0).select("x").toPandas()["x"]
    hot = []
    if n > HOT_ROWS and len(sample):
        buckets, seen = np.unique(band_keys(np.stack(sample.to_numpy()).astype(np.float64), seed, rows, bands, shingles)[1], return_counts=True)
        hot = [Row(key=int(b), count=int(c) * part) for b, c in zip(buckets, seen) if c >= SEEN and c * part > HOT_ROWS]
    candidates = skew_join(side_keys("not held", "rep_train"), side_keys("held", "rep_held"), ["key"], min_rows=HOT_ROWS, hot=hot).select("rep_train", "rep_held").repartition("rep_train").distinct()
    both = candidates.join(whole.filter("not held").select(F.col("rep").alias("rep_train"), F.col("x").alias("x_train")), "rep_train").join(whole.filter("held").select(F.col("rep").alias("rep_held"), F.col("x").alias("x_held")), "rep_held")
    pairs = both.select("rep_train", "rep_held", "x_train", "x_held").mapInArrow(_correlation(length, least), "rep_train bigint, rep_held bigint, correlation double")
    gaps = _gap_pairs(data, length, least)
    return pairs if gaps is None else pairs.unionByName(gaps), members


def overlap_pairs(windows: DataFrame, **how) -> DataFrame:
    """Every overlapping pair (window_train, window_held, correlation), copies expanded."""
    pairs, members = overlaps(windows, **how)
    train = members.filter("not held").select(F.col("window_id").alias("window_train"), F.col("rep").alias("rep_train"))
    held = members.filter("held").select(F.col("window_id").alias("window_held"), F.col("rep").alias("rep_held"))
    return pairs.join(train, "rep_train").join(held, "rep_held").select("window_train", "window_held", "correlation").distinct()


def overlap_report(windows: DataFrame, window_id: str = "window_id", split: str = "split", source: str = "bank", **how) -> DataFrame:
    """(split, source, windows, overlapping): per held split and source, how many windows stand in training, too."""
    pairs, members = overlaps(windows, window_id=window_id, split=split, **how)
    hit = members.filter("held").join(pairs.select(F.col("rep_held").alias("rep")).distinct(), "rep").select(F.col("window_id").alias(window_id)).distinct().withColumn("__hit", F.lit(1))
    held = windows.filter(F.col(split).isin(*HELD)).select(F.col(window_id).cast("bigint").alias(window_id), split, source)
    return held.join(hit, window_id, "left").groupBy(split, source).agg(F.count("*").alias("windows"), F.count("__hit").alias("overlapping"))
