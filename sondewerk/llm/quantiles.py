"""Percentiles with bounded rank error by deterministic buffer collapsing; sketches of parts can be merged.

A sketch holds sorted buffers of ``k`` values; a buffer of level l stands for ``arity**l`` values each.
Whenever a level has ``arity`` buffers they collapse into one of the next level: its values are those
at evenly spaced positions of the weighted merge. A collapse into weight w moves ranks by at most
w/2, so after n values the error is at most n * levels / (2 k) with levels = log_arity(n / k); the
sketch carries the sum of its own collapses as ``err``. Up to k * arity values it is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondewerk.util import lookup_join

#: Values per buffer and buffers per collapse.
K, ARITY = 4_096, 8
#: Tasks among which the partial sketches of one group are merged first.
FAN = 32
#: Values that a task which builds sketches holds before it hands them on (16 MB), whatever the number of groups.
HELD = 2_000_000


class Sketch:
    """Mergeable quantile sketch of one group."""

    def __init__(self, k: int = K, arity: int = ARITY):
        self.k, self.arity, self.n, self.err = k, arity, 0, 0.0
        self.raw: list[np.ndarray] = []
        self.held = 0
        self.levels: dict[int, list[np.ndarray]] = {}

    def add(self, values: np.ndarray) -> None:
        """Take in values of weight one."""
        self.n += len(values)
        self._take(values)

    def _take(self, values: np.ndarray) -> None:
        if len(values):
            self.raw.append(values)
            self.held += len(values)
        if self.held >= self.k:
            all_ = np.concatenate(self.raw)
            whole = len(all_) // self.k * self.k
            for i in range(0, whole, self.k):
                self._put(0, np.sort(all_[i : i + self.k]))
            self.raw, self.held = [all_[whole:]], len(all_) - whole

    def _put(self, level: int, buffer: np.ndarray) -> None:
        here = self.levels.setdefault(level, [])
        here.append(buffer)
        if len(here) == self.arity:
            merged = np.sort(np.concatenate(here))
            self.levels[level] = []
            weight = float(self.arity) ** (level + 1)
            self.err += weight / 2
            # the middle of each run of arity positions; of an even arity the upper and lower middle in turn
            at = (self.arity - (1 if len(self.levels.get(level + 1, [])) % 2 else 0)) // 2
            self._put(level + 1, merged[np.minimum(at, self.arity - 1) :: self.arity])

    def merge(self, level: int, values: np.ndarray) -> None:
        """Take in a buffer of another sketch (level -1: single values). ``n`` and ``err`` are the caller's to add."""
        if level < 0:
            self._take(values)
        else:
            self._put(level, values)

    def size(self) -> int:
        """Values held."""
        return self.held + sum(len(b) for buffers in self.levels.values() for b in buffers)

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        if self.held:
            yield -1, np.concatenate(self.raw)
        for level, buffers in self.levels.items():
            for b in buffers:
                yield level, b

    def bound(self) -> float:
        """How many ranks a quantile may be off: the collapses, and half of the heaviest value, as the rank may fall inside it."""
        top = max((level for level, b in self.levels.items() if b and level > 0), default=0)
        return self.err + (float(self.arity) ** top / 2 if top else 0.0)

    def quantiles(self, probs: Sequence[float]) -> np.ndarray:
        """For each p the value of rank ceil(p n), up to ``bound()`` ranks off."""
        if not self.n:
            return np.full(len(probs), np.nan)
        parts = list(self.parts())
        values = np.concatenate([v for _, v in parts])
        weights = np.concatenate([np.full(len(v), float(self.arity) ** max(level, 0)) for level, v in parts])
        order = np.argsort(values, kind="stable")
        rank = np.maximum(1, np.ceil(np.asarray(probs) * self.n - 1e-9))
        return values[order][np.minimum(np.searchsorted(np.cumsum(weights[order]), rank), len(values) - 1)]


def _emit(sketches: dict[str, Sketch]) -> pa.RecordBatch:
    names, level, values, n, err = [], [], [], [], []
    for name, s in sketches.items():
        first = True
        for lv, v in s.parts():
            names.append(name)
            level.append(lv)
            values.append(v)
            n.append(s.n if first else 0)
            err.append(s.err if first else 0.0)
            first = False
    size = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.record_batch([pa.array(names, pa.string()), pa.array(level, pa.int32()), pa.ListArray.from_arrays(pa.array(size), pa.array(flat, pa.float64())), pa.array(n, pa.int64()), pa.array(err, pa.float64())], names=["name", "level", "vals", "n", "err"])


_PART = "name string, level int, vals array<double>, n bigint, err double"


def _build(k: int, arity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: dict[str, Sketch] = {}
        fresh = 0
        for b in batches:
            if not b.num_rows:
                continue
            names, code = np.unique(b.column(0).to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            v = b.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            for name, part in zip(names, np.split(v[order], np.cumsum(np.bincount(code))[:-1])):
                have.setdefault(name, Sketch(k, arity)).add(part)
            fresh += len(v)
            if fresh >= HELD:  # what the sketches hold has grown by no more than this since it was counted
                if sum(s.size() for s in have.values()) > HELD:
                    yield _emit(have)
                    have = {}
                fresh = 0
        yield _emit(have)

    return run


def _by_name(batches: Iterator[pa.RecordBatch], k: int, arity: int) -> Iterator[tuple[str, Sketch]]:
    """The merged sketch of each name out of rows sorted by name; one is held at a time."""
    now, s = None, Sketch(k, arity)
    for b in batches:
        flat, size = b.column(2).flatten().to_numpy(zero_copy_only=False), b.column(2).value_lengths().to_numpy(zero_copy_only=False)
        end = np.cumsum(size)
        for name, level, a, z, n, err in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), end - size, end, b.column(3).to_pylist(), b.column(4).to_pylist()):
            if name != now:
                if now is not None:
                    yield now, s
                now, s = name, Sketch(k, arity)
            s.n += n
            s.err += err
            s.merge(level, flat[a:z])
    if now is not None:
        yield now, s


def _merge(k: int, arity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[str, Sketch] = {}
        held = 0
        for name, s in _by_name(batches, k, arity):
            done[name] = s
            held += s.size()
            if held >= HELD:
                yield _emit(done)
                done, held = {}, 0
        yield _emit(done)

    return run


def merge_sketches(parts: DataFrame, k: int = K, arity: int = ARITY, fan: int = FAN) -> DataFrame:
    """One sketch (several rows) per name out of any partial sketches of it: of partitions, days, tables.

    Merged as a tree: first in ``fan`` groups per name, then these; no task takes in more than a
    fan-th of the parts of a hot name.
    """
    return _first_merge(parts, k, arity, fan).repartition("name").sortWithinPartitions("name").mapInArrow(_merge(k, arity), _PART)


def _first_merge(parts: DataFrame, k: int, arity: int, fan: int) -> DataFrame:
    salted = parts.withColumn("__salt", F.pmod(F.xxhash64(F.spark_partition_id(), "level"), F.lit(fan)))
    return salted.repartition("name", "__salt").sortWithinPartitions("name").drop("__salt").mapInArrow(_merge(k, arity), _PART)


def sketch(df: DataFrame, name: str, value: str, k: int = K, arity: int = ARITY) -> DataFrame:
    """Partial sketches (name, level, vals, n, err) of df by partition: no shuffle. Null names, nulls and NaN don't count."""
    rows = df.filter(F.col(name).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return rows.select(F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("v")).mapInArrow(_build(k, arity), _PART)


def _read(k: int, arity: int, probs: Sequence[float]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values, n, err = [], [], [], []

        def out() -> pa.RecordBatch:
            m, f = len(probs), (lambda x, t: pa.array(np.repeat(np.array(x), len(probs)), t))
            flat = np.concatenate(values) if values else np.empty(0)
            return pa.record_batch([f(names, pa.string()), pa.array(np.tile(np.asarray(probs, np.float64), len(flat) // m)), pa.array(flat), f(n, pa.int64()), f(err, pa.float64())], names=["name", "p", "value", "n", "rank_error"])

        for name, s in _by_name(batches, k, arity):
            names.append(name)
            values.append(s.quantiles(probs))
            n.append(s.n)
            err.append(s.bound())
            if len(names) >= 4_096:
                yield out()
                names, values, n, err = [], [], [], []
        if names:
            yield out()

    return run


def percentiles(parts: DataFrame, probs: Sequence[float], k: int = K, arity: int = ARITY, fan: int = FAN) -> DataFrame:
    """(name, p, value, n, rank_error) of the merge of all parts of a name: value has a rank within rank_error of ceil(p n)."""
    rows = _first_merge(parts, k, arity, fan).repartition("name").sortWithinPartitions("name")
    return rows.mapInArrow(_read(k, arity, list(probs)), "name string, p double, value double, n bigint, rank_error double")


def rank_errors(df: DataFrame, name: str, value: str, found: DataFrame) -> DataFrame:
    """found with off: how far the ranks of each value among the rows of its name are from ceil(p n); 0 where one is it.

    The exact ranks are counts of smaller and of equal values, combined map-side.
    """
    rows = df.filter(F.col(name).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(name).cast("string").alias("name"), F.col(value).cast("double").alias("v"))
    lists = found.groupBy("name").agg(F.collect_list(F.struct("p", F.col("value").alias("x"))).alias("asked"))
    each = lookup_join(rows, lists, ["name"]).select("name", "v", F.explode("asked").alias("a"))
    ranks = each.groupBy("name", F.col("a.p").alias("p")).agg(F.count_if(F.col("v") < F.col("a.x")).alias("below"), F.count_if(F.col("v") <= F.col("a.x")).alias("upto"))
    want = F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n") - 1e-9))
    return found.join(ranks, ["name", "p"]).withColumn("off", F.greatest(F.col("below") + 1 - want, want - F.col("upto"), F.lit(0))).drop("below", "upto")
