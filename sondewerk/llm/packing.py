"""Texts of varying length into containers of fixed capacity: bulk-synchronous best-fit.

In every round the open gaps and the unplaced items are sorted by size and matched in one
successor sweep (largest item first, each to the smallest gap that takes it, one item a gap); ties
are resolved by rank; the gaps shrink, and the next round follows. When no item fits, new
containers are opened for the largest items. Sizes are whole tokens up to the capacity, so the
sorted items and gaps are runs of equal size: a sweep moves whole runs, its state is bounded by
the capacity and the rounds, not by the number of documents. Sweeps run side by side in shards of
the documents; ranks of the documents within shard and size carry the matching to every single one.
"""

from __future__ import annotations

import base64
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondewerk.util import lookup_join, materialize, numbered, prefix_sums, worker_cache

CAPACITY = 2_048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Split pattern of the vocabulary's tokenizer (a fixed value of the published vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Items that are swept together.
SHARD_ITEMS = 250_000


def _encoder(path: str):
    cache = worker_cache()
    if ("bpe", path) not in cache:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        cache["bpe", path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return cache["bpe", path]


def _sizes(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([len(encode(t)) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "tokens"])

    return run


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, tokens) of every text; null ids are left out, a null text has none."""
    rows = documents.filter(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(_sizes(vocabulary), "doc_id bigint, tokens bigint")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit on runs: (size, from_rank, to_rank, first container, step) for all items of the histogram.

    The item of rank r in [from_rank, to_rank) of its size goes to container first + (r - from_rank) * step.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    used = dict.fromkeys(left, 0)
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first container, how many)
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def place(size: int, first: int, n: int, gap: int, into: dict[int, list[tuple[int, int]]]) -> None:
        out.append((size, used[size], used[size] + n, first, 1))
        used[size] += n
        left[size] -= n
        if not left[size]:
            del left[size]
        if gap > size:
            into.setdefault(gap - size, []).append((first, n))

    while left:
        # sweep: sizes and gaps descend together; a gap serves the largest unplaced size it takes
        after: dict[int, list[tuple[int, int]]] = {}
        moved = False
        free: dict[int, list[tuple[int, int]]] = {g: list(r) for g, r in gaps.items()}
        order = sorted(free)
        for size in sorted(left, reverse=True):
            while size in left:
                while order and not free[order[-1]]:
                    order.pop()
                g = next((x for x in _from(order, size) if free[x]), None)
                if g is None:
                    break
                first, n = free[g].pop()
                take = min(n, left[size])
                if take < n:
                    free[g].append((first + take, n - take))
                place(size, first, take, g, after)
                moved = True
        for g, runs in free.items():
            if runs:
                after.setdefault(g, []).extend(runs)
        gaps = {g: _join(r) for g, r in after.items()}
        if not left:
            break
        if not moved or max(left) * 2 > capacity:
            # open containers for the largest items: all that need one of their own, else as many as their volume fills
            volume = sum(s * n for s, n in left.items())
            need = sum(n for s, n in left.items() if s * 2 > capacity) or max(1, -(-(volume - sum(g * n for g, r in gaps.items() for _, n in r if g >= min(left))) // capacity))
            for size in sorted(left, reverse=True):
                n = min(need, left[size])
                if n <= 0:
                    break
                place(size, opened, n, capacity, gaps)
                opened += n
                need -= n
            gaps = {g: _join(r) for g, r in gaps.items()}
    return out


def _from(order: list[int], size: int) -> Iterator[int]:
    return iter(order[bisect_left(order, size) :])


def _join(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbouring runs of containers as one, highest first."""
    out: list[tuple[int, int]] = []
    for first, n in sorted(runs):
        if out and out[-1][0] + out[-1][1] == first:
            out[-1] = (out[-1][0], out[-1][1] + n)
        else:
            out.append((first, n))
    return out[::-1]


def _plans(capacity: int) -> Callable[[pa.Table], pa.Table]:
    """The plan of one shard from its histogram of sizes."""

    def run(histogram: pa.Table) -> pa.Table:
        shard = histogram["shard"][0].as_py()
        runs = plan(dict(zip(histogram["tokens"].to_pylist(), histogram["count"].to_pylist())), capacity)
        columns = zip(*[(shard, size, lo, hi, first) for size, lo, hi, first, _ in runs])
        types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("shard", "tokens", "lo", "hi", "first"), columns, types)})

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, item: str = "doc_id", size: str = "tokens", shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(item, piece, tokens, container): every item whole in one container, or cut if it exceeds the capacity.

    An item above the capacity gives full containers of its own and a rest that is packed as an item.
    Items of size 0 or null size take no room: one row with null container. Ids may repeat, each row
    is packed. Containers are numbered from 0. Items are hashed into shards of about shard_items;
    the histogram of a shard (at most ``capacity`` rows) is swept in a task of its own, and the ranks of the items
    within shard and size come from a range sort. Nothing but two totals reaches the driver. A shard ends
    with a few containers that are not full: one in some ten thousand.
    """
    full = F.call_function("div", F.col("tokens"), F.lit(capacity))
    rest = F.col("tokens") % capacity
    base = materialize(items.select(F.col(item).alias("item"), F.coalesce(F.col(size).cast("bigint"), F.lit(0)).alias("tokens"), F.monotonically_increasing_id().alias("row")))
    rests = base.filter(rest > 0).select("item", "row", full.cast("int").alias("piece"), rest.cast("int").alias("tokens"))
    shards = -(-rests.count() // shard_items) or 1
    rests = rests.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    runs = materialize(rests.groupBy("shard", "tokens").count().groupBy("shard").applyInArrow(_plans(capacity), "shard int, tokens int, lo bigint, hi bigint, first bigint"))
    used = runs.groupBy("shard").agg(F.max(F.col("first") + F.col("hi") - F.col("lo")).alias("n"))
    opened = used.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    before = prefix_sums(used, [], ["shard"], {"upto": F.col("n")}).select("shard", (F.col("upto") - F.col("n")).alias("before"))
    by_size = lookup_join(runs, before, ["shard"]).groupBy("shard", "tokens").agg(F.collect_list(F.struct("lo", "hi", (F.col("first") + F.col("before")).alias("first"))).alias("runs"))
    ranked = numbered(rests, ["shard", "tokens"], ["item", "row"], "rank")
    run = F.filter("runs", lambda r: (r["lo"] <= F.col("rank")) & (F.col("rank") < r["hi"]))[0]
    packed = lookup_join(ranked, by_size, ["shard", "tokens"]).select("item", "piece", "tokens", (run["first"] + F.col("rank") - run["lo"]).alias("container"))
    over = prefix_sums(base.filter(full > 0).select("item", "row", full.alias("full")), [], ["row"], {"upto": F.col("full")})
    whole = over.select("item", "full", "upto", F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)).alias("piece"))
    alone = whole.select("item", "piece", F.lit(capacity).alias("tokens"), (F.lit(opened) + F.col("upto") - F.col("full") + F.col("piece")).alias("container"))
    empty = base.filter("tokens <= 0").select("item", F.lit(0).alias("piece"), F.lit(0).alias("tokens"), F.lit(None).cast("bigint").alias("container"))
    return packed.unionByName(alone).unionByName(empty).withColumnRenamed("item", item)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, tokens, container): the texts packed by their tokens; see ``pack``."""
    return pack(token_counts(documents, doc_id, text, vocabulary), capacity, "doc_id", "tokens").withColumnRenamed("doc_id", doc_id)
