"""The most similar vectors of every vector: multi-index hashing over learned binary codes.

Vectors get binary codes by rotations learned on a bounded sample (iterative quantization). A code is
cut into TABLES substrings, about as long as the binary logarithm of the number of vectors, so that a
bucket holds few vectors at any size; each substring is indexed. Two codes within a Hamming distance
of TABLES * (r + 1) - 1 agree in some substring up to r bits (pigeonhole), so probing all values
within r bits of each substring retrieves all of them; their vectors are then compared as floats.
Every query is searched with r = 2; those whose k-th similarity is so low that a better one may
have been missed are searched on with r = 3. Only queries amid a dense cluster, whose buckets hold
much of the table, and those for which fewer than k are found are compared with all vectors, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import acos, comb, log2, pi

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from sondewerk.util import materialize, skew_join

#: Length of a vector, substrings of a code, shortest and longest substring.
DIM, TABLES, SHORT, LONG = 32, 12, 6, 30
#: Bits of a substring that are flipped in the two searches.
RADII = (2, 3)
#: A query is searched on when a vector as near as its k-th found one may have been missed with more than this chance.
MISS = 0.1
#: Vectors the rotations are learned on, picked by the hash of their id (about so many at most), and steps of learning.
SAMPLE, STEPS, SEED = 8_192, 30, 7
#: Bits of the code that go along with an index row, and the most that may differ in a pair that is compared as floats.
SIGNATURE, KEEP = 128, 52
#: Rows that make a bucket hot; a query whose hot buckets hold more than this share of all vectors is cheaper to scan exactly.
HOT_ROWS, SCAN_SHARE = 5_000, 0.05
#: Vectors of the sample in a bucket from which its size is estimated.
SEEN = 8
#: Queries and vectors per block of the exact scan.
SCAN_QUERIES, SCAN_VECTORS = 8_192, 16_384


def learn_rotations(sample: np.ndarray, rotations: int, steps: int = STEPS, seed: int = SEED) -> np.ndarray:
    """rotations orthogonal matrices, each from another start, that bring the sample near the corners of a cube."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    out = []
    for _ in range(rotations):
        r, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        for _ in range(steps if len(sample) >= 2 * dim else 0):
            v = sample @ r
            u, _, w = np.linalg.svd(np.where(v > 0, 1.0, -1.0).T @ sample)
            r = (u @ w).T
        out.append(r)
    return np.concatenate(out, axis=1)


def substring_bits(vectors: int) -> int:
    """Length of a substring: one bit less than the logarithm of the number of vectors."""
    return max(SHORT, min(LONG, round(log2(max(vectors, 2))) - 1))


def codes(x: np.ndarray, rotation: np.ndarray, bits: int, tables: int = TABLES) -> tuple[np.ndarray, np.ndarray]:
    """(vectors x tables substrings, vectors x 2 words of the signature)."""
    code = x @ rotation > 0
    sub = (code[:, : tables * bits].reshape(len(x), tables, bits).astype(np.int64) << np.arange(bits)).sum(axis=2)
    words = np.packbits(code[:, :SIGNATURE], axis=1).view(np.int64)
    return sub, words


def unit(column: pa.Array, dim: int = DIM) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def flip_masks(bits: int, least: int, most: int) -> np.ndarray:
    """All words of so many bits with at least ``least`` and at most ``most`` ones."""
    return np.array([sum(1 << i for i in c) for r in range(least, most + 1) for c in combinations(range(bits), r)], np.int64)


_ENTRY = "id bigint, key bigint, c0 bigint, c1 bigint"


def _entries(rotation: np.ndarray, bits: int, masks: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row per vector, table and mask: the bucket (table in the upper 32 bits) and the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, 65_536 // (TABLES * len(masks)))
        for whole in batches:
            for i in range(0, whole.num_rows, step):
                b = whole.slice(i, step)
                sub, words = codes(unit(b.column(1)), rotation, bits)
                n, tables = sub.shape
                key = (sub[:, :, None] ^ masks) | (np.arange(tables, dtype=np.int64) << 32)[None, :, None]
                at = np.repeat(np.arange(n), tables * len(masks))
                yield pa.record_batch([b.column(0).take(pa.array(at)), pa.array(key.reshape(-1)), pa.array(words[at, 0]), pa.array(words[at, 1])], names=["id", "key", "c0", "c1"])

    return run


def miss_chance(similarity: float, bits: int, flips: int, tables: int = TABLES) -> float:
    """Chance that a vector of this cosine similarity differs by more than ``flips`` bits in every substring."""
    p = acos(max(-1.0, min(1.0, similarity))) / pi
    return (1 - sum(comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(flips + 1))) ** tables


def safe_similarity(bits: int, flips: int, miss: float = MISS) -> float:
    """Least similarity that is missed with at most this chance."""
    lo, hi = 0.0, 1.0
    for _ in range(40):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if miss_chance(mid, bits, flips) > miss else (lo, mid)
    return hi


def _rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.record_batch([b.column(0), b.column(1), pa.array((unit(b.column(2)) * unit(b.column(3))).sum(axis=1))], names=["query", "id", "similarity"])


def best_of_block(ids: np.ndarray, queries: np.ndarray, others: np.ndarray, vectors: np.ndarray, k: int, step: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, similarity): for each query the k best of the block and all that tie with the k-th."""
    out = []
    for i in range(0, len(ids), step):
        own = ids[i : i + step]
        s = queries[i : i + step] @ vectors.T
        s[own[:, None] == others[None, :]] = -np.inf
        floor = np.partition(s, -k, axis=1)[:, -k] if len(others) >= k else np.full(len(own), -2.0)
        r, c = np.nonzero((s >= floor[:, None]) & np.isfinite(s))
        out.append((own[r], others[c], s[r, c]))
    return tuple(np.concatenate([o[j] for o in out]) for j in range(3))


def _scan_block(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(asked: pa.Table, base: pa.Table) -> pa.Table:
        found = ([], [], [])
        if asked.num_rows and base.num_rows:
            found = best_of_block(asked["id"].to_numpy(), unit(asked["v"].combine_chunks()), base["id"].to_numpy(), unit(base["v"].combine_chunks()), k)
        return pa.table({c: pa.array(v, t) for (c, t), v in zip((("query", pa.int64()), ("id", pa.int64()), ("similarity", pa.float64())), found)})

    return run


_FOUND = "query bigint, id bigint, similarity double"


def _k_best(pairs: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def scan(base: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query, id, similarity, rank) of the k best others of each asked (id, v) by comparison with all of base (id, v).

    A task holds a block of queries and a block of vectors; base is repeated once per SCAN_QUERIES queries.
    """
    rows, columns = (-(-df.count() // size) or 1 for df, size in ((asked, SCAN_QUERIES), (base, SCAN_VECTORS)))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = asked.select("id", "v", part(rows).alias("i"), every(columns).alias("j"))
    b = base.select("id", "v", part(columns).alias("j"), every(rows).alias("i"))
    return _k_best(a.groupBy("i", "j").cogroup(b.groupBy("i", "j")).applyInArrow(_scan_block(k), _FOUND), k)


def usable(vectors: DataFrame, vec_id: str = "emb_id", vector: str = "vector", dim: int = DIM) -> DataFrame:
    """(id, v) of the vectors that can be compared: of full length, without null, NaN or infinity, not all zero."""
    v = F.col(vector)
    good = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(vec_id).isNotNull() & v.isNotNull() & F.coalesce(good, F.lit(False))).select(F.col(vec_id).cast("bigint").alias("id"), v.alias("v"))


def _prepared(vectors: DataFrame, queries: DataFrame, k: int, vec_id: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """(asked, base) with columns id and v: the usable vectors that are asked for, and those that can be an answer."""
    good = materialize(usable(vectors, vec_id, vector))
    asked = materialize(good.join(queries.select(F.col(vec_id).cast("bigint").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"]))
    w = Window.partitionBy("h1", "h2").orderBy("id")
    copies = good.select("id", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2")).distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k + 1).select("id")
    return asked, materialize(good.join(copies, "id", "left_semi").dropDuplicates(["id"]))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "emb_id", vector: str = "vector") -> DataFrame:
    """(query, id, similarity, how): for each query id its k most similar other vectors of the table by cosine, ties by id.

    queries: ids (vec_id) of vectors of the table. Ids without a usable vector have no result and are
    no neighbour of any; with fewer than k others all of them come out. Of exactly equal vectors only
    the k+1 smallest ids are indexed, as no other can be among the k of any query; hot buckets are
    cut into blocks. Rows repeated under one id count once. how: 'index' or, amid a dense cluster and
    for a query so far from all others that the index finds fewer than k, 'scan'.

    The answer is approximate: a neighbour is missed with a chance of at most MISS where its
    similarity is at least that of the k-th found, and of ``miss_chance`` at the wider radius beyond.
    """
    asked, base = _prepared(vectors, queries, k, vec_id, vector)
    spark, size = base.sparkSession, base.count()
    sample = base.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-size // SAMPLE)))) == 0).orderBy("id").select("v").toPandas()["v"]
    if not len(sample):
        return spark.createDataFrame([], _FOUND + ", how string")
    x = np.stack(sample.to_numpy()).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    bits = substring_bits(size)
    rotation = learn_rotations(x, max(SIGNATURE, TABLES * bits) // DIM + 1)
    index = base.mapInArrow(_entries(rotation, bits, np.zeros(1, np.int64)), _ENTRY)
    # the sizes of large buckets, from the sample: they decide on blocks and scans, not on results
    buckets, n = np.unique((codes(x, rotation, bits)[0] | (np.arange(TABLES) << 32)).reshape(-1), return_counts=True)
    n, buckets = n[n >= SEEN] * -(-size // len(x)), buckets[n >= SEEN]
    hot = [Row(key=int(b), count=int(c)) for b, c in zip(buckets, n) if c > HOT_ROWS]
    near = (F.bit_count(F.col("c0").bitwiseXOR(F.col("q0"))) + F.bit_count(F.col("c1").bitwiseXOR(F.col("q1")))) <= KEEP

    def search(some: DataFrame, probes: DataFrame) -> DataFrame:
        pairs = skew_join(index, probes, ["key"], HOT_ROWS, hot=hot).filter(near & (F.col("id") != F.col("query"))).select("query", "id").repartition("id").distinct()
        floats = pairs.join(base, "id").join(some.select(F.col("id").alias("query"), F.col("v").alias("q")), "query").select("query", "id", "v", "q")
        return floats.mapInArrow(_rerank, _FOUND)

    def probes_of(some: DataFrame, least: int, most: int) -> DataFrame:
        return some.mapInArrow(_entries(rotation, bits, flip_masks(bits, least, most)), _ENTRY).select(F.col("id").alias("query"), "key", F.col("c0").alias("q0"), F.col("c1").alias("q1"))

    scanned = None
    if hot:
        table = F.broadcast(spark.createDataFrame([(r["key"], r["count"]) for r in hot], "key bigint, n bigint"))
        heavy = materialize(probes_of(asked, 0, RADII[0]).join(table, "key").groupBy("query").agg(F.sum("n").alias("n")).filter(F.col("n") > SCAN_SHARE * size).select(F.col("query").alias("id")))
        if not heavy.isEmpty():
            scanned = asked.join(heavy, "id", "left_semi")
            asked = asked.join(heavy, "id", "left_anti")
    found = materialize(_k_best(search(asked, probes_of(asked, 0, RADII[0])), k))
    sure = found.filter((F.col("rank") == k) & (F.col("similarity") >= safe_similarity(bits, RADII[0]))).select(F.col("query").alias("id"))
    open_ = materialize(asked.join(sure, "id", "left_anti"))
    result, far = found, None
    if not open_.isEmpty():
        more = search(open_, probes_of(open_, RADII[0] + 1, RADII[1])).unionByName(found.drop("rank").join(open_.select(F.col("id").alias("query")), "query", "left_semi"))
        wider = materialize(_k_best(more.distinct(), k))
        full = wider.filter(F.col("rank") == k).select("query")
        result = found.join(sure.withColumnRenamed("id", "query"), "query", "left_semi").unionByName(wider.join(full, "query", "left_semi"))
        far = open_.join(full.withColumnRenamed("query", "id"), "id", "left_anti")
    out = result.select("query", "id", "similarity", F.lit("index").alias("how"))
    for some in (scanned, far):
        if some is not None and not (some := materialize(some)).isEmpty():
            out = out.unionByName(scan(base, some, k).select("query", "id", "similarity", F.lit("scan").alias("how")))
    return out


def nearest_pairs(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "emb_id", vector: str = "vector") -> DataFrame:
    """(emb_a, emb_b), smaller id first: the pairs of ``nearest``, each once."""
    n = nearest(vectors, queries, k, vec_id, vector)
    return n.select(F.least("query", "id").alias("emb_a"), F.greatest("query", "id").alias("emb_b")).distinct()


def recall(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "emb_id", vector: str = "vector") -> DataFrame:
    """One row (asked, neighbours, found, scanned): queries with a result, their true neighbours, those that ``nearest`` finds, queries it scanned.

    The truth is the comparison of every query with every vector, in blocks. A found vector that is as
    similar as the true k-th (to 1e-9) counts as found, whichever of equals it is.
    """
    asked, base = _prepared(vectors, queries, k, vec_id, vector)
    truth = scan(base, asked, k).groupBy("query").agg(F.min("similarity").alias("least"), F.count("*").alias("want"))
    got = nearest(vectors, queries, k, vec_id, vector)
    hits = truth.join(got, "query", "left").groupBy("query").agg(F.first("want").alias("want"), F.count_if(F.col("similarity") >= F.col("least") - 1e-9).alias("hit"), F.max(F.coalesce(F.col("how") == "scan", F.lit(False)).cast("int")).alias("scanned"))
    return hits.agg(F.count("*").alias("asked"), F.coalesce(F.sum("want"), F.lit(0)).alias("neighbours"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"), F.coalesce(F.sum("scanned"), F.lit(0)).alias("scanned"))
