"""Implausible readings: spikes, stuck values and impossible values, per source.

Spikes are found by a Haar decomposition. The largest detail of each level is held against a
threshold per source and level, scaled by the median of that detail over the source's blocks. The
thresholds of a source add up to the reach beyond which a value is a spike; as no value lies
farther from the centre than the approximation and the details add up to, a block with a spike
always has a coefficient above its threshold. Blocks with one are checked exactly. A block without any
detail is constant (stuck); bounds give the impossible values.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondewerk.operators.dedup import messages
from sondewerk.util import exact_median, lookup_join, materialize, median_of_counts

#: ADC range of a sample and range of the Kp index.
SAMPLE_RANGE, KP_RANGE = (-2048, 2047), (0.0, 9.0)
#: A value is a spike beyond FACTOR times the usual; a usual reach under MIN_REACH counts as that.
FACTOR, MIN_REACH = 8.0, 4.0
#: Seqs with one energy value, bins with one Kp that make it stuck; bin length and jump of a Kp spike.
STUCK_SEQS, STUCK_BINS, KP_BIN_S, KP_JUMP = 5, 12, 10_800, 4.0
#: Readings per wavelet block of an energy series.
BLOCK = 64
_CELLS = 4_000_000


def haar_levels(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Full Haar decomposition of ragged blocks: the coarsest approximation, and max |detail| per level, finest first.

    Blocks are padded with their last value to a power of two. Every value v of a block satisfies
    |v - approximation| <= the sum of its details. Blocks of length 0 give NaN and no details.
    """
    approx = np.full(len(starts), np.nan)
    details = [np.empty(0)] * len(starts)
    level = np.ceil(np.log2(np.maximum(lengths, 1))).astype(int)
    for k in np.unique(level[lengths > 0]):
        rows = np.flatnonzero((level == k) & (lengths > 0))
        step = max(1, _CELLS >> int(k))
        for i in range(0, len(rows), step):
            r = rows[i : i + step]
            x = values[starts[r, None] + np.minimum(np.arange(1 << int(k))[None, :], lengths[r, None] - 1)].astype(np.float64)
            d = np.empty((len(r), int(k)))
            for j in range(int(k)):
                d[:, j] = np.abs(x[:, ::2] - x[:, 1::2]).max(axis=1) / 2
                x = (x[:, ::2] + x[:, 1::2]) / 2
            approx[r] = x[:, 0]
            for row, own in zip(r.tolist(), d):
                details[row] = own
    return approx, details


def _lists(parts: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(flat, pa.float64()))


def thresholds(scales: DataFrame, limits: DataFrame) -> DataFrame:
    """(source, limit, levels): per level its number (from 0, the finest; -1 the approximation), scale and threshold.

    scales: (source, level, scale), the usual size of the details; limits: (source, limit), how far
    from the centre a value may lie. The approximation varies like the coarsest detail, so it gets that
    scale. A level's threshold is the limit's part in proportion to its scale: together they make the limit.
    """
    least = F.lit(2.0**-40)
    listed = scales.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("level", F.greatest("scale", least).alias("scale")))).alias("own"))
    every = F.concat(F.array(F.struct(F.lit(-1).alias("level"), F.element_at("own", -1)["scale"].alias("scale"))), "own")
    total = F.aggregate("every", F.lit(0.0), lambda t, x: t + x["scale"])
    # slightly under the exact part, so that rounding loses nothing
    own = lookup_join(limits, listed, ["source"]).withColumn("every", every)
    return own.select("source", "limit", F.transform("every", lambda x: F.struct(x["level"].alias("level"), x["scale"].alias("scale"), (F.col("limit") * x["scale"] / total * (1 - 1e-9)).alias("threshold"))).alias("levels"))


def over(details: str, deviation: Column, levels: str = "levels") -> Column:
    """Whether a detail, or the deviation of the approximation from the centre, is above its threshold."""
    own = F.transform(F.slice(levels, 2, 64), lambda x: x["threshold"])
    return (deviation > F.col(levels)[0]["threshold"]) | F.exists(F.zip_with(details, own, lambda d, t: F.coalesce(d > t, F.lit(False))), lambda x: x)


_STATS = "kind int, row_id bigint, source bigint, seq bigint, ts_us bigint, lo int, hi int, approx double, details array<double>, h1 bigint, h2 int, count bigint"
#: Bins of an octave in which details are counted, and the bin of a detail of nothing.
_BINS, _NOTHING = 4, -200


def _payload_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per frame (kind 0): extremes and Haar details; partial counts per source and sample value (kind 1) and per source, level and size of the detail (kind 2)."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def columns(n: int, **have) -> pa.RecordBatch:
        types = {"kind": pa.int32(), "row_id": pa.int64(), "source": pa.int64(), "seq": pa.int64(), "ts_us": pa.int64(), "lo": pa.int32(), "hi": pa.int32(), "approx": pa.float64(), "details": pa.list_(pa.float64()), "h1": pa.int64(), "h2": pa.int32(), "count": pa.int64()}
        return pa.record_batch([pa.nulls(n, t) if have.get(c) is None else pa.array(have[c], t) if isinstance(have[c], np.ndarray) else have[c].cast(t) for c, t in types.items()], names=list(types))

    def counts() -> Iterator[pa.RecordBatch]:
        nonlocal size
        if held:
            src, val = np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held])
            names, code = np.unique(src, return_inverse=True)
            keys, n = np.unique(code.astype(np.int64) * 65536 + (val.astype(np.int64) + 32768), return_counts=True)
            held.clear()
            size = 0
            yield columns(len(keys), kind=np.ones(len(keys), np.int32), source=names[keys // 65536], lo=(keys % 65536 - 32768).astype(np.int32), count=n)
        if seen:
            src, level, bin_ = (np.concatenate(x) for x in zip(*seen))
            names, code = np.unique(src, return_inverse=True)
            keys, n = np.unique((code.astype(np.int64) * 64 + level) * 1024 + bin_ + 512, return_counts=True)
            seen.clear()
            yield columns(len(keys), kind=np.full(len(keys), 2, np.int32), source=names[keys // 65536], lo=(keys // 1024 % 64).astype(np.int32), hi=(keys % 1024 - 512).astype(np.int32), count=n)

    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index("payload"))
        flat, lengths = col.flatten(), col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if flat.null_count:
            there = flat.is_valid().to_numpy(zero_copy_only=False)
            upto = np.concatenate([[0], np.cumsum(there)])
            ends = np.cumsum(lengths)
            lengths = upto[ends] - upto[ends - lengths]
            flat = flat.drop_null()
        v = flat.to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        full = np.flatnonzero(lengths > 0)
        lo, hi = np.zeros(len(lengths), np.int32), np.zeros(len(lengths), np.int32)
        if len(full):
            lo[full], hi[full] = np.minimum.reduceat(v, starts[full]), np.maximum.reduceat(v, starts[full])
        approx, details = haar_levels(v, starts, lengths)
        take = lambda name: b.column(b.schema.get_field_index(name)).take(pa.array(full))  # noqa: B023, E731
        yield columns(len(full), kind=np.zeros(len(full), np.int32), **{c: take(c) for c in ("row_id", "source", "seq", "ts_us", "h1", "h2")}, lo=lo[full], hi=hi[full], approx=approx[full], details=_lists([details[i] for i in full]))
        source = b.column(b.schema.get_field_index("source")).to_numpy(zero_copy_only=False)
        held.append((np.repeat(source, lengths), v))
        many = np.array([len(d) for d in details])
        flat = np.concatenate(details)
        with np.errstate(divide="ignore"):
            bins = np.maximum(np.floor(_BINS * np.log2(flat)), _NOTHING).astype(np.int64)
        seen.append((np.repeat(source, many), np.arange(len(flat)) - np.repeat(np.cumsum(many) - many, many), bins))
        size += len(v)
        if size > _CELLS // 2:
            yield from counts()
    yield from counts()


def _payload_rows(frames: DataFrame, row_id: str, source: str, payload: str) -> DataFrame:
    return frames.filter(F.col(row_id).isNotNull() & F.col(source).isNotNull() & F.col(payload).isNotNull()).select(
        F.col(row_id).cast("bigint").alias("row_id"), F.col(source).cast("bigint").alias("source"), F.col("seq").cast("bigint").alias("seq"), F.col("ts_us").cast("bigint").alias("ts_us"),
        F.col(payload).alias("payload"), F.xxhash64(payload).alias("h1"), F.hash(payload, F.size(payload)).alias("h2"),
    )


def bad_frames(frames: DataFrame, row_id: str = "delivery_id", source: str = "node_id", payload: str = "payload") -> DataFrame:
    """(row_id, impossible, spike, stuck) of the frames with a bad payload, judged against their own source.

    Rows with null id, source or payload and empty payloads are never bad; null samples are passed
    over. Ties and repeated rows are judged alike. A frame with null seq or ts_us names no message:
    it is judged, but does not count as a message.
    """
    rows = _payload_rows(frames, row_id, source, payload)
    table = materialize(rows.mapInArrow(_payload_stats, _STATS))
    stats = table.filter("kind = 0").drop("kind", "count").withColumn("flat", F.forall("details", lambda d: d == 0))
    seen, levels = _frame_levels(table)
    judged = lookup_join(seen, levels, ["source"])
    spikes = judged.filter(over("details", F.abs(F.col("approx") - F.col("centre")))).filter(F.col("reach") > F.col("limit")).select("row_id")
    impossible = stats.filter((F.col("lo") < SAMPLE_RANGE[0]) | (F.col("hi") > SAMPLE_RANGE[1])).select("row_id")
    by_source = messages(stats, keys=("source", "seq"), aggs={"flat": ("max", F.col("flat").cast("int"))}).groupBy("source").agg(F.avg("flat").alias("share"))
    live = by_source.filter("share < 0.5").select("source")
    # two samplings of one payload have no detail between them: equal hashes, but another message
    again = stats.filter("seq is not null and ts_us is not null").groupBy("source", "h1", "h2").agg(F.min("seq").alias("s0"), F.max("seq").alias("s1"), F.min("ts_us").alias("t0"), F.max("ts_us").alias("t1"))
    again = again.filter("s0 <> s1 or t1 - t0 > 2000000").select("source", "h1", "h2")
    copies = lookup_join(stats.filter("not flat").select("row_id", "source", "h1", "h2"), again, ["source", "h1", "h2"])
    stuck = lookup_join(stats.filter("flat").select("row_id", "source").unionByName(copies.select("row_id", "source")), live, ["source"]).select("row_id")
    kinds = impossible.withColumn("kind", F.lit("impossible")).unionByName(spikes.withColumn("kind", F.lit("spike"))).unionByName(stuck.withColumn("kind", F.lit("stuck")))
    return kinds.groupBy(F.col("row_id").alias(row_id)).agg(*[F.max(F.col("kind") == k).alias(k) for k in ("impossible", "spike", "stuck")])


def _frame_levels(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the partial statistics of payloads: the frames with centre and reach, and the thresholds of their sources."""
    centre = median_of_counts(table.filter("kind = 1").groupBy("source", F.col("lo").alias("value")).agg(F.sum("count").alias("count")), ["source"], "value", "centre")
    far = F.greatest(F.col("hi") - F.col("centre"), F.col("centre") - F.col("lo"))
    seen = lookup_join(table.filter("kind = 0").select("row_id", "source", "lo", "hi", "approx", "details"), centre, ["source"]).withColumn("reach", far)
    usual = median_of_counts(seen.groupBy("source", "reach").count(), ["source"], "reach", "usual")
    limits = usual.select("source", (F.lit(FACTOR) * F.greatest("usual", F.lit(MIN_REACH))).alias("limit"))
    bins = median_of_counts(table.filter("kind = 2").groupBy("source", F.col("lo").alias("level"), F.col("hi").alias("bin")).agg(F.sum("count").alias("count")), ["source", "level"], "bin", "bin")
    scales = bins.select("source", "level", F.pow(F.lit(2.0), F.col("bin") / _BINS).alias("scale"))
    # frames of one sample have no details: their source still needs a scale
    alone = usual.select("source", F.lit(0).alias("level"), F.lit(0.0).alias("scale"))
    scales = scales.unionByName(alone).groupBy("source", "level").agg(F.max("scale").alias("scale"))
    return seen, thresholds(scales, limits)


def frame_levels(frames: DataFrame, row_id: str = "delivery_id", source: str = "node_id", payload: str = "payload") -> DataFrame:
    """(source, level, scale, threshold, frames, above): the wavelet levels of each source (level -1: the approximation), as ``bad_frames`` uses them.

    scale: the usual largest detail of a frame; above: the frames whose coefficient is over the threshold.
    """
    table = materialize(_payload_rows(frames, row_id, source, payload).mapInArrow(_payload_stats, _STATS))
    seen, levels = _frame_levels(table)
    both = lookup_join(seen, levels, ["source"])
    own = F.concat(F.array(F.abs(F.col("approx") - F.col("centre"))), "details")
    each = both.select("source", F.explode(F.arrays_zip("levels", own.alias("size"))).alias("x")).select("source", "x.levels.*", F.col("x.size").alias("size"))
    return each.filter("size is not null").groupBy("source", "level").agg(F.first("scale").alias("scale"), F.first("threshold").alias("threshold"), F.count("*").alias("frames"), F.count_if(F.col("size") > F.col("threshold")).alias("above"))


_BLOCK = "source bigint, metric string, approx double, details array<double>, members array<struct<row_id: bigint, e: double>>"


def _energy_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of up to BLOCK positive finite energies of one source, in order of time: Haar details of their log2, and the members."""
    for b in batches:
        if not b.num_rows:
            continue
        for metric, column in (("rms", 2), ("peak", 3)):
            e = b.column(column).to_numpy(zero_copy_only=False).astype(np.float64)
            ok = np.flatnonzero(np.isfinite(e) & (e > 0))
            if not len(ok):
                continue
            src, e = b.column(1).to_numpy(zero_copy_only=False)[ok], e[ok]
            fresh = np.concatenate([[True], src[1:] != src[:-1]])
            at = np.arange(len(src)) - np.maximum.accumulate(np.where(fresh, np.arange(len(src)), 0))
            starts = np.flatnonzero(fresh | (at % BLOCK == 0))
            sizes = np.diff(np.append(starts, len(src)))
            approx, details = haar_levels(np.log2(e), starts, sizes)
            members = pa.ListArray.from_arrays(pa.array(np.append(starts, len(src)), pa.int32()), pa.StructArray.from_arrays([b.column(0).take(pa.array(ok)), pa.array(e)], ["row_id", "e"]))
            yield pa.record_batch([pa.array(src[starts], pa.int64()), pa.array([metric] * len(starts)), pa.array(approx), _lists(details), members], names=["source", "metric", "approx", "details", "members"])


def bad_energies(table: DataFrame, row_id: str = "emb_id", source: str = "node_id", rms: str = "energy_rms", peak: str = "energy_peak") -> DataFrame:
    """(row_id, impossible, spike, stuck) of the rows with a bad energy, judged against their own source.

    Nulls are never bad. A row without source is judged by the bounds only. The spike factor is
    relative to the exact median over the finite positive values of the source.
    """
    rows = table.filter(F.col(row_id).isNotNull()).select(F.col(row_id).cast("bigint").alias("row_id"), F.col(source).cast("bigint").alias("source"), F.col("seq").alias("seq"), F.col("ts_us").alias("ts_us"), F.col(rms).cast("double").alias("rms"), F.col(peak).cast("double").alias("peak"))
    wrong = lambda c: F.isnan(c) | (F.abs(c) == F.lit(float("inf"))) | (F.col(c) < 0)
    impossible = rows.filter(F.coalesce(wrong("rms"), F.lit(False)) | F.coalesce(wrong("peak"), F.lit(False)) | F.coalesce(F.col("peak") < F.col("rms"), F.lit(False))).select("row_id")
    sourced = rows.filter("source is not null")
    good = lambda c: (F.col(c) > 0) & (F.col(c) < float("inf"))
    ordered = sourced.select("row_id", "source", "rms", "peak", "ts_us").repartitionByRange(F.col("source"), F.col("ts_us"), F.col("row_id")).sortWithinPartitions("source", "ts_us", "row_id").select("row_id", "source", "rms", "peak")
    blocks = materialize(ordered.mapInArrow(_energy_blocks, _BLOCK))
    octaves = float(np.log2(FACTOR))
    depth = int(np.log2(BLOCK))
    spikes = None
    for c in ("rms", "peak"):
        own = blocks.filter(F.col("metric") == c).drop("metric")
        usual = exact_median(sourced.filter(good(c)), ["source"], c, "usual")
        # one row per block: the medians of the details are sketched map-side
        medians = own.groupBy("source").agg(*[F.percentile_approx(F.get("details", F.lit(j)), 0.5).alias(f"d{j}") for j in range(depth)])
        scales = medians.select("source", F.posexplode(F.array(*[f"d{j}" for j in range(depth)])).alias("level", "scale")).select("source", "level", F.coalesce("scale", F.lit(0.0)).alias("scale"))
        levels = thresholds(scales, usual.select("source", F.lit(octaves).alias("limit")))
        judged = lookup_join(lookup_join(own, usual, ["source"]), levels, ["source"])
        wild = judged.filter(over("details", F.abs(F.col("approx") - F.log2("usual")))).select("usual", F.explode("members").alias("m"))
        hits = wild.filter((F.col("m.e") > FACTOR * F.col("usual")) | (F.col("m.e") * FACTOR < F.col("usual"))).select("m.row_id")
        spikes = hits if spikes is None else spikes.unionByName(hits)
    finite = sourced.filter(F.abs("rms") < float("inf"))
    often = finite.groupBy("source", "rms").agg(F.count_distinct("seq").alias("seqs")).filter(F.col("seqs") >= STUCK_SEQS).select("source", "rms")
    stuck = lookup_join(finite.select("row_id", "source", "rms"), often, ["source", "rms"]).select("row_id")
    kinds = impossible.withColumn("kind", F.lit("impossible")).unionByName(spikes.withColumn("kind", F.lit("spike"))).unionByName(stuck.withColumn("kind", F.lit("stuck")))
    return kinds.groupBy(F.col("row_id").alias(row_id)).agg(*[F.max(F.col("kind") == k).alias(k) for k in ("impossible", "spike", "stuck")])


def bad_polls(polls: DataFrame, row_id: str = "poll_id", source: str = "watcher") -> DataFrame:
    """(row_id, impossible, spike, stuck) of the polls with a bad Kp, judged against their own watcher.

    One value per watcher and 3-hour bin (the largest valid one, should several differ). The
    undecimated Haar detail between neighbouring bins gives spikes (two large details of opposite
    sign) and stuck runs (zero details). Null kp and unreadable time tags are never bad beyond the bounds.
    """
    kp = F.col("latest.kp")
    rows = polls.filter(F.col(row_id).isNotNull() & kp.isNotNull()).select(F.col(row_id).cast("bigint").alias("row_id"), F.col(source).alias("source"), F.expr("unix_seconds(try_cast(latest.time_tag as timestamp))").alias("bin"), kp.alias("kp"))
    valid = (F.col("kp") >= KP_RANGE[0]) & (F.col("kp") <= KP_RANGE[1])
    impossible = rows.filter(~valid).select("row_id")
    usable = rows.filter(valid & F.col("source").isNotNull() & F.col("bin").isNotNull())
    bins = usable.groupBy("source", "bin").agg(F.max("kp").alias("kp"))
    w = Window.partitionBy("source").orderBy("bin")
    near = lambda f: F.when(F.abs(f("bin", 1).over(w) - F.col("bin")) == KP_BIN_S, F.col("kp") - f("kp", 1).over(w))
    runs = bins.withColumn("before", near(F.lag)).withColumn("after", near(F.lead)).withColumn("run", F.sum(F.coalesce((F.col("kp") != F.lag("kp").over(w)).cast("int"), F.lit(0))).over(w))
    runs = runs.withColumn("length", F.count("*").over(Window.partitionBy("source", "run")))
    up, down = (F.col("before") > KP_JUMP) & (F.col("after") > KP_JUMP), (F.col("before") < -KP_JUMP) & (F.col("after") < -KP_JUMP)
    flagged = runs.select("source", "bin", F.coalesce(up | down, F.lit(False)).alias("spike"), (F.col("length") >= STUCK_BINS).alias("stuck")).filter("spike or stuck")
    hits = usable.join(flagged, ["source", "bin"])
    out = hits.select("row_id", F.lit(False).alias("impossible"), "spike", "stuck").unionByName(impossible.select("row_id", F.lit(True).alias("impossible"), F.lit(False).alias("spike"), F.lit(False).alias("stuck")))
    return out.groupBy(F.col("row_id").alias(row_id)).agg(*[F.max(c).alias(c) for c in ("impossible", "spike", "stuck")])


def haar_details(df: DataFrame, source: Sequence[str], order: str, value: str, levels: int = 3) -> DataFrame:
    """df with undecimated Haar details d1..dn of a series per source: mean of a span minus mean of the span before.

    Rows with null value keep null details; a detail needs its whole support.
    """
    w = Window.partitionBy(*source).orderBy(order)
    for j in range(levels):
        h = 1 << j
        whole = F.count(value).over(w.rowsBetween(-2 * h + 1, 0)) == 2 * h
        df = df.withColumn(f"d{j + 1}", F.when(whole, (F.avg(value).over(w.rowsBetween(-h + 1, 0)) - F.avg(value).over(w.rowsBetween(-2 * h + 1, -h))) / 2))
    return df
