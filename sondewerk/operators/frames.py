"""Wire frames: decoding, encoding, loss accounting, framing and windowing."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondewerk.functions import kernels, series
from sondewerk.util import floor_div, lookup_join, numbered, prefix_sums

# Fixed values of the wire format: little-endian header, magic words, version.
HEADER = "<HBBIIQIHH"
HEADER_BYTES = 28
RAW, SPECTRUM, VERSION = 0x5247, 0x5347, 1
FRAME_SAMPLES, WINDOW = 512, 1024
FRAME = "is_spectrum boolean, node_id bigint, seq bigint, ts_us decimal(20,0), sr_hz bigint, n int, sensor_class smallint, payload array<float>, error string"


_HEAD = np.dtype([("magic", "<u2"), ("version", "u1"), ("flags", "u1"), ("node_id", "<u4"), ("seq", "<u4"), ("ts_us", "<u8"), ("sr_hz", "<u4"), ("n", "<u2"), ("sensor_class", "<u2")])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, start, length) of a binary column; a null has length -1."""
    _, offsets, data = column.cast(pa.binary()).buffers()
    off = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(off), -1)
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), off[:-1], size


def decode_batch(column: pa.Array) -> dict[str, pa.Array]:
    """Fields of FRAME for a column of binary frames, all rows at once."""
    data, start, size = _bytes_of(column)
    m = len(column)
    long = np.flatnonzero(size >= HEADER_BYTES)
    head = np.zeros(m, _HEAD)
    if len(long):
        head[long] = data[start[long, None] + np.arange(HEADER_BYTES)].reshape(-1).view(_HEAD)
    n, spectrum = head["n"].astype(np.int64), head["magic"] == SPECTRUM
    width = np.where(spectrum, 4, 2)
    error = np.full(m, None, object)
    for bad, name in ((size - HEADER_BYTES < n * width, "payload"), (~np.isin(head["magic"], (RAW, SPECTRUM)), "magic"), (head["version"] != VERSION, "version"), (size < HEADER_BYTES, "short")):
        error[bad] = name
    ok = np.equal(error, None)
    count = np.where(ok, n, 0)
    values = np.empty(count.sum(), np.float32)
    row = np.repeat(np.arange(m), count)
    place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    for kind, bytes_, mine in (("<i2", 2, ~spectrum[row]), ("<f4", 4, spectrum[row])):
        at = (start[row] + HEADER_BYTES + bytes_ * place)[mine]
        values[mine] = data[at[:, None] + np.arange(bytes_)].reshape(-1).view(kind)
    no = ~ok
    offsets = pa.array(np.append(0, np.cumsum(count)), pa.int32(), mask=np.append(no, False)) if m else pa.array([0], pa.int32())
    own = {f: pa.array(head[f].astype(np.int64), pa.int64(), mask=no) for f in ("node_id", "seq", "sr_hz")}
    return {
        "is_spectrum": pa.array(spectrum, mask=no), "node_id": own["node_id"], "seq": own["seq"], "ts_us": pa.array(head["ts_us"], pa.uint64(), mask=no).cast(pa.decimal128(20, 0)), "sr_hz": own["sr_hz"],
        "n": pa.array(n, pa.int32(), mask=no), "sensor_class": pa.array(head["sensor_class"].astype(np.int64) & 0xFF, pa.int16(), mask=no), "payload": pa.ListArray.from_arrays(offsets, pa.array(values)), "error": pa.array(error, pa.string()),
    }


def decode(frames: DataFrame, column: str = "frame", keep: Sequence[str] = ()) -> DataFrame:
    """The fields of binary frames beside the columns to keep; bad frames have ``error`` (short, version, magic, payload) and null fields."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = decode_batch(b.column(b.num_columns - 1))
            yield pa.record_batch([*b.columns[:-1], *fields.values()], names=[*b.schema.names[:-1], *fields])

    kept = "".join(f"`{c}` {frames.schema[c].dataType.simpleString()}, " for c in keep)
    return frames.select(*keep, column).mapInArrow(run, kept + FRAME)


def good(decoded: DataFrame) -> DataFrame:
    """Frames without error; the others are ``decoded.filter('error is not null')``."""
    return decoded.filter("error is null")


def _le(value: Column, bytes_: int) -> Column:
    """Little-endian bytes of a non-negative integer."""
    digits = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    return F.concat(*[F.unhex(F.substring(digits, 15 - 2 * i, 2)) for i in range(bytes_)])


def encode(node_id: Column, seq: Column, ts_us: Column, sr_hz: Column, samples: Column, sensor_class: Column | None = None) -> Column:
    """A raw frame as binary, built in the JVM: header and int16 samples. Null in any field gives null."""
    cls = sensor_class if sensor_class is not None else F.lit(0)
    head = F.concat(_le(F.lit(RAW), 2), _le(F.lit(VERSION), 1), _le(F.lit(0), 1), _le(node_id, 4), _le(seq, 4), _le(ts_us, 8), _le(sr_hz, 4), _le(F.size(samples), 2), _le(cls.cast("int").bitwiseAND(0xFF), 2))
    text = F.array_join(F.transform(samples, lambda s: F.hex(_le(F.pmod(s.cast("int"), F.lit(65536)), 2))), "")
    return F.concat(head, F.unhex(text))


def _crc_table() -> np.ndarray:
    word = np.arange(256, dtype=np.int64) << 8
    for _ in range(8):
        word = np.where(word & 0x8000, word << 1 ^ 0x1021, word << 1) & 0xFFFF
    return word


def crc16_batch(column: pa.Array) -> pa.Array:
    """CRC-16/CCITT-FALSE of every binary value, byte by byte over all rows at once."""
    data, start, size = _bytes_of(column)
    table, crc = _crc_table(), np.full(len(column), 0xFFFF, np.int64)
    order = np.argsort(-size, kind="stable")
    for at in range(size.max(initial=0)):
        rows = order[: np.searchsorted(-size[order], -at)]
        crc[rows] = (crc[rows] << 8 ^ table[(crc[rows] >> 8 ^ data[start[rows] + at]) & 0xFF]) & 0xFFFF
    return pa.array(crc, pa.int32(), mask=size < 0)


def crc16(data: bytes) -> int:
    """CRC-16/CCITT-FALSE."""
    return crc16_batch(pa.array([data], pa.binary()))[0].as_py()


def with_crc(frames: DataFrame, column: str, out: str = "crc") -> DataFrame:
    """df with the CRC-16/CCITT-FALSE of a binary column; null for null."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([*b.columns, crc16_batch(b.column(b.schema.get_field_index(column)))], names=[*b.schema.names, out])

    return frames.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema) + f", `{out}` int")


def pack_raw(out_size: int, node_id: int, seq: int, ts_us: int, sr_hz: int, samples: Sequence[int]) -> bytes:
    """A raw frame in at most out_size bytes; refuses what does not fit."""
    if len(samples) > 0xFFFF:
        raise ValueError("too many samples")
    if HEADER_BYTES + 2 * len(samples) > out_size:
        raise ValueError("output too small")
    return struct.pack(HEADER, RAW, VERSION, 0, node_id, seq, ts_us, sr_hz, len(samples), 0) + np.asarray(samples, "<i2").tobytes()


def edge_stats(samples: Column) -> dict[str, Column]:
    """Integer one-pass features of a node: count, mean (towards zero), rms and peak (whole), sign changes."""
    n = F.size(samples)
    sums = F.aggregate(samples, F.lit(0).cast("bigint"), lambda a, x: a + x)
    squares = F.aggregate(samples, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint") * x)
    neg = F.transform(samples, lambda x: x < 0)
    flips = F.zip_with(F.slice(neg, 2, F.greatest(n - 1, F.lit(0))), F.slice(neg, 1, F.greatest(n - 1, F.lit(0))), lambda a, b: (a != b).cast("int"))
    ok = n > 0
    return {
        "count": n, "mean": F.when(ok, F.call_function("div", sums, n)).otherwise(0), "rms": F.when(ok, F.floor(F.sqrt(F.call_function("div", squares, n)))).otherwise(0),
        "peak": F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x.cast("int")))), F.lit(0)), "crossings": F.aggregate(flips, F.lit(0), lambda a, x: a + x),
    }


def chunked_lag(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, value: str, out: str) -> DataFrame:
    """df with ``out``: value of the row before, per keys in the given order, which must not run against chunk.

    The window is cut by chunk (say, a day), so that a hot key is spread over its chunks; only the
    last row of each chunk is handed on to the next one.
    """
    w = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    cut = df.withColumn("__chunk", chunk)
    inner = cut.withColumn("__rn", F.row_number().over(w)).withColumn(out, F.lag(value).over(w))
    last = cut.groupBy(*keys, "__chunk").agg(F.max(F.struct(*order, F.col(value).alias("__last"))).alias("__s"))
    over = last.withColumn("__before", F.lag("__s.__last").over(Window.partitionBy(*keys).orderBy("__chunk"))).select(*keys, "__chunk", "__before")
    both = lookup_join(inner, over, [*keys, "__chunk"], "left")
    return both.withColumn(out, F.when(F.col("__rn") == 1, F.col("__before")).otherwise(F.col(out))).drop("__chunk", "__rn", "__before")


def seq_gaps(frames: DataFrame, arrival: str = "received_at", row_id: str = "delivery_id") -> DataFrame:
    """(row_id, node_id, seq, lost, late): frames lost before each delivery, in order of arrival per node.

    lost counts modulo 2^32 against the delivery before, 0 for the first. A modular distance of
    2^31 or more is no loss but a late or repeated frame (late, lost 0). Null nodes and seqs are left
    out. Gaps are reported, never filled.
    """
    rows = frames.filter(F.col("node_id").isNotNull() & F.col("seq").isNotNull() & F.col(arrival).isNotNull()).select(row_id, "node_id", "seq", F.col(arrival).alias("__at"))
    prev = chunked_lag(rows, ["node_id"], ["__at", row_id], F.to_date("__at"), "seq", "__prev")
    step = F.pmod(F.col("seq") - F.col("__prev") - 1, F.lit(1 << 32))
    late = F.coalesce(step >= (1 << 31), F.lit(False))
    return prev.select(row_id, "node_id", "seq", F.when(late, 0).otherwise(F.coalesce(step, F.lit(0))).cast("bigint").alias("lost"), late.alias("late"))


def running_z(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """df with the z of value against all values of its key so far, itself included (population deviation; 1 while there is none)."""
    v = F.col(value).cast("double")
    s = prefix_sums(df, keys, order, {"__n": F.lit(1).cast("bigint"), "__m": v, "__q": v * v})
    m, q = F.col("__m") / F.col("__n"), F.col("__q") / F.col("__n")
    sd = F.when((F.col("__n") > 1) & (q - m * m > 1e-6 * q), F.sqrt(q - m * m)).otherwise(1.0)
    return s.withColumn(out, (v - m) / sd).drop("__n", "__m", "__q")


def framed(df: DataFrame, keys: Sequence[str], samples: str, length: int, hop: int | None = None) -> DataFrame:
    """keys, k, x: one row per window of ``length`` samples of an array column, every ``hop`` (default: length); the rest is dropped."""
    hop = hop or length
    last = F.floor((F.size(samples) - length) / hop).cast("int")
    at = F.when(F.size(samples) >= length, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return df.select(*keys, samples, F.explode(at).alias("k")).select(*keys, "k", F.slice(samples, F.col("k") * hop + 1, F.lit(length)).alias("x"))


def rows_to_windows(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, length: int) -> DataFrame:
    """keys, k, x: scalar rows of a series gathered in windows of ``length`` by their place; an incomplete last window is dropped."""
    placed = numbered(df.select(*keys, *[c for c in order if c not in keys and c != value], F.col(value)), keys, order, "__i").withColumnRenamed(value, "__v").withColumn("k", floor_div(F.col("__i"), length))
    got = placed.groupBy(*keys, "k").agg(F.array_sort(F.collect_list(F.struct("__i", "__v"))).alias("__s")).filter(F.size("__s") == length)
    return got.select(*keys, "k", F.transform("__s", lambda s: s["__v"]).alias("x"))


def detrended(x: Column) -> Column:
    """Least-squares line removed, then z-normed with the population deviation; in the JVM."""
    def line(y: Column) -> Column:
        n = F.size(y)
        c = (n - 1) / F.lit(2.0)
        m = series.mean(y)
        num = F.aggregate(F.transform(y, lambda v, i: v * (i - c)), F.lit(0.0), lambda a, v: a + v)
        den = F.aggregate(F.transform(y, lambda v, i: (i - c) * (i - c)), F.lit(0.0), lambda a, v: a + v)
        return series.let(m, lambda mm: series.let(F.coalesce(F.try_divide(num, den), F.lit(0.0)), lambda b: F.transform(y, lambda v, i: v - mm - b * (i - c))))

    return series.let(series.let(x, line), lambda z: series.let(series.std(z) + series.EPS, lambda s: series.let(series.mean(z), lambda m: F.transform(z, lambda v: (v - m) / s))))


def mean_pooled(x: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / k).cast("int") - 1), lambda i: series.mean(F.slice(x, i * k + 1, F.lit(k))))


def to_int16(x: Column, scale: float = 2047.0) -> Column:
    """Centred, scaled to the ADC range by the largest distance, clipped and cut to whole numbers."""
    def scaled(z: Column) -> Column:
        return series.let(F.greatest(F.array_max(series.absolute(z)), F.lit(1e-12)), lambda top: F.transform(z, lambda v: F.least(F.greatest(v * scale / top, F.lit(-2048.0)), F.lit(2047.0)).cast("smallint")))

    return series.let(series.centred(x), scaled)


def readout(x: np.ndarray, windows: int, length: int = WINDOW, sampling: str = "even", pool: int = 1) -> np.ndarray:
    """Windows of one recording: at even offsets, or greedily where the rolling deviation is largest without overlap."""
    if pool > 1:
        x = kernels.mean_pool(x[None, :], pool)[0]
    if len(x) < length:
        return np.zeros((0, length))
    if sampling == "even":
        starts = np.unique(np.linspace(0, len(x) - length, windows).astype(int))
    else:
        spread = np.lib.stride_tricks.sliding_window_view(x, length).std(axis=1)
        starts = []
        for i in np.argsort(-spread, kind="stable"):
            if all(abs(i - j) >= length for j in starts):
                starts.append(int(i))
            if len(starts) == windows:
                break
        starts = np.array(sorted(starts), int)
    return np.stack([x[i : i + length] for i in starts])


def _applied(column: pa.Array, kernel: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """rows x width: the kernel over the lists of a column, those of one length together; NaN where it has no answer."""
    out = np.full((len(column), width), np.nan)
    size = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        m = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), n)
        fit = np.isfinite(m).all(axis=1)
        if fit.any():
            try:
                out[rows[fit]] = np.asarray(kernel(m[fit]), dtype=np.float64).reshape(int(fit.sum()), width)
            except (ValueError, IndexError):
                pass
    return out


def map_series(df: DataFrame, keys: Sequence[str], x: str, kernel: Callable[[np.ndarray], np.ndarray], names: Sequence[str]) -> DataFrame:
    """keys and one double column per name: kernel(rows x time) over the array column, batch by batch.

    Rows may differ in length; null or empty arrays and null or NaN samples give nulls, as do series
    too short for the kernel.
    """
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                out = _applied(b.column(len(keys)), kernel, len(names))
                yield pa.record_batch([*[b.column(i) for i in range(len(keys))], *[pa.array(out[:, j], from_pandas=True) for j in range(len(names))]], names=[*keys, *names])

    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"`{n}` double" for n in names])
    return df.select(*keys, x).mapInArrow(run, schema)


def map_vectors(df: DataFrame, keys: Sequence[str], x: str, kernel: Callable[[np.ndarray], np.ndarray], width: int, out: str = "features") -> DataFrame:
    """keys and one array<double> column of so many values per row, for kernels with many outputs; see ``map_series``.

    As such kernels are dear, rows are spread over all cores where the input has fewer partitions; a
    row without an answer has a null array.
    """
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                b = whole.slice(at, 128)
                v = _applied(b.column(len(keys)), kernel, width)
                none = np.isnan(v).all(axis=1)
                offsets = pa.array(np.append(0, np.cumsum(np.where(none, 0, width))), pa.int32(), mask=np.append(none, False))
                yield pa.record_batch([*[b.column(i) for i in range(len(keys))], pa.ListArray.from_arrays(offsets, pa.array(v[~none].reshape(-1)))], names=[*keys, out])

    schema = ", ".join([f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys] + [f"`{out}` array<double>"])
    rows, cores = df.select(*keys, x), df.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() < cores:
        rows = rows.repartition(cores)
    return rows.mapInArrow(run, schema)
