"""Readers: recordings in files (WAV, NPY, NPZ, CSV or text), banks of them, frame datasets, live brokers."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondewerk.operators.watch import label_from_path
from sondewerk.util import lookup_join, numbered

#: Share of unreadable rows above which a text recording is refused.
BAD_ROWS = 0.05
#: Texts that stand for a missing value.
MISSING = ("", "nan", "na", "null", "none")
FRAME_SCHEMA = "label string, sensor_class int, sr_hz bigint, ts_us bigint, samples binary"


def wav(content: bytes, channel: int = 0) -> tuple[int, np.ndarray]:
    """(rate, samples) of one channel of PCM WAV with 8 (unsigned), 16 or 32 bits; refuses other widths and channels."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, fmt, data = 12, None, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack_from("<I", content, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(content):
            fmt = struct.unpack_from("<HHIIHH", content, at + 8)
        elif name == b"data":
            data = content[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if fmt is None or data is None:
        raise ValueError("WAV file without format or data")
    _, channels, rate, _, _, bits = fmt
    if channel >= channels:
        raise ValueError(f"channel {channel} of {channels}")
    kinds = {8: "u1", 16: "<i2", 32: "<i4"}
    if bits not in kinds:
        raise ValueError(f"{bits} bits a sample")
    x = np.frombuffer(data, kinds[bits], len(data) // (bits // 8) // channels * channels).reshape(-1, channels)[:, channel].astype(float)
    return rate, x - 128 if bits == 8 else x


def number(text: str) -> float:
    t = text.strip().lower()
    if t in MISSING:
        return float("nan")
    try:
        return float(t)
    except ValueError:
        return float("nan")


def text_table(content: bytes, delimiter: str | None = None) -> tuple[list[str], np.ndarray]:
    """(header or [], rows x columns) of delimited text: BOM, any line ends, blank lines passed over, missing or unreadable cells NaN."""
    lines = [x for x in content.decode("utf-8-sig", "replace").splitlines() if x.strip()]
    if not lines:
        return [], np.zeros((0, 0))
    d = delimiter or next((c for c in ",;\t" if c in lines[0]), None)
    cells = [[c.strip() for c in (x.split(d) if d else x.split())] for x in lines]
    head = cells[0] if any(np.isnan(number(c)) and c.lower() not in MISSING for c in cells[0]) else []
    body = cells[1:] if head else cells
    width = len(head) or max(map(len, body))
    return head, np.array([[number(c) for c in (r + [""] * width)[:width]] for r in body], float).reshape(len(body), width)


def text_column(content: bytes, column: int = 0, delimiter: str | None = None) -> np.ndarray:
    """One numeric column; rows that cannot be read are dropped, but above BAD_ROWS of them the file is refused."""
    _, x = text_table(content, delimiter)
    if column >= x.shape[1]:
        raise ValueError(f"column {column} of {x.shape[1]}")
    v = x[:, column]
    bad = ~np.isfinite(v)
    if len(v) and bad.mean() > BAD_ROWS:
        raise ValueError(f"{bad.sum()} of {len(v)} rows are not numbers")
    return v[~bad]


def npz_bank(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(X, y, groups) of a strict bank file: 2 or 3 numeric dimensions, equal lengths, no pickles."""
    with np.load(io.BytesIO(content), allow_pickle=False) as z:
        if not {"X", "y", "groups"} <= set(z.files):
            raise ValueError("X, y and groups are needed")
        x, y, g = z["X"], z["y"], z["groups"]
    if x.ndim not in (2, 3) or not np.issubdtype(x.dtype, np.number) or not len(x) == len(y) == len(g) or not x.size:
        raise ValueError("X must be numeric with 2 or 3 dimensions, as long as y and groups, and not empty")
    return x.astype(float), y, g


def channels_of(content: bytes, suffix: str, axis: int | None = None) -> tuple[list[str], np.ndarray]:
    """(names, channels x time): multichannel NPY (the shorter axis is the channels unless axis says) or CSV with a header."""
    if suffix == "npy":
        x = np.load(io.BytesIO(content), allow_pickle=False).astype(float)
        if x.ndim != 2:
            raise ValueError("a multichannel array has two dimensions")
        axis = axis if axis is not None else int(np.argmin(x.shape))
        x = x if axis == 0 else x.T
        return [f"ch{i}" for i in range(len(x))], x
    head, x = text_table(content)
    return head or [f"ch{i}" for i in range(x.shape[1])], x.T


def recording(content: bytes, suffix: str, column: int = 0) -> np.ndarray:
    """Samples of one recording file, by its extension; refuses unknown ones."""
    if suffix == "wav":
        return wav(content, column)[1]
    if suffix == "npy":
        x = np.load(io.BytesIO(content), allow_pickle=False).astype(float)
        return x if x.ndim == 1 else channels_of(content, "npy")[1][column]
    if suffix in ("csv", "txt", "dat"):
        return text_column(content, column)
    raise ValueError(f"no reader for .{suffix}")


_BANK = "path string, label string, rate int, x array<double>, error string"


def read_bank(spark: SparkSession, path: str, label_by: str = "prefix", column: int = 0, pattern: str = "*") -> DataFrame:
    """(g, path, label, rate, x, error): one row per recording file below path; g numbers them by path.

    Files that cannot be read have an error and null x: filter on it to go on, or refuse. A file is
    read by one task; the bank is never collected.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, label, content in zip(b["path"], b["label"], b["content"]):
                suffix = p.rsplit(".", 1)[-1].lower()
                try:
                    rate = wav(content, column)[0] if suffix == "wav" else None
                    rows.append((p, label, rate, recording(content, suffix, column), None))
                except Exception as e:
                    rows.append((p, label, None, None, str(e)[:200]))
            yield pd.DataFrame(rows, columns=["path", "label", "rate", "x", "error"]).astype({"rate": "Int32"})

    out = files.select("path", label_from_path(F.col("path"), label_by).alias("label"), "content").mapInPandas(run, _BANK)
    order = numbered(files.select("path"), [], ["path"], "g")
    return lookup_join(out, order, ["path"]).select("g", "path", "label", "rate", "x", "error")


def read_channels(spark: SparkSession, path: str, columns: dict[str, str] | Sequence[str] | None = None, drop_missing: bool = True) -> DataFrame:
    """Aligned channels of a CSV with header: t and one double column per channel, selected and renamed by columns.

    Rows with any missing value are dropped as a unit; fewer than two channels are refused.
    """
    raw = spark.read.option("header", True).csv(path)
    names = columns if isinstance(columns, dict) else {c: c for c in (columns or raw.columns)}
    if len(names) < 2:
        raise ValueError("at least two channels are needed")
    cell = lambda c: F.when(~F.lower(F.trim(F.col(f"`{c}`"))).isin(*MISSING), F.expr(f"try_cast(trim(`{c}`) as double)"))
    out = raw.select(F.monotonically_increasing_id().alias("t"), *[cell(c).alias(n) for c, n in names.items()])
    return out.dropna(how="any") if drop_missing else out


def read_frames(spark: SparkSession, path: str, stream: bool = False, files_per_trigger: int = 1) -> DataFrame:
    """A frame dataset replayed: node 0, seq by recorded time, recorded times kept; a missing sensor class is 0."""
    if stream:
        src = spark.readStream.schema(FRAME_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    else:
        src = spark.read.parquet(path)
    have = src.columns
    out = src.select(
        F.col("label") if "label" in have else F.lit(None).cast("string").alias("label"), F.coalesce(F.col("sensor_class") if "sensor_class" in have else F.lit(None), F.lit(0)).cast("smallint").alias("sensor_class"),
        F.col("sr_hz").cast("bigint").alias("sr_hz"), F.col("ts_us") if "ts_us" in have else F.lit(None).cast("bigint").alias("ts_us"), int16(F.col("samples")).alias("payload"), F.lit(0).cast("bigint").alias("node_id"),
    )
    return out if stream else numbered(out.withColumn("__h", F.xxhash64("payload")), [], ["ts_us", "__h"], "seq").drop("__h")


def int16(binary):
    """Little-endian int16 bytes to array<smallint>, in the JVM."""
    h = F.hex(binary)
    word = lambda i: F.conv(F.concat(F.substring(h, i * 4 + 3, F.lit(2)), F.substring(h, i * 4 + 1, F.lit(2))), 16, 10).cast("int")
    n = F.floor(F.length(binary) / 2).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(word(i) > 32767, word(i) - 65536).otherwise(word(i)).cast("smallint"))).otherwise(F.array().cast("array<smallint>"))


def frames_of(bank: DataFrame, length: int = 512) -> DataFrame:
    """(label, sensor_class, sr_hz, ts_us, samples): recordings cut in frames of whole int16 samples, one gain per recording, the rest dropped."""
    from sondewerk.operators.frames import framed, to_int16

    cut = framed(bank.filter("error is null").select("path", "label", "rate", to_int16(F.col("x")).alias("x")), ["path", "label", "rate"], "x", length)
    text = F.array_join(F.transform("x", lambda s: F.concat(F.substring(F.lpad(F.hex(F.pmod(s.cast("int"), F.lit(65536)).cast("bigint")), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(F.pmod(s.cast("int"), F.lit(65536)).cast("bigint")), 4, "0"), 1, 2))), "")
    return cut.select("label", F.lit(0).alias("sensor_class"), F.coalesce("rate", F.lit(1)).cast("bigint").alias("sr_hz"), (F.col("k").cast("bigint") * (length * 1_000_000) / F.coalesce("rate", F.lit(1))).cast("bigint").alias("ts_us"), F.unhex(text).alias("samples"))


def parse_mqtt_rows(rows: DataFrame, payload: str = "value") -> tuple[DataFrame, DataFrame]:
    """(good, bad) frames of a broker's binary messages (Kafka's value column, or any); bad ones carry their error."""
    from sondewerk.operators.frames import decode

    d = decode(rows, payload)
    return d.filter("error is null").drop("error"), d.filter("error is not null")
