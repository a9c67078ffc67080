import numpy as np
import pytest
from pyspark.sql import functions as F

from sondewerk.operators import frames
from tests.conftest import rows


def test_wire_round_trip_and_bad_frames(spark):
    data = [(7, 3, 1_700_000_000_000_000, 16000, [0, 100, -100, 2047, -2048], 4), (2**32 - 1, 2**32 - 1, 2**62, 1, [-32768, 32767], 255), (1, 2, 3, 4, [], 0), (1, None, 3, 4, [1], 0)]
    df = spark.createDataFrame(data, "n bigint, s bigint, t bigint, r bigint, p array<smallint>, c int")
    wire = df.select(frames.encode(F.col("n"), F.col("s"), F.col("t"), F.col("r"), F.col("p"), F.col("c")).alias("frame"))
    got = [r.frame for r in wire.collect()]
    assert bytes(got[0]) == frames.pack_raw(1024, 7, 3, 1_700_000_000_000_000, 16000, data[0][4])[:26] + b"\x04\x00" + np.array(data[0][4], "<i2").tobytes()
    assert got[3] is None
    d = frames.decode(wire).collect()
    assert [(r.node_id, r.seq, int(r.ts_us), r.sr_hz, r.payload, r.sensor_class) for r in d[:3]] == [(n, s, t, r, [float(v) for v in p], c) for n, s, t, r, p, c in data[:3]]
    bad = [b"", b"x" * 40, bytes(got[0])[:30], b"\x00\x00" + bytes(got[0])[2:]]
    out = frames.decode(spark.createDataFrame([(bytearray(b),) for b in bad], "frame binary")).collect()
    assert [r.error for r in out] == ["short", "version", "payload", "magic"] and all(r.node_id is None for r in out)
    spec = bytearray(frames.struct.pack(frames.HEADER, frames.SPECTRUM, 1, 1, 5, 6, 7, 8, 2, 3) + np.array([0.5, -1.5], "<f4").tobytes())
    s = frames.decode(spark.createDataFrame([(spec,)], "frame binary")).first()
    assert s.is_spectrum and s.payload == [0.5, -1.5]
    with pytest.raises(ValueError):
        frames.pack_raw(30, 1, 1, 1, 1, [1, 2])


def test_checksum_and_edge_features(spark):
    assert frames.crc16(b"123456789") == 0x29B1
    df = spark.createDataFrame([([-4, -2, 0, 2, 4, 2, -2],), ([],), ([-32768, -32768],)], "x array<smallint>")
    got = rows(df.select(*[c.alias(n) for n, c in frames.edge_stats(F.col("x")).items()]))
    assert (7, 0, 2, 4, 2) in got and (0, 0, 0, 0, 0) in got and (2, -32768, 32768, 32768, 0) in got
    got = frames.with_crc(spark.createDataFrame([(bytearray(b"123456789"),), (None,), (bytearray(b""),), (bytearray(b"A"),)], "b binary").repartition(1), "b").collect()
    assert {bytes(r.b) if r.b is not None else None: r.crc for r in got} == {b"123456789": 0x29B1, None: None, b"": 0xFFFF, b"A": 0xB915}


def test_gaps_wraps_and_late_frames(spark):
    seqs = [0, 1, 4, 4, 2, 5, 2**32 - 1, 0, 3]
    df = spark.createDataFrame([(i, 1 if i < 6 else 2, s, i, "x") for i, s in enumerate(seqs)] + [(90, None, 1, 1, "x"), (91, 1, None, 1, "x")], "delivery_id bigint, node_id bigint, seq bigint, day int, __prev string")
    df = df.withColumn("received_at", F.timestamp_seconds(F.col("day") * 40_000))
    got = {r.delivery_id: (r.lost, r.late) for r in frames.seq_gaps(df).collect()}
    assert got == {0: (0, False), 1: (0, False), 2: (2, False), 3: (0, True), 4: (0, True), 5: (2, False), 6: (0, False), 7: (0, False), 8: (2, False)}
    assert rows(frames.seq_gaps(df.limit(0))) == []


def test_framing_and_readout(spark):
    df = spark.createDataFrame([(1, list(range(10))), (2, [1]), (3, None)], "g int, x array<int>")
    assert rows(frames.framed(df, ["g"], "x", 4).select("g", "k", "x")) == [(1, 0, [0, 1, 2, 3]), (1, 1, [4, 5, 6, 7])]
    assert frames.framed(df, ["g"], "x", 4, 3).count() == 3
    long = spark.createDataFrame([(1, i, float(i)) for i in range(10)], "g int, i int, v double")
    assert rows(frames.rows_to_windows(long, ["g"], ["i"], "v", 4).select("k", "x")) == [(0, [0.0, 1.0, 2.0, 3.0]), (1, [4.0, 5.0, 6.0, 7.0])]
    x = np.zeros(100)
    x[60:70] = np.arange(10) * 9.0
    assert frames.readout(x, 3, 20).shape == (3, 20)
    peak = frames.readout(x, 1, 20, "peak")
    assert peak.std() > 20 and frames.readout(x, 2, 200).shape == (0, 200)
    assert frames.readout(x, 2, 20, pool=2).shape == (2, 20)


def test_kernels_over_ragged_and_dirty_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, []), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [1.0, 2.0, 6.0])], "i int, x array<double>")
    got = {r.i: r.m for r in frames.map_series(df, ["i"], "x", lambda x: x.mean(axis=1), ["m"]).collect()}
    assert got == {1: 1.5, 2: None, 3: None, 4: None, 5: None, 6: 3.0}
