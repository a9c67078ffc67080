import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sondewerk.operators import frames as ops
from sondewerk.sources import readers, simulator
from sondewerk.streaming import pipeline, sinks
from tests.conftest import rows


def wav(samples, rate=16000, bits=16, channels=1):
    x = np.asarray(samples)
    data = (x + 128).astype("u1").tobytes() if bits == 8 else x.astype(f"<i{bits // 8}").tobytes()
    fmt = struct.pack("<HHIIHH", 1, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    body = b"WAVE" + b"fmt " + struct.pack("<I", 16) + fmt + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wav_widths_and_channels():
    x = np.array([0, 1, -2, 100, -128])
    for bits in (8, 16, 32):
        assert readers.wav(wav(x, bits=bits))[1].tolist() == x.tolist()
    assert readers.wav(wav([1, 10, 2, 20], channels=2), 1)[1].tolist() == [10, 20]
    for bad in (b"nope", wav([1], channels=1)[:30]):
        with pytest.raises(ValueError):
            readers.wav(bad)
    with pytest.raises(ValueError):
        readers.wav(wav([1, 2]), 3)


def test_text_is_read_leniently_but_not_blindly():
    assert readers.text_column("﻿a,b\r\n1,2\r\n\r\n3,4\r\n".encode(), 1).tolist() == [2, 4]
    good = "\n".join(["1"] * 40 + ["x"])
    assert len(readers.text_column(good.encode())) == 40
    with pytest.raises(ValueError):
        readers.text_column(b"1\nx\ny\n2")
    names, x = readers.channels_of(b"A;B\n1;NaN\n2;3\n", "csv")
    assert names == ["A", "B"] and x.shape == (2, 2) and np.isnan(x[1, 0])


def npy(x):
    f = io.BytesIO()
    np.save(f, x)
    return f.getvalue()


def test_bank_of_files_to_frames_and_back(spark, tmp_path):
    t = np.arange(16000)
    for d in ("one", "two"):
        (tmp_path / d).mkdir()
    (tmp_path / "one" / "normal_1.wav").write_bytes(wav((3000 * np.sin(t * 0.17)).astype(int)))
    (tmp_path / "one" / "fault_1.npy").write_bytes(npy(np.arange(2000.0)))
    (tmp_path / "two" / "normal_2.csv").write_text("v\n" + "\n".join(map(str, range(1100))))
    (tmp_path / "two" / "odd_3.npy").write_bytes(b"broken")
    bank = readers.read_bank(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in bank.collect()}
    assert [got[k].label for k in sorted(got)] == ["fault", "normal", "normal", "odd"] and got["odd_3.npy"].error and got["normal_1.wav"].rate == 16000
    assert sorted(r.g for r in got.values()) == [0, 1, 2, 3] and len(got["normal_1.wav"].x) == 16000
    out = str(tmp_path / "frames")
    readers.frames_of(bank).write.mode("append").parquet(out)
    back = readers.read_frames(spark, out)
    assert back.count() == 31 + 3 + 2 and back.agg(F.max(F.array_max(F.transform("payload", F.abs)))).first()[0] == 2047
    assert back.agg(F.count_distinct("seq")).first()[0] == 36 and back.filter("label = 'normal'").count() == 33
    x, y, g = np.zeros((4, 8)), np.zeros(4), np.zeros(4)
    f = io.BytesIO()
    np.savez(f, X=x, y=y, groups=g)
    assert readers.npz_bank(f.getvalue())[0].shape == (4, 8)
    f = io.BytesIO()
    np.savez(f, X=x, y=y[:2], groups=g)
    with pytest.raises(ValueError):
        readers.npz_bank(f.getvalue())


def test_channel_csv_drops_rows_as_a_unit(spark, tmp_path):
    (tmp_path / "c.csv").write_text("A,B,C\n1,2,3\nnull,5,6\n7,8,9\n")
    df = readers.read_channels(spark, str(tmp_path / "c.csv"), {"A": "a", "C": "c"})
    assert rows(df.select("a", "c")) == [(1.0, 3.0), (7.0, 9.0)]
    with pytest.raises(ValueError):
        readers.read_channels(spark, str(tmp_path / "c.csv"), ["A"])


def test_simulated_frames_do_not_depend_on_partitions(spark):
    a, b = simulator.frames(spark, 64, partitions=1), simulator.frames(spark, 64, partitions=7)
    assert rows(a) == rows(b) and a.filter("label = 'ANOMALY'").count() < 20
    assert set(simulator.CLASSES) - {"unknown"} >= {r.label for r in a.filter("label <> 'ANOMALY'").collect()}
    assert len({tuple(simulator.frame(k, np.random.default_rng(0))) for k in [*simulator.RATES, "anomaly", "other"]}) == 10
    assert simulator.observable("rossler", 5).shape == (500,)


def test_stream_tracks_loss_and_energy_like_the_batch(spark, tmp_path):
    data = [(1, s, i * 1000, float(s)) for i, s in enumerate([0, 1, 4, 5, 4])] + [(2, s, i * 1000, 1.0) for i, s in enumerate([2**32 - 1, 0, 9])] + [(None, 1, 1, 1.0)]
    schema = "node_id bigint, seq bigint, ts_us bigint, energy double"
    for i in range(2):
        part = [r for r in data if (r[2] >= 3000) == bool(i)]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = pipeline.fan_out(pipeline.track(src, None), [sinks.parquet(str(tmp_path / "out")), sinks.lines(str(tmp_path / "ilp")), sinks.points("file://" + str(tmp_path / "pts"))], str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    got = {(r.node_id, r.ts_us): (r.lost, r.late, r.energy_z) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [got[1, i * 1000][:2] for i in range(5)] == [(0, False), (0, False), (2, False), (0, False), (0, True)]
    assert [got[2, i * 1000][0] for i in range(3)] == [0, 0, 8]
    e = np.array([0, 1, 4.0])
    assert got[1, 0][2] == 0 and np.isclose(got[1, 2000][2], (4 - e.mean()) / e.std())
    last = max((tmp_path / "pts").glob("v=*"), key=lambda p: int(p.name[2:]))
    assert spark.read.parquet(str(last)).count() == 7
    assert spark.read.text(str(tmp_path / "ilp")).count() == 8


def test_stream_deduplicates_and_windows(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 5, 1.0), (1, 1, 5, 1.0), (1, 2, 6, 3.0), (2, 1, 5, 1.0)], "node_id bigint, seq bigint, ts_us bigint, energy double").withColumn("received_at", F.timestamp_seconds(F.lit(1_700_000_000)))
    df.write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, s, mode in (("dd", pipeline.first_deliveries(src), "append"), ("ww", pipeline.windowed(src, "received_at", ["node_id"], "1 minute"), "complete")):
        q = s.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert spark.table("dd").count() == 3
    assert rows(spark.table("ww").select("node_id", "n", "energy")) == [(1, 3, 5 / 3), (2, 1, 1.0)]


def test_bad_broker_messages_go_to_the_side(spark):
    ok = bytearray(ops.pack_raw(100, 1, 2, 3, 4, [5]))
    good, bad = readers.parse_mqtt_rows(spark.createDataFrame([(ok,), (bytearray(b"junk"),)], "value binary"))
    assert good.count() == 1 and bad.count() == 1
