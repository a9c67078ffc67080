import numpy as np

from sondewerk.operators import anomaly
from sondewerk.util import exact_median
from tests.conftest import rows


def test_details_bound_every_value_of_any_length():
    rng = np.random.default_rng(0)
    lengths = np.array([0, 1, 2, 3, 5, 17, 64, 100])
    v = rng.integers(-3000, 3000, lengths.sum())
    starts = np.cumsum(lengths) - lengths
    approx, details = anomaly.haar_levels(v, starts, lengths)
    for s, n, x, d in zip(starts, lengths, approx, details):
        if n:
            assert len(d) == np.ceil(np.log2(n)) and (np.abs(v[s : s + n] - x) <= d.sum() + 1e-9).all()
    assert not anomaly.haar_levels(np.full(9, 7), np.array([0]), np.array([9]))[1][0].any()


def test_thresholds_are_scaled_and_add_up_to_the_limit(spark):
    scales = spark.createDataFrame([(1, 0, 2.0), (1, 1, 1.0), (1, 2, 1.0), (2, 0, 0.0)], "source bigint, level int, scale double")
    limits = spark.createDataFrame([(1, 40.0), (2, 32.0)], "source bigint, limit double")
    got = {r.source: [(x.level, round(x.threshold, 6)) for x in r.levels] for r in anomaly.thresholds(scales, limits).collect()}
    assert got == {1: [(-1, 8.0), (0, 16.0), (1, 8.0), (2, 8.0)], 2: [(-1, 16.0), (0, 16.0)]}


def test_levels_of_frames(spark):
    rng = np.random.default_rng(8)
    data = [(i, i % 2, i, i * 10_000_000, (rng.standard_normal(16) * 20 * (1 + i % 2)).astype(int).tolist()) for i in range(80)]
    data[10][4][5] = 1500
    got = {(r.source, r.level): r for r in anomaly.frame_levels(frames(spark, data)).collect()}
    assert sorted(got) == [(s, j) for s in (0, 1) for j in range(-1, 4)]
    for s in (0, 1):
        finest = np.median([np.abs(np.diff(np.array(r[4]).reshape(-1, 2), axis=1)).max() / 2 for r in data if r[1] == s])
        assert finest / 1.2 <= got[s, 0].scale <= finest * 1.2 and got[s, 0].frames == 40
    assert got[0, 0].above == 1 and got[1, 0].above == 0


FRAME = "delivery_id bigint, node_id bigint, seq bigint, ts_us bigint, payload array<smallint>, source string, kind string"


def frames(spark, data):
    return spark.createDataFrame([(*r, "s", "k") for r in data], FRAME)


def test_frames_against_the_definition(spark):
    rng = np.random.default_rng(3)
    data, i = [], 0
    for node in range(4):
        for s in range(60):
            x = (rng.standard_normal(20 + node) * 10 * (node + 1)).astype(int)
            if s in (5, 17):
                x[3] = 1900 if node else -1900
            if s == 9:
                x[0] = 2100
            if s in (20, 21):
                x = np.arange(20)
            if s == 30 or (node == 3 and s % 2 == 0):
                x = np.full(20, 4)
            i += 1
            data.append((i, node, s, s * 10_000_000, x.tolist()))
            if s == 40:  # a redelivery is no second message
                i += 1
                data.append((i, node, s, s * 10_000_000 + 500_000, x.tolist()))
    want = set()
    for node in range(4):
        mine = [r for r in data if r[1] == node]
        med = np.median(np.concatenate([r[4] for r in mine]))
        reach = {r[0]: max(abs(np.array(r[4]) - med)) for r in mine}
        usual = max(np.median(list(reach.values())), 4)
        flat = {r[2]: len(set(r[4])) == 1 for r in mine}
        for r in mine:
            bad = min(r[4]) < -2048 or max(r[4]) > 2047 or reach[r[0]] > 8 * usual
            if np.mean(list(flat.values())) < 0.5:
                bad |= flat[r[2]] or len({q[2] for q in mine if q[4] == r[4]}) > 1
            if bad:
                want.add(r[0])
    got = anomaly.bad_frames(frames(spark, data))
    assert {r.delivery_id for r in got.collect()} == want
    assert got.columns == ["delivery_id", "impossible", "spike", "stuck"]


def test_frames_with_nulls_repeats_and_nothing(spark):
    data = [(1, None, 1, 0, [9000]), (2, 1, 1, 0, None), (3, 1, 2, 0, []), (None, 1, 3, 0, [9000]), (5, 1, None, None, [9000]), (6, 1, 7, 0, [None, 5, 6]), (7, 1, 8, 0, [None, None]), (8, 1, 9, 0, [9000, 1]), (8, 1, 9, 0, [9000, 1])]
    assert {r.delivery_id for r in anomaly.bad_frames(frames(spark, data)).filter("impossible").collect()} == {5, 8}
    assert rows(anomaly.bad_frames(frames(spark, data[:1]).limit(0))) == []


EMB = "emb_id bigint, node_id bigint, seq bigint, ts_us bigint, energy_rms double, energy_peak double, rms string, kind string"


def test_energies_against_the_definition(spark):
    rng = np.random.default_rng(4)
    data = []
    for i in range(900):
        node = 0 if i % 3 == 0 else i % 5 + 1
        rms = float(np.exp(rng.normal(node, 0.3)))
        peak = rms * 3
        u = rng.random()
        if u < 0.02:
            rms *= 20
            peak *= 20
        elif u < 0.04:
            rms, peak = rms / 30, peak / 30
        elif u < 0.06:
            rms = [float("nan"), float("inf"), -1.0, None][i % 4]
        elif u < 0.09 and node == 2:
            rms = 7.25
        elif u < 0.1:
            peak = rms / 2
        data.append((i, node if i % 50 else None, i // 7, i * 1000, rms, peak, "r", "k"))
    df = spark.createDataFrame(data, EMB)
    want = set()
    ok = lambda v: v is not None and np.isfinite(v) and v > 0
    for i, node, s, _, rms, peak, *_ in data:
        for v in (rms, peak):
            if v is not None and (v < 0 or not np.isfinite(v)):
                want.add(i)
        if rms is not None and peak is not None and (peak < rms):
            want.add(i)
        if node is None:
            continue
        mine = [r for r in data if r[1] == node]
        for v, c in ((rms, 4), (peak, 5)):
            med = np.median([r[c] for r in mine if ok(r[c])])
            if ok(v) and (v > 8 * med or v * 8 < med):
                want.add(i)
        if rms is not None and np.isfinite(rms) and len({r[2] for r in mine if r[4] == rms}) >= 5:
            want.add(i)
    assert {r.emb_id for r in anomaly.bad_energies(df).collect()} == want
    assert rows(anomaly.bad_energies(df.limit(0))) == []


def test_exact_median_of_ties_and_even_counts(spark):
    rng = np.random.default_rng(5)
    data = [(k, float(v)) for k, n in ((1, 1), (2, 2), (3, 501), (4, 1000)) for v in np.exp(rng.normal(0, 3, n))] + [(5, 2.0)] * 300 + [(5, 3.0)] * 300
    got = {r.k: r.m for r in exact_median(spark.createDataFrame(data, "k int, v double"), ["k"], "v", "m").collect()}
    for k in range(1, 6):
        assert abs(got[k] - np.median([v for q, v in data if q == k])) < 1e-12


def test_polls(spark):
    day = [(h // 8 + 1, h % 8 * 3) for h in range(40)]
    kp = [2.0] * 40
    kp[5], kp[20] = 8.0, None
    for i in range(25, 38):
        kp[i] = 3.33
    data = [(i, "a", (f"2025-01-{d:02d}T{h:02d}:00:00", kp[i] if kp[i] is not None else 99.0), "z") for i, (d, h) in enumerate(day)]
    data += [(100, "a", None, "z"), (101, None, ("2025-01-01T00:00:00", 12.0), "z"), (102, "a", ("nonsense", -1.0), "z"), (103, "a", data[5][2], "z")]
    df = spark.createDataFrame(data, "poll_id bigint, watcher string, latest struct<time_tag: string, kp: double>, bin string")
    got = {r.poll_id: (r.impossible, r.spike, r.stuck) for r in anomaly.bad_polls(df).collect()}
    assert got[20] == got[101] == got[102] == (True, False, False)
    assert got[5] == got[103] == (False, True, False)
    assert all(got[i] == (False, False, True) for i in range(25, 38))
    assert all(got[i][2] for i in range(6, 20))  # 14 bins of 2.0 before the bad one, and on to 24
    assert rows(anomaly.bad_polls(df.limit(0))) == []
