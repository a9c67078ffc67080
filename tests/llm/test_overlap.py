import numpy as np

from sondewerk.llm import overlap
from tests.conftest import rows


def table(spark, data):
    return spark.createDataFrame([(*r, "x", 1) for r in data], "window_id bigint, bank string, split string, windows array<float>, rep string, held int")


def brute(data):
    out = set()
    good = [(i, s, np.array([np.nan if v is None else v for v in w], float)) for i, _, s, w in data if i is not None and w is not None and len(w) == 64]
    for i, s, x in good:
        for j, t, y in good:
            if s == "fit" and t in ("eval", "replication"):
                ok = np.isfinite(x) & np.isfinite(y)
                if ok.sum() > 1 and x[ok].std() > 0 and y[ok].std() > 0 and np.corrcoef(x[ok], y[ok])[0, 1] >= 0.97:
                    out.add((i, j))
    return out


def test_pairs_against_brute_force(spark):
    rng = np.random.default_rng(0)
    data, i = [], 0
    for k in range(260):
        base = rng.standard_normal(64) if k % 2 else np.cumsum(rng.standard_normal(64))
        if k % 9 == 0:
            base[k % 64] += 40  # a window that is one spike
        for copy in range(3):
            split = ("fit", "eval", "replication", None)[rng.integers(0, 4)]
            x = base * rng.uniform(0.1, 50) + rng.normal(0, 9) + rng.standard_normal(64) * base.std() * rng.choice([0, 0.03, 0.1, 0.2])
            if copy == 2 and k % 5 == 0:
                x = -x
            w = x.astype(np.float32).tolist()
            if k % 7 == 0:
                w[int(rng.integers(64))] = None
            if k % 31 == 0:
                w[3] = float("nan")
            data.append((i, "b", split, w))
            i += 1
    flat = [1.0] * 64
    data += [(i, "b", "fit", flat), (i + 1, "b", "eval", flat), (i + 2, "b", "eval", None), (i + 3, "b", "eval", [1.0] * 9), (None, "b", "fit", data[0][3]), (i + 4, "b", "eval", [None] * 64)]
    # copies of one window hold a third of the rows
    data += [(10_000 + c, "b", "fit" if c % 9 else "eval", data[1][3]) for c in range(300)]
    df = table(spark, data)
    got = {(r.window_train, r.window_held) for r in overlap.overlap_pairs(df).collect()}
    want = brute(data)
    assert got <= want
    assert len(got) >= 0.99 * len(want)
    pairs, members = overlap.overlaps(df)
    assert pairs.count() < len(want)
    assert members.filter("window_id >= 10000").select("rep").distinct().count() == 2
    report = {(r.split, r.bank): r.overlapping for r in overlap.overlap_report(df).collect()}
    for s in ("eval", "replication"):
        assert report[s, "b"] == len({j for _, j in got if dict((r[0], r[2]) for r in data)[j] == s})


def test_nothing_to_compare(spark):
    df = table(spark, [(1, "b", "fit", [float(i) for i in range(64)])])
    assert rows(overlap.overlap_pairs(df)) == []
    assert rows(overlap.overlap_pairs(df.limit(0))) == []


def test_minwise_similarity_follows_the_correlation():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2, 64))
    x[1] = 0.97 * x[0] + np.sqrt(1 - 0.97**2) * x[1]
    c, o = overlap._plan(64, 256, 2000, 3)
    s = overlap.minwise(x, c, o)
    a = (np.sign(((x - x.mean(1, keepdims=True)) @ c)[0]) == np.sign(((x - x.mean(1, keepdims=True)) @ c)[1])).sum()
    assert abs((s[0] == s[1]).mean() - a / (512 - a)) < 0.04


def test_hot_buckets_are_cut_without_loss(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.standard_normal(64)
    # a third of the windows lie close together, but are no copies
    data = [(i, "b", "fit" if i % 2 else "eval", ((base if i % 3 == 0 else rng.standard_normal(64)) + 0.05 * rng.standard_normal(64)).tolist()) for i in range(240)]
    df = table(spark, data)
    plain = rows(overlap.overlap_pairs(df).select("window_train", "window_held"))
    cut = []
    join = overlap.skew_join
    monkeypatch.setattr(overlap, "skew_join", lambda *a, **k: cut.extend(k.get("hot") or []) or join(*a, **k))
    monkeypatch.setattr(overlap, "HOT_ROWS", 7)
    monkeypatch.setattr(overlap, "SEEN", 2)
    assert rows(overlap.overlap_pairs(df).select("window_train", "window_held")) == plain
    assert set(plain) == brute(data) and len(plain) == 40 * 40 and cut


def test_windows_with_gaps_are_all_compared(spark, monkeypatch):
    rng = np.random.default_rng(8)
    data = []
    for k in range(60):
        base = rng.standard_normal(64) * 10.0 ** rng.integers(-3, 4)
        base[k % 64] += (0, 10, 1e6)[k % 3] * base.std()
        x, y = base.tolist(), (base * 3 + 1 + rng.standard_normal(64) * (0, 0.3)[k % 2] * np.median(np.abs(base))).tolist()
        for at in {k % 64, *rng.integers(0, 64, (0, 3, 15)[k % 3]).tolist()}:
            y[at] = (None, float("nan"), float("inf"))[k % 3]
        if k % 5 == 0:
            x[int(rng.integers(64))] = None  # a gap on both sides
        data += [(2 * k, "b", "fit", x), (2 * k + 1, "b", "eval", y)]
        if k % 2:
            data[-2:] = [(2 * k, "b", "fit", y), (2 * k + 1, "b", "replication", x)]
    data += [(1000, "b", "fit", [1.0] * 63 + [None]), (1001, "b", "eval", [None] * 63 + [2.0]), (1002, "b", "eval", [None] * 64)]
    df = table(spark, data)
    want = brute([(i, b, s, [None if v is None else float(np.float32(v)) for v in w]) for i, b, s, w in data])
    assert len(want) >= 40
    for block in (overlap.SCAN_BLOCK, 7):
        monkeypatch.setattr(overlap, "SCAN_BLOCK", block)
        got = [tuple(r) for r in overlap.overlap_pairs(df).select("window_train", "window_held").collect()]
        assert len(got) == len(set(got)) and set(got) == want
