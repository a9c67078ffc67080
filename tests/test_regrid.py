import numpy as np

from sondewerk.operators import regrid
from tests.conftest import rows


def test_imputation_restores_a_periodic_series():
    t = np.arange(256)
    x = np.stack([np.sin(t / 6), 5 + 2 * np.cos(t / 9), t * 0.0 + 3])
    hole = x.copy()
    rng = np.random.default_rng(0)
    gone = rng.random(x.shape) < 0.15
    hole[gone] = np.nan
    got = regrid.ssa_impute(hole)
    assert np.abs(got - x).max() < 0.2
    assert (got[~gone] == hole[~gone]).all()
    empty = np.full((1, 256), np.nan)
    assert np.isnan(regrid.ssa_impute(empty)).all()


def test_periods_against_brute_force(spark):
    rng = np.random.default_rng(1)
    data = []
    for s in range(5):
        # one source with a third of the rows, one with a gap of many chunks, times before 1970
        n = 600 if s == 0 else 300
        t = np.sort(rng.integers(-50_000, 200_000, n)) * 1000
        if s == 1:
            t[-1] += 40_000 * 7000
        data += [(f"s{s},x", int(v), 60_000_000 if s == 0 else 7_000_000, float(v % 97), "p") for v in t]
    data += [("lone", 5, 7_000_000, 1.0, "p"), (None, 5, 7_000_000, 1.0, "p"), ("t", None, 7_000_000, 1.0, "p"), ("u", 5, None, 1.0, "p"), ("v", 5, 0, 1.0, "p"), ("w", 5, 9, None, "p")]
    df = spark.createDataFrame(data, "src string, t bigint, len bigint, value double, period string").repartition(3)
    out = regrid.regular_series(df, "src", "t", "len", "value")
    want = {}
    for s, t, n, v, _ in data:
        if s is not None and t is not None and n:
            want.setdefault((s, n), {}).setdefault(t // n, []).append(v)
    expect = []
    for (s, n), cells in want.items():
        for p in range(min(cells), max(cells) + 1):
            expect.append((s, p * n, len(cells.get(p, [])), p not in cells))
    got = out.select("src", "period_us", "readings", "missing")
    assert rows(got) == sorted(expect, key=repr)
    assert out.filter("missing and value is not null").count() == 0
    assert out.filter("not missing and estimate is not null").count() == 0
    only = regrid.regular_series(df, "src", "t", "len", "value", only_missing=True)
    assert rows(only.select("src", "period_us")) == sorted(((a, b) for a, b, _, m in expect if m), key=repr)
    assert rows(regrid.regular_series(df.limit(0), "src", "t", "len", "value")) == []


def test_imputation_runs_until_it_converges_and_over_borders(spark):
    t = np.arange(256)
    x = np.sin(t / 6)[None, :]
    hole = x.copy()
    hole[0, 100:130] = np.nan
    assert np.isnan(regrid.ssa_impute(hole, iterations=3)[0, 110])  # not converged: no estimate
    assert np.isfinite(regrid.ssa_impute(hole)).all()
    # a gap across the border of two chunks, with too few readings in the first one alone
    data = [("s", p * 1000, 1000, float(np.sin(p / 6))) for p in range(230, 512) if not 250 <= p < 260]
    got = regrid.regular_series(spark.createDataFrame(data, "src string, t bigint, len bigint, v double"), "src", "t", "len", "v").filter("missing").collect()
    assert len(got) == 10 and max(abs(r.estimate - np.sin(r.period_us / 6000)) for r in got) < 0.2


def test_polls_read_every_form_of_time(spark):
    data = [(1, "w", u, ("x", 2.0)) for u in ("2025-01-01T00:10:00Z", "2025-01-01T03:10:00+02:00", "2025-01-01T03:10:00.250Z", "20250101T051000Z", None, "junk")] + [(2, None, "2025-01-01T09:00:00Z", ("x", 1.0)), (3, "w", "2025-01-01T09:00:00Z", None)]
    df = spark.createDataFrame(data, "poll_id int, watcher string, utc string, latest struct<time_tag: string, kp: double>")
    miss = [r.period_us // 3_600_000_000 % 24 for r in regrid.poll_series(df, only_missing=True).collect()]
    assert sorted(miss) == [2, 4]
