import numpy as np

from sondewerk.llm import quantiles
from sondewerk.llm.quantiles import Sketch
from tests.conftest import rows

P = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)


def rank_off(values, p, v):
    want = max(1, np.ceil(p * len(values) - 1e-9))
    lo, hi = (values < v).sum() + 1, (values <= v).sum()
    return max(0, lo - want, want - hi)


def test_rank_error_stays_within_the_bound():
    rng = np.random.default_rng(0)
    for x in (rng.lognormal(0, 3, 60_000), np.sort(rng.standard_normal(50_000)), np.repeat([1.0, 2.0, 3.0], 20_000)):
        s = Sketch(64, 4)
        for part in np.array_split(x, 37):
            s.add(part)
        assert s.n == len(x) and sum(len(b) for _, b in s.parts()) < 64 * 4 * 8
        levels = np.log(len(x) / 64) / np.log(4) + 1
        assert s.err <= len(x) * levels / (2 * 64)
        for p, v in zip(P, s.quantiles(P)):
            assert rank_off(x, p, v) <= s.bound()


def test_parts_combine_to_the_same_guarantee(spark):
    rng = np.random.default_rng(1)
    data = [(f"n{min(3, int(i))}", float(v), int(d)) for i, v, d in zip(rng.integers(0, 9, 30_000), rng.lognormal(0, 2, 30_000), rng.integers(0, 4, 30_000))]
    df = spark.createDataFrame(data, "name string, v double, day int").repartition(7)
    days = None
    for d in range(4):
        part = quantiles.merge_sketches(quantiles.sketch(df.filter(f"day = {d}"), "name", "v", 128, 4), 128, 4)
        days = part if days is None else days.unionByName(part)
    for r in quantiles.percentiles(days, P, 128, 4).collect():
        x = np.array([v for n, v, _ in data if n == r.name])
        assert r.n == len(x) and r.rank_error < 0.05 * len(x) + 1
        assert rank_off(x, r.p, r.value) <= r.rank_error


def test_exact_when_small_and_nulls_left_out(spark):
    data = [("a", 3.0), ("a", 1.0), ("a", None), ("a", float("nan")), ("a", 2.0), (None, 9.0), ("b", None), ("c", float("inf")), ("d", 5.0), ("d", 5.0)]
    df = spark.createDataFrame(data, "name string, v double").withColumnRenamed("v", "level")
    got = {(r.name, r.p): (r.value, r.n, r.rank_error) for r in quantiles.percentiles(quantiles.sketch(df, "name", "level"), (0.5, 1.0)).collect()}
    assert got == {("a", 0.5): (2.0, 3, 0.0), ("a", 1.0): (3.0, 3, 0.0), ("c", 0.5): (float("inf"), 1, 0.0), ("c", 1.0): (float("inf"), 1, 0.0), ("d", 0.5): (5.0, 2, 0.0), ("d", 1.0): (5.0, 2, 0.0)}
    assert rows(quantiles.percentiles(quantiles.sketch(df.limit(0), "name", "level"), P)) == []


def test_a_task_hands_on_before_it_holds_too_much(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "HELD", 500)
    data = [(f"g{i % 40}", float(i)) for i in range(4_000)]
    df = spark.createDataFrame(data, "name string, v double").repartition(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        parts = quantiles.sketch(df, "name", "v", 64, 4)
        assert parts.groupBy("name").count().filter("count > 1").count() == 40
        got = {r.name: r.value for r in quantiles.percentiles(parts, (0.5,), 64, 4).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {f"g{i}": float(i + 40 * 49) for i in range(40)}


def test_rank_errors_are_counted_exactly(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 2, 2, 5, 6, 7, 8, 9, 10)] + [("a", None), (None, 1.0)], "name string, v double")
    found = spark.createDataFrame([("a", 0.2, 2.0, 10), ("a", 0.5, 2.0, 10), ("a", 0.6, 8.0, 10)], "name string, p double, value double, n bigint")
    assert rows(quantiles.rank_errors(df, "name", "v", found).select("p", "off")) == [(0.2, 0), (0.5, 1), (0.6, 2)]
