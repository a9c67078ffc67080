import numpy as np
from pyspark.sql import functions as F

from sondewerk import util
from tests.conftest import rows


def test_prefix_sums_and_places(spark):
    rng = np.random.default_rng(0)
    data = [(int(k), i, float(v)) for i, (k, v) in enumerate(zip(np.minimum(rng.integers(0, 6, 2000), 3), rng.integers(0, 9, 2000)))]
    df = spark.createDataFrame(data, "k int, i int, v double").repartition(5)
    got = {r.i: (r.s, r.place) for r in util.numbered(util.prefix_sums(df, ["k"], ["i"], {"s": F.col("v")}), ["k"], ["i"], "place").collect()}
    total, place = {}, {}
    for k, i, v in data:
        total[k] = total.get(k, 0) + v
        assert got[i] == (total[k], place.get(k, 0))
        place[k] = place.get(k, 0) + 1
    assert [r.n for r in util.numbered(df, [], ["i"], "n").orderBy("i").collect()] == list(range(2000))
    assert rows(util.numbered(df.limit(0), [], ["i"], "n")) == []


def test_skewed_and_large_lookups_equal_plain_joins(spark):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(3000)], "k int, i int")
    right = spark.createDataFrame([(k, j) for k in range(400) for j in range(2)], "k int, j int")
    plain = rows(left.join(right, "k"))
    assert rows(util.skew_join(left, right, ["k"], 100).select("k", "i", "j")) == plain
    one = right.filter("j = 0")
    for most in (10**6, 10):
        assert rows(util.lookup_join(left, one, ["k"], max_rows=most).select("k", "i", "j")) == rows(left.join(one, "k"))
    assert util.lookup_join(left, one, ["k"], "left", max_rows=10).count() == 3000


def test_floor_division_of_negative_numbers(spark):
    df = spark.createDataFrame([(-7,), (-6,), (0,), (5,), (6,)], "x bigint")
    assert [r[0] for r in df.select(util.floor_div(F.col("x"), 6)).collect()] == [-2, -1, 0, 0, 1]
