import math

import numpy as np

from sondewerk.operators import inference
from tests.conftest import rows


def test_auc_with_ties_and_missing_classes(spark):
    rng = np.random.default_rng(0)
    data = [(k, float(rng.integers(0, 8)), bool(rng.random() < 0.3), 1) for k in ("a", "b") for _ in range(200)] + [("c", 1.0, True, 1), ("a", None, True, 1), ("a", float("nan"), False, 1), ("a", 1.0, None, 1)]
    df = spark.createDataFrame(data, "k string, s double, y boolean, auc int")
    got = {r.k: r.auc for r in inference.auc(df, "s", "y", ["k"]).collect()}
    for k in ("a", "b"):
        p = [s for q, s, y, _ in data if q == k and y and s is not None and s == s]
        n = [s for q, s, y, _ in data if q == k and y is False and s is not None and s == s]
        assert math.isclose(got[k], np.mean([(a > b) + 0.5 * (a == b) for a in p for b in n]))
    assert got["c"] is None
    for scores, labels, want in (([1, 2, 3, 4], [0, 0, 1, 1], 1.0), ([4, 3, 2, 1], [0, 0, 1, 1], 0.0), ([1, 3, 2, 4], [0, 0, 1, 1], 0.75), ([1, 1, 1, 1], [0, 1, 0, 1], 0.5)):
        d = spark.createDataFrame([(float(s), bool(y)) for s, y in zip(scores, labels)], "s double, y boolean")
        assert inference.auc(d, "s", "y").first().auc == want


def test_cut_rank_precision(spark):
    df = spark.createDataFrame([(1, 1.0, False), (2, 2.0, False), (3, 3.0, True), (4, 4.0, True), (5, 4.0, False), (6, float("inf"), True)], "i int, s double, y boolean")
    assert rows(inference.best_cut(df, "s", "y"))[0][0] == 3.0
    assert rows(inference.best_cut(df, "s", "y", -1))[0][0] == 4.0
    assert [round(r.pct_rank, 6) for r in inference.percentile_rank(df, "s", ["i"]).orderBy("i").collect()] == [0, 0.2, 0.4, 0.6, 0.8, 1]
    assert inference.precision_at(df, "s", "y", "i", 2).first().precision == 1.0
    g = inference.alarm_gap(df, "s", "y", 3.5).first()
    assert math.isclose(g.gap, 2 / 3 - 1 / 3)


def test_resampling_is_calibrated_and_reproducible(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(v), bool(i % 2)) for i, v in enumerate(rng.standard_normal(120))], "u int, v double, y boolean")
    a, b = inference.bootstrap_mean(df, "u", "v", 300).first(), inference.bootstrap_mean(df.repartition(7), "u", "v", 300).first()
    assert np.allclose(a, b, rtol=0, atol=1e-12) and a.lo < a["mean"] < a.hi and 0.25 < a.hi - a.lo < 0.5
    assert inference.permutation_p(df, "u", "v", "y", 99).first().p > 0.02
    odd = df.withColumn("v", df.v + df.y.cast("int") * 2)
    r = inference.permutation_p(odd, "u", "v", "y", 99).first()
    assert r.p == 0.01 and r.observed > 1
    d = inference.paired(df.withColumnRenamed("v", "s").select("u", "s"), odd.withColumnRenamed("v", "s").select("u", "s"), "u", "s")
    assert d.count() == 120 and d.filter("abs(difference) > 1").count() == 60


def test_holm_spearman_fusion(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "n string, p double")
    got = {r.n: (round(r.p_holm, 6), r.rejected) for r in inference.holm(p, "p", "n").collect()}
    assert got == {"a": (0.04, True), "c": (0.09, False), "b": (0.09, False), "d": (0.5, False)}
    s = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 9.0), (4.0, 5.0), (None, 1.0)], "a double, b double")
    import pandas as pd

    f = pd.DataFrame([(1, 2), (2, 2), (3, 9), (4, 5)]).rank()
    assert math.isclose(inference.spearman(s, "a", "b").first().rho, f[0].corr(f[1]))
    v = spark.createDataFrame([("x", "a", 3.0), ("x", "b", 2.0), ("x", "c", 1.0), ("y", "c", 9.0), ("y", "b", 1.0)], "voter string, item string, score double")
    assert [r.item for r in inference.fuse_rankings(v, "voter", "item", "score").orderBy("place").collect()] == ["a", "c", "b"]


def test_small_exact_tests():
    assert inference.sign_test([1, 1, 1, 1, 1]) == 1 / 32 and inference.sign_test([1, -1, 0]) == 0.75
    assert inference.wilcoxon([1, 2, 3, 4]) == 1 / 16 and inference.wilcoxon([]) == 1.0
    assert abs(inference.wilcoxon(np.arange(-10, 20) + 0.5) - 0.0047) < 0.01
    assert math.isclose(inference.fisher_exact(3, 0, 0, 3), 1 / 20)
    assert inference.kendall_tau([1, 2, 3]) == 1 and inference.kendall_tau([3, 2, 1]) == -1
    assert inference.jaccard_stability([{1, 2}, {2, 3}]) == 1 / 3 and inference.predicted_auc(1.0) == 0.5
    least = inference.smallest_p(["a"] * 3 + ["b"] * 3, 50)
    assert math.isclose(least.by_design, 2 / 20) and math.isclose(least.expected, 6 / 51)


def test_fan_out(spark):
    assert rows(inference.fan_out(spark, range(5), lambda t: t * t)) == [(i, float(i * i)) for i in range(5)]


def test_hash_draws_of_every_row(spark, tmp_path):
    from hashlib import md5

    from sondewerk.plans import analytics

    data = [(i, None if i % 11 == 0 else float(("nan", "inf", "0.5")[min(i % 5, 2)])) for i in range(1, 251)]
    spark.createDataFrame(data, "emb_id bigint, recon_error double").write.parquet(f"{tmp_path}/frame_embeddings.parquet")
    ids = [i for i, v in data if v == 0.5]
    x = [int(md5(f"0-{b}-{i}".encode()).hexdigest()[:8], 16) / 2**32 for i in ids for b in range(1, 101)]
    got = analytics.hash_draws(spark, str(tmp_path)).first()
    assert got["n"] == len(x) > 10_000
    assert abs(got["mean_draw"] - sum(x) / len(x)) < 2e-9 and abs(got["max_draw"] - max(x)) < 2e-9
