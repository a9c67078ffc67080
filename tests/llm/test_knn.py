import numpy as np

from sondewerk.llm import knn
from tests.conftest import rows


def clustered(n, seed=0, spread=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, 32))
    return (centres[rng.integers(0, len(centres), n)] + spread * rng.standard_normal((n, 32)) * rng.uniform(0.2, 1, (n, 1))).astype(np.float32)


def brute(x, ids, query, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u[ids.index(query)]
    s[ids.index(query)] = -2
    return {ids[i] for i in np.argsort(-s)[:k]}


def frame(spark, pairs):
    return spark.createDataFrame([(i, v, 0, "t") for i, v in pairs], "emb_id bigint, vector array<float>, sub int, tbl string")


def test_recall_against_brute_force(spark):
    x = clustered(4000)
    ids = list(range(1, 4001))
    df = frame(spark, [(i, v.tolist()) for i, v in zip(ids, x)])
    asked = ids[::100]
    got = {}
    for r in knn.nearest(df, spark.createDataFrame([(i, "q") for i in asked], "emb_id bigint, vector string")).collect():
        got.setdefault(r.query, set()).add(r.id)
    recall = np.mean([len(got[q] & brute(x.astype(float), ids, q, 5)) / 5 for q in asked])
    assert all(len(v) == 5 for v in got.values()) and recall >= 0.97
    asked_df = spark.createDataFrame([(i,) for i in asked], "emb_id bigint")
    r = knn.recall(df, asked_df).first()
    assert (r.asked, r.neighbours, r.scanned) == (40, 200, 0) and abs(r.found - 200 * recall) <= 1


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(4)
    bits, radius = 10, knn.TABLES * (knn.RADII[0] + 1) - 1
    masks = knn.flip_masks(bits, 0, knn.RADII[0])
    assert len(masks) == 1 + 10 + 45 and len(knn.flip_masks(bits, 3, 3)) == 120
    code = rng.integers(0, 1 << bits, knn.TABLES)
    for _ in range(200):
        other = code.copy()
        for b in rng.choice(bits * knn.TABLES, radius, replace=False):
            other[b // bits] ^= 1 << (b % bits)
        assert any(o in c ^ masks for o, c in zip(other, code))


def test_far_neighbours_are_found_by_the_wider_search(spark):
    x = np.random.default_rng(2).standard_normal((700, 32)).astype(np.float32)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)])
    r = knn.recall(df, df.select("emb_id").filter("emb_id % 10 = 0")).first()
    assert (r.asked, r.neighbours, r.scanned) == (70, 350, 0) and r.found >= 0.95 * 350


def test_copies_unusable_vectors_and_small_tables(spark):
    x = clustered(60, 3)
    bad = [(100, None), (101, [0.0] * 32), (102, [float("nan")] * 32), (103, [1.0] * 31), (104, [None] + [1.0] * 31), (None, [1.0] * 32)]
    copies = [(200 + i, x[0].tolist()) for i in range(40)]
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)] + bad + copies + copies[:5])
    asked = spark.createDataFrame([(0,), (200,), (239,), (100,), (101,), (999,), (7,)], "emb_id bigint")
    got = {}
    for r in knn.nearest(df, asked).collect():
        got.setdefault(r.query, []).append(r.id)
    assert sorted(got) == [0, 7, 200, 239]
    assert sorted(got[0]) == [200, 201, 202, 203, 204]
    assert sorted(got[239]) == [0, 200, 201, 202, 203]
    assert sorted(got[200]) == [0, 201, 202, 203, 204]
    two = frame(spark, [(1, x[0].tolist()), (2, x[1].tolist())])
    assert rows(knn.nearest_pairs(two, two)) == [(1, 2)]
    assert rows(knn.nearest_pairs(two.limit(0), two)) == []


def test_queries_amid_a_dense_cluster_are_scanned(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = clustered(900, 7)
    x[::3] = x[0] + 0.02 * rng.standard_normal((300, 32))
    ids = list(range(900))
    df = frame(spark, [(i, v.tolist()) for i, v in zip(ids, x)])
    asked = df.select("emb_id").filter("emb_id % 45 = 0 or emb_id % 100 = 1")
    monkeypatch.setattr(knn, "HOT_ROWS", 40)
    monkeypatch.setattr(knn, "SCAN_QUERIES", 7)
    monkeypatch.setattr(knn, "SCAN_VECTORS", 200)
    got = {}
    how = {}
    for r in knn.nearest(df, asked).collect():
        got.setdefault(r.query, set()).add(r.id)
        how[r.query] = r.how
    assert {how[q] for q in range(0, 900, 45)} == {"scan"} and "index" in how.values()
    assert all(got[q] == brute(x.astype(float), ids, q, 5) for q in range(0, 900, 45))
