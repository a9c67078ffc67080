import numpy as np

from sondewerk.llm import groupsplit
from tests.conftest import rows


def union_find(edges):
    up = {}

    def root(a):
        up.setdefault(a, a)
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {(a, root(a)) for a in up}


def test_components_against_union_find(spark):
    rng = np.random.default_rng(0)
    chain = [(i, i + 1) for i in range(5000, 5060)]
    star = [(i, 9000) for i in range(3000, 3400)]
    loose = [(int(a), int(b)) for a, b in rng.integers(0, 400, (250, 2))]
    edges = chain + star + loose + loose[:20] + [(1, None), (None, 2), (3, 3)]
    got = {(r.node, r.unit) for r in groupsplit.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == union_find(edges)
    assert rows(groupsplit.components(spark.createDataFrame([], "a bigint, b bigint"))) == []


def bank(spark, seed=1, n=400):
    rng = np.random.default_rng(seed)
    recs, wins = [], []
    w = 0
    for g in range(n):
        machine = [None, "Unknown", "N/A", " - "][g % 4] if g % 3 == 0 else f"{'PUMP-' if g % 2 else 'pump '}{0 if g % 5 == 0 else g // 4}"
        recs.append((g, machine, int(rng.integers(0, n)) if g % 11 == 0 else (10**6 if g % 13 == 0 else None), "unit"))
        for k in range(int(rng.integers(0, 12))):
            x = [float(v) for v in rng.standard_normal(64)] if g % 17 else [1.0 + k] * 64
            if g % 19 == 0:
                x[0] = None
            wins.append((w, g if k % 9 else None, "ANOMALY" if g % 6 == 0 else ["normal", None][k == 3], x, "unit"))
            w += 1
    wins.append((w, 10**7, "normal", [1.0] * 64, "unit"))
    return spark.createDataFrame(recs, "g bigint, machine string, parent_g bigint, unit string"), spark.createDataFrame(wins, "window_id bigint, g bigint, y string, windows array<float>, unit string")


def test_units_and_splits(spark):
    recs, wins = bank(spark)
    r, w = recs.collect(), wins.collect()
    edges, by = [], {}
    held = {x.g for x in r}
    for x in r:
        m = "".join(c for c in (x.machine or "").lower() if c.isalnum())
        if m not in ("", "unknown", "na"):
            by.setdefault(m, []).append(x.g)
        if x.parent_g in held:
            edges.append((x.g, x.parent_g))
    for x in w:
        if x.g in held and None not in x.windows:
            by.setdefault(tuple(x.windows), []).append(x.g)
    edges += [(a, v[0]) for v in by.values() for a in v]
    got = groupsplit.units(recs, wins)
    assert {(x.g, x.unit_g) for x in got.collect()} == union_find(edges)
    s = {x.g: (x.unit_g, x.split) for x in groupsplit.assign_splits(recs, wins).collect()}
    assert set(s) == held
    unit_split = {}
    for u, split in s.values():
        assert unit_split.setdefault(u, split) == split
    sizes = {k: 0 for k in groupsplit.SPLITS}
    for x in w:
        if x.g in s:
            sizes[s[x.g][1]] += 1
    n = sum(sizes.values())
    assert abs(sizes["train"] / n - 0.8) < 0.01 and abs(sizes["validation"] / n - 0.1) < 0.01 and abs(sizes["test"] / n - 0.1) < 0.01


def test_light_units_are_annealed_in_shards(spark):
    rng = np.random.default_rng(3)
    data = [(i, float(s), float(rng.integers(0, s + 1))) for i, s in enumerate(rng.integers(1, 5, 9000))] + [(9000, 12_000.0, 0.0)]
    got = groupsplit.split_units(spark.createDataFrame(data, "unit bigint, n double, odd double"), ["odd"], chains=2).toPandas()
    assert len(got) == 9001 and got["unit"].is_unique
    n = {u: (a, b) for u, a, b in data}
    for c in (0, 1):
        tot = sum(v[c] for v in n.values())
        part = [sum(n[u][c] for u in got[got.split_no == k].unit) / tot for k in range(3)]
        assert np.abs(np.array(part) - (0.8, 0.1, 0.1)).max() < 0.02


def test_empty_bank(spark):
    recs, wins = bank(spark, n=4)
    assert rows(groupsplit.assign_splits(recs.limit(0), wins)) == []
    assert len(rows(groupsplit.assign_splits(recs, wins.limit(0)))) == 4
