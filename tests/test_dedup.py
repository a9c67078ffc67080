from datetime import datetime, timedelta

import numpy as np

from sondewerk.operators import dedup
from tests.conftest import rows

SCHEMA = "delivery_id bigint, node_id bigint, seq bigint, ts_us bigint, received_at timestamp, __cell string, kept_id string"
T0 = datetime(2025, 1, 1)


def table(spark, data):
    return spark.createDataFrame([(*r, "x", "y") for r in data], SCHEMA)


def brute(data, tol=2_000_000):
    by = {}
    for d, n, s, t, at in data:
        if None not in (d, n, s, t):
            by.setdefault((n, s), []).append((t, at is None, at or T0, d))
    out = set()
    for group in by.values():
        run = []
        for r in sorted(group):
            if run and r[0] - run[-1][0] > tol:
                out |= {x[3] for x in run} - {min(run, key=lambda x: x[1:])[3]}
                run = []
            run.append(r)
        out |= {x[3] for x in run} - {min(run, key=lambda x: x[1:])[3]}
    return sorted(((d,) for d in out), key=repr)


def test_random_deliveries_agree_with_brute_force(spark):
    rng = np.random.default_rng(1)
    data = []
    for i in range(3000):
        # a third of all rows under one stuck counter, times close to day borders and before 1970
        hot = i % 3 == 0
        t = int(rng.integers(-3, 4)) * 86_400_000_000 + int(rng.integers(-6_000_000, 6_000_000))
        at = None if rng.random() < 0.05 else T0 + timedelta(seconds=int(rng.integers(0, 9)))
        data.append((i, 1 if hot else int(rng.integers(0, 5)), 0 if hot else int(rng.integers(0, 40)), t, at))
    assert rows(dedup.redelivered(table(spark, data))) == brute(data)


def test_edges_ties_and_nulls(spark):
    data = [
        (1, 1, 1, 0, T0), (2, 1, 1, 2_000_000, T0), (3, 1, 1, 4_000_001, T0),  # exactly at, just beyond the tolerance
        (4, None, 1, 0, T0), (5, None, 1, 0, T0), (6, 1, None, 0, T0), (7, 1, None, 0, T0), (8, 1, 5, None, T0), (9, 1, 5, None, T0), (None, 1, 1, 0, T0),
        (11, 2, 1, 0, None), (10, 2, 1, 0, T0 + timedelta(1)), (12, 2, 1, 0, None),
    ]
    df = table(spark, data)
    assert rows(dedup.redelivered(df)) == [(11,), (12,), (2,)]
    assert dedup.deduplicate(df).count() == len(data) - 3
    assert df.columns == dedup.deduplicate(df).columns


def test_repeated_rows_and_empty_table(spark):
    df = table(spark, [(1, 1, 1, 0, T0)] * 3)
    assert rows(dedup.redelivered(df)) == []
    assert rows(dedup.redelivered(df.limit(0))) == []
    assert dedup.messages(df.limit(0)).count() == 0


def test_batches_against_stored_messages_equal_one_pass(spark):
    rng = np.random.default_rng(2)
    data = [(i, 1, int(rng.integers(0, 30)), int(rng.integers(0, 3)) * 60_000_000 + int(rng.integers(0, 900_000)), T0 + timedelta(seconds=i)) for i in range(400)]
    first, second = table(spark, data[:200]), table(spark, data[200:])
    stored = dedup.kept(first)
    new = dedup.admit(second, stored)
    whole = {r[0] for r in rows(dedup.kept(table(spark, data)).select("kept_id"))}
    assert {r.kept_id for r in stored.collect()} | {r.delivery_id for r in new.select("delivery_id").collect()} == whole


def test_a_late_chain_belongs_to_the_stored_message(spark):
    stored = dedup.kept(table(spark, [(1, 1, 1, -2_000_000, T0)]))
    late = table(spark, [(11, 1, 1, 2_000_000, T0), (12, 1, 1, 0, T0 + timedelta(1)), (13, 1, 1, 4_000_001, T0), (14, None, 1, 0, T0), (15, 2, 1, 0, T0), (15, 2, 1, 0, T0)])
    assert sorted(r.delivery_id for r in dedup.admit(late, stored).collect()) == [13, 14, 15]
    assert rows(dedup.admit(late.limit(0), stored)) == [] and dedup.admit(late, stored.limit(0)).count() == 4
