"""Every query of the core against its SQL on the smallest tables."""

import math
import os
from collections import Counter

import duckdb
import pytest

from sondewerk.plans import analytics, detect, edges, grammar, problems, roundtrips, selection, windows

DATA = "/root/testdata/sf0.001"
QUERIES = problems.QUERIES | grammar.QUERIES | analytics.QUERIES | selection.QUERIES | roundtrips.QUERIES | windows.QUERIES | detect.QUERIES | edges.QUERIES
ORACLES = problems.ORACLES | grammar.ORACLES | analytics.ORACLES | selection.ORACLES | roundtrips.ORACLES | windows.ORACLES | detect.ORACLES | edges.ORACLES

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, str)):
        return v
    return round(float(v), 9) + 0.0


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for t in os.listdir(DATA):
        c.execute(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    assert len(set(cols)) == len(cols)
    if name in ORACLES:
        want = duck.execute(f"select {', '.join(f'\"{c}\"' for c in cols)} from ({ORACLES[name]})").fetchall()
        assert Counter(tuple(map(plain, r)) for r in got) == Counter(tuple(map(plain, r)) for r in want)
