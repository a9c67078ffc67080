"""Every query of the subpackage against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from sondewerk.llm import queries
from tests.test_queries import DATA, plain

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"create view {t.split('.')[0]} as select * from '{DATA}/{t}'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = df.select(*cols).collect()
    if name in queries.ORACLES:
        want = c.execute(f"select {', '.join(cols)} from ({queries.ORACLES[name]})").fetchall()
        assert Counter(tuple(map(plain, r)) for r in got) == Counter(tuple(map(plain, r)) for r in want)
    else:
        assert got
