"""Every registered query against its SQL, over the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from tessella.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "events documents embeddings pages conversations part".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for n in TABLES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{FOLDER}/{n}.parquet'")
    return c


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = Counter(str(tuple(r[c] for c in cols)) for r in df.collect())
    if name in ORACLE_SQL:
        out = con.execute(ORACLE_SQL[name])
        names = [x[0] for x in out.description]
        assert sorted(names) == cols
        assert got == Counter(str(tuple(r[names.index(c)] for c in cols)) for r in out.fetchall())
    else:
        assert got
