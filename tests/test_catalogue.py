import math

import duckdb
import pandas as pd
import pytest

from pagewright.plans.catalogue import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "pages", "embeddings"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NaT or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float):
        return f"{x:.6g}"
    return str(x).removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    got = df.collect()
    assert got
    if name in ORACLE_SQL:
        cur = duck.execute(ORACLE_SQL[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == sorted(df.columns)
        want = [[r[names.index(c)] for c in df.columns] for r in cur.fetchall()]
        assert sorted([plain(x) for x in r] for r in got) == sorted([plain(x) for x in r] for r in want)
