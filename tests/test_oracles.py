"""Every query that has SQL gives the SQL's rows; every other gives rows."""

import math

import duckdb
import pytest

from wavelathe.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows):
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 5) + 0.0
        return v

    return sorted((tuple(map(one, r)) for r in rows), key=repr)


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5 * max(1, abs(a)))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    df = df.select(*sorted(df.columns))
    got = plain(map(tuple, df.collect()))
    if name not in catalog.oracle_sql():
        assert got
        return
    columns = con.execute(f"describe {catalog.oracle_sql()[name]}").fetchall()
    assert sorted(c[0] for c in columns) == df.columns
    cur = con.execute(f"select {', '.join(df.columns)} from ({catalog.oracle_sql()[name]})")
    want = plain(cur.fetchall())
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if not all(map(close, g, w))]
    assert not bad, bad[:3]
