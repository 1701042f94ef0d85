import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from flowloom.session import local_session

    session = local_session("4", memory="4g", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """DuckDB over the smallest tables."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return con


def plain(v):
    """Values of either engine in one form."""
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def same_rows(df, con, sql):
    """Assert that a DataFrame has the rows of a query, in any order."""
    names = sorted(df.columns)
    found = con.execute(sql)
    there = [d[0] for d in found.description]
    assert sorted(there) == names
    theirs = sorted(repr([plain(r[there.index(c)]) for c in names]) for r in found.fetchall())
    ours = sorted(repr([plain(r[c]) for c in names]) for r in df.collect())
    assert ours == theirs
