import duckdb
import pytest

from tidewright.operators import corpus
from tidewright.operators import queries as core

QUERIES, ORACLES = core.queries() | corpus.queries(), core.oracle_sql() | corpus.oracle_sql()
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in core.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    found = duck.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=lambda k: names[k])
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    want = sorted((tuple(r[k] for k in order) for r in found.fetchall()), key=key)
    assert sorted(df.columns) == sorted(names)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=key)
    assert got == want
