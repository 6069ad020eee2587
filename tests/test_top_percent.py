"""TOP PERCENT wherever a query may stand: no window over the whole table, and the rows that SQL asks for."""

import math

import pytest

from tidewright.operators import queries as core
from tidewright.operators import session as sessions

DATA = "/root/testdata/sf0.001"
FIRST = "SELECT TOP 10 PERCENT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def session(spark):
    return core.Session(spark, core.parquet_tables(spark, DATA, core.TABLES))


@pytest.fixture(scope="module")
def first(spark):
    rows = spark.read.parquet(f"{DATA}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice").collect()
    return sorted(rows, key=lambda r: (-r.o_totalprice, r.o_orderkey))[: math.ceil(len(rows) / 10)]


def test_catalogue_query_has_no_window(spark):
    df = core.queries()["top_percent_in_subquery"](spark, DATA)
    assert "Window" not in plan(df) and "SinglePartition, ENSURE_REQUIREMENTS" in plan(df)  # one row of counts for each task


@pytest.mark.parametrize(
    "sql",
    [
        f"SELECT t.o_orderkey FROM ({FIRST}) t",
        f"WITH a AS (SELECT * FROM orders), t AS ({FIRST.replace('FROM orders', 'FROM a')}) SELECT o_orderkey FROM t",
        f"WITH a AS (SELECT * FROM orders) {FIRST.replace('FROM orders', 'FROM a')}",
        f"WITH orders2 AS (SELECT o_orderkey AS k FROM orders) SELECT k AS o_orderkey FROM orders2 WHERE k IN ({FIRST.replace(', o_custkey, o_totalprice FROM', ' FROM')})",
        f"SELECT 1 AS o_orderkey WHERE 1 = 0 UNION ALL SELECT t.o_orderkey FROM ({FIRST}) t",
        f"SELECT a.o_orderkey FROM ({FIRST}) a JOIN ({FIRST}) b ON a.o_orderkey = b.o_orderkey",
        f"SELECT t.o_orderkey FROM region r CROSS APPLY ({FIRST}) t WHERE r.r_regionkey = 0",
        f"DECLARE @p INT = 10; SELECT t.o_orderkey FROM ({FIRST.replace('TOP 10', 'TOP (@p)')}) t",
    ],
)
def test_first_rows(session, first, sql):
    df = session.query(sql)
    assert "Window" not in plan(df)
    assert sorted(r.o_orderkey for r in df.collect()) == sorted(r.o_orderkey for r in first)


def test_ranges_divided_again(session, first, monkeypatch):
    monkeypatch.setattr(sessions, "FEW", 3)
    assert [r.o_orderkey for r in session.query(FIRST).collect()] == [r.o_orderkey for r in first]


def test_under_insert_and_delete(session, first):
    n = session.query("SELECT COUNT(*) AS n FROM orders").first().n
    session.sql(f"SELECT * INTO kept FROM orders WHERE 1 = 0; INSERT INTO kept (o_orderkey, o_custkey, o_totalprice) {FIRST}; WITH t AS ({FIRST}) DELETE FROM t")
    assert {r.o_orderkey for r in session.query("SELECT o_orderkey FROM kept").collect()} == {r.o_orderkey for r in first}
    left = {r.o_orderkey for r in session.query("SELECT o_orderkey FROM orders").collect()}
    assert not left & {r.o_orderkey for r in first} and len(left) == n - len(first)


# 900 equal rows, few lesser and greater ones, and nulls
VALUES = [None] * 7 + [1, 2, 2, 3] + [5] * 900 + [6, 7, 8]


@pytest.mark.parametrize("direction", ["ASC", "DESC"])
@pytest.mark.parametrize("percent", ["0", "1.2", "50", "99.5"])
def test_equal_rows_and_ties(spark, monkeypatch, percent, direction):
    monkeypatch.setattr(sessions, "FEW", 2)
    session = core.Session(spark, {"t": spark.createDataFrame([(v,) for v in VALUES], "v int").repartition(4)})
    key = lambda v: (v is not None, v or 0)
    ordered = sorted(VALUES, key=key, reverse=direction == "DESC")
    n = math.ceil(round(float(percent) * len(VALUES) / 100, 9))
    ties = [v for v in ordered if n and (v in ordered[:n])]
    for how, want in (("", ordered[:n]), ("WITH TIES", ties)):
        df = session.query(f"SELECT s.v FROM (SELECT TOP ({percent}) PERCENT {how} v FROM t ORDER BY v {direction}) s")
        assert "Window" not in plan(df)
        assert sorted((r.v for r in df.collect()), key=key) == sorted(want, key=key)


def test_without_order(session):
    rows = session.query("SELECT s.n_nationkey FROM (SELECT TOP 30 PERCENT n_nationkey FROM nation) s")
    assert "Window" not in plan(rows) and len({r.n_nationkey for r in rows.collect()}) == 8
    assert len(session.query("SELECT TOP 30 PERCENT n_nationkey, NULL AS x, MAP(1, n_nationkey) AS m FROM nation ORDER BY (SELECT NULL)").collect()) == 8
    assert len(session.query("SELECT TOP 30 PERCENT WITH TIES n_nationkey FROM nation ORDER BY (SELECT NULL)").collect()) == 25


def test_share_times_rows_beyond_an_int(spark):
    session = core.Session(spark, {"t": spark.range(10)})
    assert len(session.query("SELECT TOP (2000000000) PERCENT id FROM t ORDER BY id").collect()) == 10


def test_names_given_twice(session):
    df = session.query("WITH a AS (SELECT * FROM nation) SELECT TOP 20 PERCENT a.n_nationkey, b.n_nationkey FROM a JOIN nation b ON a.n_nationkey = b.n_nationkey ORDER BY a.n_nationkey DESC")
    assert df.columns == ["n_nationkey", "n_nationkey"] and [tuple(r) for r in df.collect()] == [(k, k) for k in (24, 23, 22, 21, 20)]


def test_what_depends_on_an_outer_row_or_a_call_stays_late(session):
    per = "SELECT r.r_regionkey, t.k FROM region r CROSS APPLY (SELECT TOP 40 PERCENT n_nationkey AS k FROM nation WHERE n_regionkey = r.r_regionkey ORDER BY n_nationkey) t"
    nations = session.query("SELECT n_regionkey, n_nationkey FROM nation").collect()
    want = {(r, k) for r in {n[0] for n in nations} for k in sorted(n[1] for n in nations if n[0] == r)[:2]}
    assert {tuple(r) for r in session.query(per).collect()} == want
    session.sql("CREATE TABLE v (k INT); INSERT INTO v VALUES (1), (2)")
    session.sql("CREATE FUNCTION dbo.half () RETURNS TABLE AS RETURN (SELECT TOP 50 PERCENT k FROM v ORDER BY k)")
    session.sql("INSERT INTO v VALUES (3), (4)")
    assert sorted(r.k for r in session.query("SELECT k FROM dbo.half()").collect()) == [1, 2]
