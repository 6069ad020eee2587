"""Statements cut off after any token, and broken ones between whole ones; how far nesting and chains may go; the order that ORDER BY gives."""

import duckdb
import pytest

from tidewright.frontend.lexer import tokenize
from tidewright.frontend.parser import parse
from tidewright.operators import queries as core

DATA = "/root/testdata/sf0.001"
# A statement, the kind it keeps however early it breaks off, and after how many tokens that kind is known.
WHOLE = [
    ("SELECT DISTINCT TOP (3) PERCENT a.x AS y, z = COUNT(*) + 1 FROM t AS a WITH (NOLOCK, INDEX(i)) LEFT OUTER JOIN [u v] b ON a.k = b.k WHERE a.x BETWEEN 1 AND 2 GROUP BY a.x HAVING COUNT(*) > 1 ORDER BY y DESC", "SelectStatement", 1),
    ("SELECT CASE x WHEN 1 THEN ABS(-y) ELSE NULL END, ROW_NUMBER() OVER (PARTITION BY p ORDER BY q), x IN (1, 2), y NOT IN (SELECT k FROM u) FROM t CROSS APPLY f(t.k) AS g", "SelectStatement", 1),
    ("INSERT INTO t (a, b) VALUES (1, 'x'), (2, N'y''z')", "InsertStatement", 1),
    ("INSERT INTO t SELECT a, b FROM u WHERE a LIKE 'q%' ESCAPE '!'", "InsertStatement", 1),
    ("UPDATE t SET a = a + 1, b = (SELECT MAX(c) FROM u) FROM t JOIN v ON t.k = v.k WHERE NOT EXISTS (SELECT 1 FROM w)", "UpdateStatement", 1),
    ("DELETE a FROM t AS a, u WHERE a.k = u.k OR a.m IS NOT NULL", "DeleteStatement", 1),
    ("DECLARE @a INT = 1, @b DECIMAL(9, 2), @t TABLE (k INT NOT NULL DEFAULT 3, v VARCHAR(MAX))", "DeclareStatement", 1),
    ("SET @a = (@b * 2) % 7", "SetStatement", 1),
    ("PRINT 'a' + CAST(@a AS VARCHAR(9))", "PrintStatement", 1),
    ("IF @a > 1 BEGIN PRINT 1; SELECT 2 AS x END ELSE SET @a = 3", "IfStatement", 1),
    ("BEGIN DECLARE @x INT; PRINT @x END", "BlockStatement", 1),
    ("WITH a (k) AS (SELECT 1), b AS (SELECT k FROM a UNION ALL SELECT 2) UPDATE t SET k = 1 WHERE k IN (SELECT k FROM b)", "WithStatement", 1),
    ("CREATE TABLE s.t (k INT IDENTITY(1, 1) PRIMARY KEY, CONSTRAINT c CHECK (k > 0))", "CreateStatement", 2),
    ("CREATE VIEW v (a) AS SELECT x FROM t", "CreateStatement", 2),
    ("CREATE PROCEDURE p @a INT = 1, @b INT OUTPUT AS BEGIN SET @b = @a END", "CreateStatement", 2),
    ("CREATE FUNCTION f (@a INT) RETURNS INT AS BEGIN RETURN @a + 1 END", "CreateStatement", 2),
    ("CREATE TYPE s.y AS TABLE (k INT)", "CreateStatement", 2),
]


@pytest.mark.parametrize("sql, kind, known", WHOLE)
def test_a_statement_cut_after_any_token_keeps_its_kind(sql, kind, known):
    whole = parse(sql)
    assert [s.kind for s in whole.body] == [kind] and not whole.body[0].incomplete
    tokens = tokenize(sql)[:-1]
    for n in range(known, len(tokens)):
        cut = sql[: tokens[n].offset]
        first = parse(cut).body[0]
        assert first.kind == kind and 0 == first.start <= first.end <= len(cut), cut
        for tail in ("", "'open", "[open", "/* open", " ) ) ,"):
            parse(cut + tail)


@pytest.mark.parametrize("sql, kind, known", WHOLE[:9])
def test_what_follows_a_broken_statement_is_read(sql, kind, known):
    tokens = tokenize(sql)[:-1]
    for n in range(known, len(tokens)):
        cut = sql[: tokens[n].offset].rstrip()
        if cut.count("(") == cut.count(")") or kind in ("SelectStatement", "InsertStatement"):
            body = parse(cut + " ; DELETE FROM z WHERE k = 1").body
            assert len(body) >= 2 and body[-1].kind == "DeleteStatement" and not body[-1].incomplete, cut


def test_depth():
    assert not parse("SELECT " + "(" * 900 + "1" + ")" * 900).body[0].incomplete
    nested = parse("BEGIN " * 900 + "PRINT 1 " + "END " * 900).body[0]
    assert not any(n.incomplete for n in nested.walk())
    too_deep = parse("SELECT " + "(" * 5000 + "1" + ")" * 5000 + "; SELECT 2").body
    assert too_deep[0].incomplete and too_deep[0].kind == "SelectStatement"


def test_nested_parentheses_run(spark):
    assert core.Session(spark, {}).query("SELECT " + "(" * 300 + "7" + ")" * 300 + " AS a").collect()[0].a == 7


@pytest.mark.parametrize("name", ["order_multi", "top_n", "top_percent", "win_in_order_by", "setop_order_by", "order_nulls", "offset_fetch"])
def test_rows_come_in_the_order_asked_for(spark, name):
    con = duckdb.connect()
    for t in core.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    sql = core.oracle_sql()[name] + {"top_percent": " ORDER BY r"}.get(name, "")
    assert [tuple(r) for r in core.queries()[name](spark, DATA).collect()] == con.execute(sql).fetchall()


@pytest.mark.parametrize("sql", ["SELECT n_nationkey = 1 AND 2 = 2 AS a FROM nation WHERE NOT 1", "SELECT (n_nationkey > 1) FROM nation", "SELECT 1 AS a FROM nation WHERE n_nationkey AND 1 = 1"])
def test_conditions_are_no_values(spark, sql):
    session = core.Session(spark, core.parquet_tables(spark, DATA, ["nation"]))
    with pytest.raises(Exception, match="condition|no value|conditions"):
        session.query(sql)


def test_sessions_do_not_share_functions_or_settings(spark):
    before = spark.conf.get("spark.sql.groupByOrdinal")
    a, b = core.Session(spark, {}), core.Session(spark, {})
    a.sql("CREATE FUNCTION dbo.f (@n INT) RETURNS INT AS BEGIN RETURN @n + 1 END")
    b.sql("CREATE FUNCTION dbo.f (@n INT) RETURNS INT AS BEGIN RETURN @n + 2 END")
    assert (a.query("SELECT dbo.f(1) AS x").first().x, b.query("SELECT dbo.f(1) AS x").first().x) == (2, 3)
    assert spark.conf.get("spark.sql.groupByOrdinal") == before


def test_plans(spark):
    def plan(sql):
        df = core.Session(spark, core.parquet_tables(spark, DATA, core.TABLES)).query(sql)
        return df._jdf.queryExecution().executedPlan().toString()

    texts = dict(core.CATALOGUE)
    assert "Window" not in plan(texts["top_percent"][0]) and "Window" not in plan(texts["top_ties"][0])
    applied = plan(texts["cross_apply_top2"][0])
    assert "WindowGroupLimit" in applied and "rangepartitioning" not in applied
    assert "LeftAnti" in plan(texts["not_in_subquery"][0]) and "isnull(o_custkey" not in plan(texts["not_in_subquery"][0]).split("LeftAnti")[1].split("\n")[0]
