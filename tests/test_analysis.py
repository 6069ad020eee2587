import random

from tidewright.operators import analysis as A


def corpus(spark, *texts):
    return A.nodes(spark.createDataFrame([(f"s{k}", t) for k, t in enumerate(texts)], "script_id string, sql string"))


def test_rules(spark):
    want = {
        "DECLARE @t TABLE (k INT)": [],
        "DECLARE @x INT; SET @x = 1": ["VAR002"],
        "PRINT @x; DECLARE @x INT; PRINT @x": ["VAR001"],
        "SELECT a FROM t WHERE EXISTS (SELECT * FROM u)": ["SEL001"],
        "IF 1 = 1 BEGIN DELETE FROM t END": ["DML002"],
        "UPDATE t SET a =": [],
    }
    found = A.diagnostics(corpus(spark, *want)).collect()
    assert [sorted(r.code for r in found if r.script_id == f"s{k}") for k in range(len(want))] == list(want.values())


def test_names_are_case_blind_and_inner_scopes_see_outer_ones(spark):
    n = corpus(spark, "DECLARE @A INT; CREATE PROC p @a INT AS BEGIN SELECT k FROM t WHERE k = @a END; PRINT @a")
    kinds = {r.symbol_id: r.kind for r in A.symbols(n).collect()}
    assert [kinds[r.symbol_id] for r in A.refs(n).orderBy("start").collect()] == ["Parameter", "Variable"]


def test_empty_null_and_broken_scripts(spark):
    n = corpus(spark, None, "", ";;", "SELECT (", "CREATE", "WITH c AS (", "BEGIN SELECT 'x")
    assert A.scopes(n).where("parent_id is null").count() == 7
    assert A.diagnostics(n).count() == 0
    empty = A.nodes(spark.createDataFrame([], "script_id string, sql string"))
    assert [f(empty).count() for f in (A.scopes, A.symbols, A.refs, A.duplicates, A.diagnostics)] == [0] * 5


def test_derived_tables_have_a_scope_between_their_parentheses(spark):
    sql = "SELECT d.k FROM (SELECT 1 AS k) AS d JOIN (SELECT 2 AS k) e ON d.k = e.k"
    n = corpus(spark, sql)
    spans = sorted((r.name, sql[r.start : r.end]) for r in A.scopes(n).where("name <> 'root'").collect())
    assert spans == sorted([("select", sql), ("select", "SELECT 1 AS k"), ("select", "SELECT 2 AS k"), ("subquery", "(SELECT 1 AS k)"), ("subquery", "(SELECT 2 AS k)")])
    depth = {(r.name, r.start): r.depth for r in A.scopes(n).collect()}
    assert [d for (name, _), d in sorted(depth.items()) if name == "subquery"] == [2, 2]
    outer = A.symbols(n).where("kind = 'Alias' and name in ('d', 'e')").join(A.scopes(n).where("name = 'select' and start = 0"), ["script_id", "scope_id"], "left_semi")
    assert outer.count() == 2 and A.diagnostics(n).count() == 0


def test_any_words_in_any_order_give_nodes():
    words = "SELECT FROM WHERE ( ) , ; . @a #t [x] 'y' 1 = + CASE WHEN END IF ELSE BEGIN CREATE VIEW AS WITH JOIN ON UPDATE SET DELETE INSERT INTO VALUES DECLARE INT NOT IN OVER TOP".split()
    rng = random.Random(5)
    for _ in range(400):
        rows = list(A.script_nodes(" ".join(rng.choices(words, k=rng.randint(1, 25)))))
        assert rows[0]["kind"] == "Program" and all(r["parent_id"] < r["node_id"] for r in rows[1:])
