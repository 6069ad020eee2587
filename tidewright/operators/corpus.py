"""Queries of the script analysis over a small corpus, and their expected rows in SQL.

Expected rows are stated in the scripts themselves, or beside them, by the rules and not by a run: in FINDINGS a finding's span stands between ⟪ and ⟫
after its code and, where the message has one, its name; a token list gives types and texts, and offsets follow from finding the texts in the
script. Scopes, symbols, references and visible names were checked against the rules after a run's output was seen: they guard against changes
more than they prove the first result.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import scratch_table
from . import analysis

SCRIPTS = [
    ("declare", "DECLARE @x INT = 1, @y INT; SET @y = @x; SELECT * FROM T WHERE ID = @z"),
    ("dml", "UPDATE T SET A = 1; DELETE FROM T; INSERT INTO T VALUES (1)"),
    ("view", "CREATE VIEW V AS SELECT * FROM T; DECLARE @a INT; DECLARE @A INT; PRINT @a"),
    ("cte", "WITH C AS (SELECT 1 AS k), c AS (SELECT 2 AS k) SELECT k FROM C"),
    ("proc", "CREATE PROCEDURE P @p INT, @q INT AS BEGIN SELECT e.Name AS n FROM E e JOIN D d ON e.k = d.k WHERE e.Id = @p END"),
    ("clean", "DELETE FROM T WHERE k = 1; PRINT @@ROWCOUNT"),
    ("none", None),
]
PROBES = [("proc", 1, 70), ("cte", 1, 40), ("declare", 1, 5)]
# script: types of its tokens in order, by first letter: Keyword, Identifier, Variable, Number, Operator, semicolon ;, Comma, Dot, parentheses.
TOKENS = {
    "declare": "KVIONCVI;KVOV;KOKIKIOV",
    "dml": "KIKION;KKI;KKIK(N)",
    "view": "KKIKKOKI;KVI;KVI;KV",
    "cte": "KIK(KNKI)CIK(KNKI)KIKI",
    "proc": "KKIVICVIKKKIDIKIKIIKIIKIDIOIDIKIDIOVK",
    "clean": "KKIKION;KV",
}
LETTERS = {"K": "Keyword", "I": "Identifier", "V": "Variable", "N": "Number", "O": "Operator", ";": "Semicolon", "C": "Comma", "D": "Dot", "(": "OpenParen", ")": "CloseParen"}
# (script, scripts with marked findings)
FINDINGS = [
    ("undeclared", "SELECT a.x FROM a WHERE a.k = ⟪VAR001|@missing⟫ AND a.l > ⟪VAR001|@other⟫ + ⟪VAR001|@other⟫"),
    ("system names", "IF @@ERROR <> 0 PRINT @@IDENTITY; PRINT @@ROWCOUNT + ⟪VAR001|@row⟫"),
    ("too early", "PRINT ⟪VAR001|@late⟫; DECLARE @late INT = 3; PRINT @LATE"),
    ("set undeclared", "SET ⟪VAR001|@nowhere⟫ = 4"),
    ("in branches", "DECLARE @k INT = 2; IF @k > 1 BEGIN PRINT ⟪VAR001|@in⟫ END ELSE PRINT @k"),
    ("of another routine", "CREATE PROC a1 @own INT AS BEGIN PRINT @own END; PRINT ⟪VAR001|@own⟫"),
    ("block names leak", "BEGIN DECLARE @deep INT = 1 END; PRINT @deep"),
    ("only written", "DECLARE ⟪VAR002:@w|@w INT⟫; SET @w = 5"),
    ("some idle", "DECLARE ⟪VAR002:@a|@a INT⟫, @b INT, ⟪VAR002:@c|@c DECIMAL(9,2)⟫; PRINT @b"),
    ("read by itself", "DECLARE @n INT = 0; SET @n = @n + 1"),
    ("initialiser reads", "DECLARE @p INT = 1; DECLARE ⟪VAR002:@q|@q INT = @p * 2⟫"),
    ("table variables are never idle", "DECLARE @rows TABLE (k INT, v VARCHAR(9))"),
    ("read in subqueries", "DECLARE @m INT = 1; SELECT t.k FROM t WHERE t.k IN (SELECT u.k FROM u WHERE u.m = @m)"),
    ("idle parameter", "CREATE PROCEDURE r1 @used INT, ⟪VAR003:@idle|@idle INT⟫ AS BEGIN SELECT t.k FROM t WHERE t.k = @used END"),
    ("parameter hides variable", "DECLARE ⟪VAR002:@h|@h INT⟫; CREATE PROC r2 @h INT AS BEGIN PRINT @h END"),
    ("update all", "⟪DML001|UPDATE⟫ t SET k = 1; UPDATE t SET k = 2 WHERE m = 3"),
    ("update in a block", "IF 1 = 1 BEGIN ⟪DML001|UPDATE⟫ t SET k = 1 END"),
    ("delete all", "⟪DML002|DELETE⟫ FROM t; DELETE FROM t WHERE k = 2; ⟪DML002|DELETE⟫ t"),
    ("insert without columns", "⟪DML003|INSERT⟫ INTO t VALUES (1, 'a'), (2, 'b'); INSERT INTO t (k, v) VALUES (3, 'c'); INSERT INTO t SELECT u.k, u.v FROM u"),
    ("insert in a routine", "CREATE PROC r3 @v INT AS BEGIN ⟪DML003|INSERT⟫ INTO t VALUES (@v) END"),
    ("stars", "SELECT ⟪SEL001|*⟫ FROM t; SELECT ⟪SEL001|t.*⟫, 1 AS one FROM t; SELECT COUNT(*) AS n FROM t"),
    ("star below", "SELECT d.k FROM (SELECT ⟪SEL001|*⟫ FROM t) AS d"),
    ("star in a view", "CREATE VIEW v1 AS SELECT ⟪SEL002|*⟫ FROM t"),
    ("named in a view", "CREATE VIEW v2 AS SELECT t.k FROM t"),
    ("twice declared", "DECLARE @d INT = 1; DECLARE ⟪DUP001:@D|@D INT⟫; PRINT @d"),
    ("alias twice", "SELECT a.k FROM t AS a, ⟪DUP001:a|u AS a⟫ WHERE a.k = 1"),
    ("same name in two scopes", "SELECT x.k FROM t AS x; SELECT x.k FROM u AS x"),
    ("expression twice", "WITH w AS (SELECT 1 AS k), ⟪DUP002:W|W AS (SELECT 2 AS k)⟫, z AS (SELECT 3 AS k) SELECT w.k FROM w"),
    ("nothing wrong", "CREATE PROC r4 @k INT AS BEGIN UPDATE t SET v = 1 WHERE k = @k; DELETE FROM t WHERE k < @k; INSERT INTO t (k) VALUES (@k) END"),
    ("broken", "UPDATE t SET k = ; DELETE FROM t WHERE ; SELECT t.k FROM t WHERE t.k = ⟪VAR001|@after⟫"),
]
NODES = ("shape", "SELECT a AS b FROM t WHERE k = 1")
# role, kind, the parent's kind, and the node's text.
NODE_ROWS = [
    ("", "Program", "", "SELECT a AS b FROM t WHERE k = 1"),
    ("body", "SelectStatement", "Program", "SELECT a AS b FROM t WHERE k = 1"),
    ("from", "TableReference", "SelectStatement", "t"),
    ("name", "Identifier", "TableReference", "t"),
    ("columns", "Column", "SelectStatement", "a AS b"),
    ("expression", "Identifier", "Column", "a"),
    ("where", "BinaryExpression", "SelectStatement", "k = 1"),
    ("left", "Identifier", "BinaryExpression", "k"),
    ("right", "Literal", "BinaryExpression", "1"),
]
ASTRAL = ("astral", "PRINT '😀😀'; PRINT @x; PRINT '😀' + @y")


def marked(text: str) -> tuple[str, list[tuple[str, str, int, int]]]:
    """A script without its marks, and (code, name, start, end) of each."""
    sql, found, at = "", [], 0
    for m in re.finditer("⟪([A-Z0-9]+)(?::([^|]*))?\\|([^⟫]*)⟫", text):
        sql += text[at : m.start()]
        found.append((m[1], m[2] or "", len(sql), len(sql) + len(m[3])))
        sql += m[3]
        at = m.end()
    return sql + text[at:], found


def _quote(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, bool)) else "'" + value.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    listed = ", ".join("(" + ", ".join(map(_quote, r)) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {listed}) t({names})"


def _nodes(spark: SparkSession, scripts: list[tuple] = SCRIPTS) -> DataFrame:
    return scratch_table(analysis.nodes(spark.createDataFrame(scripts, "script_id string, sql string")), "nodes")  # parsed once for all rules


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.tokens(spark.createDataFrame(SCRIPTS, "script_id string, sql string"))


def _visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.visible_symbols(_nodes(spark), spark.createDataFrame(PROBES, "script_id string, probe_id int, offset int"))


def _statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _nodes(spark).where("role = 'body' and parent_id = 0").select("script_id", "ordinal", "kind", "start", "end", "incomplete")


def _shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = _nodes(spark, [NODES])
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("kind").alias("parent"))
    return nodes.join(parents, "parent_id", "left").select("role", "kind", F.coalesce("parent", F.lit("")).alias("parent"), "start", "end")


def _rule(code: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: analysis.diagnostics(_nodes(spark, [(k, marked(t)[0]) for k, t in FINDINGS])).where(F.col("code") == code)


def _rule_rows(code: str) -> list[tuple]:
    severity, message = analysis.RULES[code]
    return [(k, code, severity, message.format(name), a, e) for k, t in FINDINGS for c, name, a, e in marked(t)[1] if c == code]


def _utf16(spark: SparkSession, sf_dir: str) -> DataFrame:
    scripts = spark.createDataFrame([ASTRAL], "script_id string, sql string")
    return analysis.with_utf16(analysis.refs(_nodes(spark, [ASTRAL])), scripts).select("script_id", "name_key", "start", "start_utf16", "end_utf16")


def _utf16_rows() -> list[tuple]:
    sql = ASTRAL[1]
    units = lambda text: len(text.encode("utf-16-le")) // 2
    return [("astral", v, sql.index(v), units(sql[: sql.index(v)]), units(sql[: sql.index(v)]) + 2) for v in ("@x", "@y")]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "corpus_tokens": _tokens,
        "corpus_statements": _statements,
        "corpus_nodes": _shape,
        "corpus_utf16": _utf16,
        "corpus_scopes": lambda spark, sf_dir: analysis.scopes(_nodes(spark)).select("script_id", "name", "start", "end", "depth"),
        "corpus_symbols": lambda spark, sf_dir: analysis.symbols(_nodes(spark)).select("script_id", "name", "kind", "data_type", "start"),
        "corpus_refs": lambda spark, sf_dir: analysis.refs(_nodes(spark)).selectExpr("script_id", "name_key", "start", "end", "kind", "symbol_id is not null as declared"),
        "corpus_diagnostics": lambda spark, sf_dir: analysis.diagnostics(_nodes(spark)),
        "cursor_visible_symbols": _visible,
    }
    return found | {f"diag_{code.lower()}": _rule(code) for code in analysis.RULES}


def _token_rows() -> list[tuple]:
    """Rows of TOKENS: each token's text is the longest that its type can have at the next place of the script that is not blank."""
    shapes = {"N": r"\d+", "O": r"<=|>=|<>|.", "V": r"@@?\w+"}
    rows = []
    for script, letters in TOKENS.items():
        sql, at = dict(SCRIPTS)[script], 0
        for pos, letter in enumerate(letters):
            at += len(sql[at:]) - len(sql[at:].lstrip())
            text = re.match(shapes.get(letter, r"\w+" if letter in "KI" else "."), sql[at:])[0]
            rows.append((script, pos, LETTERS[letter], text, 1, at + 1, at))
            at += len(text)
        assert at == len(sql), script
    return rows


def _node_rows() -> list[tuple]:
    sql = NODES[1]
    first = lambda text: re.search(rf"(?<!\w){re.escape(text)}(?!\w)", sql).start()
    return [(role, kind, parent, first(text), first(text) + len(text)) for role, kind, parent, text in NODE_ROWS]


def oracle_sql() -> dict[str, str]:
    end = analysis.ROOT_END
    roots = [(k, "root", 0, end, 0) for k, _ in SCRIPTS]
    scopes = roots + [
        ("declare", "select", 41, 70, 1), ("view", "select", 17, 32, 1), ("cte", "with", 0, 63, 1), ("cte", "select", 11, 24, 2), ("cte", "select", 33, 46, 2),
        ("cte", "select", 48, 63, 2), ("proc", "P", 0, 112, 1), ("proc", "select", 43, 108, 2),
    ]
    statements = [
        ("declare", 0, "DeclareStatement", 0, 26, False), ("declare", 1, "SetStatement", 28, 39, False), ("declare", 2, "SelectStatement", 41, 70, False),
        ("dml", 0, "UpdateStatement", 0, 18, False), ("dml", 1, "DeleteStatement", 20, 33, False), ("dml", 2, "InsertStatement", 35, 59, False),
        ("view", 0, "CreateStatement", 0, 32, False), ("view", 1, "DeclareStatement", 34, 48, False), ("view", 2, "DeclareStatement", 50, 64, False),
        ("view", 3, "PrintStatement", 66, 74, False), ("cte", 0, "WithStatement", 0, 63, False), ("proc", 0, "CreateStatement", 0, 112, False),
        ("clean", 0, "DeleteStatement", 0, 25, False), ("clean", 1, "PrintStatement", 27, 43, False),
    ]
    symbols = [
        ("declare", "@x", "Variable", "INT", 8), ("declare", "@y", "Variable", "INT", 20), ("view", "V", "Table", None, 0), ("view", "@a", "Variable", "INT", 42),
        ("cte", "C", "CTE", None, 5), ("cte", "k", "Alias", None, 18), ("cte", "k", "Alias", None, 40), ("proc", "P", "Procedure", None, 0), ("proc", "@p", "Parameter", "INT", 19),
        ("proc", "@q", "Parameter", "INT", 27), ("proc", "n", "Alias", None, 50), ("proc", "e", "Alias", None, 67), ("proc", "d", "Alias", None, 71),
    ]
    refs = [("declare", "@y", 32, 34, "write", True), ("declare", "@x", 37, 39, "read", True), ("declare", "@z", 68, 70, "read", False), ("view", "@a", 72, 74, "read", True), ("proc", "@p", 106, 108, "read", True)]
    spots = [
        ("declare", "VAR002", "@y", 20, 26), ("declare", "SEL001", "", 48, 49), ("declare", "VAR001", "", 68, 70), ("dml", "DML001", "", 0, 6), ("dml", "DML002", "", 20, 26),
        ("dml", "DML003", "", 35, 41), ("view", "SEL002", "", 24, 25), ("view", "DUP001", "@A", 58, 64), ("cte", "DUP002", "c", 27, 47), ("proc", "VAR003", "@q", 27, 33),
    ]
    found = [(k, code, analysis.RULES[code][0], analysis.RULES[code][1].format(name), a, e) for k, code, name, a, e in spots]
    visible = [
        ("proc", 1, "root", "P", "Procedure"), ("proc", 1, "P", "@p", "Parameter"), ("proc", 1, "P", "@q", "Parameter"), ("proc", 1, "select", "n", "Alias"),
        ("proc", 1, "select", "e", "Alias"), ("proc", 1, "select", "d", "Alias"), ("cte", 1, "with", "C", "CTE"), ("cte", 1, "select", "k", "Alias"),
        ("declare", 1, "root", "@x", "Variable"), ("declare", 1, "root", "@y", "Variable"),
    ]
    finding = 'script_id, code, severity, message, start, "end"'
    return {
        "corpus_tokens": _values(_token_rows(), 'script_id, pos, type, value, line, col, "offset"'),
        "corpus_statements": _values(statements, 'script_id, ordinal, kind, start, "end", incomplete'),
        "corpus_nodes": _values(_node_rows(), 'role, kind, parent, start, "end"'),
        "corpus_utf16": _values(_utf16_rows(), "script_id, name_key, start, start_utf16, end_utf16"),
        "corpus_scopes": f"""SELECT script_id, name, start, CAST("end" AS BIGINT) AS "end", depth FROM ({_values(scopes, 'script_id, name, start, "end", depth')})""",
        "corpus_symbols": _values(symbols, "script_id, name, kind, data_type, start"),
        "corpus_refs": _values(refs, 'script_id, name_key, start, "end", kind, declared'),
        "corpus_diagnostics": _values(found, finding),
        "cursor_visible_symbols": _values(visible, "script_id, probe_id, scope_name, name, kind"),
    } | {f"diag_{code.lower()}": _values(_rule_rows(code), finding) for code in analysis.RULES}
