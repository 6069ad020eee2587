"""Analysis of script corpora: tokens, syntax nodes, scopes, symbols, references and diagnostics as DataFrames.

A corpus is a DataFrame with script_id and sql; a null sql is an empty script. Two passes parse text, one row of work per script and no shuffle: tokens and
nodes. Everything else is relational over the nodes, which carry the path of the scopes around them; parse once, write the nodes, and derive the rest.
Joins and windows are keyed by the script and a name or a scope, so no task needs more than one script's rows of one name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frontend.lexer import tokenize
from ..frontend.nodes import Node
from ..frontend.parser import parse

ROWS = 5000  # rows of an Arrow batch that is sent back
ROOT_END = 2**53 - 1

# Codes, severities and messages of the diagnostics; {} is the name.
RULES = {
    "VAR001": ("error", "Variable is not declared"),
    "VAR002": ("warning", "Variable '{}' is declared but never used"),
    "VAR003": ("warning", "Parameter '{}' is declared but never used"),
    "DML001": ("warning", "UPDATE statement has no WHERE clause — all rows will be affected"),
    "DML002": ("warning", "DELETE statement has no WHERE clause — all rows will be deleted"),
    "DML003": ("warning", "INSERT statement does not specify a column list — this will break if the table schema changes"),
    "SEL001": ("info", "SELECT * is not recommended — list columns explicitly"),
    "SEL002": ("error", "SELECT * inside a view will break if the underlying table schema changes"),
    "DUP001": ("error", "'{}' is already declared in this scope"),
    "DUP002": ("error", "CTE '{}' is defined more than once in this WITH clause"),
}


def _per_script(scripts: DataFrame, rows_of: Callable[[str], Iterator[dict]], ddl: str, schema: pa.Schema) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for key, sql in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for row in rows_of(sql or ""):
                    held.append(row | {"script_id": key})
                    if len(held) >= ROWS:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return scripts.select(F.col("script_id").cast("string"), F.col("sql").cast("string")).mapInArrow(run, ddl)


_TOKEN = pa.schema([("script_id", pa.string()), ("pos", pa.int32()), ("type", pa.string()), ("value", pa.string()), ("line", pa.int32()), ("col", pa.int32()), ("offset", pa.int32())])
_NODE = pa.schema(
    [("script_id", pa.string()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("role", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("name", pa.string()), ("alias", pa.string())]
    + [("operator", pa.string()), ("value", pa.string()), ("variant", pa.string()), ("data_type", pa.string()), ("columns", pa.list_(pa.string())), ("clauses", pa.list_(pa.string())), ("start", pa.int32()), ("end", pa.int32())]
    + [("incomplete", pa.bool_()), ("errors", pa.list_(pa.string())), ("path", pa.list_(pa.int32())), ("scope_name", pa.string()), ("in_view", pa.bool_())]
)
_TOKEN_DDL = "script_id string, pos int, type string, value string, line int, col int, offset int"
_NODE_DDL = (
    "script_id string, node_id int, parent_id int, role string, ordinal int, kind string, name string, alias string, operator string, value string, variant string, data_type string, "
    "columns array<string>, clauses array<string>, start int, end int, incomplete boolean, errors array<string>, path array<int>, scope_name string, in_view boolean"
)


def tokens(scripts: DataFrame) -> DataFrame:
    """(script_id, pos, type, value, line, col, offset) without the end mark; offsets count code points."""

    def rows_of(sql: str) -> Iterator[dict]:
        for pos, t in enumerate(tokenize(sql)):
            if t.type != "EOF":
                yield {"pos": pos, "type": t.type, "value": t.value, "line": t.line, "col": t.col, "offset": t.offset}

    return _per_script(scripts, rows_of, _TOKEN_DDL, _TOKEN)


def _text(value) -> str | None:
    return value.get("name") if isinstance(value, Node) else None if value is None else str(value)


def _opens(node: Node, role: str) -> str | None:
    """The name of the scope that the node opens for its children; None where it opens none."""
    if node.kind == "Program":
        return "root"
    if node.kind == "WithStatement" and node.get("ctes"):
        return "with"
    if node.kind in ("UpdateStatement", "DeleteStatement") and node.get("from"):
        return node.kind[:6].lower()
    if node.kind == "CreateStatement" and node.get("objectType") in ("PROCEDURE", "FUNCTION"):
        return _text(node.get("name"))
    return {"SelectStatement": "select", "SubqueryExpression": "subquery"}.get(node.kind)


def _derived(table: Node, query: Node) -> Node:
    """A derived table's query as an expression of its own, with the parentheses around it, so that it opens a scope."""
    start, end = table.get("inner") or (table.start, query.end)
    return Node("SubqueryExpression", start, end, query=query)


def script_nodes(sql: str) -> Iterator[dict]:
    """The nodes of a script, parents first; sources come before the other clauses, so that ids are in the order in which names are declared.
    path: the node ids of the scopes around the node; the last is the node itself if it opens one, as scope_name tells."""
    todo: list[tuple[Node, int | None, str, int, list[int], bool]] = [(parse(sql), None, "", 0, [], False)]
    node_id = 0
    while todo:
        node, parent, role, ordinal, around, in_view = todo.pop()
        opened = _opens(node, role)
        path = [*around, node_id] if opened is not None else around
        fields = node.fields
        named = [c.get("name") for c in fields.get("columns") or [] if isinstance(c, Node) and c.kind == "ColumnDefinition"]
        yield {
            "node_id": node_id, "parent_id": parent, "role": role, "ordinal": ordinal, "kind": node.kind, "name": _text(fields.get("name")), "alias": fields.get("alias"), "operator": fields.get("operator"),
            "value": fields["value"] if isinstance(fields.get("value"), str) else fields.get("assigns") or fields.get("option"), "variant": fields.get("objectType") or _text(fields.get("type")),
            "data_type": fields.get("dataType"), "columns": named or None, "clauses": sorted(k for k, v in fields.items() if v is not None and v is not False and v != []),
            "start": node.start, "end": node.end, "incomplete": node.incomplete, "errors": node.errors, "path": path, "scope_name": opened, "in_view": in_view,
        }
        inside = in_view or (node.kind == "CreateStatement" and fields.get("objectType") == "VIEW")
        children = [(r, k, _derived(node, child) if node.kind == "TableReference" and r == "query" else child) for r, k, child in node.children()]
        children.sort(key=lambda c: c[0] != "from")
        todo.extend((child, node_id, r, k, path, inside) for r, k, child in reversed(children))
        node_id += 1


def nodes(scripts: DataFrame) -> DataFrame:
    """One row per syntax node; clauses lists the fields that are present."""
    return _per_script(scripts, script_nodes, _NODE_DDL, _NODE)


def with_utf16(rows: DataFrame, scripts: DataFrame) -> DataFrame:
    """rows, which have script_id, start and end in code points, with start_utf16 and end_utf16 in UTF-16 units: one more for each character
    beyond U+FFFF before the place. A place behind the text's end (the root scope's) is moved by all of them."""
    texts = scripts.select("script_id", F.coalesce("sql", F.lit("")).alias("__sql"))
    beyond = lambda c: F.length(F.regexp_replace(F.substring("__sql", F.lit(1), F.least(F.col(c), F.lit(2**31 - 1)).cast("int")), r"[\x{0}-\x{FFFF}]", ""))
    found = rows.join(texts, "script_id", "left")
    return found.withColumns({f"{c}_utf16": F.col(c) + beyond(c) for c in ("start", "end")}).drop("__sql")


def scopes(nodes: DataFrame) -> DataFrame:
    """(script_id, scope_id, parent_id, ancestor_ids, name, start, end, depth); the root has no parent and no end."""
    depth = F.size("path") - 1
    parent = F.when(depth > 0, F.element_at("path", F.greatest(depth, F.lit(1))))
    end = F.when(depth == 0, F.lit(ROOT_END)).otherwise(F.col("end").cast("long"))
    ids = ["script_id", F.col("node_id").alias("scope_id"), parent.alias("parent_id"), F.col("path").alias("ancestor_ids")]
    return nodes.where("scope_name is not null").select(*ids, F.col("scope_name").alias("name"), "start", end.alias("end"), depth.alias("depth"))


def declarations(nodes: DataFrame) -> DataFrame:
    """All declarations in order, with nth: 1 for a scope's first of a name, which is the symbol; the others are duplicates."""
    variant = F.col("variant")
    created = F.when(variant.isin("TABLE", "VIEW"), "Table").when(variant == "TYPE", "Type").when(variant == "PROCEDURE", "Procedure").when(variant == "FUNCTION", "Function")
    kind = (
        F.when(F.col("kind") == "Declaration", F.when(F.upper("data_type") == "TABLE", "Table").otherwise("Variable"))
        .when(F.col("kind") == "Parameter", "Parameter")
        .when(F.col("kind") == "CTE", "CTE")
        .when(F.col("kind") == "CreateStatement", created)
        .when(F.col("kind").isin("Column", "TableReference") & F.col("alias").isNotNull(), "Alias")
    )
    around = F.when(F.col("scope_name").isNull(), F.col("path")).otherwise(F.slice("path", 1, F.size("path") - 1))
    name = F.when(kind == "Alias", F.col("alias")).otherwise(F.col("name"))
    ids = ["script_id", F.col("node_id").alias("symbol_id"), "parent_id", "role", F.element_at(around, -1).alias("scope_id")]
    found = nodes.select(*ids, name.alias("name"), F.lower(name).alias("name_key"), kind.alias("kind"), "data_type", "columns", "start", "end")
    found = found.where("kind is not null and name is not null")
    # a joined table's alias has the span of the join
    joins = nodes.where("kind = 'Join'").select("script_id", F.col("node_id").alias("parent_id"), F.lit("target").alias("role"), F.col("start").alias("join_start"), F.col("end").alias("join_end"))
    found = found.join(joins, ["script_id", "parent_id", "role"], "left")
    found = found.withColumn("start", F.coalesce("join_start", "start")).withColumn("end", F.coalesce("join_end", "end"))
    order = Window.partitionBy("script_id", "scope_id", "name_key").orderBy("symbol_id")
    return found.select("script_id", "symbol_id", "scope_id", "name", "name_key", "kind", "data_type", "columns", "start", "end").withColumn("nth", F.row_number().over(order))


def symbols(nodes: DataFrame) -> DataFrame:
    return declarations(nodes).where("nth = 1").drop("nth")


def duplicates(nodes: DataFrame) -> DataFrame:
    """Second and later declarations of a name in one scope, with the name of the scope."""
    where = scopes(nodes).select("script_id", "scope_id", F.col("name").alias("scope_name"))
    return declarations(nodes).where("nth > 1").drop("nth").join(where, ["script_id", "scope_id"])


def refs(nodes: DataFrame) -> DataFrame:
    """(script_id, ref_id, name_key, scope_id, start, end, kind, symbol_id): uses of variables. A symbol is found in the innermost scope that declared
    the name before the use; symbol_id is null where none did. Names that begin with @@ are not variables."""
    variable, assigns = F.col("kind") == "Variable", (F.col("kind") == "Column") & F.col("value").startswith("@")
    name = F.when(variable, F.col("name")).otherwise(F.col("value"))
    end = F.when(variable, F.col("end")).otherwise(F.col("start") + F.length("value"))
    kind = F.when(variable & (F.col("role") == "target"), "write").otherwise("read").alias("kind")
    ids = ["script_id", F.col("node_id").alias("ref_id"), F.lower(name).alias("name_key"), F.element_at("path", -1).alias("scope_id")]
    used = nodes.where((variable | assigns) & ~name.startswith("@@")).select(*ids, "path", "start", end.alias("end"), kind)
    declared = symbols(nodes).select("script_id", "name_key", F.col("scope_id").alias("at"), "symbol_id")
    seen = used.join(declared, ["script_id", "name_key"]).where(F.array_contains("path", F.col("at")) & (F.col("symbol_id") < F.col("ref_id")))
    nearest = seen.groupBy("script_id", "ref_id").agg(F.max_by("symbol_id", "at").alias("symbol_id"))
    return used.drop("path").join(nearest, ["script_id", "ref_id"], "left")


def visible_symbols(nodes: DataFrame, probes: DataFrame) -> DataFrame:
    """(script_id, probe_id, scope_name, name, kind) for probes (script_id, probe_id, offset): what can be named at the offset, inner names hiding outer ones.
    Scopes hold both their ends; where two meet, the first counts."""
    all_scopes = scopes(nodes)
    at = probes.select("script_id", "probe_id", "offset").join(all_scopes, "script_id").where("start <= offset and offset <= end")
    holds = at.select("script_id", "probe_id", "scope_id", "parent_id", "ancestor_ids")
    inner = holds.select("script_id", "probe_id", F.col("parent_id").alias("scope_id"))
    leaf = holds.join(inner, ["script_id", "probe_id", "scope_id"], "left_anti").groupBy("script_id", "probe_id").agg(F.min_by("ancestor_ids", "scope_id").alias("path"))
    around = leaf.select("script_id", "probe_id", F.explode("path").alias("scope_id"))
    named = around.join(symbols(nodes), ["script_id", "scope_id"])
    nearest = named.groupBy("script_id", "probe_id", "name_key").agg(F.max_by(F.struct("scope_id", "name", "kind"), "scope_id").alias("s"))
    names = all_scopes.select("script_id", "scope_id", F.col("name").alias("scope_name"))
    return nearest.select("script_id", "probe_id", "s.*").join(names, ["script_id", "scope_id"]).select("script_id", "probe_id", "scope_name", "name", "kind")


def diagnostics(nodes: DataFrame) -> DataFrame:
    """(script_id, code, severity, message, start, end) of every rule, unsorted; order by script_id and start to show them."""

    def rule(code: str, found: DataFrame, first: int | None = None) -> DataFrame:
        severity, message = RULES[code]
        before, _, after = message.partition("{}")
        text = F.concat(F.lit(before), F.col("name"), F.lit(after)) if "{}" in message else F.lit(message)
        end = F.col("end") if first is None else F.col("start") + first
        return found.select("script_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), text.alias("message"), "start", end.alias("end"))

    used, declared, twice = refs(nodes), symbols(nodes), duplicates(nodes)
    read = used.where("kind = 'read' and symbol_id is not null").select("script_id", "symbol_id")
    idle = declared.where("kind in ('Variable', 'Parameter')").join(read, ["script_id", "symbol_id"], "left_anti")
    has = lambda clause: F.array_contains("clauses", clause)
    bare = ~F.col("incomplete") & ~has("where")
    wildcards = nodes.where("kind = 'WildcardExpression' and role = 'expression'").select("script_id", F.col("parent_id").alias("node_id"))
    stars = nodes.where("kind = 'Column'").join(wildcards, ["script_id", "node_id"], "left_semi")
    return (
        rule("VAR001", used.where("symbol_id is null"))
        .unionByName(rule("VAR002", idle.where("kind = 'Variable'")))
        .unionByName(rule("VAR003", idle.where("kind = 'Parameter'")))
        .unionByName(rule("DML001", nodes.where((F.col("kind") == "UpdateStatement") & bare), 6))
        .unionByName(rule("DML002", nodes.where((F.col("kind") == "DeleteStatement") & bare), 6))
        .unionByName(rule("DML003", nodes.where((F.col("kind") == "InsertStatement") & has("values") & ~has("columns")), 6))
        .unionByName(rule("SEL001", stars.where(~F.col("in_view"))))
        .unionByName(rule("SEL002", stars.where("in_view")))
        .unionByName(rule("DUP001", twice.where("scope_name <> 'with'")))
        .unionByName(rule("DUP002", twice.where("scope_name = 'with' and kind = 'CTE'")))
    )
