"""Runs T-SQL scripts: queries as DataFrames, variables, IF and blocks, temporary tables, views, procedures and functions, and DML by rewriting.

Variables are put into a statement's text when it is compiled, so a later SET does not change earlier results. A table that DML changes is a view over
the changed DataFrame; every FLATTEN changes it is written out, which bounds its lineage. @@ROWCOUNT is counted only where a script reads it.

A joined UPDATE or DELETE finds the values of the target's columns that it mentions and meets the target by these: rows that agree in them
fare alike, so neither row numbers nor a copy of the target are needed. TOP PERCENT, of a statement or in it, is taken by ranges of the sort keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType

from ..frontend.nodes import Node
from ..frontend.parser import deep, parse
from ..plans.compiler import CompileError, Compiler, cast, literal, plain, quoted, spark_type, ticked, up_to
from ..sources.tables import scratch_table

FLATTEN = 16
# A range of at most so many rows is sorted in one task to be cut, a larger one is divided again.
FEW = 1 << 17
# System variables of a session in which nothing has failed and no transaction is open.
SYSTEM = {"@@error": ("0", "int"), "@@trancount": ("0", "int"), "@@identity": ("CAST(NULL AS DECIMAL(38,0))", "decimal"), "@@fetch_status": ("0", "int")}


class Session:
    """integer_average and fold_case are the dialect's flags: AVG of integers is an integer; strings compare without regard to case and trailing blanks."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], integer_average: bool = False, fold_case: bool = False):
        self.spark, self.id = spark, uuid.uuid4().hex[:8]
        self.flags = {"integer_average": integer_average, "fold_case": fold_case}
        self.frames: dict[str, DataFrame] = {}
        self.variables: dict[str, tuple[str, str]] = {}
        self.declared: dict[str, str] = {}
        self.defaults: dict[str, dict[str, str]] = {}
        self.routines: dict[str, Node] = {}
        self.functions: dict[str, str] = {}
        self.types: dict[str, list[Node]] = {}
        self.changes: dict[str, int] = {}
        self.messages: list[str] = []
        self.outputs: dict[str, object] = {}
        self.taken = 0
        self.rows: Callable[[], int] = lambda: 0
        for name, df in tables.items():
            self._put(name, df)

    def sql(self, script: str) -> list[DataFrame]:
        """The results of the script's queries, in order."""
        out: list[DataFrame] = []
        batch = 0
        with deep():
            for s in parse(script).body:
                if s.get("batch") != batch:
                    batch, self.variables = s.batch, {}
                self._run(s, out)
        return out

    def query(self, script: str) -> DataFrame:
        """The last result."""
        return self.sql(script)[-1]

    def call(self, name: str, **arguments) -> list[DataFrame]:
        """Runs a procedure with named arguments; a DataFrame is the value of a parameter of a table type. `outputs` then holds the OUTPUT parameters."""
        proc, out, outer = self.routines[name.lower()], [], self.variables
        self.variables = {}
        try:
            for p in proc.parameters:
                given = arguments.get(p.name[1:])
                if self._table_type(p.dataType) is not None:
                    self._put(p.name, given)
                    continue
                missing = self._compiler().expr(p.default, []) if p.get("default") else "NULL"
                self._set(p.name.lower(), missing if given is None else literal(given) if isinstance(given, str) else str(given), p.dataType)
            self._run(proc.body, out)
            self.outputs = {p.name[1:]: self._spark_sql(f"SELECT {self.variables[p.name.lower()][0]}").first()[0] for p in proc.parameters if p.get("output")}
        finally:
            self.variables = outer
        return out

    # helpers
    def _compiler(self, percent: bool = True) -> Compiler:
        return Compiler(self._table, self._variable, self.functions, **self.flags, percent=self._percent if percent else None)

    def _variable(self, name: str) -> tuple[str, str]:
        key = name.lower()
        if key == "@@rowcount":
            return f"CAST({self.rows()} AS INT)", "int"
        return SYSTEM[key] if key in SYSTEM else self.variables[key] if key in self.variables else _undeclared(name)

    def _spark_sql(self, text: str) -> DataFrame:
        """Spark's plan of a text, in which a number in GROUP BY is a number; the caller's session keeps its own setting."""
        key = "spark.sql.groupByOrdinal"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "false")
        try:
            return self.spark.sql(text)
        finally:
            self.spark.conf.set(key, before)

    def _table_type(self, data_type: str) -> list[Node] | None:
        return self.types.get(plain(data_type.rsplit(".", 1)[-1]).lower())

    def _view(self, name: str) -> str:
        return f"tw_{self.id}_" + "".join(c if c.isalnum() else f"_{ord(c):x}_" for c in name.lower())

    def _put(self, name: str, df: DataFrame) -> None:
        self.frames[name.lower()] = df
        df.createOrReplaceTempView(self._view(name))

    def _table(self, name: Node) -> tuple[str, dict[str, str]]:
        key = plain(name.parts[-1]).lower()
        if key not in self.frames:
            raise CompileError(f"unknown table {name.name}")
        return quoted(self._view(key)), {c.lower(): t for c, t in self.frames[key].dtypes}

    def _set(self, key: str, text: str, data_type: str | None = None) -> None:
        self.declared[key] = data_type = data_type or self.declared[key]
        kind = spark_type(data_type)
        value = self._spark_sql(f"SELECT CAST({cast(f'({text})', data_type, short=1)} AS STRING)").first()[0]
        self.variables[key] = (f"CAST({'NULL' if value is None else literal(value)} AS {kind})", kind.lower())

    def _changed(self, name: str, df: DataFrame, rows: Callable[[], int]) -> None:
        self.changes[name] = self.changes.get(name, 0) + 1
        if self.changes[name] % FLATTEN == 0:
            df = scratch_table(df, "changed")
        self.rows = rows
        self._put(name, df)

    def _run(self, s: Node, out: list[DataFrame]) -> None:
        if s.incomplete:
            raise CompileError("; ".join(s.errors) or f"incomplete {s.kind}")
        getattr(self, "_run_" + s.kind.removesuffix("Statement").lower())(s, out)

    def _run_select(self, s: Node, out: list[DataFrame]) -> None:
        if s.kind == "SelectStatement" and any(c.get("assigns") for c in s.columns):
            names = [c.assigns for c in s.columns]
            values = [Node(c.kind, c.start, c.end, expression=c.expression, alias=f"v{k}") for k, c in enumerate(s.columns)]
            last = self._result(Node(s.kind, s.start, s.end, **(s.fields | {"columns": values}))).tail(1)
            for n, v in zip(names, last[0] if last else []):
                if n.lower() not in self.variables:
                    _undeclared(n)
                self._set(n.lower(), "NULL" if v is None else literal(str(v)))
            self.rows = lambda: len(last)
            return
        df = self._result(s)
        self.rows = df.count
        if s.get("into"):
            self._put(plain(s.into.parts[-1]), df)
        else:
            out.append(df)

    _run_setoperator = _run_select

    def _result(self, s: Node) -> DataFrame:
        return self._spark_sql(self._compiler().query(s)[0])

    def _percent(self, inner: str, down: list[bool], share: str, ties: bool) -> str | None:
        """The text of the first rows of a query whose last columns are its sort keys, which are taken now; None where the query does not stand alone
        or has columns that cannot be written."""
        try:
            df, share = self._spark_sql(inner), self._spark_sql(share)
            names = df.columns[: len(df.columns) - len(down)]
            cols, keys = [f"c{k}" for k in range(len(names))], [f"__o{k}" for k in range(len(down))]
            df = df.toDF(*cols, *keys)
            empty = {f.name for f in df.schema if isinstance(f.dataType, NullType)}  # columns that hold nothing and order nothing
            down = {k: d for k, d in enumerate(down) if keys[k] not in empty}
            hashed = [F.col(f.name) for f in df.schema if f.name not in empty and not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
            df = df.drop(*empty).withColumn("__t", F.xxhash64(*hashed) if hashed else F.lit(0))
            ranges = self._ranges(df, down)
        except AnalysisException:
            return None
        taken = self._first(ranges, down, share)
        if ties:
            last = (taken.orderBy(*self._order(down, back=True)) if down else taken).limit(1).select(*(F.col(f"__o{k}").alias(f"__l{k}") for k in down))
            taken = ranges.crossJoin(F.broadcast(last)).where(up_to(down))
        self.taken += 1
        view = f"tw_{self.id}__percent_{self.taken}"
        taken.createOrReplaceTempView(view)
        text = ", ".join(f"{'NULL' if c in empty else ticked(c)} AS {ticked(n)}" for c, n in zip(cols, names))
        by = ", ".join(f"`__o{k}` {'DESC' if d else 'ASC'}" for k, d in down.items())
        return f"SELECT {text} FROM {ticked(view)}" + (f" ORDER BY {by}" if by else "")

    @staticmethod
    def _order(down: dict[int, bool], back: bool = False) -> list[Column]:
        return [F.col(f"__o{k}").desc() if d != back else F.col(f"__o{k}").asc() for k, d in down.items()]

    def _ranges(self, df: DataFrame, down: dict[int, bool]) -> DataFrame:
        """The rows written by ranges `__p` of the sort keys and, among equal ones, of the rows' hash `__t`; as they lie where nothing orders them."""
        parts = max(8, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        ranged = df.repartitionByRange(parts, *self._order(down), "__t") if down else df
        return scratch_table(ranged.withColumn("__p", F.spark_partition_id()), "ranges")

    def _first(self, ranges: DataFrame, down: dict[int, bool], share: DataFrame) -> DataFrame:
        """The first rows, as many as the share says: whole ranges, and of the one with the cut, which is divided until it is small, its own first rows.
        No task sorts more than FEW rows, and rows equal to each other need no sort."""
        taken, left, order = [], None, [*self._order(down), F.col("__t").asc()]
        while True:
            counts = sorted(ranges.groupBy("__p").count().collect())
            if left is None:
                left = max(0, share.selectExpr(f"ceil(`n` * {sum(n for _, n in counts)}L / 100.0D)").first()[0] or 0)
            whole, cut = -1, None
            for p, n in counts:
                if n > left:
                    cut = n, ranges.where(F.col("__p") == p)
                    break
                whole, left = p, left - n
            taken.append(ranges.where(F.col("__p") <= whole))
            if cut is None or not left:
                break
            n, rest = cut
            if n <= FEW or not down:
                taken.append((rest.repartition(1).sortWithinPartitions(*order) if down else rest).limit(left))  # a sort that can spill, where a top-n cannot
                break
            if len(counts) == 1:  # not divided, as nearly all of its rows equal its last one
                by = [*(f"__o{k}" for k in down), "__t"]
                end = rest.orderBy(*self._order(down, back=True), F.col("__t").desc()).limit(1).select(*(F.col(k).alias(f"__e{k}") for k in by))
                both = rest.crossJoin(F.broadcast(end))
                is_end = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__e{k}")) for k in by))
                rest = both.where(~is_end).select(*ranges.columns)
                n = rest.count()
                if n <= left:
                    taken += [rest, both.where(is_end).select(*ranges.columns).limit(left - n)]
                    break
            ranges = self._ranges(rest.drop("__p"), down)
        return reduce(DataFrame.unionByName, taken)

    def _run_with(self, s: Node, out: list[DataFrame]) -> None:
        if s.body.kind not in ("InsertStatement", "UpdateStatement", "DeleteStatement"):
            return self._run_select(s, out)
        kept, changed = dict(self.frames), plain(s.body.table.parts[-1]).lower()
        names = [plain(c.name).lower() for c in s.ctes]
        if changed in names and s.body.kind != "InsertStatement":
            return self._change_through(s, names.index(changed), out)
        try:
            self._name_ctes(s)
            self._run(s.body, out)
        finally:
            for n in names:
                self.frames.pop(n, None)
                if n in kept:
                    self._put(n, kept[n])

    def _name_ctes(self, s: Node) -> None:
        """The table expressions of a WITH as tables of the session."""
        for k, t in enumerate(s.ctes):
            c = self._compiler()
            head = c.with_head(Node("WithStatement", s.start, s.end, ctes=s.ctes[: k + 1], body=s.body))
            self._put(plain(t.name), self._spark_sql(f"{head} SELECT * FROM {quoted(t.name)}"))

    def _change_through(self, s: Node, k: int, out: list[DataFrame]) -> None:
        """UPDATE or DELETE of a table expression over one table: of the rows of that table which it stands for. They are told apart by a row number,
        since windows may treat equal rows differently."""
        q = s.ctes[k].query
        simple = q.kind == "SelectStatement" and len(q.get("from") or []) == 1 and q.get("from")[0].get("name") and not q.get("from")[0].get("joins")
        if not simple or q.distinct or any(q.get(x) for x in ("groupBy", "having")) or s.ctes[k].get("columns"):
            raise CompileError("a changed table expression must be over one table, without grouping")
        base = plain(q.get("from")[0].name.parts[-1]).lower()
        kept = dict(self.frames)
        marked = scratch_table(self.frames[base].withColumn("__rid", F.monotonically_increasing_id()), "target")
        try:
            self._put(base, marked)
            q = Node(q.kind, q.start, q.end, **q.fields)
            if not any(c.expression.kind == "WildcardExpression" for c in q.columns):
                rid = Node("Column", q.start, q.end, expression=Node("Identifier", q.start, q.end, name="__rid", parts=["__rid"]))
                q.set(columns=[*q.columns, rid])
            ctes = [Node("CTE", c.start, c.end, **(c.fields | ({"query": q} if i == k else {}))) for i, c in enumerate(s.ctes)]
            self._name_ctes(Node(s.kind, s.start, s.end, ctes=ctes, body=s.body))
            through = plain(s.ctes[k].name).lower()
            seen = self.frames[through]
            if s.body.kind == "DeleteStatement":
                self._run(s.body, out)
                gone = seen.select("__rid").join(self.frames[through].select("__rid"), "__rid", "left_anti")
                result = marked.join(gone, "__rid", "left_anti").drop("__rid")
            else:
                self._run(s.body, out)
                names = [plain(a.column.parts[-1]).lower() for a in s.body.assignments]
                now = self.frames[through].select(F.col("__rid"), F.lit(True).alias("__hit"), *(F.col(n).alias(f"__{n}") for n in names))
                both = marked.join(now, "__rid", "left")
                new = {f.name: F.when(F.col("__hit"), F.col(f"__{f.name.lower()}").cast(f.dataType)).otherwise(F.col(f.name)) for f in kept[base].schema if f.name.lower() in names}
                result = both.select(*(new.get(f.name, F.col(f.name)).alias(f.name) for f in kept[base].schema))
            rows = self.rows
        finally:
            for n in {base, *(plain(c.name).lower() for c in s.ctes)}:
                self.frames.pop(n, None)
                if n in kept:
                    self._put(n, kept[n])
        self._changed(base, result, rows)

    def _run_print(self, s: Node, out) -> None:
        self.messages.append(str(self._spark_sql(f"SELECT {self._compiler().expr(s.value, [])}").first()[0]))

    def _run_declare(self, s: Node, out) -> None:
        for d in s.declarations:
            columns = d.columns if d.dataType == "TABLE" else self._table_type(d.dataType)
            if columns is not None:
                self._create(d.name, columns)
            else:
                self._set(d.name.lower(), self._compiler().expr(d.value, []) if d.get("value") else "NULL", d.dataType)

    def _run_set(self, s: Node, out) -> None:
        if s.get("variable"):
            key = s.variable.lower()
            if key not in self.variables:
                _undeclared(s.variable)
            self._set(key, self._compiler().expr(s.value, []))

    def _run_if(self, s: Node, out) -> None:
        if self._spark_sql(f"SELECT {self._compiler().expr(s.condition, [])}").first()[0]:
            self._run(s.then, out)
        elif s.get("otherwise"):
            self._run(s.otherwise, out)

    def _run_block(self, s: Node, out) -> None:
        for x in s.body:
            self._run(x, out)

    def _create(self, name: str, columns: list[Node]) -> None:
        fields = ", ".join(f"{quoted(c.name)} {spark_type(c.dataType)}" + (" NOT NULL" if c.get("notNull") else "") for c in columns)
        self.defaults[plain(name).lower()] = {plain(c.name).lower(): self._compiler().expr(c.default, []) for c in columns if c.get("default")}
        self._put(plain(name), self.spark.createDataFrame([], fields))

    def _run_create(self, s: Node, out) -> None:
        name = plain(s.name.parts[-1])
        if s.objectType == "TABLE":
            self._create(name, s.columns)
        elif s.objectType == "TYPE":
            self.types[name.lower()] = s.columns
        elif s.objectType == "VIEW":
            df = self._result(s.body)
            self._put(name, df.toDF(*map(plain, s.names)) if s.get("names") else df)
        elif s.objectType == "PROCEDURE":
            self.routines[name.lower()] = s
        elif s.objectType == "FUNCTION":
            outer = dict(self.variables)
            for p in s.parameters:
                self.variables[p.name.lower()] = (quoted("p_" + p.name[1:].lower()), spark_type(p.dataType).lower())
            c = self._compiler(percent=False)  # a function's tables are read when it is called
            given = ", ".join(f"{quoted('p_' + p.name[1:].lower())} {spark_type(p.dataType)}" for p in s.parameters)
            body = c.query(s.result)[0] if s.returns == "TABLE" else c.expr(s.result, [])
            self.variables = outer
            real = f"tw_{self.id}_{name.lower()}"
            returned = "TABLE" if s.returns == "TABLE" else spark_type(s.returns)
            self._spark_sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {quoted(real)}({given}) RETURNS {returned} RETURN {body}")
            self.functions[name.lower()] = real

    # DML
    def _run_insert(self, s: Node, out) -> None:
        name = plain(s.table.parts[-1]).lower()
        target = self.frames.get(name)
        if target is None:
            raise CompileError(f"unknown table {s.table.name}")
        c = self._compiler()
        text = c.query(s.query)[0] if s.get("query") else "VALUES " + ", ".join("(" + ", ".join(c.expr(e, []) for e in r) + ")" for r in s.values)
        given = [plain(x).lower() for x in s.get("columns") or target.columns]
        rows = self._spark_sql(text).toDF(*[f"_{k}" for k in range(len(given))])
        place = {n: f"_{k}" for k, n in enumerate(given)}
        defaults = self.defaults.get(name, {})
        cols = [(F.col(place[f.name.lower()]) if f.name.lower() in place else F.expr(defaults.get(f.name.lower(), "NULL"))).cast(f.dataType).alias(f.name) for f in target.schema]
        self._changed(name, target.unionByName(rows.select(*cols)), rows.count)

    def _target(self, s: Node) -> tuple[str, str]:
        """The changed table's name and its alias in the statement's FROM."""
        name = plain(s.table.parts[-1]).lower()
        for t in s.get("from") or []:
            for x in [t, *(j.target for j in t.get("joins") or [])]:
                if x.get("name") and x.get("alias") and plain(x.alias).lower() == name:
                    return plain(x.name.parts[-1]).lower(), name
        return name, plain(s.alias) if s.get("alias") else name

    def _joined(self, s: Node, name: str, alias: str, values: list[Node]) -> tuple[list[str], DataFrame]:
        """The target's columns that the joined statement mentions, and (k0.., __hit) of their values that it hits, once each: the least values to
        be set where several match."""
        target = self.frames[name]
        held = {x.lower(): x for x in target.columns}
        read = [part for part in [*(s.get("from") or []), s.get("where"), *values] if part is not None]
        named = [[plain(x).lower() for x in n.parts[-2:]] for part in read for n in part.walk() if n.kind == "Identifier" and n.get("parts")]
        keys = sorted({held[n[-1]] for n in named if n[-1] in held and (len(n) == 1 or n[0] == alias)}) or target.columns[:1]
        c, env = self._compiler(), []
        sources = ", ".join(c._source(t, env, []) for t in s.get("from"))
        if alias not in [a for a, _ in env] and name not in [a for a, _ in env]:
            sources = f"{c._relation(Node('TableReference', 0, name=s.table), env, [])}, {sources}"
        cols = [f"{quoted(alias)}.{quoted(k)} AS `k{i}`" for i, k in enumerate(keys)] + ["CAST(1 AS INT) AS `v`"] + [f"{c.expr(v, env)} AS `v{k}`" for k, v in enumerate(values)]
        hit = self._spark_sql(f"SELECT {', '.join(cols)} FROM {sources}" + (f" WHERE {c.condition(s.where, env)}" if s.get("where") else ""))
        by = [f"k{i}" for i in range(len(keys))]
        return keys, hit.groupBy(*by).agg(F.min(F.struct("v", *(f"v{k}" for k in range(len(values))))).alias("__hit")).select(*(F.col(k).alias(f"__{k}") for k in by), "__hit")

    def _met(self, name: str, keys: list[str], hit: DataFrame, how: str) -> DataFrame:
        same = [self.frames[name][quoted(k)].eqNullSafe(hit[f"__k{i}"]) for i, k in enumerate(keys)]
        return self.frames[name].join(hit, reduce(lambda x, y: x & y, same), how)

    def _run_update(self, s: Node, out) -> None:
        name, alias = self._target(s)
        target = self.frames[name]
        names = [plain(a.column.parts[-1]).lower() for a in s.assignments]
        if s.get("from"):
            keys, hit = self._joined(s, name, alias, [a.value for a in s.assignments])
            both, before = self._met(name, keys, hit, "left"), self._met(name, keys, hit, "left_semi")
            value = lambda f: F.col(f"__hit.v{names.index(f.name.lower())}").cast(f.dataType)
            new = {f.name: F.when(F.col("__hit").isNotNull(), value(f)).otherwise(F.col(f.name)) for f in target.schema if f.name.lower() in names}
            cols = [new.get(f.name, F.col(f.name)).alias(f.name) for f in target.schema]
            return self._changed(name, both.select(*cols), before.count)
        env = [(alias, {c.lower(): t for c, t in target.dtypes})]
        c = self._compiler()
        where = f"coalesce({c.expr(s.where, env)}, false)" if s.get("where") else "true"
        cols = []
        for f in target.schema:
            value = quoted(f.name)
            if f.name.lower() in names:
                given = c.expr(s.assignments[names.index(f.name.lower())].value, env)
                value = f"CAST(CASE WHEN {where} THEN {given} ELSE {value} END AS {f.dataType.simpleString()})"
            cols.append(f"{value} AS {quoted(f.name)}")
        self._changed(name, self._spark_sql(f"SELECT {', '.join(cols)} FROM {quoted(self._view(name))} AS {quoted(alias)}"), self._counted(name, alias, where))

    def _run_delete(self, s: Node, out) -> None:
        name, alias = self._target(s)
        if s.get("from"):
            keys, hit = self._joined(s, name, alias, [])
            return self._changed(name, self._met(name, keys, hit, "left_anti"), self._met(name, keys, hit, "left_semi").count)
        env = [(alias, {c.lower(): t for c, t in self.frames[name].dtypes})]
        where = f"coalesce({self._compiler().expr(s.where, env)}, false)" if s.get("where") else "true"
        rows = self._counted(name, alias, where)
        self._changed(name, self._spark_sql(f"SELECT * FROM {quoted(self._view(name))} AS {quoted(alias)} WHERE NOT {where}"), rows)

    def _counted(self, name: str, alias: str, where: str) -> Callable[[], int]:
        """How many rows of the table, as it is now, a change hits."""
        return self._spark_sql(f"SELECT * FROM {quoted(self._view(name))} AS {quoted(alias)} WHERE {where}").count


def _undeclared(name: str):
    raise CompileError(f"variable {name} is not declared")
