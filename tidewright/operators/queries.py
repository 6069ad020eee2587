"""Queries over the star schema: T-SQL text, and the same in DuckDB's dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import parquet_tables
from .session import Session

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
FLAGSHIP = """SELECT TOP 10 [n].[n_name], CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))) AS DECIMAL(18,2)) AS revenue
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
GROUP BY n.n_name ORDER BY revenue DESC, n.n_name"""

# name: (T-SQL, DuckDB SQL; None where the text is the same for both)
CATALOGUE: dict[str, tuple[str, str | None]] = {
    "flagship": (
        FLAGSHIP,
        "SELECT n.n_name, CAST(SUM(CAST(l.l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2)))) AS DECIMAL(18,2)) AS revenue FROM "
        "lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey "
        "GROUP BY n.n_name ORDER BY revenue DESC, n.n_name LIMIT 10",
    ),
    "scan_star": ("SELECT * FROM dbo.nation", "SELECT * FROM nation"),
    "project_alias_forms": (
        "SELECT k = n.n_nationkey, n.n_name AS nm, n.n_regionkey rk FROM nation n",
        "SELECT n_nationkey AS k, n_name AS nm, n_regionkey AS rk FROM nation",
    ),
    "distinct_cols": ("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer", None),
    "select_without_from": ("SELECT 1 AS a, 'x' AS b", None),
    "where_compare": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'F'", None),
    "where_bool": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' OR o_orderstatus = 'F' AND o_custkey < 50", None),
    "where_in_list": ("SELECT c_custkey, c_name FROM customer WHERE c_nationkey IN (1, 3, 5)", None),
    "where_between": ("SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 40", None),
    "where_like": ("SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%A%'", None),
    "where_like_class": ("SELECT n_name FROM nation WHERE n_name LIKE '[A-C]%'", "SELECT n_name FROM nation WHERE regexp_matches(n_name, '^[A-C]')"),
    "where_is_null": ("SELECT o_orderkey FROM orders WHERE o_orderdate IS NOT NULL AND NOT (o_custkey = 1)", None),
    "in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", None),
    "not_in_subquery": ("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", None),
    "exists_corr": ("SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "not_exists_corr": ("SELECT c.c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)", None),
    "exists_or": (
        "SELECT c.c_custkey FROM customer c WHERE c.c_nationkey = 3 OR EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > "
        "300000)",
        None,
    ),
    "scalar_subquery": ("SELECT n.n_name, (SELECT COUNT(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey) AS customers FROM nation n", None),
    "collate_ci": (
        "SELECT n_nationkey FROM nation WHERE n_name COLLATE Latin1_General_CI_AS = 'france'",
        "SELECT n_nationkey FROM nation WHERE lower(n_name) = 'france'",
    ),
    "int_division": ("SELECT o_orderkey, o_custkey / 7 AS q, o_custkey % 7 AS r FROM orders", "SELECT o_orderkey, o_custkey // 7 AS q, o_custkey % 7 AS r FROM orders"),
    "string_plus": ("SELECT c_name + '-' + c_mktsegment AS tag FROM customer", "SELECT c_name || '-' || c_mktsegment AS tag FROM customer"),
    "bitwise_leftassoc": ("SELECT n_nationkey & 3 + 1 AS a, n_nationkey ^ 5 AS b FROM nation", "SELECT (n_nationkey & 3) + 1 AS a, xor(n_nationkey, 5) AS b FROM nation"),
    "case_simple": ("SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'part' END AS s FROM orders", None),
    "case_searched": ("SELECT p_partkey, CASE WHEN p_size > 25 THEN 'big' WHEN p_size > 10 THEN 'mid' END AS s FROM part", None),
    "join_left": ("SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT OUTER JOIN orders o ON c.c_custkey = o.o_custkey", None),
    "join_right": ("SELECT c.c_custkey, o.o_orderkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey", None),
    "join_full": ("SELECT s.s_suppkey, n.n_name FROM supplier s FULL JOIN nation n ON s.s_nationkey = n.n_nationkey", None),
    "join_cross": ("SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n", None),
    "join_comma": ("SELECT r.r_name, n.n_name FROM region r, nation n WHERE r.r_regionkey = n.n_regionkey", None),
    "join_theta": ("SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey", None),
    "join_derived": (
        "SELECT n.n_name, d.total FROM nation n JOIN (SELECT c_nationkey AS k, COUNT(*) AS total FROM customer GROUP BY c_nationkey) d ON d.k = n.n_nationkey",
        None,
    ),
    "join_hints": (
        "SELECT o.o_orderkey, c.c_name FROM orders o WITH (NOLOCK) JOIN customer c WITH (NOLOCK, INDEX(ix)) ON o.o_custkey = c.c_custkey",
        "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    ),
    "cross_apply_top2": (
        "SELECT c.c_custkey, t.o_orderkey FROM customer c CROSS APPLY (SELECT TOP 2 o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY "
        "o.o_totalprice DESC, o.o_orderkey) t",
        "SELECT o_custkey AS c_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM "
        "orders WHERE o_custkey IN (SELECT c_custkey FROM customer)) WHERE r <= 2",
    ),
    "outer_apply_top1": (
        "SELECT c.c_custkey, t.o_orderkey FROM customer c OUTER APPLY (SELECT TOP 1 o.o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY "
        "o.o_orderkey DESC) t",
        "SELECT c.c_custkey, max(o.o_orderkey) AS o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey",
    ),
    "group_by_expr": (
        "SELECT DATEPART(year, o_orderdate) AS y, COUNT(*) AS n FROM orders GROUP BY DATEPART(year, o_orderdate)",
        "SELECT CAST(date_part('year', o_orderdate) AS INTEGER) AS y, COUNT(*) AS n FROM orders GROUP BY 1",
    ),
    "agg_basic": (
        "SELECT l_returnflag, COUNT(*) AS n, MIN(l_quantity) AS lo, MAX(l_quantity) AS hi, ROUND(AVG(l_quantity), 4) AS mean FROM lineitem GROUP BY "
        "l_returnflag",
        None,
    ),
    "having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", None),
    "count_distinct": ("SELECT COUNT(DISTINCT o_custkey) AS n FROM orders", None),
    "rollup": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)", None),
    "cube": ("SELECT l_returnflag, l_linestatus, COUNT(*) AS n FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)", None),
    "win_row_number": (
        "SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders",
        "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS rn FROM orders",
    ),
    "win_lag": ("SELECT event_id, LAG(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events", None),
    "win_in_order_by": (
        "SELECT TOP 20 o_orderkey FROM orders ORDER BY ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey), o_orderkey",
        "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders) ORDER BY r, o_orderkey "
        "LIMIT 20",
    ),
    "top_percent": (
        "SELECT TOP 10 PERCENT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey",
        "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE "
        "r <= ceil(n * 0.1)",
    ),
    "setop_chain": ("SELECT n_regionkey AS k FROM nation UNION SELECT 7 EXCEPT SELECT 2", "(SELECT n_regionkey AS k FROM nation UNION SELECT 7) EXCEPT SELECT 2"),
    "intersect": ("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    "cte_chain": (
        "WITH a AS (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey), b AS (SELECT n, COUNT(*) AS m FROM a GROUP BY n) SELECT n, m FROM b",
        None,
    ),
    "cte_recursive": (
        "WITH t(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM t WHERE k < 50) SELECT k FROM t",
        "WITH RECURSIVE t(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM t WHERE k < 50) SELECT k FROM t",
    ),
    "fn_string": (
        "SELECT LEN(c_name) AS a, SUBSTRING(c_name, 0, 3) AS b, CHARINDEX('0', c_name) AS c, LEFT(c_name, 3) AS d, REPLICATE('x', 3) AS e FROM customer",
        "SELECT CAST(length(rtrim(c_name)) AS INTEGER) AS a, substr(c_name, 1, 2) AS b, CAST(strpos(c_name, '0') AS INTEGER) AS c, left(c_name, 3) AS d, 'xxx' "
        "AS e FROM customer",
    ),
    "var_filter": (
        "DECLARE @lo INT = 5, @seg VARCHAR(20) = 'BUILDING'; SET @lo = @lo + 1; SELECT c_custkey FROM customer WHERE c_mktsegment = @seg AND c_nationkey > @lo",
        "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey > 6",
    ),
    "if_else": ("IF (SELECT COUNT(*) FROM region) > 3 SELECT r_name FROM region ELSE SELECT n_name AS r_name FROM nation", "SELECT r_name FROM region"),
    "table_variable": (
        "DECLARE @t TABLE (k INT, v VARCHAR(10) DEFAULT 'none'); INSERT INTO @t (k) VALUES (1), (2); INSERT INTO @t VALUES (3, 'three'); SELECT * FROM @t",
        "SELECT * FROM (VALUES (1, 'none'), (2, 'none'), (3, 'three')) t(k, v)",
    ),
    "update_where": (
        "UPDATE nation SET n_name = 'X' + n_name WHERE n_regionkey = 1; SELECT * FROM nation",
        "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'X' || n_name ELSE n_name END AS n_name, n_regionkey FROM nation",
    ),
    "update_join": (
        "UPDATE n SET n_name = r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey = 2; SELECT * FROM nation",
        "SELECT n_nationkey, coalesce(r.r_name, n_name) AS n_name, n_regionkey FROM nation LEFT JOIN region r ON n_regionkey = r_regionkey AND r_regionkey = 2",
    ),
    "delete_where": ("DELETE FROM nation WHERE n_regionkey = 1; SELECT * FROM nation", "SELECT * FROM nation WHERE n_regionkey <> 1"),
    "delete_join": (
        "DELETE n FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_regionkey > 2; SELECT * FROM nation",
        "SELECT * FROM nation WHERE n_regionkey <= 2",
    ),
    "join_inner": ("SELECT o.o_orderkey, c.c_name FROM orders o INNER JOIN customer c ON o.o_custkey = c.c_custkey", None),
    "join_self": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "join_range": ("SELECT n.n_nationkey, r.r_regionkey FROM nation n JOIN region r ON n.n_nationkey BETWEEN r.r_regionkey * 5 AND r.r_regionkey * 5 + 4", None),
    "where_not": ("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 1000)", None),
    "agg_global": ("SELECT COUNT(*) AS n, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM orders", None),
    "win_rank": (
        "SELECT o_orderkey, RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS r, DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY "
        "o_orderstatus) AS d FROM orders",
        "SELECT o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS INTEGER) AS r, CAST(dense_rank() OVER (PARTITION BY o_custkey "
        "ORDER BY o_orderstatus) AS INTEGER) AS d FROM orders",
    ),
    "win_sum_part": (
        "SELECT n_nationkey, SUM(n_nationkey) OVER (PARTITION BY n_regionkey) AS s FROM nation",
        "SELECT n_nationkey, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey) AS BIGINT) AS s FROM nation",
    ),
    "win_sum_running": (
        "SELECT n_nationkey, SUM(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS s FROM nation",
        "SELECT n_nationkey, CAST(sum(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS BIGINT) AS s FROM nation",
    ),
    "order_multi": ("SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name", None),
    "top_n": ("SELECT TOP (7) o_orderkey FROM orders ORDER BY o_orderkey DESC", "SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 7"),
    "union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "union_all": ("SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region", None),
    "except": ("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 9", None),
    "setop_order_by": ("SELECT n_regionkey AS k FROM nation UNION ALL SELECT 9 ORDER BY k", None),
    "cte_columns": ("WITH a(k, n) AS (SELECT n_regionkey, COUNT(*) FROM nation GROUP BY n_regionkey) SELECT k, n FROM a WHERE n > 1", None),
    "cte_setop": ("WITH a AS (SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region) SELECT k, COUNT(*) AS n FROM a GROUP BY k", None),
    "fn_math": (
        "SELECT n_nationkey, ABS(n_nationkey - 10) AS a, SIGN(n_nationkey - 10) * 1 AS s FROM nation WHERE FLOOR(n_nationkey) > 2",
        "SELECT n_nationkey, abs(n_nationkey - 10) AS a, sign(n_nationkey - 10) AS s FROM nation WHERE n_nationkey > 2",
    ),
    "fn_null": (
        "SELECT n_nationkey, ISNULL(NULLIF(n_regionkey, 1), -1) AS a, COALESCE(NULL, n_name) AS b FROM nation",
        "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), -1) AS a, n_name AS b FROM nation",
    ),
    "fn_cast": ("SELECT CAST(n_nationkey AS VARCHAR(10)) AS a, CONVERT(INT, '12') AS b FROM nation", "SELECT CAST(n_nationkey AS VARCHAR) AS a, 12 AS b FROM nation"),
    "fn_date": (
        "SELECT o_orderkey, YEAR(o_orderdate) AS y, MONTH(o_orderdate) AS m FROM orders",
        "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m FROM orders",
    ),
    "temp_table_pipeline": (
        "SELECT n_nationkey AS k, n_name INTO #t FROM nation WHERE n_regionkey = 2; SELECT COUNT(*) AS n, MIN(k) AS lo FROM #t",
        "SELECT count(*) AS n, min(n_nationkey) AS lo FROM nation WHERE n_regionkey = 2",
    ),
    "view_query": (
        "CREATE VIEW v AS SELECT n_regionkey AS k, COUNT(*) AS n FROM nation GROUP BY n_regionkey; SELECT r.r_name, v.n FROM v JOIN region r ON r.r_regionkey "
        "= v.k",
        "SELECT r_name, n FROM (SELECT n_regionkey AS k, count(*) AS n FROM nation GROUP BY n_regionkey) JOIN region ON r_regionkey = k",
    ),
    "scalar_udf": (
        "CREATE FUNCTION dbo.twice (@n INT) RETURNS INT AS BEGIN RETURN @n * 2 END; SELECT dbo.twice(n_nationkey) AS d FROM nation",
        "SELECT n_nationkey * 2 AS d FROM nation",
    ),
    "tvf_apply": (
        "CREATE FUNCTION dbo.nations_of (@r INT) RETURNS TABLE AS RETURN (SELECT n_name FROM nation WHERE n_regionkey = @r); SELECT r.r_name, f.n_name FROM "
        "region r CROSS APPLY dbo.nations_of(r.r_regionkey) f",
        "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey",
    ),
    "insert_values": (
        "INSERT INTO region (r_regionkey, r_name) VALUES (50, 'NEW'), (51, 'NEWER'); SELECT r_regionkey, r_name FROM region",
        "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 50, 'NEW' UNION ALL SELECT 51, 'NEWER'",
    ),
    "insert_select": (
        "INSERT INTO region (r_regionkey, r_name) SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 0; SELECT r_regionkey, r_name FROM region",
        "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 0",
    ),
    "arith_precedence": ("SELECT n_nationkey, n_nationkey + 2 * 3 - n_regionkey % 3 AS a, -(n_nationkey - 4) AS b, ~n_regionkey AS c FROM nation", None),
    "qualified_star": ("SELECT n.*, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey", None),
    "derived_names": (
        "SELECT n_nationkey, MAX(n_regionkey), 7, n_nationkey + 1 FROM nation GROUP BY n_nationkey",
        'SELECT n_nationkey, max(n_regionkey) AS "MAX", 7 AS "7", n_nationkey + 1 AS expression FROM nation GROUP BY n_nationkey',
    ),
    "where_any_all": (
        "SELECT c_custkey FROM customer WHERE c_nationkey > ALL (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) OR c_nationkey <= ANY (SELECT "
        "n_nationkey FROM nation WHERE n_regionkey = 0) OR c_custkey = SOME (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
        "SELECT c_custkey FROM customer WHERE c_nationkey > (SELECT max(n_nationkey) FROM nation WHERE n_regionkey = 1) OR c_nationkey <= (SELECT "
        "max(n_nationkey) FROM nation WHERE n_regionkey = 0) OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    ),
    "all_of_nothing": (
        "SELECT n_nationkey FROM nation WHERE n_nationkey > ALL (SELECT r_regionkey FROM region WHERE r_regionkey > 90) AND NOT n_nationkey > ANY (SELECT "
        "r_regionkey FROM region WHERE r_regionkey > 90)",
        "SELECT n_nationkey FROM nation",
    ),
    "all_with_null": (
        "SELECT n_nationkey FROM nation WHERE NOT n_nationkey > ALL (SELECT NULLIF(r_regionkey, 0) FROM region)",
        "SELECT n_nationkey FROM nation WHERE n_nationkey <= 4",
    ),
    "not_in_with_null": (
        "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT NULLIF(r_regionkey, 0) FROM region) AND n_regionkey > 0",
        "SELECT n_nationkey FROM nation WHERE false",
    ),
    "not_in_nothing": (
        "SELECT n_nationkey FROM nation WHERE NULLIF(n_nationkey, 3) NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 90)",
        "SELECT n_nationkey FROM nation",
    ),
    "not_in_null_key": (
        "SELECT n_nationkey FROM nation WHERE NULLIF(n_nationkey, 13) NOT IN (SELECT r_regionkey FROM region)",
        "SELECT n_nationkey FROM nation WHERE n_nationkey > 4 AND n_nationkey <> 13",
    ),
    "like_backslash": (
        "SELECT n_nationkey, 'a\\b' AS t FROM nation WHERE 'a\\b' LIKE 'a\\%' AND n_name LIKE 'A%' AND 'x_y' LIKE 'x!_y' ESCAPE '!'",
        "SELECT n_nationkey, 'a\\b' AS t FROM nation WHERE n_name LIKE 'A%'",
    ),
    "or_chain": (
        "SELECT n_nationkey FROM nation WHERE " + " OR ".join(f"n_nationkey = {k}" for k in range(0, 4000, 2)),
        "SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0",
    ),
    "hints_of_joined_tables": (
        "SELECT [my o].o_orderkey, c.c_name FROM orders [my o] WITH (NOLOCK) JOIN customer c WITH (BROADCAST) ON [my o].o_custkey = c.c_custkey",
        "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
    ),
    "grouping_sets": ("SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY GROUPING SETS ((n_regionkey), ())", None),
    "group_with_rollup": (
        "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey WITH ROLLUP",
        "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY ROLLUP(n_regionkey)",
    ),
    "agg_aliases": (
        "SELECT n_regionkey, COUNT_BIG(*) AS n, ROUND(STDEV(n_nationkey), 6) AS s, ROUND(VAR(n_nationkey), 6) AS v FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, count(*) AS n, round(stddev_samp(n_nationkey), 6) AS s, round(var_samp(n_nationkey), 6) AS v FROM nation GROUP BY n_regionkey",
    ),
    "win_empty_over": ("SELECT n_nationkey, COUNT(*) OVER () AS n, MAX(n_nationkey) OVER () AS m FROM nation", None),
    "win_frame": (
        "SELECT n_nationkey, SUM(n_nationkey) OVER (ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM nation",
        "SELECT n_nationkey, CAST(sum(n_nationkey) OVER (ORDER BY n_nationkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS s FROM nation",
    ),
    "win_ntile": (
        "SELECT n_nationkey, NTILE(4) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS q, ROUND(PERCENT_RANK() OVER (ORDER BY n_regionkey), 6) AS p, "
        "ROUND(CUME_DIST() OVER (ORDER BY n_regionkey), 6) AS c FROM nation",
        "SELECT n_nationkey, CAST(ntile(4) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS INTEGER) AS q, round(percent_rank() OVER (ORDER BY "
        "n_regionkey), 6) AS p, round(cume_dist() OVER (ORDER BY n_regionkey), 6) AS c FROM nation",
    ),
    "win_lead_first_last": (
        "SELECT n_nationkey, LEAD(n_nationkey, 2, -1) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS l, FIRST_VALUE(n_nationkey) OVER (PARTITION BY "
        "n_regionkey ORDER BY n_nationkey) AS f, LAST_VALUE(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS z FROM nation",
        None,
    ),
    "order_nulls": (
        "SELECT TOP 30 o_orderkey, NULLIF(o_orderstatus, 'F') AS s FROM orders ORDER BY NULLIF(o_orderstatus, 'F'), o_orderkey",
        "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s NULLS FIRST, o_orderkey LIMIT 30",
    ),
    "top_ties": (
        "SELECT TOP 3 WITH TIES n_nationkey, NULLIF(n_regionkey, 2) AS r FROM nation ORDER BY NULLIF(n_regionkey, 2) DESC",
        "SELECT n_nationkey, nullif(n_regionkey, 2) AS r FROM nation WHERE n_regionkey = 4",
    ),
    "top_ties_null_key": ("SELECT TOP 2 WITH TIES n_nationkey FROM nation ORDER BY NULLIF(n_regionkey, 2)", "SELECT n_nationkey FROM nation WHERE n_regionkey = 2"),
    "top_percent_in_subquery": (
        "SELECT COUNT(*) AS n, MIN(t.o_orderkey) AS lo FROM (SELECT TOP 10 PERCENT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey) t",
        "SELECT count(*) AS n, min(o_orderkey) AS lo FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS r, count(*) OVER "
        "() AS n FROM orders) WHERE r <= ceil(n * 0.1)",
    ),
    "offset_fetch": (
        "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 10 ROWS FETCH NEXT 5 ROWS ONLY",
        "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 10",
    ),
    "setop_in_subquery": ("SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 UNION SELECT 5)", None),
    "cte_nested": ("SELECT t.k FROM (SELECT a.k FROM (SELECT n_nationkey AS k FROM nation) a WHERE a.k IN (SELECT r_regionkey FROM region)) t", None),
    "cte_max_recursion": (
        "WITH t(k) AS (SELECT 1 UNION ALL SELECT k + 1 FROM t WHERE k < 300) SELECT COUNT(*) AS n, MAX(k) AS hi FROM t OPTION (MAXRECURSION 400)",
        "SELECT 300 AS n, 300 AS hi",
    ),
    "cte_insert": (
        "WITH n AS (SELECT n_nationkey + 100 AS k, n_name AS v FROM nation WHERE n_regionkey = 3) INSERT INTO region (r_regionkey, r_name) SELECT k, v FROM n; "
        "SELECT r_regionkey, r_name FROM region",
        "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 3",
    ),
    "cte_update": (
        "WITH m AS (SELECT MAX(n_nationkey) AS k FROM nation) UPDATE nation SET n_name = 'LAST' WHERE n_nationkey IN (SELECT k FROM m); SELECT * FROM nation",
        "SELECT n_nationkey, CASE WHEN n_nationkey = 24 THEN 'LAST' ELSE n_name END AS n_name, n_regionkey FROM nation",
    ),
    "cte_delete_through": (
        "WITH d AS (SELECT n_regionkey, ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation) DELETE FROM d WHERE rn > 1; "
        "SELECT * FROM nation",
        "SELECT n_nationkey, n_name, n_regionkey FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation) WHERE r = "
        "1",
    ),
    "cte_update_through": (
        "WITH d AS (SELECT n_name, ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation) UPDATE d SET n_name = 'FIRST' WHERE rn "
        "= 1; SELECT * FROM nation",
        "SELECT n_nationkey, CASE WHEN r = 1 THEN 'FIRST' ELSE n_name END AS n_name, n_regionkey FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey "
        "ORDER BY n_nationkey) AS r FROM nation)",
    ),
    "rowcount": (
        "UPDATE nation SET n_name = 'X' WHERE n_regionkey = 1; DECLARE @a INT = @@ROWCOUNT; DELETE n FROM nation n JOIN region r ON n.n_regionkey = "
        "r.r_regionkey WHERE r.r_regionkey > 2; DECLARE @b INT = @@ROWCOUNT; SELECT @a AS a, @b AS b, @@ERROR AS c",
        "SELECT (SELECT count(*) FROM nation WHERE n_regionkey = 1) AS a, (SELECT count(*) FROM nation WHERE n_regionkey > 2) AS b, 0 AS c",
    ),
    "assign_last_row": (
        "DECLARE @v INT, @n VARCHAR(30); SELECT @v = n_nationkey, @n = n_name FROM nation ORDER BY n_nationkey; SELECT @v AS v, @n AS n",
        "SELECT n_nationkey AS v, n_name AS n FROM nation ORDER BY n_nationkey DESC LIMIT 1",
    ),
    "table_type": (
        "CREATE TYPE dbo.Pairs AS TABLE (k INT NOT NULL, v VARCHAR(20)); DECLARE @t dbo.Pairs; INSERT INTO @t SELECT n_nationkey, n_name FROM nation WHERE "
        "n_regionkey = 2; SELECT k, v FROM @t",
        "SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_regionkey = 2",
    ),
    "create_table": (
        "CREATE TABLE t (k INT PRIMARY KEY, v DECIMAL(9,2) DEFAULT 1.5); INSERT INTO t (k) VALUES (1); INSERT INTO t VALUES (2, 2.25); SELECT k, v FROM t",
        "SELECT k, CAST(v AS DECIMAL(9,2)) AS v FROM (VALUES (1, 1.5), (2, 2.25)) t(k, v)",
    ),
    "go_batches": ("DECLARE @a INT = 1; GO DECLARE @a INT = 2; SET NOCOUNT ON; SELECT @a AS a", "SELECT 2 AS a"),
    "bit_values": (
        "DECLARE @b BIT = 1; SELECT n_nationkey, CAST(n_regionkey AS BIT) AS f FROM nation WHERE @b = 1 AND CAST(n_regionkey AS BIT) <> 0",
        "SELECT n_nationkey, true AS f FROM nation WHERE n_regionkey <> 0",
    ),
    "varchar_cut": (
        "DECLARE @s VARCHAR(3) = 'abcdef'; SELECT @s AS a, CAST(n_name AS VARCHAR(4)) AS b, CONVERT(VARCHAR(2), n_nationkey + 100) AS c, TRY_CAST('x' AS INT) "
        "AS d FROM nation",
        "SELECT 'abc' AS a, left(n_name, 4) AS b, left(CAST(n_nationkey + 100 AS VARCHAR), 2) AS c, CAST(NULL AS INTEGER) AS d FROM nation",
    ),
    "fn_text_more": (
        "SELECT UPPER(n_name) AS a, LOWER(n_name) AS b, LTRIM('  x ') + '|' AS c, RTRIM(' x  ') + '|' AS d, REPLACE(n_name, 'A', '-') AS e, RIGHT(n_name, 2) "
        "AS f, REVERSE(n_name) AS g, CHAR(65) AS h, ASCII(n_name) AS i, 'a' + SPACE(2) + 'b' AS j, STUFF(n_name, 2, 2, '##') AS k, PATINDEX('%[E-G]%', n_name) "
        "AS l, CONCAT(n_name, NULL, 1) AS m, CONCAT_WS('-', n_name, NULL, n_nationkey) + '!' AS n, STR(n_nationkey, 4) + '.' AS o, QUOTENAME(n_name) AS p FROM "
        "nation",
        "SELECT upper(n_name) AS a, lower(n_name) AS b, 'x |' AS c, ' x|' AS d, replace(n_name, 'A', '-') AS e, right(n_name, 2) AS f, reverse(n_name) AS g, "
        "'A' AS h, ascii(n_name) AS i, 'a  b' AS j, left(n_name, 1) || '##' || substr(n_name, 4) AS k, CAST(CASE WHEN regexp_matches(n_name, '[E-G]') THEN "
        "length(regexp_extract(n_name, '^[^E-G]*')) + 1 ELSE 0 END AS INTEGER) AS l, n_name || '1' AS m, n_name || '-' || n_nationkey || '!' AS n, "
        "lpad(CAST(n_nationkey AS VARCHAR), 4, ' ') || '.' AS o, '[' || n_name || ']' AS p FROM nation",
    ),
    "fn_string_agg": (
        "SELECT n_regionkey, STRING_AGG(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS s FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS s FROM nation GROUP BY n_regionkey",
    ),
    "fn_math_more": (
        "SELECT n_nationkey, LOG(8, 2) AS a, ROUND(2.567, 1, 1) * 1.0 AS b, CEILING(n_nationkey / 4.0) * 1 AS c, POWER(2.0, n_regionkey) AS d, "
        "SQRT(n_nationkey) AS e, SQUARE(n_nationkey) AS f, ROUND(EXP(1), 6) AS g, LOG10(1000) AS h, n_nationkey % 7 - 3 AS i, ROUND(LOG(n_nationkey + 1), 6) "
        "AS j FROM nation",
        "SELECT n_nationkey, 3.0::DOUBLE AS a, 2.5::DOUBLE AS b, CAST(ceil(n_nationkey / 4.0) AS DECIMAL(11,0)) AS c, power(2.0, n_regionkey) AS d, "
        "sqrt(n_nationkey) AS e, n_nationkey * n_nationkey AS f, round(exp(1), 6) AS g, log10(1000) AS h, n_nationkey % 7 - 3 AS i, round(ln(n_nationkey + 1), "
        "6) AS j FROM nation",
    ),
    "fn_date_more": (
        "SELECT o_orderkey, DATEPART(week, o_orderdate) AS a, DATEPART(weekday, o_orderdate) AS b, DATEPART(quarter, o_orderdate) AS c, DATEPART(dayofyear, "
        "o_orderdate) AS d, DATEADD(month, 1, CAST(o_orderdate AS DATE)) AS e, DATEADD(day, -3, o_orderdate) AS f, DATEDIFF(month, o_orderdate, '1999-01-31') "
        "AS g, DATEDIFF(day, o_orderdate, '1999-01-31') AS h, EOMONTH(o_orderdate) AS i, EOMONTH(o_orderdate, 1) AS j, DATENAME(month, o_orderdate) AS k, "
        "DAY(o_orderdate) AS l, DATEDIFF(week, o_orderdate, '1999-01-31') AS m FROM orders",
        "SELECT o_orderkey, CAST((dayofyear(o_orderdate) + dayofweek(date_trunc('year', o_orderdate)) - 1) // 7 + 1 AS INTEGER) AS a, "
        "CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS b, CAST(quarter(o_orderdate) AS INTEGER) AS c, CAST(dayofyear(o_orderdate) AS INTEGER) AS d, "
        "CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH AS DATE) AS e, o_orderdate - INTERVAL 3 DAY AS f, CAST(date_diff('month', o_orderdate, TIMESTAMP "
        "'1999-01-31') AS INTEGER) AS g, CAST(date_diff('day', o_orderdate, TIMESTAMP '1999-01-31') AS INTEGER) AS h, last_day(o_orderdate) AS i, "
        "last_day(last_day(o_orderdate) + INTERVAL 1 DAY) AS j, monthname(o_orderdate) AS k, CAST(day(o_orderdate) AS INTEGER) AS l, CAST(date_diff('day', "
        "CAST(o_orderdate AS DATE) - CAST(dayofweek(o_orderdate) AS INTEGER), DATE '1999-01-31') // 7 AS INTEGER) AS m FROM orders",
    ),
    "fn_conditional": (
        "SELECT n_nationkey, IIF(n_regionkey > 2, 'high', 'low') AS a, CHOOSE(n_regionkey, 'one', 'two') AS b, ISNUMERIC(n_name) AS c, ISNUMERIC('12.5') AS d, "
        "NULLIF(n_name, 'FRANCE') AS e FROM nation",
        "SELECT n_nationkey, CASE WHEN n_regionkey > 2 THEN 'high' ELSE 'low' END AS a, CASE n_regionkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' END AS b, 0 AS c, "
        "1 AS d, nullif(n_name, 'FRANCE') AS e FROM nation",
    ),
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Session(spark, parquet_tables(spark, sf_dir, TABLES)).query(text)


def _proc_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Session(spark, parquet_tables(spark, sf_dir, TABLES))
    session.sql("CREATE PROCEDURE nations_of @r INT, @least INT = 3 AS BEGIN SELECT n_name FROM nation WHERE n_regionkey = @r AND n_nationkey >= @least END")
    return session.call("nations_of", r=1)[-1]


def _output_parameter(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Session(spark, parquet_tables(spark, sf_dir, TABLES))
    session.sql("CREATE PROCEDURE count_of @r INT, @n INT OUTPUT AS BEGIN SELECT @n = COUNT(*) FROM nation WHERE n_regionkey = @r END")
    session.call("count_of", r=1)
    return spark.createDataFrame([(session.outputs["n"],)], "n int")


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = Session(spark, parquet_tables(spark, sf_dir, TABLES), integer_average=True, fold_case=True)
    return session.query("SELECT n_regionkey, AVG(n_nationkey) AS mean FROM nation WHERE n_name <> 'france  ' GROUP BY n_regionkey")


# name: (a query of its own making, DuckDB SQL)
PROGRAMS = {
    "proc_call": (_proc_call, "SELECT n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey >= 3"),
    "output_parameter": (_output_parameter, "SELECT count(*) AS n FROM nation WHERE n_regionkey = 1"),
    "dialect_flags": (_flags, "SELECT n_regionkey, CAST(trunc(avg(n_nationkey)) AS BIGINT) AS mean FROM nation WHERE lower(n_name) <> 'france' GROUP BY n_regionkey"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(text) for name, (text, _) in CATALOGUE.items()} | {name: q for name, (q, _) in PROGRAMS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: other or text for name, (text, other) in CATALOGUE.items()} | {name: sql for name, (_, sql) in PROGRAMS.items()}
