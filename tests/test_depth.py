"""Broken statements take nothing from the nesting that later ones may have."""

from tidewright.operators.analysis import script_nodes


def test_valid_statements_after_several_hundred_broken_ones():
    broken = "DELETE FROM T WHERE ; SELECT 1 + ; " * 200
    for valid in ("SELECT a FROM t", "BEGIN SELECT a FROM t; PRINT @x END", "CREATE PROCEDURE P @p INT AS BEGIN SELECT a FROM t WHERE a = @p END", "SELECT " + "(" * 60 + "1" + ")" * 60):
        alone = [(r["kind"], r["incomplete"]) for r in script_nodes(valid)][1:]
        after = [(r["kind"], r["incomplete"]) for r in script_nodes(broken + valid) if r["start"] >= len(broken)]
        assert after == alone and not any(x for _, x in after)
