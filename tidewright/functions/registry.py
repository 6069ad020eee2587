"""T-SQL functions as Spark SQL text. Each entry takes the emitted arguments and, where it matters, their types."""

from __future__ import annotations

import re

# Date parts by every spelling that T-SQL has for them.
PARTS = {
    "year": "year", "yy": "year", "yyyy": "year", "quarter": "quarter", "qq": "quarter", "q": "quarter", "month": "month", "mm": "month", "m": "month",
    "dayofyear": "doy", "dy": "doy", "y": "doy", "day": "day", "dd": "day", "d": "day", "week": "week", "wk": "week", "ww": "week", "weekday": "dayofweek", "dw": "dayofweek",
    "iso_week": "iso", "isowk": "iso", "isoww": "iso", "hour": "hour", "hh": "hour", "minute": "minute", "mi": "minute", "n": "minute", "second": "second", "ss": "second", "s": "second",
}
SECONDS = {"hour": 3600, "minute": 60, "second": 1}
RENAMED = {
    "CEILING": "ceil", "GETDATE": "current_timestamp", "SYSDATETIME": "current_timestamp", "REPLICATE": "repeat", "NEWID": "uuid", "STDEV": "stddev_samp", "VAR": "var_samp",
    "COUNT_BIG": "count", "IIF": "if", "STDEVP": "stddev_pop", "VARP": "var_pop", "NCHAR": "char", "UNICODE": "ascii", "DATALENGTH": "octet_length", "DATEFROMPARTS": "make_date", "ATN2": "atan2",
}
INTEGRAL = set(
    "LEN CHARINDEX PATINDEX DATEPART DATEDIFF YEAR MONTH DAY COUNT COUNT_BIG ROW_NUMBER RANK DENSE_RANK NTILE ASCII UNICODE DATALENGTH ISNUMERIC ISDATE GROUPING CEILING FLOOR".split()
)
TEXT = set(
    "UPPER LOWER LTRIM RTRIM TRIM REPLACE LEFT RIGHT REVERSE CHAR NCHAR SPACE STRING_AGG SUBSTRING CONCAT CONCAT_WS REPLICATE STUFF DATENAME STR QUOTENAME TRANSLATE NEWID SOUNDEX".split()
)
SAME = set("SUM MIN MAX ABS COALESCE ISNULL NULLIF LAG LEAD FIRST_VALUE LAST_VALUE ROUND".split())
WHOLE_DAYS = ("year", "quarter", "month", "week", "day", "doy", "dayofweek")


def part_of(text: str) -> str:
    return PARTS.get(text.strip("`'").lower(), text.strip("`'").lower())


def type_of(name: str, types: list[str]) -> str:
    """The type of a call from those of its arguments; double where nothing better is known."""
    if name in INTEGRAL:
        return "int"
    if name in TEXT:
        return "string"
    if name in ("GETDATE", "SYSDATETIME"):
        return "timestamp"
    if name in ("EOMONTH", "DATEFROMPARTS"):
        return "date"
    if name == "DATEADD":
        return types[2] if len(types) > 2 else ""
    if name in ("IIF", "CHOOSE"):
        return next((t for t in types[1:] if t not in ("", "null")), "")
    if name == "AVG" or name not in SAME:
        return "double"
    return next((t for t in types if t not in ("", "null")), "")


def _datediff(part: str, a: str, b: str) -> str:
    """Counts the boundaries crossed, as T-SQL does."""
    if part == "year":
        return f"(year({b}) - year({a}))"
    if part == "quarter":
        return f"((year({b}) * 4 + quarter({b})) - (year({a}) * 4 + quarter({a})))"
    if part == "month":
        return f"((year({b}) * 12 + month({b})) - (year({a}) * 12 + month({a})))"
    if part in ("day", "doy", "dayofweek"):
        return f"datediff({b}, {a})"
    if part == "week":
        return f"CAST((datediff(date_trunc('week', date_add({b}, 1)), date_trunc('week', date_add({a}, 1)))) / 7 AS INT)"
    whole = f"unix_timestamp(CAST(date_trunc('{part}', {b}) AS TIMESTAMP)) - unix_timestamp(CAST(date_trunc('{part}', {a}) AS TIMESTAMP))"
    return f"CAST(({whole}) / {SECONDS[part]} AS INT)"


def _datepart(part: str, d: str) -> str:
    if part == "week":  # the week of 1 January is the first, and a week begins on Sunday
        return f"CAST(floor((dayofyear({d}) + dayofweek(trunc({d}, 'YEAR')) - 2) / 7) + 1 AS INT)"
    if part == "second":
        return f"second({d})"
    return f"date_part('{'week' if part == 'iso' else part}', {d})"


def like_regex(pattern: str, escape: str = "") -> str:
    """The regular expression of a LIKE pattern, without anchors."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        end = pattern.find("]", k + 2) if c == "[" else -1
        if escape and c == escape and k + 1 < len(pattern):
            k += 1
            out += re.escape(pattern[k])
        elif end > 0:
            body = pattern[k + 1 : end]
            out += "[" + ("^" if body[0] == "^" else "") + body.lstrip("^").replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&") + "]"
            k = end
        else:
            out += {"%": ".*", "_": "."}.get(c, re.escape(c))
        k += 1
    return out


def like_pattern(pattern: str, escape: str = "") -> str | None:
    """An anchored regular expression for a LIKE pattern with character classes; None if it has none."""
    return "(?s)^" + like_regex(pattern, escape) + "$" if "[" in pattern else None


def _round(args: list[str]) -> str:
    if len(args) < 3:
        return f"round({', '.join(args)})"
    scale = f"power(10, {args[1]})"
    cut = f"(sign({args[0]}) * floor(abs({args[0]}) * {scale}) / {scale})"
    return f"CASE WHEN {args[2]} = 0 THEN round({args[0]}, {args[1]}) ELSE {cut} END"


def _str(args: list[str]) -> str:
    size, places = (args[1:2] or ["10"])[0], (args[2:3] or ["0"])[0]
    text = f"CAST(CAST(round({args[0]}, {places}) AS DECIMAL(38, {places})) AS STRING)"
    return f"CASE WHEN length({text}) > {size} THEN repeat('*', {size}) ELSE lpad({text}, {size}, ' ') END"


def _text(x: str) -> str:
    return f"CAST({x} AS STRING)"


FORMS = {
    "LEN": lambda a: f"length(rtrim({a[0]}))",
    "ISNULL": lambda a: f"coalesce({', '.join(a)})",
    "CONCAT": lambda a: "concat(" + ", ".join(f"coalesce({_text(x)}, '')" for x in a) + ")",
    "CONCAT_WS": lambda a: f"concat_ws({', '.join(map(_text, a))})",
    "CHARINDEX": lambda a: f"locate({', '.join(a)})",
    "STUFF": lambda a: f"overlay({a[0]} PLACING coalesce({a[3]}, '') FROM {a[1]} FOR {a[2]})",
    "SUBSTRING": lambda a: f"substring({a[0]}, greatest({a[1]}, 1), greatest(least({a[1]}, 1) - 1 + {a[2]}, 0))",
    "SQUARE": lambda a: f"(({a[0]}) * ({a[0]}))",
    "LOG": lambda a: f"log({', '.join(a[::-1])})",
    "ROUND": _round,
    "STR": _str,
    "QUOTENAME": lambda a: f"concat('[', replace({a[0]}, ']', ']]'), ']')",
    "CHOOSE": lambda a: f"CASE {a[0]} " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(a[1:], 1)) + " END",
    "EOMONTH": lambda a: f"last_day({a[0]})" if len(a) == 1 else f"last_day(add_months({a[0]}, {a[1]}))",
    "ISNUMERIC": lambda a: f"CAST(try_cast({a[0]} AS DOUBLE) IS NOT NULL AS INT)",
    "ISDATE": lambda a: f"CAST(try_cast({a[0]} AS TIMESTAMP) IS NOT NULL AS INT)",
    "STRING_AGG": lambda a: f"listagg({', '.join(a)})",
}


def call(name: str, args: list[str], distinct: bool = False, types: list[str] | None = None) -> str:
    n = name.upper()
    if n == "DATEPART":
        return _datepart(part_of(args[0]), args[1])
    if n == "DATENAME":
        part = part_of(args[0])
        form = {"month": "MMMM", "dayofweek": "EEEE"}.get(part)
        return f"date_format({args[1]}, '{form}')" if form else f"CAST({_datepart(part, args[1])} AS STRING)"
    if n == "DATEADD":
        part = part_of(args[0])
        moved = f"timestampadd({ {'doy': 'DAY', 'dayofweek': 'DAY'}.get(part, part.upper()) }, {args[1]}, {args[2]})"
        return f"CAST({moved} AS DATE)" if part in WHOLE_DAYS and types and types[2] == "date" else moved
    if n == "DATEDIFF":
        return _datediff(part_of(args[0]), args[1], args[2])
    if n in FORMS and not distinct:
        return FORMS[n](args)
    return f"{RENAMED.get(n, name.lower())}({'DISTINCT ' if distinct else ''}{', '.join(args)})"
