"""T-SQL text to tokens with exact code-point offsets."""

from __future__ import annotations

import re
from typing import NamedTuple

# The words that are tokens of type Keyword.
KEYWORDS = frozenset(
    "SELECT FROM WHERE GROUP BY HAVING ORDER TOP DISTINCT INSERT UPDATE DELETE INTO VALUES SET CREATE DECLARE UNION EXCEPT INTERSECT ALL AND OR NOT NULL IN "
    "BETWEEN LIKE CASE WHEN THEN ELSE END EXISTS OVER PARTITION PROCEDURE PROC FUNCTION VIEW TABLE TYPE AS GO ON JOIN INNER LEFT RIGHT CROSS OUTER ASC DESC "
    "WITH IF BEGIN PRINT OUTPUT OUT".split()
)
_PATTERN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|/\*.*?(?:\*/|\Z))
    |(?P<String>[Nn]?'(?:[^']|'')*(?:'|\Z))
    |(?P<Bracket>\[(?:[^\]]|\]\])*(?:\]|\Z)|"(?:[^"]|"")*(?:"|\Z))
    |(?P<Word>[\w@\#][\w@\#$]*)
    |(?P<Composite>>=|<=|<>|!=)
    |(?P<OpenParen>\()|(?P<CloseParen>\))|(?P<Semicolon>;)|(?P<Comma>,)|(?P<Dot>\.)
    |(?P<Operator>.)""",
    re.X | re.S,
)
_NUMBER = re.compile(r"0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")


class Token(NamedTuple):
    type: str
    value: str
    line: int
    col: int
    offset: int

    @property
    def end(self) -> int:
        return self.offset + len(self.value)


def tokenize(sql: str) -> list[Token]:
    """All tokens, an EOF token last. Keywords come in upper case; strings and bracketed names as written; unclosed ones run to the end."""
    out, pos, line, begin, returns = [], 0, 1, 0, 0
    while pos < len(sql):
        m = _NUMBER.match(sql, pos) if sql[pos].isdigit() else None
        if m:
            kind, text = "Number", m[0]
        else:
            m = _PATTERN.match(sql, pos)
            kind, text = m.lastgroup, m[0]
            if kind == "Word":
                upper = text.upper()
                kind = "Variable" if text[0] == "@" else "TempTable" if text[0] == "#" else "Keyword" if upper in KEYWORDS else "Identifier"
                text = upper if kind == "Keyword" else text
            kind = {"Bracket": "Identifier", "Composite": "Operator"}.get(kind, kind)
        if kind != "skip":
            out.append(Token(kind, text, line, pos - begin - returns + 1, pos))
        end = m.end()
        if "\n" in m[0]:
            line += m[0].count("\n")
            begin, returns = sql.rindex("\n", pos, end) + 1, 0
        returns += sql.count("\r", max(pos, begin), end)
        pos = end
    out.append(Token("EOF", "", line, len(sql) - begin - returns + 1, len(sql)))
    return out


def utf16_offset(sql: str, offset: int) -> int:
    """The offset in UTF-16 code units, for editors."""
    return len(sql[:offset].encode("utf-16-le")) // 2
