"""Syntax nodes: a kind, a half-open span, and fields that depend on the kind."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any


class Node:
    def __init__(self, kind: str, start: int, end: int = -1, **fields: Any):
        self.kind, self.start, self.end = kind, start, end
        self.incomplete, self.errors = False, []
        self.fields = fields

    def __getattr__(self, name: str) -> Any:
        try:
            return self.__dict__["fields"][name]
        except KeyError:
            raise AttributeError(name) from None

    def get(self, name: str, default: Any = None) -> Any:
        return self.fields.get(name, default)

    def set(self, **fields: Any) -> Node:
        self.fields.update(fields)
        return self

    def children(self) -> Iterator[tuple[str, int, Node]]:
        """(role, ordinal, child) in field order."""
        for role, value in self.fields.items():
            rows = value if isinstance(value, list) else [value]
            k = 0
            for x in rows:
                for y in x if isinstance(x, list) else [x]:
                    if isinstance(y, Node):
                        yield role, k, y
                        k += 1

    def walk(self) -> Iterator[Node]:
        """The node and all below it, parents first, by a loop."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed([child for _, _, child in node.children()]))

    def __repr__(self) -> str:
        return f"{self.kind}[{self.start},{self.end}){self.fields}"
