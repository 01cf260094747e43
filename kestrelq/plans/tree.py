"""Spark's plans and expressions as Python trees, from their JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any


@dataclass
class Item:
    kind: str
    data: dict[str, Any]
    children: list[Item] = field(default_factory=list)

    def walk(self) -> Iterator[Item]:
        yield self
        for child in self.children:
            yield from child.walk()

    def expressions(self, *names: str) -> list[Item]:
        """Expression trees in these fields, or in all fields, of a plan node."""
        fields = [self.data.get(n) for n in names] if names else list(self.data.values())
        return [tree for value in fields for tree in _trees(value)]


def _trees(value: Any) -> Iterator[Item]:
    if isinstance(value, list) and value:
        if isinstance(value[0], dict) and "class" in value[0]:
            yield build(value)
        else:
            for inner in value:
                yield from _trees(inner)


def build(rows: list[dict[str, Any]]) -> Item:
    """A tree of rows in pre-order, each with its number of children."""
    at = 0

    def take() -> Item:
        nonlocal at
        row = rows[at]
        at += 1
        item = Item(row["class"].rpartition(".")[2].rpartition("$")[2] or row["class"], row)
        item.children = [take() for _ in range(row["num-children"])]
        return item

    return take()


def of(plan: Any) -> Item:
    """The tree of a JVM plan."""
    return build(json.loads(plan.toJSON()))


def parsed(spark: Any, sql: str) -> Any:
    """Spark's syntax tree of a statement, before names are resolved."""
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)


def names(text: str) -> list[str]:
    """Parts of a name as the JSON gives them: '[t, a]'."""
    return [x.strip() for x in text.strip("[]").split(",")]


def object_name(value: Any) -> str:
    """'Inner' of {'object': '...Inner$'}."""
    return str(value.get("object", value) if isinstance(value, dict) else value).rstrip("$").rpartition(".")[2]


def items(seq: Any) -> list[Any]:
    """A Scala sequence as a list."""
    it, out = seq.iterator(), []
    while it.hasNext():
        out.append(it.next())
    return out
