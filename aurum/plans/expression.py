"""Virtual-table query expressions: nested and/or/xor conditions, orders and pages, compiled to Columns."""

from __future__ import annotations

import re
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.documents import read_path

OPERATORS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "ge": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "le": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(v),
    "like": lambda c, v: c.like(v),
    "null": lambda c, v: c.isNull(),
    "notnull": lambda c, v: c.isNotNull(),
}


def condition(node: dict[str, Any]) -> Column:
    """{"and"|"or"|"xor": [nodes]} or {"property", "operator", "value"}."""
    for name, join in (("and", Column.__and__), ("or", Column.__or__), ("xor", lambda a, b: (a & ~b) | (~a & b))):
        if name in node:
            return reduce(join, map(condition, node[name]))
    return OPERATORS[node["operator"].lower()](F.col(node["property"]), node.get("value"))


TESTS = {
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a is not None and a != b,
    "gt": lambda a, b: a is not None and a > b,
    "ge": lambda a, b: a is not None and a >= b,
    "lt": lambda a, b: a is not None and a < b,
    "le": lambda a, b: a is not None and a <= b,
    "in": lambda a, b: a in b,
    "like": lambda a, b: isinstance(a, str) and re.fullmatch(re.escape(b).replace("%", ".*").replace("_", "."), a, re.S) is not None,
    "null": lambda a, b: a is None,
    "notnull": lambda a, b: a is not None,
}


def holds(node: dict[str, Any], document: dict[str, Any]) -> bool:
    """The same condition for one document; a property is a path in it."""
    if "and" in node:
        return all(holds(n, document) for n in node["and"])
    if "or" in node:
        return any(holds(n, document) for n in node["or"])
    if "xor" in node:
        return reduce(lambda a, b: a != b, [holds(n, document) for n in node["xor"]])
    return TESTS[node["operator"].lower()](read_path(document, node["property"]), node.get("value"))


def evaluate(rows: DataFrame, query: dict[str, Any]) -> DataFrame:
    """columns, where, orders [(column, descending)], page (number from 1, size)."""
    if query.get("where"):
        rows = rows.where(condition(query["where"]))
    orders = [F.desc(c) if down else F.asc(c) for c, down in query.get("orders", [])]
    rows = rows.orderBy(*orders) if orders else rows
    number, size = query.get("page", (1, 50))
    rows = rows.offset((number - 1) * size).limit(size)
    return rows.select(*query["columns"]) if query.get("columns") else rows
