"""Builders of predicates: typed equality and membership on paths of JSON documents, and the common ones of tests."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from .resolve import equals


def path_column(path: str, doc: str = "doc", kind: str = "string") -> Column:
    return F.get_json_object(doc, f"$.{path}").cast(kind)


def path_equals(path: str, value: Any, doc: str = "doc", include_nulls: bool = False) -> Column:
    """Text without case, other values by type; null equals null only where asked for."""
    text = value is None or isinstance(value, str)
    return equals(path_column(path, doc, "string" if text else "boolean" if isinstance(value, bool) else "decimal(38,9)"), F.lit(value), text, include_nulls)


def path_in(path: str, values: list[Any], doc: str = "doc") -> Column:
    """Membership in the values that are not null; none of them matches nothing."""
    known = [v for v in values if v is not None]
    if not known:
        return F.lit(False)
    if all(isinstance(v, str) for v in known):
        return F.coalesce(F.lower(path_column(path, doc)).isin([v.lower() for v in known]), F.lit(False))
    return F.coalesce(path_column(path, doc, "decimal(38,9)").isin(known), F.lit(False))


def in_values(rows: DataFrame, column: str, values: DataFrame, text: bool = True) -> DataFrame:
    """Membership in a table of values of any size, as a semi join."""
    name = values.columns[0]
    fold = F.lower if text else (lambda c: F.col(c))
    return rows.join(values.where(F.col(name).isNotNull()).select(fold(name).alias("_value")).distinct(), fold(column) == F.col("_value"), "left_semi")


def name_equals(name: str) -> Column:
    return path_equals("Name", name)


def name_in(names: list[str]) -> Column:
    return path_in("Name", names)


def email_equals(email: str) -> Column:
    return path_equals("Email", email)


def email_in(emails: list[str]) -> Column:
    return path_in("Email", emails)


def alternate_key_found(key: str, value: str | None = None, column: str = "alternateKeys") -> Column:
    return F.exists(column, lambda k: (k["Key"] == key) & (F.lit(True) if value is None else k["Value"] == value))
