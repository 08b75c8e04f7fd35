"""Document queries: where/select/order/page/count, lookups by id and alternate key, logs, traces."""

from __future__ import annotations

import base64
import json
import re
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def ordering(order_by: str | None, key: str) -> list[tuple[str, bool]]:
    """An order clause as (column, descending) pairs, ended by the key."""
    out = []
    for part in (order_by or "").split(","):
        if part.strip():
            column, _, way = part.strip().partition(" ")
            out.append((column.removeprefix("x."), way.strip().lower() == "desc"))
    return out if key in [c for c, _ in out] else [*out, (key, False)]


def entities_where(entities: DataFrame, where: str | None = None, select: str | None = None, order_by: str | None = None, page_size: int = 100, token: str | None = None, parameters: dict[str, Any] | None = None, key: str = "id") -> DataFrame:
    """One page, alias x, named parameters :name; select is any SELECT list. page_size -1 gives all rows.

    Pages follow the order clause and the key, nulls first when ascending and last when descending, so the next one starts
    behind the token's row, and no row is skipped or given twice."""
    rows = matching(entities, where, parameters)
    order, kinds = ordering(order_by, key), dict(rows.dtypes)
    if token:
        past, same = F.lit(False), F.lit(True)
        for (column, down), value in zip(order, json.loads(base64.urlsafe_b64decode(token)), strict=True):
            c, v = F.col(column), F.lit(value).cast(kinds[column])
            if down:
                after = F.lit(False) if value is None else (c < v) | c.isNull()
            else:
                after = c.isNotNull() if value is None else c > v
            past, same = past | same & F.coalesce(after, F.lit(False)), same & c.eqNullSafe(v)
        rows = rows.where(past)
    rows = rows.orderBy(*[F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in order])
    rows = rows if page_size < 0 else rows.limit(page_size)
    return rows.sparkSession.sql(f"SELECT {select} FROM {{rows}} x", args=parameters or {}, rows=rows) if select else rows


def matching(entities: DataFrame, where: str | None, parameters: dict[str, Any] | None = None) -> DataFrame:
    return entities.sparkSession.sql("SELECT x.* FROM {rows} x" + (f" WHERE {where}" if where else ""), args=parameters or {}, rows=entities)


def total_count(entities: DataFrame, where: str | None = None, parameters: dict[str, Any] | None = None) -> DataFrame:
    """The count of all rows that a query pages through, as one row; asked for apart from the page."""
    return matching(entities, where, parameters).agg(F.count("*").alias("total"))


def next_token(row: dict[str, Any], order_by: str | None, key: str = "id") -> str:
    """The continuation token behind a page's last row, which must hold the columns of the order clause and the key."""
    return base64.urlsafe_b64encode(json.dumps([row[c] for c, _ in ordering(order_by, key)], default=str).encode()).decode()


def by_ids(entities: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Entities whose key is among ids; unknown ids are just missing."""
    return entities.join(ids.select(key).distinct(), key, "left_semi")


def updated_since(entities: DataFrame, since: Column, column: str = "lastUpdated", key: str = "id") -> DataFrame:
    return entities.where(F.col(column) >= since).orderBy(column, key)


def alternate_keys(entities: DataFrame, key: str = "id", column: str = "alternateKeys") -> DataFrame:
    """One row for each alternate key: key, Key, Value."""
    return entities.select(key, F.explode(column).alias("k")).select(key, "k.Key", "k.Value")


def with_alternate_key(entities: DataFrame, name: str, value: str | None = None, column: str = "alternateKeys") -> DataFrame:
    return entities.where(F.exists(column, lambda k: (k["Key"] == name) & (F.lit(True) if value is None else k["Value"] == value)))


def by_alternate_keys(entities: DataFrame, wanted: DataFrame, key: str = "id") -> DataFrame:
    """A row for each key that matches (a bag: an entity found by two keys comes twice)."""
    return alternate_keys(entities, key).join(wanted.select("Key", "Value").distinct(), ["Key", "Value"])


def like_log_column(where: str, properties: list[str]) -> str:
    """x.Id -> x.id and x.<event property> -> x.Data.<event property>, longest names first, whole names only."""
    names = "|".join(re.escape(n) for n in sorted({*properties, "Id"}, key=len, reverse=True))
    return re.sub(rf"(?<![\w.])x\.({names})(?!\w)", lambda m: "x.id" if m[1] == "Id" else f"x.Data.{m[1]}", where)


def log_where(logs: DataFrame, kind: str, where: str | None, properties: list[str]) -> DataFrame:
    rows = logs.where(F.col("Type") == kind).alias("x")
    return rows.where(like_log_column(where, properties)) if where else rows


def trace(tables: list[tuple[str, DataFrame]], correlation: str, take: int, latest: int = 10_000, since: Any = None, until: Any = None) -> DataFrame:
    """Rows of several telemetry tables that are correlated or share an operation with a correlated row, by time; since and
    until bound the time, and reach the scans."""
    rows: DataFrame | None = None
    for kind, t in tables:
        t = t.withColumn("ItemType", F.lit(kind))
        rows = t if rows is None else rows.unionByName(t, allowMissingColumns=True)
    rows = rows if since is None else rows.where(F.col("TimeGenerated") >= since)
    rows = rows if until is None else rows.where(F.col("TimeGenerated") <= until)
    hits = rows.where(F.col("CorrelationId") == correlation).select(F.col("OperationId").alias("op")).distinct()
    return rows.join(hits, rows["OperationId"] == hits["op"], "left_semi").orderBy("TimeGenerated", "OperationId", "ItemType").limit(max(1, min(take, latest)))


def span_tree(spans: DataFrame) -> DataFrame:
    """spans (id, parent, start, name) -> the rows with depth and ordinal, children behind their parent by start then name;
    spans whose parent is missing come last; spans that are their own ancestors have no root and are left out. A tree is one
    request's, so it is bounded; one deeper than spark.sql.cteRecursionLevelLimit is an error."""
    return spans.sparkSession.sql("""
        WITH RECURSIVE tree (id, parent, start, name, depth, path) AS (
          SELECT id, parent, start, name, 0, array(struct(CASE WHEN parent IS NULL THEN 0 ELSE 1 END AS late, start, lower(name) AS name, id))
          FROM {spans} s WHERE parent IS NULL OR NOT EXISTS (SELECT 1 FROM {spans} p WHERE p.id = s.parent)
          UNION ALL
          SELECT c.id, c.parent, c.start, c.name, t.depth + 1, concat(t.path, array(struct(0 AS late, c.start, lower(c.name) AS name, c.id)))
          FROM tree t JOIN {spans} c ON c.parent = t.id)
        SELECT id, parent, name, depth, row_number() OVER (ORDER BY path) AS ordinal FROM tree""", spans=spans)


def latest_markers(markers: DataFrame, key: list[str], order: str) -> DataFrame:
    """The newest marker of each key."""
    cols = [c for c in markers.columns if c not in key]
    return markers.groupBy(*key).agg(F.max_by(F.struct(*cols), F.col(order)).alias("m")).select(*key, "m.*")


def type_counts(entities: DataFrame, column: str = "entityType") -> DataFrame:
    return entities.groupBy(F.col(column).alias("EntityType")).agg(F.count("*").alias("Count"))


def identities(log: DataFrame) -> DataFrame:
    """Distinct (DataSource, EntityType) without blanks, ordered."""
    return log.select("DataSource", "EntityType").where("trim(DataSource) != '' and trim(EntityType) != ''").distinct().orderBy("DataSource", "EntityType")


def version_order(versions: DataFrame, source: list[str], ts: str, arrival: str) -> DataFrame:
    """Stable version sort: inside a source id by timestamp, ties by arrival; `slot` is the arrival place that each takes, so
    other sources keep theirs. Versions without a timestamp are marked."""
    by_time, by_arrival = W.partitionBy(*source).orderBy(F.asc_nulls_last(ts), arrival), W.partitionBy(*source).orderBy(arrival)
    ranked = versions.withColumn("version", F.row_number().over(by_time)).withColumn("place", F.row_number().over(by_arrival))
    slots = ranked.select(*source, F.col("place").alias("version"), F.col(arrival).alias("slot"))
    return ranked.drop("place").join(slots, [*source, "version"]).withColumn("failed", F.col(ts).isNull())
