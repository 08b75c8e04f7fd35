"""Entity resolution: alternate-key lookup, references, promises, conflicts, duplicate candidates and matches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def source_key(data_source: Column, source_type: Column) -> Column:
    return F.lower(F.concat_ws(".", data_source, source_type))


def resolve_references(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """refs (EntityType, Key, Value), keys (EntityType, Key, Value, EntityId) -> for each distinct ref: matches, resolved.

    No match leaves it unresolved; of several the smallest id is taken and each further one is a failure."""
    got = refs.select("EntityType", "Key", "Value").distinct().join(keys, ["EntityType", "Key", "Value"], "left")
    return got.groupBy("EntityType", "Key", "Value").agg(F.count_distinct("EntityId").alias("matches"), F.min("EntityId").alias("resolved"))


def split_new(requests: DataFrame, known: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(new, existing) requests."""
    ids = known.select(*key).distinct()
    return requests.join(ids, key, "left_anti"), requests.join(ids, key, "left_semi")


def merge_conflicts(requests: DataFrame, destination: str, source: list[str]) -> DataFrame:
    """Destinations that different sources of one batch resolve to."""
    return requests.groupBy(destination).agg(F.count_distinct(*source).alias("sources")).where("sources > 1")


def promise_id(source_type: Column, source_id: Column, path: Column, entity_type: Column, hub_id: Column) -> Column:
    """Deterministic, so that a promise stored twice is one."""
    return F.concat(source_type, F.lit(":"), source_id, F.lit("->"), path, F.lit(":"), entity_type, F.lit(":"), hub_id)


def settle_promises(promises: DataFrame, owners: DataFrame, targets: DataFrame) -> DataFrame:
    """promises (promise, owner, ref, path), owners (owner, ref_at_path, refs), targets (ref, target) -> promise, status, target.

    Stale: the owner is gone, or no longer holds the reference; Unresolved: it holds it elsewhere, or no target exists yet;
    Failed: several targets."""
    found = targets.groupBy("ref").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"))
    rows = promises.join(owners.withColumn("here", F.lit(True)), "owner", "left").join(found, "ref", "left")
    moved = ~F.coalesce(F.col("ref_at_path") == F.col("ref"), F.lit(False))
    status = (
        F.when(F.col("here").isNull(), "Stale")
        .when(moved & F.coalesce(F.array_contains("refs", F.col("ref")), F.lit(False)), "Unresolved")
        .when(moved, "Stale")
        .when(F.col("n").isNull(), "Unresolved")
        .when(F.col("n") > 1, "Failed")
        .otherwise("Resolved")
    )
    return rows.select("promise", status.alias("status"), F.when(status == "Resolved", F.col("target")).alias("target"))


TOKEN = re.compile(r"@(?P<kind>Path)?In<(?P<type>\w+)>\((?P<fields>[^)]*)\)|\$(?P<literal>\w+)|\\\"(?P<quoted>[^\"\\]*)\\\"")


def blocking_template(template: str) -> tuple[str, list[tuple[str, bool]]]:
    """A Find template -> its predicate with literals quoted and each @In replaced by a marker, and the fields with whether
    they are compared without case (string and char ones). An @In of several fields stands for any of their values: each
    field is listed, and the markers are joined by or."""
    fields: list[tuple[str, bool]] = []

    def put(m: re.Match) -> str:
        if m["literal"]:
            return f"'{m['literal']}'"
        if m["quoted"] is not None:
            return f"'{m['quoted']}'"
        marks = []
        for name in m["fields"].split(","):
            fields.append((name.strip().lstrip("$"), m["type"].lower() in ("string", "char")))
            marks.append(f":in{len(fields) - 1}")
        return marks[0] if len(marks) == 1 else "(" + " or ".join(marks) + ")"

    return TOKEN.sub(put, template), fields


def candidates(incoming: DataFrame, existing: DataFrame, fields: list[tuple[str, bool]], key: str = "id") -> DataFrame:
    """Blocking: pairs that agree in every field; null fields agree with nothing."""
    a, b = incoming.alias("incoming"), existing.alias("existing")
    on = None
    for name, fold in fields:
        x, y = F.col(f"incoming.{name}"), F.col(f"existing.{name}")
        both = F.lower(x) == F.lower(y) if fold else x == y
        on = both if on is None else on & both
    return a.join(b, on)


def best_match(pairs: DataFrame, incoming: str, candidate: str, created: str, has_key: str) -> DataFrame:
    """The latest created candidate of each incoming; none if just that one already has a key of the source type (what comes
    second is not tried)."""
    best = pairs.groupBy(incoming).agg(F.max_by(F.struct(F.col(candidate).alias("c"), F.col(has_key).alias("k")), F.struct(created, candidate)).alias("best"))
    return best.select(incoming, F.when(~F.col("best.k"), F.col("best.c")).alias("match"))


def block_match(incoming: DataFrame, existing: DataFrame, block: list[tuple[str, bool]], key: str, candidate: str, created: str, has_key: Column | None = None) -> DataFrame:
    """best_match() for blocking fields alone: the latest existing row of each block is found first, so that k incoming and k
    existing rows of one block make k rows and not k times k. has_key: over the columns of both sides (existing ones in
    `best`); null fields match nothing."""
    names = [f"_block{k}" for k in range(len(block))]

    def keyed(rows: DataFrame) -> DataFrame:
        out = rows.withColumns({n: F.lower(c) if fold else F.col(c) for n, (c, fold) in zip(names, block, strict=True)})
        return out.dropna(subset=names)

    old = keyed(existing).groupBy(*names).agg(F.max_by(F.struct(*existing.columns), F.struct(created, candidate)).alias("best"))
    met = keyed(incoming).join(old, names)
    taken = F.lit(False) if has_key is None else F.coalesce(has_key, F.lit(False))
    return met.select(key, F.when(~taken, F.col(f"best.{candidate}")).alias("match"))


def match_sources(new: DataFrame, entities: DataFrame, paths: list[str]) -> DataFrame:
    """new (source, Key, fresh, ts, ord, EntityType, Data JSON), entities (id, entityType, createdOn, alternateKeys, doc JSON)
    -> (source, match) of the new sources that join an entity, stored or created earlier in the batch (then named `fresh`).

    The stored candidates of a block come down to the latest one before anything is joined. What is left depends on the
    order of arrival and is a fold over a block's sources, in rows of a few short columns."""
    fields = [f"f{k}" for k in range(len(paths))]
    read = lambda doc: [F.lower(F.get_json_object(doc, f"$.{p}")).alias(f) for p, f in zip(paths, fields, strict=True)]
    old = entities.select("id", "entityType", "createdOn", "alternateKeys", *read("doc")).dropna(subset=fields)
    best = old.groupBy("entityType", *fields).agg(F.max_by(F.struct("id", F.transform("alternateKeys", lambda k: k["Key"]).alias("keys")), F.struct("createdOn", "id")).alias("best"))
    rows = new.select("source", "Key", "fresh", "ts", "ord", F.col("EntityType").alias("entityType"), *read("Data"))
    rows = rows.groupBy("source").agg(F.min_by(F.struct("Key", "fresh", "ts", "ord", "entityType", *fields), F.struct("ts", "ord")).alias("r")).select("source", "r.*").dropna(subset=fields)
    rows = rows.join(best, ["entityType", *fields], "left").select("entityType", *fields, "source", "Key", "fresh", "ts", "ord", "best.id", "best.keys")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["ts", "ord", "source"], na_position="last")
        first, out = part.iloc[0], []
        last = None if first["id"] is None else (first["id"], set(first["keys"]))
        for source, key, fresh in zip(part["source"], part["Key"], part["fresh"], strict=True):
            if last is not None and key not in last[1]:
                last[1].add(key)
                out.append((source, last[0]))
            else:
                last = fresh, {key}
        return pd.DataFrame(out, columns=["source", "match"])

    return rows.groupBy("entityType", *fields).applyInPandas(fold, "source string, match string")


def equals(a: Column, b: Column, text: bool, include_nulls: bool = False) -> Column:
    """Typed predicate equality: text without case; null equals null only where asked for."""
    x, y = (F.lower(a), F.lower(b)) if text else (a, b)
    return x.eqNullSafe(y) if include_nulls else F.coalesce(x == y, F.lit(False))
