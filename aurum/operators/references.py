"""References between entities: found in documents, resolved by alternate keys, promised where the target is not there yet.

A reference is a nested object tagged ExternalEntityReference with DataSource, SourceEntityType, EntityId and EntityType (the
golden type it points to). Resolving replaces it by {EntityType, EntityId} of the golden entity and logs the change."""

from __future__ import annotations

import json
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import documents as D
from .resolve import source_key

FOUND = "owner string, path string, EntityType string, DataSource string, SourceEntityType string, RefId string, at string"
PROMISES = "promise string, owner string, ownerType string, path string, EntityType string, DataSource string, SourceEntityType string, RefId string"
FIELDS = ["EntityType", "DataSource", "SourceEntityType", "RefId"]


def found_references(entities: DataFrame) -> DataFrame:
    """entities (id, doc JSON) -> a row for each unresolved reference at any depth, with the time it was given at."""

    def run(batches):
        for part in batches:
            rows = []
            for ident, doc in zip(part["id"], part["doc"], strict=True):
                document = json.loads(doc)
                for path, ref in D.external_references(document):
                    rows.append((ident, path, ref.get("EntityType"), ref.get("DataSource"), ref.get("SourceEntityType"), str(ref.get("EntityId")), ref.get("Timestamp") or document.get("lastUpdated")))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in FOUND.split(", ")])

    # a document without the tag's text is not parsed
    return entities.where(F.instr("doc", "ExternalEntityReference") > 0).select("id", "doc").mapInPandas(run, FOUND)


def targets_of(refs: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct references -> n (how many golden entities have the key) and target (the smallest of them, if any)."""
    keys = entities.select(F.col("entityType").alias("EntityType"), F.col("id").alias("target"), F.explode("alternateKeys").alias("k")).select("EntityType", F.col("k.Key").alias("Key"), F.col("k.Value").alias("RefId"), "target")
    wanted = refs.select(*FIELDS).distinct().withColumn("Key", source_key(F.col("DataSource"), F.col("SourceEntityType")))
    got = wanted.join(keys, ["EntityType", "Key", "RefId"], "left")
    return got.groupBy(*FIELDS).agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"))


def promise_key(source_type: Column, ref: Column, path: Column, entity_type: Column, owner: Column) -> Column:
    return F.concat(F.coalesce(source_type, F.lit("")), F.lit(":"), ref, F.lit("->"), path, F.lit(":"), F.coalesce(entity_type, F.lit("")), F.lit(":"), owner)


def replaced(changes: DataFrame, entities: DataFrame) -> DataFrame:
    """changes (owner, path, EntityType, target, at) -> id, doc, delta, at: the references replaced, one row for each owner.

    An owner's references are one group, which its document bounds."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        old = json.loads(part["doc"].iloc[0])
        new, stamps = json.loads(part["doc"].iloc[0]), []
        for path, kind, target, at in sorted(zip(part["path"], part["EntityType"], part["target"], part["at"], strict=True)):
            D.write_path(new, path, {"EntityType": kind, "EntityId": target})
            stamps.append(at)
        delta = D.diff(old, new)
        return pd.DataFrame([{"id": part["id"].iloc[0], "doc": D.canonical(new), "delta": None if delta is None else D.canonical(delta), "at": max(filter(None, stamps), default=None)}])

    rows = changes.select(F.col("owner").alias("id"), "path", "EntityType", "target", "at").join(entities.select("id", "doc"), "id")
    return rows.groupBy("id").applyInPandas(fold, "id string, doc string, delta string, at string")


def resolve_documents(entities: DataFrame, every: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """References of entities (id, entityType, doc), looked up in every (id, entityType, alternateKeys):
    (changed documents, new promises, failures of references that several entities answer to)."""
    refs = found_references(entities)
    known = refs.join(targets_of(refs, every).withColumnRenamed("EntityType", "t").withColumnRenamed("DataSource", "d").withColumnRenamed("SourceEntityType", "s").withColumnRenamed("RefId", "r"), F.col("EntityType").eqNullSafe(F.col("t")) & F.col("DataSource").eqNullSafe(F.col("d")) & F.col("SourceEntityType").eqNullSafe(F.col("s")) & (F.col("RefId") == F.col("r")))
    changed = replaced(known.where("n = 1"), entities)
    owner = known.where("n = 0").join(entities.select(F.col("id").alias("owner"), F.col("entityType").alias("ownerType")), "owner")
    promises = owner.select(promise_key(F.col("SourceEntityType"), F.col("RefId"), F.col("path"), F.col("EntityType"), F.col("owner")).alias("promise"), "owner", "ownerType", "path", *FIELDS).dropDuplicates(["promise"])
    failures = known.where("n > 1").select("owner", "path", *FIELDS, F.lit("several entities have this alternate key").alias("Error"))
    return changed, promises, failures


def settle(promises: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(promise, status, target and the promise's columns; changed documents).

    Stale: the owner is gone, or holds the reference nowhere; Unresolved: it holds it elsewhere, or no target is there yet;
    Failed: several targets; Resolved: replaced. The golden type is compared by exact case, sources without."""
    refs = found_references(entities.join(promises.select(F.col("owner").alias("id")).distinct(), "id", "left_semi"))

    def same(a: str, b: str) -> Column:
        fold = lambda side, c: F.lower(F.coalesce(F.col(f"{side}.{c}"), F.lit("")))
        return (F.col(f"{a}.owner") == F.col(f"{b}.owner")) & F.col(f"{a}.EntityType").eqNullSafe(F.col(f"{b}.EntityType")) & (fold(a, "DataSource") == fold(b, "DataSource")) & (fold(a, "SourceEntityType") == fold(b, "SourceEntityType")) & (fold(a, "RefId") == fold(b, "RefId"))

    # one row for each promise: is the reference at its path, is it anywhere
    places = promises.alias("p").join(refs.alias("r"), same("p", "r"), "left").groupBy("p.promise").agg(F.max(F.col("r.path") == F.col("p.path")).alias("here"), F.count("r.path").alias("held"), F.max("r.at").alias("at"))
    owners = entities.select(F.col("id").alias("owner"), F.lit(True).alias("there"))
    targets = targets_of(promises, entities)
    rows = promises.join(places, "promise").join(owners, "owner", "left").join(targets, FIELDS, "left")
    status = (
        F.when(F.col("there").isNull(), "Stale")
        .when(~F.coalesce("here", F.lit(False)) & (F.col("held") > 0), "Unresolved")
        .when(~F.coalesce("here", F.lit(False)), "Stale")
        .when(F.coalesce("n", F.lit(0)) == 0, "Unresolved")
        .when(F.col("n") > 1, "Failed")
        .otherwise("Resolved")
    )
    rows = rows.withColumn("status", status).withColumn("target", F.when(F.col("status") == "Resolved", F.col("target")))
    return rows.select(*promises.columns, "status", "target", "at"), replaced(rows.where("status = 'Resolved'"), entities)


def rollup(settled: DataFrame) -> DataFrame:
    """One row with the counts Resolved, Unresolved, Stale and Failed."""
    return settled.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("Resolved", "Unresolved", "Stale", "Failed")])


def patch_promises(promises: DataFrame, operations: list[dict]) -> DataFrame:
    """set and remove operations on a promise's columns; if any of them cannot be done nothing changes (ValueError)."""
    out = promises
    for op in operations:
        kind, name = op["Operation"].lower(), op["Path"]
        if kind not in ("set", "remove") or name not in promises.columns or name in ("promise", "owner"):
            raise ValueError(f"{name}: cannot be patched")
        out = out.withColumn(name, F.lit(op.get("Value") if kind == "set" else None).cast("string"))
    return out


def as_updates(changed: DataFrame, entities: DataFrame, hub: str, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Changed documents as (rows of entities, rows of the log)."""
    real = changed.where("delta is not null")
    rows = entities.drop("doc").join(real.select("id", "doc"), "id").withColumn("lastUpdated", F.lit(now)).select(*entities.columns)
    at = F.coalesce(F.try_to_timestamp(F.col("at")), F.lit(now))
    log = real.join(entities.select("id", "entityType"), "id").select(F.lit(hub).alias("DataSource"), F.col("entityType").alias("EntityType"), F.col("id").alias("EntityId"), F.sha2(F.concat_ws("|", "id", "delta", at.cast("string")), 256).alias("_id"), F.lit("Update").alias("EntryType"), at.alias("Timestamp"), F.lit(0).cast("long").alias("_ts"), F.col("delta").alias("Data"))
    return rows, log.withColumnRenamed("_id", "id")
