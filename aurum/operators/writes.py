"""Create, update, patch, import, delete; alternate-key maintenance; numbering; management tables."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import documents as D


def upsert(current: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace those of the same key."""
    return current.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def create_only(new: DataFrame, tracked: DataFrame, key: list[str]) -> DataFrame:
    """Each new row with an error if its key is tracked already."""
    seen = tracked.select(*key).distinct().withColumn("_seen", F.lit(True))
    return new.join(seen, key, "left").withColumn("error", F.when(F.col("_seen"), "Entity already exists")).drop("_seen")


def import_entities(current: DataFrame, incoming: DataFrame, key: list[str], overwrite: bool = False) -> DataFrame:
    """Unknown ids are created; known ones are replaced only if `overwrite` and the row's own overwrite flag say so."""
    ids = current.select(*key).distinct()
    cols = current.columns
    created = incoming.join(ids, key, "left_anti").select(*cols)
    if not overwrite:
        return current.unionByName(created)
    replaced = incoming.where("overwrite").join(ids, key, "left_semi").select(*cols)
    return upsert(current, created.unionByName(replaced), key)


def delete_entities(current: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(the rest, ids that were not found with their error); an id that is asked for twice counts once, null ids are nothing."""
    ids = ids.where(F.col(key).isNotNull()).select(key).distinct()
    return current.join(ids, key, "left_anti"), ids.join(current, key, "left_anti").select(key, F.lit("Key not found").alias("error"))


def patch_documents(docs: DataFrame, operations: list[dict], key: str = "id") -> DataFrame:
    """docs (key, doc JSON) -> key, doc, delta, errors: operations in order, one that fails leaves the others in force."""

    def run(batches):
        for part in batches:
            out = [(D.apply_patch(json.loads(d), operations), json.loads(d)) for d in part["doc"]]
            deltas = [D.diff(old, new) for (new, _), old in out]
            yield pd.DataFrame({key: part[key], "doc": [D.canonical(new) for (new, _), _ in out], "delta": [None if d is None else D.canonical(d) for d in deltas], "errors": [e for (_, e), _ in out]})

    return docs.select(key, "doc").mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, doc string, delta string, errors array<string>")


def update_documents(docs: DataFrame, updates: DataFrame, key: str = "id", patch: bool = False) -> DataFrame:
    """docs (key, doc), updates (key, payload) -> key, doc, delta, error: deep merge, arrays replaced; a patch ignores nulls."""
    joined = updates.join(docs.select(key, F.col("doc")), key, "left")

    def run(batches):
        for part in batches:
            rows = []
            for k, doc, payload in zip(part[key], part["doc"], part["payload"], strict=True):
                if doc is None:
                    rows.append((k, None, None, "Entity does not exist"))
                    continue
                old = json.loads(doc)
                new = D.strip_nulls(D.deep_merge(old, json.loads(payload), null_ignored=patch))
                delta = D.diff(old, new)
                rows.append((k, D.canonical(new), None if delta is None else D.canonical(delta), None))
            yield pd.DataFrame(rows, columns=[key, "doc", "delta", "error"])

    return joined.select(key, "doc", "payload").mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, doc string, delta string, error string")


def detach(keys: Column, data_source: str) -> Column:
    """Alternate keys without those of a data source (equal to it or under it, without case)."""
    ds = data_source.lower()
    return F.filter(keys, lambda k: ~((F.lower(k["Key"]) == ds) | F.startswith(F.lower(k["Key"]), F.lit(ds + "."))))


def register_key(keys: Column, key: Column, value: Column, replace: bool = False, replace_same_source: bool = False) -> Column:
    """Adds (key, value) unless it is there; may first drop the same key, or all keys of its data source."""
    kept = keys
    if replace_same_source:
        kept = F.filter(kept, lambda k: F.substring_index(k["Key"], ".", 1) != F.substring_index(key, ".", 1))
    if replace:
        kept = F.filter(kept, lambda k: k["Key"] != key)
    there = F.exists(kept, lambda k: (k["Key"] == key) & (k["Value"] == value))
    return F.when(there, kept).otherwise(F.concat(kept, F.array(F.struct(key.alias("Key"), value.alias("Value")))))


def split_key(entities: DataFrame, key: str, value: str, new_id: str, id_col: str = "id") -> DataFrame:
    """The entity that has (key, value) loses it, and a copy of it has that key alone; the key must be one entity's and the
    value that of another of its keys too. Otherwise nothing changes."""
    has = F.exists("alternateKeys", lambda k: (k["Key"] == key) & (k["Value"] == value))
    again = F.exists("alternateKeys", lambda k: (k["Key"] != key) & (k["Value"] == value))
    owners = entities.where(has).count()
    rows = entities.withColumn("_go", has & again & F.lit(owners == 1))
    gone = F.filter("alternateKeys", lambda k: ~((k["Key"] == key) & (k["Value"] == value)))
    only = F.filter("alternateKeys", lambda k: (k["Key"] == key) & (k["Value"] == value))
    cols = entities.columns
    stay = rows.withColumn("alternateKeys", F.when(F.col("_go"), gone).otherwise(F.col("alternateKeys"))).select(*cols)
    copy = rows.where("_go").withColumn(id_col, F.lit(new_id)).withColumn("alternateKeys", only).select(*cols)
    return stay.unionByName(copy)


def auto_numbers(rows: DataFrame, group: list[str], order: list[str], start: int = 1, step: int = 1, current: int = 0, prefix: str = "", suffix: str = "", padding: int = 0) -> DataFrame:
    """number and text for each row: the first is `start` for a fresh sequence, else current + step.

    `group` is the sequence a row draws from; sequences are numbered independently."""
    if step == 0 or padding < 0:
        raise ValueError("IncrementBy must not be 0 and padding not negative")
    first = start if current == 0 and start != 0 else current + step
    out = ranks(rows, group, order, "_rank").withColumn("number", (F.lit(first) + (F.col("_rank") - 1) * step).cast("long")).drop("_rank")
    text = F.abs("number").cast("string")
    return out.withColumn("text", F.concat(F.lit(prefix), F.when(F.col("number") < 0, "-").otherwise(""), F.lpad(text, F.greatest(F.lit(padding), F.length(text)), F.lit("0")), F.lit(suffix)))


def ranks(rows: DataFrame, group: list[str], order: list[str], name: str, ranges: int = 64) -> DataFrame:
    """row_number within group by order, without one task for a whole group: the rows are cut into ranges of group and order
    at the quantiles of a bounded sample, counted for each group and range, and numbered from the sum of the ranges before.
    The sample decides how even the ranges are, never the result."""
    kinds, names = dict(rows.dtypes), [*group, *order]
    key = F.struct(*names)
    sample = rows.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(32 * ranges).orderBy("k").collect()
    bounds = [F.struct(*[F.lit(row["k"][c]).cast(kinds[c]).alias(c) for c in names]) for row in sample[32::32]]
    number = F.size(F.filter(F.array(*bounds), lambda b: b < key)) if bounds else F.lit(0)
    cut = rows.withColumn("_range", number)
    before = W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    bases = cut.groupBy(*group, "_range").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    bases = bases.select(*[F.col(c).alias(f"_b_{c}") for c in group], F.col("_range").alias("_b_range"), "_base")
    inner = cut.withColumn("_inner", F.row_number().over(W.partitionBy(*group, "_range").orderBy(*order)))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_b_{c}")) for c in group], F.col("_range") == F.col("_b_range"))
    return inner.join(bases, same).withColumn(name, F.col("_base") + F.col("_inner")).select(*rows.columns, name)


def retry_failures(failures: DataFrame, group: list[str], ident: str) -> DataFrame:
    """One Ready job for each group of failures, with how many ids it resubmits."""
    return failures.groupBy(*group).agg(F.count_distinct(ident).alias("ids"), F.min(ident).alias("first_id")).withColumn("status", F.lit("Ready"))


def bulk_update(rows: DataFrame, target: Column, column: str, value: Column, dry_run: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows after a one-property update of the targets, the rollup Matched, Updated)."""
    changes = target & ~F.col(column).eqNullSafe(value)
    rollup = rows.agg(F.count_if(target).alias("Matched"), F.count_if(changes).alias("Updated"))
    return (rows if dry_run else rows.withColumn(column, F.when(target, value).otherwise(F.col(column)))), rollup


def effective_permissions(users: DataFrame, roles: DataFrame) -> DataFrame:
    """users (user, roles), roles (role, permissions) -> user, permissions; a user with an unknown role has none (null)."""
    each = users.select("user", F.explode("roles").alias("role")).join(roles, "role", "left")
    got = each.groupBy("user").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("permissions")))).alias("permissions"), F.count_if(F.col("permissions").isNull()).alias("unknown"))
    return got.select("user", F.when(F.col("unknown") == 0, F.col("permissions")).alias("permissions"))


def submit_jobs(jobs: DataFrame, requests: DataFrame) -> DataFrame:
    """Appends requests (id, type, payload) with status Ready."""
    return jobs.unionByName(requests.withColumn("status", F.coalesce("status", F.lit("Ready")) if "status" in requests.columns else F.lit("Ready")), allowMissingColumns=True)


def retry_jobs(jobs: DataFrame, ids: list[str]) -> DataFrame:
    hit = F.col("id").isin(ids)
    return jobs.withColumn("status", F.when(hit, "Ready").otherwise(F.col("status"))).withColumn("completed_on", F.when(~hit, F.col("completed_on")))
