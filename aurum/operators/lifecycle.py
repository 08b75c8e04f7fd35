"""Operators on whole histories and item lists: source rebase, split with history, sync events, item results, checkpoints."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import documents as D

IDENT = ["DataSource", "EntityType", "EntityId"]


def item_results(asked: DataFrame, done: DataFrame, failed: DataFrame, key: list[str]) -> DataFrame:
    """What became of each item that was asked for: success, its error, or 'Not processed' where neither list names it."""
    errors = failed.groupBy(*key).agg(F.min("error").alias("error"))
    good = done.select(*key).distinct().withColumn("done", F.lit(True))
    rows = asked.select(*key).distinct().join(errors, key, "left").join(good, key, "left")
    return rows.select(*key, (F.col("error").isNull() & F.col("done").isNotNull()).alias("success"), F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("done").isNull(), "Not processed").alias("error"))


def distinct_first(rows: DataFrame, key: list[str], arrival: str) -> DataFrame:
    """The first arrival of each key, as one aggregation."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(arrival)).alias("first")).select(*key, "first.*").select(*rows.columns)


def tracking(log: DataFrame, data_source: str | None = None, entity_type: str | None = None, since: datetime | None = None, until: datetime | None = None, ids: list[str] | None = None) -> DataFrame:
    """Change entries by optional source, type, time (both ends included) and entity ids; every filter reaches the scan."""
    for test, column in ((data_source, "DataSource"), (entity_type, "EntityType")):
        log = log if test is None else log.where(F.col(column) == test)
    log = log if since is None else log.where(F.col("Timestamp") >= since)
    log = log if until is None else log.where(F.col("Timestamp") <= until)
    return log if ids is None else log.where(F.col("EntityId").isin(ids))


def record_sync(entities: DataFrame, events: DataFrame) -> DataFrame:
    """events (id, Key, Value, synced, error) set LastSync and Error of the alternate key of each entity, and a key that is not
    there is added; of several events of one key the last counts."""
    last = events.groupBy("id", "Key", "Value").agg(F.max_by(F.struct("synced", "error"), "synced").alias("e"))
    mine = last.groupBy("id").agg(F.collect_list(F.struct("Key", "Value", F.col("e.synced").alias("LastSync"), F.col("e.error").alias("Error"))).alias("seen"))
    plain = F.transform("alternateKeys", lambda k: F.struct(k["Key"].alias("Key"), k["Value"].alias("Value"), F.lit(None).cast(events.schema["synced"].dataType).alias("LastSync"), F.lit(None).cast("string").alias("Error")))
    rows = entities.withColumn("alternateKeys", plain).join(mine, "id", "left")
    fresh = F.filter("seen", lambda s: ~F.exists("alternateKeys", lambda k: (k["Key"] == s["Key"]) & (k["Value"] == s["Value"])))
    known = F.transform("alternateKeys", lambda k: F.coalesce(F.get(F.filter("seen", lambda s: (k["Key"] == s["Key"]) & (k["Value"] == s["Value"])), 0), k))
    return rows.withColumn("alternateKeys", F.when(F.col("seen").isNull(), F.col("alternateKeys")).otherwise(F.concat(known, fresh))).drop("seen")


def checkpoint_id(identity: Column, entries: Column, data: Column) -> Column:
    """The same for the same identity, set of entries and state, so that a job that runs again writes the same baseline."""
    return F.sha2(F.concat_ws("\n", identity, F.array_join(F.array_sort(entries), ","), data), 256)


def rebase_sources(log: DataFrame, wanted: DataFrame, to: datetime) -> tuple[DataFrame, DataFrame]:
    """(the new log with actions baseline, keep and failed; a row for each wanted (DataSource, EntityType, EntityId) with code).

    Names are found without case; one that is stored in several spellings is ambiguous and keeps its rows. A history is
    compacted up to `to`, but only as far as it is sound: it stops before two baselines of one time that differ, and before
    the first time at which it cannot be replayed (code PARTIAL)."""
    lower = [F.lower(c).alias(f"_{c}") for c in IDENT]
    keyed = log.select("*", *lower)
    asked = wanted.select(*lower).distinct()
    named = keyed.join(asked, [f"_{c}" for c in IDENT], "left_semi").select(*IDENT, *[f"_{c}" for c in IDENT]).distinct()
    spelled = named.groupBy(*[f"_{c}" for c in IDENT]).agg(F.count_distinct("EntityType").alias("types"), F.count("*").alias("n"))
    codes = asked.join(spelled, [f"_{c}" for c in IDENT], "left").withColumn("code", F.when(F.col("n").isNull(), "NOT_FOUND").when(F.col("types") > 1, "AMBIGUOUS_SOURCE_ENTITY_TYPE").when(F.col("n") > 1, "AMBIGUOUS_SOURCE_ENTITY_IDENTITY"))
    clear = codes.where("code is null").select(*[f"_{c}" for c in IDENT])
    columns = log.columns
    schema = ", ".join([*(f"`{n}` {t}" for n, t in log.dtypes), "action string", "code string"])

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        rows = part[columns].to_dict("records")
        entries = [r | {"Data": json.loads(r["Data"]), "Timestamp": r["Timestamp"].isoformat()} for r in rows]
        kept, code = sound_prefix(entries, to)
        if kept is None:
            return pd.DataFrame([r | {"action": "failed" if code else "keep", "code": code} for r in rows])
        cutoff, state = kept
        before = [k for k, e in enumerate(entries) if D.as_instant(e["Timestamp"]) <= cutoff]
        ids = sorted(str(rows[k]["id"]) for k in before)
        data = D.canonical(state)
        ident = hashlib.sha256("\n".join(["|".join(str(rows[0][c]) for c in IDENT), ",".join(ids), data]).encode()).hexdigest()
        base = rows[before[0]] | {"id": ident, "EntryType": "Init", "Timestamp": pd.Timestamp(cutoff).tz_convert(None), "_ts": 0, "Data": data, "action": "baseline", "code": code}
        return pd.DataFrame([base, *(r | {"action": "keep", "code": code} for k, r in enumerate(rows) if k not in set(before))])

    mine = keyed.join(clear, [f"_{c}" for c in IDENT], "left_semi")
    rest = keyed.join(clear, [f"_{c}" for c in IDENT], "left_anti").select(*columns, F.lit("keep").alias("action"), F.lit(None).cast("string").alias("code"))
    new = mine.select(*columns).groupBy(*IDENT).applyInPandas(fold, schema).unionByName(rest)
    return new, codes.select(*[F.col(f"_{c}").alias(c) for c in IDENT], "code")


def sound_prefix(entries: list[dict], to: datetime) -> tuple[tuple[datetime, dict] | None, str | None]:
    """((cutoff, state) of the longest history up to `to` that replays, code); the first is None where nothing is to be done."""
    times = sorted({D.as_instant(e["Timestamp"]) for e in entries if D.as_instant(e["Timestamp"]) <= to})
    inits: dict[datetime, set[str]] = {}
    for e in entries:
        if e["EntryType"] == "Init":
            inits.setdefault(D.as_instant(e["Timestamp"]), set()).add(D.canonical(e["Data"]))
    clash = min((t for t, found in inits.items() if len(found) > 1), default=None)
    code = None
    if clash is not None and times and clash <= times[-1]:
        times, code = [t for t in times if t < clash], "BASELINE_CONFLICT"

    def state_at(t: datetime) -> dict | None:
        try:
            found = D.replay([e for e in entries if D.as_instant(e["Timestamp"]) <= t], t)
        except D.PatchError:
            return None
        if found is None:
            return None
        return D.strip_base(found) | ({"createdOn": found["createdOn"]} if "createdOn" in found else {})

    if times and (state := state_at(times[-1])) is None:
        # a prefix of a history that replays does so too: the longest one is found by halving
        low, high = 0, len(times) - 1
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if state_at(times[mid]) is not None else (low, mid)
        times, code = times[:low], "REPLAY_FAILED"
        state = state_at(times[-1]) if times else None
    if not times or state is None:
        return None, code or None
    if sum(D.as_instant(e["Timestamp"]) <= times[-1] for e in entries) < 2:
        return None, code
    return (times[-1], state), "PARTIAL" if code else None


def split_history(log: DataFrame, entity_id: str, new_id: str, key: dict[str, str]) -> DataFrame:
    """The history of an entity again for its split-off copy: in replay order with new ids; each Init has the one alternate
    key, changes of the keys go from the Updates, and Updates that changed nothing else go whole."""
    mine = log.where(F.col("EntityId") == entity_id)

    def rewrite(batches):
        for part in batches:
            out = []
            for kind, data in zip(part["EntryType"], part["Data"], strict=True):
                data = json.loads(data)
                if kind == "Init":
                    data["alternateKeys"] = [key]
                else:
                    data.pop("alternateKeys", None)
                out.append(D.canonical(data) if data else None)
            yield part.assign(Data=out)

    rows = mine.mapInPandas(rewrite, mine.schema).where("Data is not null")
    order = W.partitionBy("EntityId").orderBy("Timestamp", F.when(F.col("_ts") == 0, F.lit(2**63 - 1)).otherwise(F.col("_ts")), "id")
    number = F.row_number().over(order)  # one entity's history
    return rows.withColumn("_n", number).withColumn("id", F.sha2(F.concat_ws("|", F.lit(new_id), F.lpad(F.col("_n").cast("string"), 9, "0")), 256)).withColumn("EntityId", F.lit(new_id)).drop("_n").select(*log.columns)


def split_problem(entities: DataFrame, entity_id: str, key: str, value: str) -> str | None:
    """Why an alternate key of an entity cannot be split off, or None."""
    has = F.exists("alternateKeys", lambda k: (k["Key"] == key) & (k["Value"] == value))
    owners = entities.where(has | (F.col("id") == entity_id)).select("id", "alternateKeys", has.alias("has")).limit(3).collect()
    mine = [r for r in owners if r["id"] == entity_id]
    if not mine:
        return "ENTITY_NOT_FOUND"
    if not mine[0]["has"]:
        return "ALTERNATE_KEY_NOT_FOUND"
    if sum(r["has"] for r in owners) > 1 or sum(k["Key"] == key and k["Value"] == value for k in mine[0]["alternateKeys"]) > 1:
        return "ALTERNATE_KEY_NOT_UNIQUE"
    if not any(k["Key"] != key and k["Value"] == value for k in mine[0]["alternateKeys"]):
        return "NO_OTHER_KEY_WITH_THIS_VALUE"
    return None
