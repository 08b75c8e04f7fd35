"""Event-sourced history: deltas, replay, as-of reads, revert, compaction, baseline conflicts.

The long form of a change log has a row for each changed leaf: entity, path, value (canonical JSON, null deletes), ts, ord.
Replay of whole-value changes is last-writer-wins in it and stays in Spark's aggregates; logs of JSON deltas go through a
strict fold for each entity.
"""

from __future__ import annotations

import hashlib
import json
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import documents as D


def change_deltas(log: DataFrame, entity: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the one before it in its entity, with that as `old`."""
    w = W.partitionBy(*entity).orderBy(*order)
    return log.withColumn("old", F.lag(value).over(w)).withColumn("n", F.row_number().over(w)).where(~F.col(value).eqNullSafe(F.col("old")) | (F.col("n") == 1)).drop("n")


def replay_leaves(log: DataFrame, entity: list[str], order: list[str], value: str, as_of: Column | None = None) -> DataFrame:
    """The last value of each leaf, up to as_of if given; leaves whose last change deletes are absent."""
    held = log if as_of is None else log.where(as_of)
    # the value sits in a struct, so that a deletion, whose value is null, can be the last word
    return held.groupBy(*entity).agg(F.max_by(F.struct(F.col(value)), F.struct(*order)).alias("s")).select(*entity, F.col(f"s.{value}").alias(value)).where(F.col(value).isNotNull())


def revert_deltas(log: DataFrame, entity: list[str], order: list[str], value: str, target: Column) -> DataFrame:
    """Changes that lead from the current state back to the state at target: entity, current, reverted."""
    now = F.max_by(value, F.struct(*order))
    # one pass: the state then is the last change among the rows that target keeps
    then = F.max_by(F.when(target, F.col(value)), F.when(target, F.struct(*order)))
    return log.groupBy(*entity).agg(now.alias("current"), then.alias("reverted")).where(~F.col("current").eqNullSafe(F.col("reverted")))


def compaction(log: DataFrame, entity: list[str], order: list[str], value: str, cutoff: Column) -> DataFrame:
    """Rebase: entity, baseline value at the cutoff, archived entries, kept entries."""
    return log.groupBy(*entity).agg(F.max_by(F.when(cutoff, F.col(value)), F.when(cutoff, F.struct(*order))).alias("baseline"), F.count_if(cutoff).alias("archived"), F.count_if(~cutoff).alias("kept"))


def baseline_conflicts(inits: DataFrame, entity: list[str], ts: str, data: str) -> DataFrame:
    """Entities with differing baselines at one timestamp, and the first such timestamp."""
    return inits.groupBy(*entity, ts).agg(F.count_distinct(data).alias("k")).where("k > 1").groupBy(*entity).agg(F.min(ts).alias("conflict_at"))


def replay_order(ts: str = "Timestamp", stored: str = "_ts", tie: str = "id") -> list[Column]:
    return [F.col(ts), F.when(F.col(stored) == 0, F.lit(2**63 - 1)).otherwise(F.col(stored)), F.col(tie)]


def replay_documents(log: DataFrame, as_of: datetime | None = None, lenient: bool = False) -> DataFrame:
    """log (DataSource, EntityType, EntityId, id, EntryType, Timestamp, _ts, Data JSON) -> state JSON or error of each entity.

    An entity's history is one group, which its own length bounds."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        entries = [r | {"Data": json.loads(r["Data"]), "Timestamp": r["Timestamp"].isoformat()} for r in part.to_dict("records")]
        try:
            state, error = D.replay(entries, as_of, lenient), None
        except D.PatchError as e:
            state, error = None, str(e)
        if state is None and error is None:
            error = "NO_TRACKING_STATE_AT_TARGET"
        return pd.DataFrame([{"DataSource": first["DataSource"], "EntityType": first["EntityType"], "EntityId": first["EntityId"], "state": None if state is None else D.canonical(state), "error": error}])

    return log.groupBy("DataSource", "EntityType", "EntityId").applyInPandas(fold, "DataSource string, EntityType string, EntityId string, state string, error string")


def revert_documents(log: DataFrame, to: datetime | str, now: datetime, dry_run: bool = False, hub: str | None = None) -> DataFrame:
    """One new Update for each entity whose state differs from that at `to`: EntityId, Timestamp, Data, error, written.

    to: a time, or the id of an entry: then all up to it, in the order of replay. hub: histories of other data sources are
    refused."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        entries = [r | {"Data": json.loads(r["Data"]), "Timestamp": r["Timestamp"].isoformat()} for r in part.to_dict("records")]
        data, error = None, None
        if isinstance(to, str):
            ranked = sorted(entries, key=D.replay_order)
            last = next((k for k, e in enumerate(ranked) if e["id"] == to), None)
            then = ranked[: last + 1] if last is not None else None
        else:
            then = [e for e in entries if D.as_instant(e["Timestamp"]) <= to]
        if hub is not None and first["DataSource"] != hub:
            error = "UNSUPPORTED_DATA_SOURCE"
        elif then is None:
            error = "TRACKING_ENTRY_NOT_FOUND"
        elif not any(e["EntryType"] == "Init" for e in then):
            error = "NO_TRACKING_STATE_AT_TARGET"
        else:
            try:
                data = D.diff(D.strip_base(D.replay(entries)), D.strip_base(D.replay(then)))
            except D.PatchError:
                error = "REPLAY_FAILED"
        return pd.DataFrame([{"DataSource": first["DataSource"], "EntityType": first["EntityType"], "EntityId": first["EntityId"], "EntryType": "Update", "Timestamp": pd.Timestamp(now), "Data": None if data is None else D.canonical(data), "error": error, "written": data is not None and not dry_run}])

    return log.groupBy("DataSource", "EntityType", "EntityId").applyInPandas(fold, "DataSource string, EntityType string, EntityId string, EntryType string, Timestamp timestamp, Data string, error string, written boolean")


def rebase_documents(log: DataFrame, to: datetime, stored: DataFrame | None = None) -> DataFrame:
    """Compaction of JSON histories up to `to`: rows of the new log with action 'baseline' or 'keep', and 'failed' entities' rows as they were.

    A history that cannot be replayed falls back on the stored entity (EntityId, doc, lastUpdated) if nothing later was
    logged and it is no newer than `to`; else it is kept whole."""
    joined = log if stored is None else log.join(stored.select("EntityId", F.col("doc").alias("_doc"), F.col("lastUpdated").alias("_updated")), "EntityId", "left")

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.to_dict("records")
        doc, updated = (rows[0].pop("_doc", None), rows[0].pop("_updated", None))
        for r in rows:
            r.pop("_doc", None)
            r.pop("_updated", None)
        before = [r for r in rows if D.as_instant(r["Timestamp"]) <= to]
        after = [r for r in rows if D.as_instant(r["Timestamp"]) > to]
        out = [r | {"action": "keep", "warning": None} for r in rows]
        if len(before) > 1:
            cutoff = max(D.as_instant(r["Timestamp"]) for r in before)
            entries = [r | {"Data": json.loads(r["Data"]), "Timestamp": r["Timestamp"].isoformat()} for r in before]
            inits: dict = {}
            for e in entries:
                if e["EntryType"] == "Init":
                    inits.setdefault(e["Timestamp"], set()).add(D.canonical(e["Data"]))
            state, warning = None, None
            if all(len(v) == 1 for v in inits.values()) and inits:
                try:
                    replayed = D.replay(entries, to)
                    # the baseline goes to the cutoff, but the entity keeps the time it was created at
                    state = D.strip_base(replayed) | {"createdOn": replayed["createdOn"]}
                except D.PatchError:
                    state = None
            if state is None and not after and doc is not None and updated is not None and D.as_instant(updated) <= to:
                whole = json.loads(doc)
                state, warning = D.strip_base(whole) | ({"createdOn": whole["createdOn"]} if "createdOn" in whole else {}), "STORED_ENTITY_RECOVERY"
            if state is None:
                out = [r | {"action": "failed", "warning": "REPLAY_FAILED"} for r in rows]
            else:
                base = before[0] | {"id": hashlib.sha256("|".join([str(before[0]["EntityId"]), *sorted(str(r["id"]) for r in before), D.canonical(state)]).encode()).hexdigest(), "EntryType": "Init", "Timestamp": pd.Timestamp(cutoff).tz_convert(None), "_ts": 0, "Data": D.canonical(state), "action": "baseline", "warning": warning}
                out = [base, *(r | {"action": "keep", "warning": None} for r in after)]
        return pd.DataFrame(out)[columns]

    columns = [*log.columns, "action", "warning"]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in log.dtypes), "action string", "warning string"])
    return joined.groupBy("DataSource", "EntityType", "EntityId").applyInPandas(fold, schema)
