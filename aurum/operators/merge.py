"""The merge engine: new and existing entities, first-time merge, tracked fold with staged acceptance, outcomes.

Set-wise parts (resolution, split, first-time survivorship over columns, outcomes, failure log) are DataFrame operations. What
depends on the order of one entity's events runs as a fold over that entity's events: a group holds one golden entity's
batch and history.
"""

from __future__ import annotations

import json
from collections import defaultdict
from datetime import datetime, timezone
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import documents as D
from .rules import Rules, allows, resolve_property_rule

# fixed values
CREATED = "New Entity Created"
UPDATED = "Entity Matched And Updated"
MATCHED = "Entity Matched But Not Updated"
UNCHANGED = "No Source Entity Update To Process"
NOT_FOUND = "Source Entity Not Found"
REJECTED = "Merge Rejected"
SILENT = "Merge Silently Rejected"
FAILED = "Merge Failed"
FAILURES = (FAILED, NOT_FOUND, REJECTED)
FIRST_DATE = datetime(1, 1, 1, tzinfo=timezone.utc)


class Refused(Exception):
    """A pre-merge rule turns an event away; args: the outcome."""


def survive(action: str | None, old: Column, new: Column, newer: Column) -> Column:
    """First-time merge of one column by its rule's action; without a rule the property is dropped, so the old value stays."""
    if action == "AlwaysOverwrite":
        return F.coalesce(new, old)
    if action == "OverwriteIfNewer":
        return F.when(newer, F.coalesce(new, old)).otherwise(old)
    if action == "OverwriteIfEmpty":
        return F.coalesce(old, new)
    if action == "OverwriteIfNotEmpty":
        return F.coalesce(new, old)
    return old


def first_time_merge(target: DataFrame, source: DataFrame, key: str, rules: dict[str, str | None], newer: Column | None = None) -> DataFrame:
    """target left-joined with source; each property of rules survives by its action. outcome tells matched from created."""
    t, s = target.alias("t"), source.withColumn("_hit", F.lit(True)).alias("s")
    rows = t.join(s, key, "left")
    cols = [survive(a, F.col(f"t.{c}"), F.col(f"s.{c}"), F.lit(True) if newer is None else newer).alias(c) for c, a in rules.items()]
    return rows.select(key, *cols, F.when(F.col("_hit").isNull(), CREATED).otherwise(UPDATED).alias("outcome"))


def merge_keys(old: list[dict], new: list[dict]) -> list[dict]:
    """Payload keys are added or overwrite the value of the same Key; none goes."""
    out = {k["Key"]: dict(k) for k in old}
    for k in new:
        out[k["Key"]] = out.get(k["Key"], {}) | k
    return list(out.values())


def accept(state: dict, delta: Any, rules: list[dict], target_updated: datetime | None, changed: datetime | None, prefix: str = "") -> Any:
    """The part of a delta that the property rules let through, or None."""
    out = {}
    for name, d in delta.items():
        path = prefix + name
        if isinstance(d, dict):
            inner = state.get(name) if isinstance(state, dict) else None
            if (kept := accept(inner or {}, d, rules, target_updated, changed, path + ".")) is not None:
                out[name] = kept
            continue
        rule = resolve_property_rule(rules, path)
        old, new = (None if len(d) == 1 else d[0]), (d[-1] if len(d) < 3 else None)
        if allows(rule and rule["action"], old, new, target_updated, changed, deletes=len(d) == 3):
            out[name] = d
    return out or None


def source_of(e: dict) -> tuple:
    """What identifies a source entity; names of systems and types are compared without case."""
    return e["DataSource"].lower(), e["SourceEntityType"].lower(), e["SourceEntityId"]


def own_key(e: dict, now: datetime) -> dict:
    return {"Key": f"{e['DataSource']}.{e['SourceEntityType']}".lower(), "Value": e["SourceEntityId"], "LastMerge": now.isoformat()}


def has_key(state: dict, key: dict) -> bool:
    return any(k["Key"] == key["Key"] and k["Value"] == key["Value"] for k in state.get("alternateKeys") or [])


def first_into(state: dict, data: dict, stamps: tuple[datetime, datetime], properties: list[dict] | None) -> dict:
    """The first merge of a source into an entity that it matched; data: without base properties. With rules only the
    properties that a rule lets through are copied, arrays are united and nulls delete; without rules a source that is no
    older gives all it has, arrays are replaced and nulls pass by. stamps: last changes of the target and the source."""
    base = D.strip_base(state)
    base.pop("alternateKeys", None)
    if properties is None:
        return base if stamps[1] < stamps[0] else D.strip_nulls(D.deep_merge(base, data, null_ignored=True))
    taken: dict = {}
    for path, new in D.leaves(data).items():
        rule = resolve_property_rule(properties, path)
        if allows(rule and rule["action"], D.read_path(base, path), new, *stamps, unmatched=False):
            D.write_path(taken, path, new)
    return D.strip_nulls(D.deep_merge(base, taken, union_arrays=True))


class SourceLog:
    """What the sources have said so far (source -> its log entries) and the states that follow from it."""

    def __init__(self, history: dict[tuple, list[dict]], now: datetime):
        self.entries, self.now, self.latest = history, now, {}

    def inits(self, source: tuple) -> list[datetime]:
        return [D.as_instant(x["Timestamp"]) for x in self.entries.get(source, ()) if x["EntryType"] == "Init"]

    def as_of(self, source: tuple, at: datetime) -> dict | None:
        """The source's state at a time; None before it has said anything."""
        if not self.inits(source):
            return None
        entries = self.entries[source]
        named = [x | {"EntityType": x["SourceEntityType"], "EntityId": x["SourceEntityId"]} for x in entries]
        if source not in self.latest:
            self.latest[source] = D.strip_base(D.replay(named) or {}), max(D.as_instant(x["Timestamp"]) for x in entries)
        state, last = self.latest[source]
        return state if at >= last else D.strip_base(D.replay(named, at) or {})

    def add(self, source: tuple, ident: dict, kind: str, at: datetime, data: dict, whole: dict) -> None:
        entries = self.entries.setdefault(source, [])
        order = max([int(self.now.timestamp() * 1e6), *(x["_ts"] + 1 for x in entries[-1:])])
        entries.append({**ident, "EntryType": kind, "Timestamp": at.isoformat(), "_ts": order, "id": f"{order:020d}", "Data": data})
        if len(entries) == 1 or source in self.latest and at >= self.latest[source][1]:
            self.latest[source] = whole, at
        else:
            self.latest.pop(source, None)


def fold_entity(stored: dict | None, events: list[dict], rules: list[dict] | Rules, now: datetime, tracked: bool = True, history: dict[tuple, list[dict]] | None = None) -> tuple[dict | None, list[dict], list[dict]]:
    """Events of one golden entity in version order -> (entity, new log entries, results).

    An event is staged on a copy; only if all of it succeeds does the copy become the state, else its supplied fields are
    offered again by a later event of the same source that still holds them. An event of a source that the entity has no
    key of is the source's first merge. history (source -> its log entries) is what the sources have said so far; what they
    say now is added to it, but for events that are rejected. An event is compared with its source's state as of its time;
    one from before the source's last Init changes nothing."""
    rules = Rules.of(rules)
    state, log, results, skipped = (dict(stored) if stored else None), [], [], {}
    said = SourceLog({} if history is None else history, now)

    def check(context: str, e: dict, incoming: dict, change: dict | None = None) -> None:
        action = rules.pre_merge(e["DataSource"], e["SourceEntityType"], context, {"incoming": incoming, "existing": state or {}, "change": change or {}})
        if action == "RejectMerge" or action == "SilentlyRejectMerge":
            raise Refused(REJECTED if action == "RejectMerge" else SILENT)
        if action is not None and not (action == "AllowMerge" and context == "ExistingEntityPreMerge"):
            raise ValueError(f"{action} is an invalid rule action")

    def create(e: dict, ident: dict, data: dict, changed: datetime) -> tuple[str, dict | None]:
        nonlocal state
        created = D.as_instant(e["Data"].get("createdOn"), required="createdOn")
        check("NewEntityPreMerge", e, data)
        check("UnmatchedEntityPreMerge", e, data)
        whole = D.strip_nulls(data)
        state = whole | {"id": e["EntityId"], "entityType": e["EntityType"], "createdOn": created.isoformat(), "lastUpdated": changed.isoformat(), "alternateKeys": merge_keys([own_key(e, now)], e["Data"].get("alternateKeys") or [])}
        said.add(source_of(e), ident, "Init", created, whole, whole)
        log.append({**ident, "EntryType": "Init", "Timestamp": created.isoformat(), "Data": whole})
        return CREATED, whole

    def meet(e: dict, ident: dict, data: dict, changed: datetime) -> tuple[str, dict | None]:
        """The first merge of a source."""
        nonlocal state
        check("NewEntityPreMerge", e, data)
        check("MatchedEntityPreMerge", e, data)
        started = D.as_instant(e["Data"].get("createdOn")) or changed
        before = D.as_instant(state.get("lastUpdated")) or D.as_instant(state.get("createdOn")) or FIRST_DATE
        own = D.strip_base(state)
        own.pop("alternateKeys", None)
        new = first_into(state, data, (before, changed), rules.properties(e["DataSource"], e["SourceEntityType"], "FirstTimeMerge"))
        kept = D.diff(own, new)
        candidate = dict(state) if kept is None else D.patched(state, kept)
        candidate["alternateKeys"] = merge_keys(state.get("alternateKeys") or [], [*(e["Data"].get("alternateKeys") or []), own_key(e, now)])
        candidate["lastUpdated"] = max(before, changed).isoformat()
        state, whole = candidate, D.strip_nulls(data)
        if not said.inits(source_of(e)):
            said.add(source_of(e), ident, "Init", min(started, changed), whole, whole)
        if kept is not None and tracked:
            log.append({**ident, "EntryType": "Update", "Timestamp": changed.isoformat(), "Data": kept})
        return (UPDATED if kept is not None else MATCHED), kept

    def update(e: dict, ident: dict, data: dict, changed: datetime) -> tuple[str, dict | None]:
        nonlocal state
        source, whole, change = source_of(e), None, None
        before = said.as_of(source, changed)
        own = D.strip_base(state)
        own.pop("alternateKeys", None)
        if before is not None:
            # omitted fields are unchanged, nulls delete; fields of a refused event count as unseen
            known = {k: v for k, v in before.items() if k not in skipped.get(source, ())}
            delta = D.diff(D.strip_nulls(known), D.strip_nulls(D.deep_merge(known, data)))
            whole = D.strip_nulls(D.deep_merge(before, data))
            change = D.diff(D.strip_nulls(before), whole)
            if changed < max(said.inits(source)):
                delta = None
        else:
            delta = D.diff(own, D.strip_nulls(D.deep_merge(own, data)))
            whole = D.strip_nulls(data)
        if delta is None:
            if before is None:
                said.add(source, ident, "Init", changed, whole, whole)
            return UNCHANGED, None

        def remember() -> None:
            if before is None:
                said.add(source, ident, "Init", changed, whole, whole)
            elif change is not None:
                said.add(source, ident, "Update", changed, change, whole)

        wanted = D.diff(own, D.patched(own, _retarget(own, delta)))
        try:
            check("ExistingEntityPreMerge", e, data, wanted)
        except Refused as refused:
            if refused.args[0] == SILENT:
                remember()
            skipped.setdefault(source, set()).update(delta)
            raise
        properties = rules.properties(e["DataSource"], e["SourceEntityType"], "MergeUpdatedEntity") or []
        kept = accept(state, wanted, properties, D.as_instant(state.get("lastUpdated")), changed) if wanted else None
        candidate = dict(state) if kept is None else D.patched(state, kept)
        held = (resolve_property_rule([r for r in properties if r["name"].lower() == "alternatekeys"], "alternateKeys") or {}).get("action")
        if held not in ("DoNotUpdate", "NeverOverwrite"):
            candidate["alternateKeys"] = merge_keys(state.get("alternateKeys") or [], [*(e["Data"].get("alternateKeys") or []), own_key(e, now)])
        candidate["lastUpdated"] = max(D.as_instant(state["lastUpdated"]), changed).isoformat()
        state = candidate
        remember()
        skipped.pop(source, None)
        if kept is not None and tracked:
            log.append({**ident, "EntryType": "Update", "Timestamp": changed.isoformat(), "Data": kept})
        return (UPDATED if kept is not None else UNCHANGED), kept

    for e in events:
        ident = {"DataSource": e["DataSource"], "SourceEntityType": e["SourceEntityType"], "SourceEntityId": e["SourceEntityId"]}
        try:
            changed = D.as_instant(e["Data"].get("lastUpdated"), required="lastUpdated")
            data = D.strip_base(e["Data"])
            data.pop("alternateKeys", None)
            step = create if state is None else update if has_key(state, own_key(e, now)) else meet
            outcome, what = step(e, ident, data, changed)
            results.append(ident | {"Outcome": outcome} | ({"Changed": sorted(what)} if what else {}))
        except Refused as refused:
            results.append(ident | {"Outcome": refused.args[0]})
        except ValueError as error:
            if isinstance(e.get("Data"), dict):
                skipped.setdefault(source_of(e), set()).update(D.strip_base(e["Data"]))
            results.append(ident | {"Outcome": FAILED, "Error": str(error)})
    return state, log, results


def fold_untracked(stored: dict | None, events: list[dict], rules: list[dict] | Rules, now: datetime) -> tuple[dict | None, list[dict]]:
    """The merge without history: the payload goes over the entity. Rules are chosen by exact case, the first that fits;
    of the property actions only OverwriteIfNewer, NeverOverwrite and DoNotUpdate hold anything back; base properties of the
    payload are dropped only where there is a rule, alternate keys stay as they are stored; nulls delete. A rejection is a
    failure, a silent one a rejection."""
    rules = Rules.of(rules)
    state, results = (dict(stored) if stored else None), []
    for e in events:
        ident = {"DataSource": e["DataSource"], "SourceEntityType": e["SourceEntityType"], "SourceEntityId": e["SourceEntityId"]}
        try:
            data, key = dict(e["Data"]), own_key(e, now)
            scope = {"incoming": data, "existing": state or {}, "change": {}}
            action = rules.pre_merge(e["DataSource"], e["SourceEntityType"], "NewEntityPreMerge" if state is None else "ExistingEntityPreMerge", scope)
            if action in ("RejectMerge", "SilentlyRejectMerge"):
                results.append(ident | ({"Outcome": FAILED, "Error": "Merge was rejected by pre-merge rules"} if action == "RejectMerge" else {"Outcome": REJECTED}))
                continue
            if state is None:
                created = D.as_instant(data.get("createdOn"), required="createdOn")
                state = D.strip_nulls(D.strip_base(data)) | {"id": e["EntityId"], "entityType": e["EntityType"], "createdOn": created.isoformat(), "lastUpdated": now.isoformat(), "alternateKeys": merge_keys([key], data.get("alternateKeys") or [])}
                results.append(ident | {"Outcome": CREATED})
                continue
            properties = rules.properties(e["DataSource"], e["SourceEntityType"], "MergeUpdatedEntity", exact=True)
            if properties is not None:
                for path in D.leaves(data):
                    action = (resolve_property_rule(properties, path) or {}).get("action")
                    late = action == "OverwriteIfNewer" and D.as_instant(state.get("lastUpdated"), required="lastUpdated") > D.as_instant(e["Data"].get("lastUpdated"), required="lastUpdated")
                    allows(action, 1, 1, None, None)  # an unknown action fails the event
                    if late or action in ("NeverOverwrite", "DoNotUpdate"):
                        D.remove_path(data, path)
                data = D.strip_base(data)
            keys = [k | {"LastMerge": now.isoformat()} if k["Key"] == key["Key"] else k for k in state.get("alternateKeys") or []]
            if not has_key(state, key):
                keys = merge_keys(keys, [key])
            state = D.strip_nulls(D.deep_merge(state, data)) | {"id": state["id"], "entityType": e["EntityType"], "alternateKeys": keys, "lastUpdated": now.isoformat()}
            results.append(ident | {"Outcome": UPDATED})
        except ValueError as error:
            results.append(ident | {"Outcome": FAILED, "Error": str(error)})
    return state, results


def _retarget(base: Any, delta: Any) -> Any:
    """A delta that was made against another base: additions and changes put their new value, deletions delete what is there."""
    out = {}
    for k, d in delta.items():
        here = base.get(k, D.MISSING) if isinstance(base, dict) else D.MISSING
        if isinstance(d, dict):
            inner = _retarget(here if isinstance(here, dict) else {}, d)
            if isinstance(here, dict):
                out[k] = inner
            elif inner:
                out[k] = [D.patched({}, {n: x if isinstance(x, list) else [D.patched({}, x)] for n, x in inner.items()})]
        elif len(d) == 3:
            if here is not D.MISSING:
                out[k] = [here, 0, 0]
        else:
            out[k] = [d[-1]] if here is D.MISSING else [here, d[-1]]
    return out


def merge_batch(requests: DataFrame, stored: DataFrame, rules: list[dict] | Rules, now: datetime, tracked: bool = True, history: DataFrame | None = None) -> DataFrame:
    """requests (EntityId, EntityType, DataSource, SourceEntityType, SourceEntityId, ts, ord, Data JSON), resolved to golden
    ids; stored (EntityId, doc JSON); history (EntityId, entry JSON), the log entries of the sources, in the order of replay
    -> tagged rows: EntityId, kind (entity, log, source, result), payload JSON; a source row is a new log entry of a source.

    One shuffle by EntityId brings events and entity together; the fold then writes an entity once for the whole batch."""

    def fold(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left.sort_values(["ts", "ord"], kind="stable", na_position="last")
        events = [r | {"Data": json.loads(r["Data"])} for r in left.to_dict("records")]
        docs, past = right["doc"].dropna(), defaultdict(list)
        doc = json.loads(docs.iloc[0]) if len(docs) else None
        for entry in map(json.loads, right["entry"].dropna()):
            past[source_of(entry)].append(entry | {"Data": json.loads(entry["Data"])})
        for entries in past.values():
            entries.sort(key=lambda x: (D.as_instant(x["Timestamp"]), x["_ts"] or 2**63 - 1, x["id"]))
        old = {id(x) for entries in past.values() for x in entries}
        if not events:
            return pd.DataFrame({"EntityId": [], "kind": [], "payload": []}, dtype=str)
        if tracked:
            entity, log, results = fold_entity(doc, events, rules, now, tracked, past)
        else:
            (entity, results), log = fold_untracked(doc, events, rules, now), []
        rows = [("entity", entity)] if entity is not None and entity != doc else []
        rows += [("log", x) for x in log] + [("result", x) for x in results]
        if tracked:
            rows += [("source", x) for entries in past.values() for x in entries if id(x) not in old]
        return pd.DataFrame([{"EntityId": key[0], "kind": k, "payload": D.canonical(p)} for k, p in rows])

    none = F.lit(None).cast("string")
    stored = stored.join(requests.select("EntityId").distinct(), "EntityId", "left_semi").select("EntityId", "doc", none.alias("entry"))
    if history is not None:
        stored = stored.unionByName(history.select("EntityId", none.alias("doc"), "entry"))
    return requests.groupBy("EntityId").cogroup(stored.groupBy("EntityId")).applyInPandas(fold, "EntityId string, kind string, payload string")


def failure_log(previous: DataFrame, results: DataFrame, key: list[str]) -> DataFrame:
    """Latest state: rows of sources in the batch go, its failures come; successes write nothing."""
    return previous.join(results.select(*key).distinct(), key, "left_anti").unionByName(results.where(F.col("Outcome").isin(*FAILURES)).select(*previous.columns))


def notifications(results: DataFrame) -> DataFrame:
    """Created, Updated (with the changed top-level paths, where results have them) and Failure; other outcomes give none."""
    return results.select("*", F.when(F.col("Outcome") == CREATED, "Created").when(F.col("Outcome") == UPDATED, "Updated").when(F.col("Outcome").isin(*FAILURES), "Failure").alias("Notification")).where("Notification is not null")
