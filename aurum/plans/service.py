"""The engine as one object over a Store: what clients and the command line ask for, also as request envelopes.

Tables: entities (id, entityType, createdOn, lastUpdated, alternateKeys, doc), log (change entries), failures, markers, jobs,
duplicates, promises, sequences. A request's writes follow the order history, entities, failures; each replaces a table whole."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections import Counter
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import documents as D
from ..operators import history as H, lifecycle as L, merge as M, query as Q, references as P, resolve as R, writes as X
from ..operators.rules import Rules
from ..sources.store import Store
from .requests import dispatch, handles

SCHEMAS = {
    "entities": "id string, entityType string, createdOn timestamp, lastUpdated timestamp, alternateKeys array<struct<Key:string,Value:string>>, doc string",
    "log": "DataSource string, EntityType string, EntityId string, id string, EntryType string, Timestamp timestamp, _ts long, Data string",
    "failures": "DataSource string, SourceEntityType string, SourceEntityId string, Outcome string, Error string",
    "markers": "DataSource string, EntityType string, Value string, _ts long",
    "jobs": "id string, type string, payload string, status string, completed_on timestamp",
    "duplicates": "id string, entity_id string, duplicate_id string, status string",
    "promises": P.PROMISES,
    "events": "kind string, DataSource string, EntityType string, EntityId string, Outcome string, Error string, at timestamp",
    "users": "user string, tenant string, object_id string, upn string, roles array<string>",
    "roles": "role string, permissions array<string>",
    "sequences": "name string, prefix string, suffix string, padding int, start_at long, increment_by long, current_value long",
}
HUB = "Golden"
BUILT_IN = {"Administrator": ["Admin", "Merge", "Read", "Write"], "Reader": ["Read"]}
PERMISSIONS = {"Admin", "Merge", "Read", "Write"}
AGENT = "DataMaintenanceAgent"


class Service:
    def __init__(self, spark: SparkSession, root: str, clock=lambda: datetime.now(timezone.utc), notify: Callable[[DataFrame], None] | None = None):
        """notify gets the notifications of each request as a DataFrame; None: no service listens, which is fine."""
        self.spark, self.store, self.clock, self.notify = spark, Store(spark, root), clock, notify
        self.counters: Counter[str] = Counter()
        self._batches: list[str] = []

    def table(self, name: str) -> DataFrame:
        return self.store.read(name) if self.store.exists(name) else self.spark.createDataFrame([], SCHEMAS[name])

    # queries

    def entities_where(self, **query: Any) -> DataFrame:
        return Q.entities_where(self.table("entities"), **query)

    def entities_by_id(self, entity_type: str, ids: list[str]) -> DataFrame:
        return Q.by_ids(self.table("entities").where(F.col("entityType") == entity_type), self.spark.createDataFrame([(i,) for i in ids], "id string"))

    def entities_by_alternate_keys(self, keys: list[tuple[str, str]]) -> DataFrame:
        return Q.by_alternate_keys(self.table("entities"), self.spark.createDataFrame(keys, "Key string, Value string"))

    def updated_since(self, entity_type: str, since: datetime) -> DataFrame:
        return Q.updated_since(self.table("entities").where(F.col("entityType") == entity_type), F.lit(since))

    def type_counts(self, where: str | None = None) -> DataFrame:
        rows = self.table("entities")
        return Q.type_counts(rows.where(where) if where else rows)

    def tracked(self, ids: list[str], as_of: datetime | None = None) -> DataFrame:
        return H.replay_documents(self.table("log").where((F.col("DataSource") == HUB) & F.col("EntityId").isin(ids)), as_of)

    def entities_count(self, where: str | None = None, parameters: dict[str, Any] | None = None) -> int:
        return Q.total_count(self.table("entities"), where, parameters).first()[0]

    def entity(self, ident: str) -> dict[str, Any] | None:
        """Point read by id."""
        row = self.table("entities").where(F.col("id") == ident).limit(1).first()
        return None if row is None else json.loads(row["doc"])

    def tracking(self, where: str | None = None, order_by: str | None = "Timestamp", page_size: int = 100, token: str | None = None, parameters: dict[str, Any] | None = None, **filters: Any) -> DataFrame:
        """Change entries by filters (data_source, entity_type, since, until, ids) and free text on alias x, page by page."""
        return Q.entities_where(L.tracking(self.table("log"), **filters), where, None, order_by, page_size, token, parameters)

    def tracking_by_id(self, ids: list[str]) -> DataFrame:
        return Q.by_ids(self.table("log"), self.spark.createDataFrame([(i,) for i in ids], "id string"))

    def tracking_of(self, data_source: str, entity_type: str, entity_id: str) -> DataFrame:
        return L.tracking(self.table("log"), data_source, entity_type, ids=[entity_id])

    def log_where(self, kind: str, where: str | None = None, properties: list[str] = ()) -> DataFrame:
        """Typed log entries (MergeFailure, SyncFailure, PatchFailure, Alert, ...); x.<property> reads the entry's data."""
        data = [c for c in ("DataSource", "EntityType", "EntityId", "Outcome", "Error") if not properties or c in properties]
        rows = self.table("events").select(F.sha2(F.concat_ws("|", "kind", "DataSource", "EntityType", "EntityId"), 256).alias("id"), F.col("kind").alias("Type"), "at", F.struct(*data).alias("Data"))
        return Q.log_where(rows, kind, where, data)

    # merge

    def merge(self, requests: DataFrame, rules: list[dict] | Rules, same_as: list[str] = (), tracked: bool = True) -> DataFrame:
        """requests (DataSource, SourceEntityType, SourceEntityId, EntityType, Data JSON, ord) -> results (EntityId, source, Outcome, Error, Changed).

        A source id is resolved by its alternate key; an unknown one joins the latest created entity, stored or new in this
        batch, that agrees in all paths of `same_as` (text without case) and has no key of that source type, else it becomes
        a new entity. Different ids of one source type that lead to one entity all fail. Untracked merges keep no history
        and no failure log."""
        now, entities = self.clock(), self.table("entities")
        requests = requests.withColumn("Key", R.source_key(F.col("DataSource"), F.col("SourceEntityType"))).withColumn("Value", F.col("SourceEntityId"))
        keys = entities.select("entityType", F.col("id").alias("EntityId"), F.explode("alternateKeys").alias("k")).select(F.col("entityType").alias("EntityType"), F.col("k.Key").alias("Key"), F.col("k.Value").alias("Value"), "EntityId")
        known = R.resolve_references(requests, keys)
        source = F.concat_ws("|", "EntityType", "Key", "Value")
        rows = requests.join(known, ["EntityType", "Key", "Value"]).withColumn("source", source)
        rows = self._kept(rows.withColumn("fresh", F.substring(F.sha2("source", 256), 1, 32)).withColumn("ts", F.try_to_timestamp(F.get_json_object("Data", "$.lastUpdated"))))
        matched = R.match_sources(rows.where("resolved is null"), entities, list(same_as)) if same_as else self.spark.createDataFrame([], "source string, match string")
        rows = rows.join(matched, "source", "left").withColumn("EntityId", F.coalesce("resolved", "match", "fresh"))
        # different ids of one source type cannot both be one entity
        clash = rows.where("resolved is not null").groupBy("EntityId", "Key").agg(F.count_distinct("Value").alias("n")).where("n > 1").select("EntityId", "Key", F.lit(True).alias("clash"))
        rows = rows.join(clash, ["EntityId", "Key"], "left").withColumn("problem", F.when(F.col("matches") > 1, "several entities have this alternate key").when(F.col("clash"), "several source entities lead to this entity"))
        rows = self._kept(rows)
        ready = rows.where("problem is null").select("EntityId", "EntityType", "DataSource", "SourceEntityType", "SourceEntityId", "ts", "ord", "Data")
        out = M.merge_batch(ready, entities.select(F.col("id").alias("EntityId"), "doc"), rules, now, tracked, self.source_history(ready) if tracked else None)
        out = self._kept(out)
        part = lambda kind, schema: out.where(F.col("kind") == kind).select("EntityId", F.from_json("payload", schema).alias("p"), "payload")
        results = part("result", "DataSource string, SourceEntityType string, SourceEntityId string, Outcome string, Error string, Changed array<string>").select("EntityId", "p.*")
        twice = rows.where("problem is not null").select("EntityId", "DataSource", "SourceEntityType", "SourceEntityId", F.lit(M.FAILED).alias("Outcome"), F.col("problem").alias("Error"), F.lit(None).cast("array<string>").alias("Changed"))
        results = self._kept(results.unionByName(twice), "result")
        golden = part("entity", "id string, entityType string, createdOn timestamp, lastUpdated timestamp, alternateKeys array<struct<Key:string,Value:string>>").select("p.*", F.col("payload").alias("doc"))
        if tracked:
            entry = "DataSource string, SourceEntityType string, SourceEntityId string, EntryType string, Timestamp timestamp, _ts long"
            log, said = (part(kind, entry).withColumn("Data", F.get_json_object("payload", "$.Data")) for kind in ("log", "source"))
            types = golden.select(F.col("id").alias("EntityId"), F.col("entityType").alias("GoldenType"))
            ident = F.sha2("payload", 256)
            source = said.select("p.DataSource", F.col("p.SourceEntityType").alias("EntityType"), F.col("p.SourceEntityId").alias("EntityId"), ident.alias("id"), "p.EntryType", "p.Timestamp", "p._ts", "Data")
            hub = log.join(types, "EntityId").select(F.lit(HUB).alias("DataSource"), F.col("GoldenType").alias("EntityType"), "EntityId", F.sha2(F.concat(F.lit("hub"), "payload"), 256).alias("id"), "p.EntryType", "p.Timestamp", F.lit(0).cast("long").alias("_ts"), "Data")
            self.store.append("log", source.unionByName(hub))
        self.store.replace("entities", X.upsert(entities, golden, ["id"]))
        if tracked:
            self.store.replace("failures", M.failure_log(self.table("failures"), results, ["DataSource", "SourceEntityType", "SourceEntityId"]))
        if self.notify is not None:
            self.notify(M.notifications(results))
        self._swept()
        return results

    def source_history(self, requests: DataFrame) -> DataFrame:
        """(EntityId, entry JSON): the log entries of the sources of requests, with the golden id that each request goes to."""
        log = self.table("log").where(F.col("DataSource") != HUB).withColumnRenamed("EntityType", "SourceEntityType").withColumnRenamed("EntityId", "SourceEntityId")
        log = log.select(F.lower("DataSource").alias("ds"), F.lower("SourceEntityType").alias("st"), "SourceEntityId", F.to_json(F.struct("DataSource", "SourceEntityType", "SourceEntityId", "EntryType", F.date_format("Timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("Timestamp"), F.coalesce("_ts", F.lit(0)).alias("_ts"), "id", "Data")).alias("entry"))
        wanted = requests.select("EntityId", F.lower("DataSource").alias("ds"), F.lower("SourceEntityType").alias("st"), "SourceEntityId").distinct()
        return wanted.join(log, ["ds", "st", "SourceEntityId"]).select("EntityId", "entry")

    def _kept(self, rows: DataFrame, name: str = "batch") -> DataFrame:
        """Written once, so that a batch's outputs all come from one run of the fold."""
        path = f"{self.store.root}/.{name}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        if name == "batch":
            self._batches.append(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _swept(self) -> None:
        """Deletes what a finished request kept for itself; results that a caller may still read stay until close()."""
        while self._batches:
            self.store.discard(self._batches.pop())

    def close(self) -> None:
        """Deletes the kept results of all requests."""
        self._swept()
        for status in self.store.fs.globStatus(self.store.path(f"{self.store.root}/.result-*")) or []:
            self.store.fs.delete(status.getPath(), True)

    # changes

    def patch_where(self, entity_type: str, where: str, operations: list[dict], dry_run: bool = False) -> DataFrame:
        entities = self.table("entities")
        target = entities.where(F.col("entityType") == entity_type).where(where)
        done = self._kept(X.patch_documents(target, operations), "result")
        if not dry_run:
            now = F.lit(self.clock())
            changed = entities.drop("doc").join(done.where("delta is not null").select("id", "doc"), "id").withColumn("lastUpdated", now).select(*entities.columns)
            new = self._kept(X.upsert(entities, changed, ["id"]))
            log = changed.join(done.select("id", "delta"), "id").select(F.lit(HUB).alias("DataSource"), F.col("entityType").alias("EntityType"), F.col("id").alias("EntityId"), F.sha2(F.concat_ws("|", "id", "delta", now.cast("string")), 256).alias("eid"), F.lit("Update").alias("EntryType"), now.alias("Timestamp"), F.lit(0).cast("long").alias("_ts"), F.col("delta").alias("Data")).withColumnRenamed("eid", "id")
            self.store.append("log", self._kept(log))
            self.store.replace("entities", new)
        self._swept()
        return done

    def delete(self, ids: list[str], cascade: bool = False) -> DataFrame:
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id string")
        left, missing = X.delete_entities(self.table("entities"), wanted, "id")
        missing = self._kept(missing, "result")
        self.store.replace("entities", left)
        if cascade:
            gone = wanted.join(missing, "id", "left_anti").select(F.col("id").alias("EntityId")).withColumn("DataSource", F.lit(HUB))
            self.store.replace("log", self.table("log").join(gone, ["DataSource", "EntityId"], "left_anti").select(*self.table("log").columns))
        return missing

    def revert(self, ids: list[str], to: datetime | str, dry_run: bool = False) -> DataFrame:
        log = self.table("log").where((F.col("DataSource") == HUB) & F.col("EntityId").isin(ids))
        done = self._kept(H.revert_documents(log, to, self.clock(), dry_run, HUB), "result")
        if not dry_run:
            self.store.append("log", done.where("written").select("DataSource", "EntityType", "EntityId", F.sha2(F.concat_ws("|", "EntityId", "Data", F.col("Timestamp").cast("string")), 256).alias("id"), "EntryType", "Timestamp", F.lit(0).cast("long").alias("_ts"), "Data"))
            self.materialise(ids)
        return done

    def materialise(self, ids: list[str]) -> None:
        """Entities anew from their history."""
        entities, states = self.table("entities"), self.tracked(ids).where("error is null")
        at = F.to_timestamp(F.get_json_object("state", "$.lastUpdated"))
        fresh = entities.drop("doc", "lastUpdated").join(states.select(F.col("EntityId").alias("id"), F.col("state").alias("doc"), at.alias("lastUpdated")), "id").select(*entities.columns)
        self.store.replace("entities", self._kept(X.upsert(entities, fresh, ["id"])))

    def rebase(self, to: datetime) -> DataFrame:
        """Compacts golden histories; returns counts of actions."""
        log = self.table("log")
        stored = self.table("entities").select(F.col("id").alias("EntityId"), "doc", "lastUpdated")
        new = self._kept(H.rebase_documents(log.where(F.col("DataSource") == HUB), to, stored), "result")
        rest = log.where(F.col("DataSource") != HUB)
        self.store.replace("log", self._kept(rest.unionByName(new.select(*log.columns))))
        return new.groupBy("action").count()

    def _write(self, new: DataFrame, log: DataFrame | None) -> None:
        """Rows of the log, then new rows of entities in place of the old ones."""
        if log is not None:
            self.store.append("log", self._kept(log.select(*self.table("log").columns)))
        self.store.replace("entities", self._kept(X.upsert(self.table("entities"), new.select(*self.table("entities").columns), ["id"])))
        self._swept()

    def _as_rows(self, docs: DataFrame) -> DataFrame:
        """docs (id, entityType, doc) as rows of entities; createdOn and lastUpdated default to now."""
        at = lambda p: F.coalesce(F.try_to_timestamp(F.get_json_object("doc", f"$.{p}")), F.lit(self.clock()))
        keys = F.coalesce(F.from_json(F.get_json_object("doc", "$.alternateKeys"), "array<struct<Key:string,Value:string>>"), F.array().cast("array<struct<Key:string,Value:string>>"))
        return docs.select("id", "entityType", at("createdOn").alias("createdOn"), at("lastUpdated").alias("lastUpdated"), keys.alias("alternateKeys"), "doc")

    def _entry(self, rows: DataFrame, kind: str, data: Column, at: Column) -> DataFrame:
        """A log entry of each golden row (id, entityType)."""
        entry = rows.select(F.lit(HUB).alias("DataSource"), F.col("entityType").alias("EntityType"), F.col("id").alias("EntityId"), F.lit(kind).alias("EntryType"), at.alias("Timestamp"), F.lit(0).cast("long").alias("_ts"), data.alias("Data"))
        return entry.withColumn("id", F.sha2(F.concat_ws("|", "EntityId", "EntryType", F.col("Timestamp").cast("string"), "Data"), 256)).select(*self.table("log").columns)

    def create(self, docs: DataFrame) -> DataFrame:
        """docs (id, entityType, doc) -> id, error. An entity that has a history exists, whether it is stored or not."""
        tracked = self.table("log").where(F.col("DataSource") == HUB).select(F.col("EntityId").alias("id"))
        done = self._kept(X.create_only(docs.dropDuplicates(["id"]), tracked, ["id"]), "result")
        new = self._kept(self._as_rows(done.where("error is null")))
        self._write(new, self._entry(new, "Init", F.col("doc"), F.col("createdOn")))
        return done.select("id", "error")

    def update(self, updates: DataFrame, update_type: str = "update", update_only: bool = True) -> DataFrame:
        """updates (id, entityType, payload) -> id, doc, delta, error: deep merge, arrays replaced; 'patch' passes nulls by.
        An unknown id is an error, or is created if update_only is false."""
        entities = self.table("entities")
        done = self._kept(X.update_documents(entities, updates.select("id", "payload"), patch=update_type == "patch"), "result")
        now = F.lit(self.clock())
        changed = self._kept(entities.drop("doc").join(done.where("delta is not null").select("id", "doc", "delta"), "id").withColumn("lastUpdated", now))
        log, rows = self._entry(changed, "Update", F.col("delta"), now), changed.select(*entities.columns)
        if not update_only:
            new = self._as_rows(done.where("error is not null").select("id").join(updates, "id").select("id", "entityType", F.col("payload").alias("doc")))
            rows, log = rows.unionByName(new), log.unionByName(self._entry(new, "Init", F.col("doc"), F.col("createdOn")))
        self._write(rows, log)
        return done

    def update_untracked(self, docs: DataFrame, create_if_missing: bool = True, silent: bool = False) -> None:
        """docs (id, entityType, doc) replace the stored documents whole; silent keeps lastUpdated."""
        entities = self.table("entities")
        new = self._as_rows(docs)
        old = entities.select("id", F.col("lastUpdated").alias("before"))
        new = new.join(old, "id", "left" if create_if_missing else "inner")
        stamp = F.when(F.col("before").isNotNull() & F.lit(silent), F.col("before")).otherwise(F.lit(self.clock()))
        self._write(self._kept(new.withColumn("lastUpdated", stamp).drop("before")), None)

    def patch(self, patches: DataFrame, operations: list[dict], silent: bool = False) -> DataFrame:
        """patches (id) of any number -> id, doc, delta, errors; ids that are not there come back as ENTITY_NOT_FOUND. Entities
        without a history get no log entry."""
        entities = self.table("entities")
        target = entities.join(patches.select("id").distinct(), "id", "left_semi")
        done = X.patch_documents(target, operations)
        missing = patches.select("id").distinct().join(entities, "id", "left_anti").select("id", F.lit(None).cast("string").alias("doc"), F.lit(None).cast("string").alias("delta"), F.array(F.lit("ENTITY_NOT_FOUND")).alias("errors"))
        done = self._kept(done.unionByName(missing), "result")
        now = F.lit(self.clock())
        changed = entities.drop("doc").join(done.where("delta is not null").select("id", "doc", "delta"), "id")
        changed = self._kept(changed if silent else changed.withColumn("lastUpdated", now))
        tracked = self.table("log").where(F.col("DataSource") == HUB).select(F.col("EntityId").alias("id")).distinct()
        self._write(changed.select(*entities.columns), self._entry(changed.join(tracked, "id", "left_semi"), "Update", F.col("delta"), now))
        return done

    def import_entities(self, docs: DataFrame, overwrite: bool = False, untracked: bool = False, silent: bool = False) -> DataFrame:
        """docs (id, entityType, doc, overwrite boolean) -> id, error. Rows without id or type, and documents that are no JSON
        object, are failures and the others are imported. Known ids are replaced only if both flags say so; an import is
        an Init of its own unless untracked; silent keeps lastUpdated of replaced ones."""
        entities = self.table("entities")
        bad = F.when(F.col("id").isNull() | F.col("entityType").isNull(), "id and entityType are required").when(F.from_json("doc", "map<string,string>").isNull(), "the document is no JSON object")
        rows = self._kept(docs.withColumn("error", bad), "result")
        good = self._as_rows(rows.where("error is null").select("id", "entityType", "doc")).join(rows.where("error is null").select("id", "overwrite"), "id").dropDuplicates(["id"])
        good = good.join(entities.select("id", F.col("lastUpdated").alias("before")), "id", "left")
        good = self._kept(good.where(F.col("before").isNull() | (F.lit(overwrite) & F.col("overwrite"))).withColumn("lastUpdated", F.coalesce("before", "lastUpdated") if silent else F.col("lastUpdated")))
        self._write(good, None if untracked else self._entry(good, "Init", F.col("doc"), F.coalesce("before", "createdOn")))
        return rows.select("id", "error")

    def delete_tracking(self, data_source: str, ids: list[str]) -> None:
        """All change entries of source entities."""
        log = self.table("log")
        self.store.replace("log", self._kept(log.where(~((F.col("DataSource") == data_source) & F.col("EntityId").isin(ids)))))
        self._swept()

    def delete_where(self, table: str, where: str, parameters: dict[str, Any] | None = None) -> int:
        """Rows of a management table that fit go, in one rewrite; how many they were."""
        if table not in ("failures", "markers", "jobs", "duplicates", "promises", "events"):
            raise ValueError(f"{table} cannot be deleted from")
        rows = self.table(table)
        left = self._kept(self.spark.sql(f"SELECT x.* FROM {{rows}} x WHERE NOT coalesce(({where}), false)", args=parameters or {}, rows=rows))
        n = rows.count() - left.count()
        self.store.replace(table, left)
        self._swept()
        return n

    def register_key(self, ident: str, key: str, value: str, replace: bool = False, replace_same_source: bool = False) -> bool:
        """Adds an alternate key; false if nothing changes."""
        return self._rekey([ident], X.register_key(F.col("alternateKeys"), F.lit(key), F.lit(value), replace, replace_same_source)) > 0

    def detach(self, ids: list[str], data_source: str) -> int:
        """Entities lose the alternate keys of a data source; how many did."""
        return self._rekey(ids, X.detach(F.col("alternateKeys"), data_source))

    def _rekey(self, ids: list[str], keys: Column) -> int:
        entities = self.table("entities")
        rows = entities.where(F.col("id").isin(ids)).withColumn("old", F.to_json("alternateKeys")).withColumn("alternateKeys", keys).withColumn("new", F.to_json("alternateKeys")).where("old != new")
        keyed = rows.withColumn("delta", F.concat(F.lit('{"alternateKeys":['), "old", F.lit(","), "new", F.lit("]}")))

        def put(batches):
            for part in batches:
                docs = [D.canonical(json.loads(d) | {"alternateKeys": json.loads(k)}) for d, k in zip(part["doc"], part["new"], strict=True)]
                yield part[["id", "delta"]].assign(doc=docs)

        done = self._kept(keyed.select("id", "delta", "doc", "new").mapInPandas(put, "id string, delta string, doc string"))
        now = F.lit(self.clock())
        changed = self._kept(rows.select("id", "entityType", "createdOn", "alternateKeys").join(done, "id").withColumn("lastUpdated", now))
        n = changed.count()
        self._write(changed.select(*entities.columns), self._entry(changed, "Update", F.col("delta"), now))
        return n

    def split(self, ident: str, key: str, value: str, dry_run: bool = False, silent: bool = False) -> dict[str, Any]:
        """Splits an alternate key off into a copy of the entity with a copy of its history: {"id"} or {"error"}."""
        entities = self.table("entities")
        if problem := L.split_problem(entities, ident, key, value):
            return {"error": problem}
        new_id = hashlib.sha256(f"{ident}|{key}|{value}".encode()).hexdigest()[:32]
        if dry_run:
            return {"id": new_id}
        log = self.table("log").where(F.col("DataSource") == HUB)
        history = self._kept(L.split_history(log, ident, new_id, {"Key": key, "Value": value}))
        row = entities.where(F.col("id") == ident).first()
        doc, stamp = json.loads(row["doc"]), row["lastUpdated"] if silent else self.clock()
        keys = doc.get("alternateKeys") or []
        stay = [k for k in keys if not (k["Key"] == key and k["Value"] == value)]
        gone = [k for k in keys if k["Key"] == key and k["Value"] == value]
        pair = [(ident, row["entityType"], row["createdOn"], stamp, stay), (new_id, row["entityType"], row["createdOn"], self.clock(), gone)]
        rows = self.spark.createDataFrame([(i, t, c, u, [(k["Key"], k["Value"]) for k in ks], D.canonical(doc | {"id": i, "alternateKeys": ks})) for i, t, c, u, ks in pair], SCHEMAS["entities"])
        if not silent:
            change = self._entry(rows.where(F.col("id") == ident), "Update", F.lit(D.canonical({"alternateKeys": [keys, stay]})), F.lit(self.clock()))
            history = history.unionByName(change)
        self._write(rows, history)
        return {"id": new_id}

    def rebase_sources(self, wanted: DataFrame, to: datetime) -> DataFrame:
        """Compacts histories of sources (DataSource, EntityType, EntityId); what could not be found or was ambiguous, with code."""
        new, codes = L.rebase_sources(self.table("log"), wanted, to)
        new, codes = self._kept(new), self._kept(codes, "result")
        partial = new.where("code is not null").select(*L.IDENT, "code").distinct()
        out = self._kept(codes.where("code is not null").unionByName(partial), "result")
        self.store.replace("log", new.select(*self.table("log").columns))
        self._swept()
        return out

    def record_sync(self, events: DataFrame) -> None:
        """events (id, Key, Value, synced, error): outcomes of writing entities to a system, kept at their alternate keys."""
        entities = self.table("entities")
        marked = L.record_sync(entities.join(events.select("id").distinct(), "id", "left_semi"), events).select("id", F.to_json("alternateKeys").alias("keys"))

        def put(batches):
            for part in batches:
                docs = []
                for doc, keys in zip(part["doc"], part["keys"], strict=True):
                    doc, fresh = json.loads(doc), json.loads(keys)
                    old = {(k["Key"], k["Value"]): k for k in doc.get("alternateKeys") or []}
                    docs.append(D.canonical(doc | {"alternateKeys": [old.get((k["Key"], k["Value"]), {}) | k for k in fresh]}))
                yield part[["id"]].assign(doc=docs)

        done = self._kept(entities.select("id", "doc").join(marked, "id").mapInPandas(put, "id string, doc string"))
        keys = F.from_json(F.get_json_object("doc", "$.alternateKeys"), "array<struct<Key:string,Value:string>>")
        self._write(entities.drop("doc", "alternateKeys").join(done, "id").withColumn("alternateKeys", keys), None)

    # references

    def resolve_references(self, ids: list[str] | None = None) -> DataFrame:
        """Replaces references whose target is known, promises the others; returns those that several entities answer to."""
        entities = self.table("entities")
        some = entities if ids is None else entities.where(F.col("id").isin(ids))
        changed, promises, failures = P.resolve_documents(some, entities)
        failures = self._kept(failures, "result")
        promises = self._kept(X.upsert(self.table("promises"), promises, ["promise"]))
        rows, log = P.as_updates(self._kept(changed), entities, HUB, self.clock())
        rows = self._kept(rows)
        self.store.replace("promises", promises)
        self._write(rows, log)
        return failures

    def settle_promises(self, dry_run: bool = False, stop_on_failure: bool = False) -> DataFrame:
        """(promise, status, ...) of all promises; resolved and stale ones are done with and go."""
        entities, promises = self.table("entities"), self.table("promises")
        settled, changed = P.settle(promises, entities)
        settled = self._kept(settled, "result")
        if stop_on_failure and settled.where("status = 'Failed'").take(1):
            raise ValueError("several entities answer to a promised reference")
        if not dry_run:
            rows, log = P.as_updates(self._kept(changed), entities, HUB, self.clock())
            left = self._kept(promises.join(settled.where("status in ('Resolved', 'Stale')").select("promise"), "promise", "left_anti").select(*promises.columns))
            rows = self._kept(rows)
            self.store.replace("promises", left)
            self._write(rows, log)
        return settled

    def promises(self, where: str | None = None, page_size: int = 100, token: str | None = None) -> DataFrame:
        return Q.entities_where(self.table("promises"), where, None, None, page_size, token, None, "promise")

    def patch_promise(self, promise: str, operations: list[dict]) -> None:
        rows = self.table("promises")
        new = P.patch_promises(rows.where(F.col("promise") == promise), operations)
        self.store.replace("promises", self._kept(X.upsert(rows, new, ["promise"])))
        self._swept()

    def delete_promises(self, promises: list[str]) -> int:
        """One that is not there counts as deleted."""
        self.store.replace("promises", self._kept(self.table("promises").where(~F.col("promise").isin(promises))))
        self._swept()
        return len(set(promises))

    # events, users and readiness

    def register_events(self, kind: str, events: DataFrame) -> None:
        """events (DataSource, EntityType, EntityId, Outcome, Error): the last word of each entity and kind stays; successes
        (Outcome 'Success') only clear what was there."""
        key = ["kind", "DataSource", "EntityType", "EntityId"]
        new = events.select(F.lit(kind).alias("kind"), "DataSource", "EntityType", "EntityId", "Outcome", "Error", F.lit(self.clock()).alias("at")).dropDuplicates(key)
        left = self.table("events").join(new.select(*key), key, "left_anti").unionByName(new.where("Outcome != 'Success'"))
        self.store.replace("events", self._kept(left.select(*[c.split()[0] for c in SCHEMAS["events"].split(", ")])))
        self._swept()

    def register_role(self, role: str, permissions: list[str]) -> str | None:
        """The error, or None."""
        if role in BUILT_IN:
            return "BUILT_IN_ROLE"
        if set(permissions) - PERMISSIONS:
            return "UNKNOWN_PERMISSION"
        if self.table("roles").where(F.col("role") == role).take(1):
            return "ROLE_EXISTS"
        self.store.replace("roles", self._kept(self.table("roles").unionByName(self.spark.createDataFrame([(role, permissions)], SCHEMAS["roles"]))))
        self._swept()
        return None

    def register_user(self, user: str, tenant: str, object_id: str | None, upn: str | None, roles: list[str]) -> None:
        row = self.spark.createDataFrame([(user, tenant, object_id, upn, roles)], SCHEMAS["users"])
        self.store.replace("users", self._kept(X.upsert(self.table("users"), row, ["user"])))
        self._swept()

    def user(self, tenant: str, object_id: str | None = None, upn: str | None = None) -> dict[str, Any] | None:
        """By tenant and object id, else by tenant and name without case; with the permissions of the user's roles (None if
        a role is unknown). Several matches are an error."""
        mine = self.table("users").where(F.col("tenant") == tenant)
        for test in (F.col("object_id") == object_id, F.lower("upn") == (upn or "").lower()):
            found = mine.where(test).limit(2).collect()
            if len(found) > 1:
                raise ValueError("MATCHED_MULTIPLE_USERS")
            if found:
                known = BUILT_IN | {r["role"]: r["permissions"] for r in self.table("roles").where(F.col("role").isin(found[0]["roles"])).collect()}
                granted = [known.get(r) for r in found[0]["roles"]]
                return found[0].asDict() | {"permissions": None if None in granted else sorted({p for g in granted for p in g})}
        return None

    def ready(self) -> dict[str, Any]:
        """Whether the store answers, and the counters of requests."""
        try:
            self.table("entities").limit(1).count()
            return {"Ready": True, **self.counters}
        except Exception as error:  # readiness reports every failure
            return {"Ready": False, "Error": str(error), **self.counters}

    def enqueue(self, kind: str, payload: dict[str, Any]) -> str:
        """MergeEntities or SyncEntities for the maintenance agent: only a job."""
        return self.submit_job(f"{AGENT}:{kind}", json.dumps(payload))

    # management

    def set_marker(self, data_source: str, entity_type: str, value: str) -> None:
        row = self.spark.createDataFrame([(data_source, entity_type, value, int(self.clock().timestamp()))], SCHEMAS["markers"])
        self.store.replace("markers", self._kept(X.upsert(self.table("markers"), row, ["DataSource", "EntityType"])))

    def marker(self, data_source: str, entity_type: str, default: str | None = None) -> str | None:
        rows = self.table("markers").where((F.col("DataSource") == data_source) & (F.col("EntityType") == entity_type)).orderBy(F.desc("_ts")).take(1)
        return rows[0]["Value"] if rows else default

    def submit_job(self, kind: str, payload: str) -> str:
        ident = uuid.uuid4().hex
        self.store.replace("jobs", self._kept(X.submit_jobs(self.table("jobs"), self.spark.createDataFrame([(ident, kind, payload)], "id string, type string, payload string"))))
        return ident

    def reserve_numbers(self, name: str, count: int, prefix: str = "", suffix: str = "", padding: int = 0, start_at: int = 1, increment_by: int = 1) -> list[str]:
        if increment_by == 0 or padding < 0:
            raise ValueError("IncrementBy must not be 0 and padding not negative")
        rows = self.table("sequences").where(F.col("name") == name).take(1)
        s = rows[0].asDict() if rows else {"name": name, "prefix": prefix, "suffix": suffix, "padding": padding, "start_at": start_at, "increment_by": increment_by, "current_value": 0}
        first = s["start_at"] if s["current_value"] == 0 and s["start_at"] != 0 else s["current_value"] + s["increment_by"]
        numbers = [first + k * s["increment_by"] for k in range(count)]
        fresh = self.spark.createDataFrame([tuple((s | {"current_value": numbers[-1]}).values())], SCHEMAS["sequences"])
        self.store.replace("sequences", self._kept(X.upsert(self.table("sequences"), fresh, ["name"])))
        return [D.auto_number(n, s["prefix"], s["suffix"], s["padding"]) for n in numbers]

    def register_duplicates(self, pairs: DataFrame, submit_jobs: bool = False) -> None:
        """pairs (entity_id, duplicate_id); optionally one Ready job for each."""
        rows = pairs.select(F.sha2(F.concat_ws("|", "entity_id", "duplicate_id"), 256).alias("id"), "entity_id", "duplicate_id", F.lit("Open").alias("status"))
        rows = self._kept(rows)
        self.store.replace("duplicates", self._kept(X.upsert(self.table("duplicates"), rows, ["id"])))
        if submit_jobs:
            jobs = rows.select("id", F.lit("DuplicateMerge").alias("type"), F.to_json(F.struct("entity_id", "duplicate_id")).alias("payload"))
            self.store.replace("jobs", self._kept(X.submit_jobs(self.table("jobs"), jobs)))

    def request(self, envelope: dict[str, Any]) -> dict[str, Any]:
        reply = dispatch(envelope, service=self)
        self.counters["requests"] += 1
        self.counters["failures"] += not reply["Success"]
        return reply


for _name, _method in {"GetEntitiesWhere": "entities_where", "GetEntitiesById": "entities_by_id", "GetEntitiesByAlternateKeys": "entities_by_alternate_keys", "GetUpdatedEntities": "updated_since", "GetEntityTypeCounts": "type_counts", "GetTrackedEntities": "tracked", "MergeEntities": "merge", "PatchEntitiesWhere": "patch_where", "DeleteEntities": "delete", "RevertEntities": "revert", "RebaseEntities": "rebase", "GetMarker": "marker", "UpdateMarker": "set_marker", "SubmitJob": "submit_job", "ReserveAutoNumbers": "reserve_numbers", "RegisterDuplicates": "register_duplicates", "CountEntities": "entities_count", "GetEntity": "entity", "GetTrackingData": "tracking", "GetTrackingEntriesById": "tracking_by_id", "GetTrackingEntriesForEntity": "tracking_of", "GetLogEntriesWhere": "log_where", "CreateEntities": "create", "UpdateEntities": "update", "UpdateUntrackedEntities": "update_untracked", "PatchEntities": "patch", "ImportEntities": "import_entities", "DeleteTrackingData": "delete_tracking", "DeleteWhere": "delete_where", "RegisterAlternateKey": "register_key", "DetachEntitiesFromDataSource": "detach", "SplitAlternateKey": "split", "RebaseSourceEntities": "rebase_sources", "RecordSyncEvents": "record_sync", "ResolveExternalReferences": "resolve_references", "SettleResolutionPromises": "settle_promises", "ListResolutionPromises": "promises", "PatchResolutionPromise": "patch_promise", "DeleteResolutionPromises": "delete_promises", "RegisterEvents": "register_events", "RegisterRole": "register_role", "RegisterUser": "register_user", "GetUser": "user", "GetReadiness": "ready", "EnqueueAgentJob": "enqueue"}.items():
    handles(_name)(lambda service, _method=_method, **data: getattr(service, _method)(**data))
