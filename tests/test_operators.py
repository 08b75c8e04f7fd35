from __future__ import annotations

import json
import zipfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from aurum.functions import documents as D
from aurum.operators import history as H, lifecycle as L, merge as M, query as Q, resolve as R, rules as U, writes as X
from aurum.plans.expression import condition
from aurum.plans.requests import dispatch, handles
from aurum.sources.files import as_requests, export, export_csv, file_name, read_entities
from aurum.sources.store import Store

T0 = datetime(2030, 1, 1, tzinfo=timezone.utc)
NOW = T0 + timedelta(hours=1)
ALL = [{"name": "*", "action": "AlwaysOverwrite"}]


def version(n, **data):
    at = (T0 + timedelta(minutes=n)).isoformat()
    return {"EntityId": "h1", "EntityType": "Booking", "DataSource": "TestSource", "SourceEntityType": "Reservation", "SourceEntityId": "booking-1", "Data": {"createdOn": T0.isoformat(), "lastUpdated": at, **data}}


def test_fold_creates_updates_and_leaves_alone():
    state, log, results = M.fold_entity(None, [version(1, Total=42, Status="Booked"), version(2, Total=42, Status="Booked"), version(3, Status=None, Total=0)], ALL, NOW)
    assert [r["Outcome"] for r in results] == [M.CREATED, M.UNCHANGED, M.UPDATED]
    assert state["Total"] == 0 and "Status" not in state and state["alternateKeys"][0]["Key"] == "testsource.reservation"
    assert [x["EntryType"] for x in log] == ["Init", "Update"] and log[1]["Data"] == {"Total": [42, 0], "Status": ["Booked", 0, 0]}


def test_a_failing_event_leaves_the_state_and_the_next_one_offers_its_fields_again():
    events = [version(1, Total=1, Note="a"), version(2, Total=2, Note="b") | {"Data": {"Total": 2, "Note": "b"}}, version(3, Total=2, Note="b")]
    state, _, results = M.fold_entity(None, events, ALL, NOW)
    assert [r["Outcome"] for r in results] == [M.CREATED, M.FAILED, M.UPDATED] and (state["Total"], state["Note"]) == (2, "b")


@pytest.mark.parametrize("action,expected", [("AlwaysOverwrite", 2), ("NeverOverwrite", 1), ("DoNotUpdate", 1), ("OverwriteIfEmpty", 1), ("OverwriteIfNotEmpty", 2), ("OverwriteIfNewer", 2)])
def test_property_actions_in_the_fold(action, expected):
    state, _, _ = M.fold_entity(None, [version(1, Total=1), version(2, Total=2)], [{"name": "Total", "action": action}], NOW)
    assert state["Total"] == expected


def test_no_rule_applies_when_tracked_and_drops_at_first_merge():
    assert U.allows(None, 1, 2, None, None) and not U.allows(None, 1, 2, None, None, unmatched=False)
    assert U.allows("OverwriteIfEmpty", 0, 5, None, None) and not U.allows("OverwriteIfNewer", 1, 2, NOW, T0) and U.allows("OverwriteIfNewer", 1, 2, T0, T0)
    with pytest.raises(ValueError):
        U.allows("Odd", 1, 2, None, None)


def test_history_as_of_revert_and_rebase(spark):
    at = lambda n: (T0 + timedelta(minutes=n)).replace(tzinfo=None)
    rows = [("Hub", "E", "1", "a", "Init", at(0), 0, '{"n":1,"o":"x"}'), ("Hub", "E", "1", "b", "Update", at(1), 0, '{"n":[1,2]}'), ("Hub", "E", "1", "c", "Update", at(2), 0, '{"o":["x",0,0]}'), ("Hub", "E", "2", "d", "Init", at(5), 0, '{"n":9}')]
    log = spark.createDataFrame(rows, "DataSource string, EntityType string, EntityId string, id string, EntryType string, Timestamp timestamp, _ts long, Data string")
    got = {r["EntityId"]: r for r in H.replay_documents(log).collect()}
    assert json.loads(got["1"]["state"])["n"] == 2 and "o" not in json.loads(got["1"]["state"])
    back = {r["EntityId"]: r for r in H.revert_documents(log, T0, NOW).collect()}
    assert json.loads(back["1"]["Data"]) == {"n": [2, 1], "o": ["x"]} and back["2"]["error"] == "NO_TRACKING_STATE_AT_TARGET"
    assert not any(r["written"] for r in H.revert_documents(log, T0, NOW, dry_run=True).collect())
    new = H.rebase_documents(log, T0 + timedelta(minutes=1))
    kept = sorted((r["EntityId"], r["action"], r["Data"]) for r in new.collect())
    assert kept == [("1", "baseline", '{"createdOn":"2030-01-01T00:00:00+00:00","n":2,"o":"x"}'), ("1", "keep", '{"o":["x",0,0]}'), ("2", "keep", '{"n":9}')]
    again = {r["EntityId"]: json.loads(r["state"]) for r in H.replay_documents(new.select(*log.columns)).collect()}
    assert again["1"]["createdOn"].startswith("2030-01-01T00:00:00"), "it was created when it was created"
    by_entry = {r["EntityId"]: r for r in H.revert_documents(log, "b", NOW, hub="Hub").collect()}
    assert json.loads(by_entry["1"]["Data"]) == {"o": ["x"]} and by_entry["2"]["error"] == "TRACKING_ENTRY_NOT_FOUND"
    assert {r["error"] for r in H.revert_documents(log, T0, NOW, hub="Other").collect()} == {"UNSUPPORTED_DATA_SOURCE"}


def test_blocking_templates():
    text, fields = R.blocking_template("x.kind = $Shop and @In<string>($City, $Town) and @In<int>($Floor) and @PathIn<char>($Owner.Initial) and x.old = \\\"yes\\\"")
    assert text == "x.kind = 'Shop' and (:in0 or :in1) and :in2 and :in3 and x.old = 'yes'"
    assert fields == [("City", True), ("Town", True), ("Floor", False), ("Owner.Initial", True)]


def test_log_columns():
    assert Q.like_log_column("x.Id = 1 and x.Data2 = 2 and x.Data = 3 and y.x.Data = 4", ["Data", "Data2"]) == "x.id = 1 and x.Data.Data2 = 2 and x.Data.Data = 3 and y.x.Data = 4"


def test_version_order_permutes_a_sources_own_slots(spark):
    rows = spark.createDataFrame([(1, "a", 3), (2, "b", 9), (3, "a", 1), (4, "a", None)], "arrival int, src string, ts int")
    got = {r["arrival"]: (r["slot"], r["failed"]) for r in Q.version_order(rows, ["src"], "ts", "arrival").collect()}
    assert got == {1: (3, False), 2: (2, False), 3: (1, False), 4: (4, True)}


def test_pages_cover_everything_once(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(10)], "id int, n int")
    seen, token = [], None
    while page := Q.entities_where(rows, order_by="n desc", page_size=4, token=token).collect():
        seen += [r["id"] for r in page]
        token = Q.next_token(page[-1].asDict(), "n")
    assert seen == [r["id"] for r in rows.orderBy(F.desc("n"), "id").collect()]


@pytest.mark.parametrize("order", ["n", "n desc", "m desc, n"])
def test_pages_over_nulls_cover_everything_once(spark, order):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 4, i % 2) for i in range(12)], "id int, n int, m int")
    seen, token = [], None
    while page := Q.entities_where(rows, select="id, n, m, coalesce(n, -1) AS c", order_by=order, page_size=5, token=token).collect():
        seen += [r["id"] for r in page]
        token = Q.next_token(page[-1].asDict(), order)
    assert sorted(seen) == list(range(12))


def test_stores_have_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert not store.exists("t")
    for k in range(4):
        store.replace("t", spark.range(k + 1))
    store.append("t", spark.range(2))
    assert store.read("t").count() == 6 and len(store.pointers("t")) == Store.KEEP
    # a crash before the pointer leaves the version before
    spark.range(99).write.parquet(f"{store.root}/t/v-unfinished")
    assert store.read("t").count() == 6


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    from aurum.streaming.streams import latest_values

    folder, schema = str(tmp_path / "in"), "k string, ts int, v int"
    run = lambda: {r["k"]: r["v"] for r in latest_values(spark, folder, schema, str(tmp_path / "state"), str(tmp_path / "check"), ["k"], ["ts"], "v").collect()}
    spark.createDataFrame([("a", 1, 1), ("b", 1, 2)], schema).write.parquet(folder)
    assert run() == {"a": 1, "b": 2} == run()
    spark.createDataFrame([("a", 2, 5)], schema).write.mode("append").parquet(folder)
    assert run() == {"a": 5, "b": 2}


def test_source_rebase_keeps_what_is_sound(spark):
    at = lambda n: (T0 + timedelta(minutes=n)).replace(tzinfo=None)
    row = lambda e, i, kind, n, data, source="Crm", kind_of="Person": (source, kind_of, e, i, kind, at(n), 0, data)
    rows = [row("1", "a", "Init", 0, '{"n":1}'), row("1", "b", "Update", 1, '{"n":[1,2]}'), row("1", "c", "Update", 9, '{"n":[2,3]}'), row("2", "d", "Init", 0, '{"n":1}'), row("2", "e", "Update", 1, '{"n":[1,5]}'), row("2", "f", "Update", 2, '{"n":{"x":[1]}}'), row("3", "g", "Init", 0, '{"n":1}'), row("3", "h", "Update", 1, '{"n":[1,4]}'), row("3", "i", "Init", 2, '{"n":7}'), row("3", "j", "Init", 2, '{"n":8}'), row("4", "k", "Init", 0, "{}"), row("4", "l", "Init", 0, "{}", kind_of="person")]
    log = spark.createDataFrame(rows, "DataSource string, EntityType string, EntityId string, id string, EntryType string, Timestamp timestamp, _ts long, Data string")
    wanted = spark.createDataFrame([("CRM", "PERSON", str(k)) for k in range(1, 6)], "DataSource string, EntityType string, EntityId string")
    new, codes = L.rebase_sources(log, wanted, T0 + timedelta(minutes=5))
    assert {r["EntityId"]: r["code"] for r in codes.collect()} == {"1": None, "2": None, "3": None, "4": "AMBIGUOUS_SOURCE_ENTITY_TYPE", "5": "NOT_FOUND"}
    got = sorted((r["EntityId"], r["action"], json.loads(r["Data"]).get("n"), r["code"]) for r in new.where("EntityId < '4'").collect() if r["action"] == "baseline")
    assert got == [("1", "baseline", 2, None), ("2", "baseline", 5, "PARTIAL"), ("3", "baseline", 4, "PARTIAL")]
    assert new.count() == len(rows) - 3 and {len(r["id"]) for r in new.where("action = 'baseline'").collect()} == {64}


def test_rules_by_context():
    rules = U.Rules([{"context": "*", "properties": [1]}, {"data_source": "CRM", "properties": [2]}, {"source_entity_type": "Person", "context": "FirstTimeMerge", "properties": [3]}])
    assert rules.properties("Erp", "x", "MergeUpdatedEntity") == [1] and rules.properties("crm", "Person", "FirstTimeMerge") == [2]
    assert rules.properties("Erp", "PERSON", "FirstTimeMerge") == [3] and rules.properties("crm", "x", "MergeUpdatedEntity", exact=True) == [1]
    assert U.Rules([{"data_source": "A", "properties": [1]}]).properties("B", "", "") is None


def test_first_merge_into_a_match():
    state = {"id": "h", "entityType": "E", "lastUpdated": NOW.isoformat(), "createdOn": T0.isoformat(), "alternateKeys": [], "tags": ["a"], "name": "n", "city": ""}
    event = version(2, tags=["b"], name="m", city="Rome", extra=1)
    rules = U.Rules([{"context": "FirstTimeMerge", "properties": [{"name": "tags", "action": "AlwaysOverwrite"}, {"name": "name", "action": "OverwriteIfNewer"}, {"name": "city", "action": "OverwriteIfEmpty"}]}])
    new, log, results = M.fold_entity(state, [event], rules, NOW)
    assert (new["tags"], new["name"], new["city"], "extra" in new) == (["a", "b"], "n", "Rome", False), "without a rule a property is not copied"
    assert results[0]["Outcome"] == M.UPDATED and len(new["alternateKeys"]) == 1 and [x["EntryType"] for x in log] == ["Update"]
    old, _, results = M.fold_entity(state, [event], [], NOW)
    assert old["name"] == "n" and results[0]["Outcome"] == M.MATCHED, "an older source gives nothing without rules"


def test_pre_merge_rules_in_the_fold():
    reject = lambda context, action: U.Rules([], [{"context": context, "predicate": {"property": "incoming.Total", "operator": "gt", "value": 5}, "action": action}])
    state, _, results = M.fold_entity(None, [version(1, Total=9)], reject("NewEntityPreMerge", "RejectMerge"), NOW)
    assert state is None and results[0]["Outcome"] == M.REJECTED
    _, _, results = M.fold_entity(None, [version(1, Total=9)], reject("UnmatchedEntityPreMerge", "AllowMerge"), NOW)
    assert results[0]["Outcome"] == M.FAILED, "AllowMerge with a predicate is invalid for new entities"
    history = {}
    state, _, results = M.fold_entity(None, [version(1, Total=1), version(2, Total=9, Note="a"), version(3, Total=2, Note="a")], reject("ExistingEntityPreMerge", "RejectMerge"), NOW, history=history)
    assert [r["Outcome"] for r in results] == [M.CREATED, M.REJECTED, M.UPDATED] and (state["Total"], state["Note"]) == (2, "a")
    assert [[x["EntryType"], x["Data"]] for x in next(iter(history.values()))] == [["Init", {"Total": 1}], ["Update", {"Total": [1, 2], "Note": ["a"]}]], "the rejected event is no part of the source's history"


def test_conditions(spark):
    rows = spark.range(8)
    node = {"xor": [{"property": "id", "operator": "lt", "value": 4}, {"property": "id", "operator": "in", "value": [2, 6]}]}
    assert [r[0] for r in rows.where(condition(node)).collect()] == [0, 1, 3, 6]


def test_requests():
    handles("Echo")(lambda text: text * 2)
    assert dispatch({"RequestType": "Echo", "CorrelationId": "c", "Data": {"text": "a"}}) == {"CorrelationId": "c", "Success": True, "Data": "aa"}
    assert not dispatch({"RequestType": "None"})["Success"] and not dispatch({"RequestType": "Echo", "Data": {}})["Success"]


def test_files_and_store(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "venue_1.json").write_text('[{"id": 1, "entityType": "Venue", "Name": "a"}]')
    (tmp_path / "in" / "other.json").write_text('[{"id": 2, "entityType": "Venue", "Name": "b"}]')
    rows = read_entities(spark, str(tmp_path / "in"), "^venue_")
    assert [json.loads(r["Data"])["Name"] for r in as_requests(rows, "Crm").collect()] == ["a"]
    docs = rows.select("entityType", F.col("id").cast("string").alias("id"), F.to_json(F.struct("*")).alias("doc"))
    export(docs, str(tmp_path / "o.zip"))
    assert zipfile.ZipFile(tmp_path / "o.zip").namelist() == [file_name("Venue", "1")] and file_name("a/b", "1") == "a_b_1.json"
    export(docs, str(tmp_path / "o.json"))
    assert json.loads((tmp_path / "o.json").read_text())[0]["Name"] == "a"
    export_csv(rows, str(tmp_path / "csv"), ["entityType", "Name"], ";", humanize=True)
    assert [r.asDict() for r in spark.read.option("sep", ";").option("header", True).csv(str(tmp_path / "csv")).collect()] == [{"Entity Type": "Venue", "Name": "a"}]
    store = Store(spark, str(tmp_path / "store"))
    store.replace("t", spark.range(3))
    store.replace("t", X.upsert(store.read("t").withColumn("v", F.lit(0)), spark.createDataFrame([(1, 5), (9, 9)], "id long, v int"), ["id"]))
    assert sorted(map(tuple, store.read("t").collect())) == [(0, 0), (1, 5), (2, 0), (9, 9)]


def test_updates_and_numbers(spark):
    docs = spark.createDataFrame([("1", '{"a":1,"b":[1],"c":"x"}')], "id string, doc string")
    ups = spark.createDataFrame([("1", '{"b":[2],"c":null}'), ("2", "{}")], "id string, payload string")
    got = {r["id"]: r for r in X.update_documents(docs, ups).collect()}
    assert json.loads(got["1"]["doc"]) == {"a": 1, "b": [2]} and got["2"]["error"] == "Entity does not exist"
    patch = {r["id"]: r for r in X.update_documents(docs, ups, patch=True).collect()}
    assert json.loads(patch["1"]["doc"]) == {"a": 1, "b": [2], "c": "x"}
    with pytest.raises(ValueError):
        X.auto_numbers(spark.range(1), ["id"], ["id"], step=0)
    rows = X.auto_numbers(spark.range(2).withColumn("g", F.lit(1)), ["g"], ["id"], current=9, step=-7, padding=2).collect()
    assert [r["text"] for r in rows] == ["02", "-05"]


def test_jobs(spark):
    jobs = X.submit_jobs(spark.createDataFrame([("a", "x", "Complete", 5)], "id string, type string, status string, completed_on int"), spark.createDataFrame([("b", "y")], "id string, type string"))
    assert sorted((r["id"], r["status"]) for r in jobs.collect()) == [("a", "Complete"), ("b", "Ready")]
    assert [(r["status"], r["completed_on"]) for r in X.retry_jobs(jobs, ["a"]).where("id = 'a'").collect()] == [("Ready", None)]


def test_rule_resolution_in_python_and_spark_agree(spark):
    rules = [{"name": n, "action": "x"} for n in ("*", "Venue", "Venue.Address")]
    assert U.resolve_property_rule(rules, "venue.address.City")["name"] == "Venue.Address" and U.resolve_property_rule(rules, "VenueOther.x")["name"] == "*"
    assert U.resolve_property_rule(rules[1:], "Other") is None
    assert D.canonical({"b": 1, "a": [2]}) == '{"a":[2],"b":1}'
