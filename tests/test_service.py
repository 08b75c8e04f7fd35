from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from aurum.operators import merge as M
from aurum.plans.service import Service

T0 = datetime(2030, 1, 1, tzinfo=timezone.utc)
SCHEMA = "DataSource string, SourceEntityType string, SourceEntityId string, EntityType string, Data string, ord long"
RULES = [{"name": "*", "action": "AlwaysOverwrite"}]


def requests(spark, *rows):
    out = []
    for k, (source, ident, minutes, data) in enumerate(rows):
        out.append((source, "Contact", ident, "Person", json.dumps({"createdOn": T0.isoformat(), "lastUpdated": (T0 + timedelta(minutes=minutes)).isoformat(), **data}), k))
    return spark.createDataFrame(out, SCHEMA)


def test_from_merge_to_rebase(spark, tmp_path):
    now = [T0 + timedelta(hours=1)]
    hub = Service(spark, str(tmp_path / "hub"), lambda: now[0])
    first = hub.merge(requests(spark, ("Crm", "1", 1, {"Email": "A@x", "Name": "Ann"}), ("Crm", "1", 2, {"Email": "A@x", "Name": "Anna"}), ("Crm", "2", 1, {"Email": "b@x"})), RULES)
    assert sorted(r["Outcome"] for r in first.collect()) == sorted([M.CREATED, M.CREATED, M.UPDATED])
    second = hub.merge(requests(spark, ("Erp", "77", 3, {"Email": "a@X", "City": "Rome"}), ("Crm", "1", 4, {"Name": None})), RULES, same_as=["Email"])
    assert [r["Outcome"] for r in second.collect()] == [M.UPDATED, M.UPDATED]
    assert {r["EntityType"]: r["Count"] for r in hub.type_counts().collect()} == {"Person": 2}
    ann = hub.entities_by_alternate_keys([("erp.contact", "77")]).collect()[0]["id"]
    doc = json.loads(hub.entities_by_id("Person", [ann]).first()["doc"])
    assert doc["City"] == "Rome" and "Name" not in doc and {k["Key"] for k in doc["alternateKeys"]} == {"crm.contact", "erp.contact"}
    assert json.loads(hub.tracked([ann]).first()["state"])["City"] == "Rome"
    assert json.loads(hub.tracked([ann], T0 + timedelta(minutes=2)).first()["state"])["Name"] == "Anna"
    failed = hub.merge(spark.createDataFrame([("Crm", "Contact", "9", "Person", '{"Email":"z"}', 0)], SCHEMA), RULES)
    assert failed.first()["Outcome"] == M.FAILED and hub.table("failures").count() == 1
    hub.patch_where("Person", "get_json_object(doc, '$.City') = 'Rome'", [{"Operation": "set", "Path": "City", "Value": "Bari"}])
    now[0] += timedelta(minutes=5)
    done = hub.revert([ann], T0 + timedelta(minutes=3)).first()
    assert done["written"] and json.loads(hub.entities_by_id("Person", [ann]).first()["doc"])["City"] == "Rome"
    before = hub.table("log").where("DataSource = 'Golden'").count()
    hub.rebase(now[0])
    assert hub.table("log").where("DataSource = 'Golden'").count() == 2 < before
    assert json.loads(hub.tracked([ann]).first()["state"])["City"] == "Rome"
    assert [r["id"] for r in hub.delete([ann, "none"], cascade=True).collect()] == ["none"] and hub.table("entities").count() == 1


def test_a_source_is_compared_with_what_it_said_before(spark, tmp_path):
    hub = Service(spark, str(tmp_path / "hub"), lambda: T0 + timedelta(hours=1))
    name = lambda: json.loads(hub.table("entities").first()["doc"])["Name"]
    hub.merge(requests(spark, ("Crm", "1", 1, {"Email": "a@x", "Name": "X"})), RULES)
    hub.merge(requests(spark, ("Erp", "7", 2, {"Email": "a@x", "Name": "Y"})), RULES, same_as=["Email"])
    assert name() == "Y"
    before = hub.table("log").count()
    again = hub.merge(requests(spark, ("Crm", "1", 3, {"Email": "a@x", "Name": "X"})), RULES)
    assert [r["Outcome"] for r in again.collect()] == [M.UNCHANGED] and name() == "Y" and hub.table("log").count() == before
    changed = hub.merge(requests(spark, ("CRM", "1", 4, {"Email": "a@x", "Name": "Z"})), RULES)
    assert [r["Outcome"] for r in changed.collect()] == [M.UPDATED] and name() == "Z"
    said = [(r["EntryType"], json.loads(r["Data"])) for r in hub.table("log").where("lower(DataSource) = 'crm'").orderBy("_ts").collect()]
    assert said == [("Init", {"Email": "a@x", "Name": "X"}), ("Update", {"Name": ["X", "Z"]})]
    late = hub.merge(requests(spark, ("Erp", "7", 1, {"Email": "a@x", "Name": "Y"})), RULES)
    assert [r["Outcome"] for r in late.collect()] == [M.UNCHANGED], "it is older than the source's Init"


def test_management(spark, tmp_path):
    hub = Service(spark, str(tmp_path / "hub"), lambda: T0)
    assert hub.marker("Crm", "Person", "zero") == "zero"
    hub.set_marker("Crm", "Person", "17")
    assert hub.request({"RequestType": "GetMarker", "CorrelationId": "c", "Data": {"data_source": "Crm", "entity_type": "Person"}}) == {"CorrelationId": "c", "Success": True, "Data": "17"}
    assert hub.reserve_numbers("inv", 2, "I-", padding=3, start_at=10, increment_by=5) + hub.reserve_numbers("inv", 1) == ["I-010", "I-015", "I-020"]
    hub.register_duplicates(spark.createDataFrame([("a", "b")], "entity_id string, duplicate_id string"), submit_jobs=True)
    assert hub.table("jobs").first()["status"] == "Ready" and hub.table("duplicates").count() == 1


def test_new_sources_of_one_batch_meet_and_conflicts_fail(spark, tmp_path):
    heard = []
    hub = Service(spark, str(tmp_path / "hub"), lambda: T0 + timedelta(hours=1), lambda n: heard.extend(r["Notification"] for r in n.collect()))
    hub.merge(requests(spark, ("Crm", "1", 1, {"Email": "a@x"}), ("Erp", "2", 2, {"Email": "A@X", "City": "Rome"}), ("Crm", "3", 3, {"Email": "a@x"}), ("Web", "4", 3, {})), RULES, same_as=["Email"])
    assert hub.entities_count() == 3 and sorted(heard) == ["Created"] * 3 + ["Updated"]
    both = hub.entities_by_alternate_keys([("crm.contact", "1"), ("erp.contact", "2")]).collect()
    assert len({r["id"] for r in both}) == 1 and hub.entity(both[0]["id"])["City"] == "Rome"
    hub.register_key(both[0]["id"], "crm.contact", "9")
    clash = hub.merge(requests(spark, ("Crm", "1", 5, {"X": 1}), ("crm", "9", 6, {"X": 2})), RULES)
    assert {r["Outcome"] for r in clash.collect()} == {M.FAILED} and hub.table("failures").count() == 2
    untracked = hub.merge(requests(spark, ("Crm", "1", 9, {"X": 3})), [], tracked=False)
    assert untracked.first()["Outcome"] == M.UPDATED and hub.entity(both[0]["id"])["X"] == 3
    hub.close()


def test_writes_have_history(spark, tmp_path):
    hub = Service(spark, str(tmp_path / "hub"), lambda: T0 + timedelta(hours=1))
    docs = spark.createDataFrame([("a", "Person", '{"n":1,"alternateKeys":[{"Key":"crm.x","Value":"7"},{"Key":"web.x","Value":"7"}]}'), ("b", "Person", '{"n":2}')], "id string, entityType string, doc string")
    assert [r["error"] for r in hub.create(docs).collect()] == [None, None]
    assert {r["error"] for r in hub.create(docs).collect()} == {"Entity already exists"}
    up = spark.createDataFrame([("a", "Person", '{"n":5}'), ("z", "Person", '{"n":0}')], "id string, entityType string, payload string")
    assert sorted((r["id"], r["error"]) for r in hub.update(up).collect())[1] == ("z", "Entity does not exist") and hub.entity("a")["n"] == 5
    assert hub.tracking("x.EntryType = :t", parameters={"t": "Update"}, ids=["a"]).count() == 1 and hub.tracking_of("Golden", "Person", "b").count() == 1
    assert hub.split("a", "crm.x", "8")["error"] == "ALTERNATE_KEY_NOT_FOUND" and hub.split("b", "crm.x", "7")["error"] == "ALTERNATE_KEY_NOT_FOUND"
    new = hub.split("a", "crm.x", "7")["id"]
    assert [k["Key"] for k in hub.entity(new)["alternateKeys"]] == ["crm.x"] and [k["Key"] for k in hub.entity("a")["alternateKeys"]] == ["web.x"]
    states = {r["EntityId"]: json.loads(r["state"]) for r in hub.tracked(["a", new]).collect()}
    assert states[new]["n"] == 5 and [k["Key"] for k in states["a"]["alternateKeys"]] == ["web.x"]
    assert hub.detach(["a", "b"], "WEB") == 1 and not hub.entity("a")["alternateKeys"]
    done = hub.patch(spark.createDataFrame([("b",), ("q",)], "id string"), [{"Operation": "set", "Path": "n", "Value": 9}])
    assert {r["id"]: list(r["errors"]) for r in done.collect()} == {"b": [], "q": ["ENTITY_NOT_FOUND"]} and hub.entity("b")["n"] == 9
    items = spark.createDataFrame([("b", "Person", '{"n":0}', True), ("c", "Person", '{"n":4}', False), (None, "Person", "{}", True), ("d", "Person", "none", True)], "id string, entityType string, doc string, overwrite boolean")
    assert {r["id"]: r["error"] is None for r in hub.import_entities(items).collect()} == {"b": True, "c": True, None: False, "d": False}
    assert hub.entity("b")["n"] == 9 and hub.entity("c")["n"] == 4
    hub.update_untracked(docs.where("id = 'b'"))
    assert hub.entity("b") == {"n": 2}
    hub.record_sync(spark.createDataFrame([(new, "crm.x", "7", "2030", "down")], "id string, Key string, Value string, synced string, error string"))
    assert hub.entity(new)["alternateKeys"][0]["Error"] == "down"
    hub.delete_tracking("Golden", ["b"])
    assert hub.tracking_of("Golden", "Person", "b").count() == 0


def test_references_are_resolved_or_promised(spark, tmp_path):
    hub = Service(spark, str(tmp_path / "hub"), lambda: T0 + timedelta(hours=1))
    ref = {"@Tag": "ExternalEntityReference", "EntityType": "Person", "DataSource": "Crm", "SourceEntityType": "Contact", "EntityId": "2"}
    hub.merge(requests(spark, ("Crm", "1", 1, {"Boss": ref})), RULES)
    assert hub.resolve_references().count() == 0 and hub.promises().count() == 1
    assert [r["status"] for r in hub.settle_promises().collect()] == ["Unresolved"]
    hub.merge(requests(spark, ("Crm", "2", 2, {"Name": "b"})), RULES)
    boss = hub.entities_by_alternate_keys([("crm.contact", "2")]).first()["id"]
    assert [r["status"] for r in hub.settle_promises(dry_run=True).collect()] == ["Resolved"] and hub.promises().count() == 1
    assert [r["target"] for r in hub.settle_promises().collect()] == [boss] and hub.promises().count() == 0
    one = hub.entities_by_alternate_keys([("crm.contact", "1")]).first()["id"]
    assert hub.entity(one)["Boss"] == {"EntityType": "Person", "EntityId": boss}
    assert json.loads(hub.tracked([one]).first()["state"])["Boss"]["EntityId"] == boss, "the change is logged"


def test_events_users_and_readiness(spark, tmp_path):
    hub = Service(spark, str(tmp_path / "hub"), lambda: T0)
    event = lambda outcome: spark.createDataFrame([("Crm", "Person", "1", outcome, "why")], "DataSource string, EntityType string, EntityId string, Outcome string, Error string")
    hub.register_events("SyncFailure", event("Failed"))
    assert hub.log_where("SyncFailure", "x.Outcome = 'Failed' AND x.Id IS NOT NULL").count() == 1
    hub.register_events("SyncFailure", event("Success"))
    assert hub.table("events").count() == 0
    assert hub.register_role("Reader", []) == "BUILT_IN_ROLE" and hub.register_role("x", ["Fly"]) == "UNKNOWN_PERMISSION"
    assert hub.register_role("Editor", ["Read", "Write"]) is None and hub.register_role("Editor", []) == "ROLE_EXISTS"
    hub.register_user("u", "t", "o1", "Ann@x", ["Editor", "Reader"])
    assert hub.user("t", "o1")["permissions"] == ["Read", "Write"] and hub.user("t", "zz", "ann@X")["user"] == "u" and hub.user("q", "o1") is None
    hub.register_user("v", "t", "o1", "b@x", ["Ghost"])
    assert not hub.request({"RequestType": "GetUser", "Data": {"tenant": "t", "object_id": "o1"}})["Success"]
    hub.enqueue("MergeEntities", {"ids": [1]})
    assert hub.delete_where("jobs", "x.status = :s", {"s": "Ready"}) == 1 and hub.table("jobs").count() == 0
    assert hub.ready() == {"Ready": True, "requests": 1, "failures": 1}
