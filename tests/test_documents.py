from __future__ import annotations

from copy import deepcopy
from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings, strategies as st

from aurum.functions import documents as D

T0 = datetime(2030, 1, 1, tzinfo=timezone.utc)
scalars = st.none() | st.booleans() | st.integers(-5, 5) | st.text("ab", max_size=3)
values = st.recursive(scalars, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.sampled_from("abcd"), x, max_size=3), max_leaves=8)
objects = st.dictionaries(st.sampled_from("abcd"), values, max_size=4)


@settings(max_examples=300, deadline=None)
@given(objects, objects)
def test_a_delta_leads_from_one_document_to_the_other_and_changes_neither(a, b):
    x, y = deepcopy(a), deepcopy(b)
    delta = D.diff(a, b)
    assert (a, b) == (x, y)
    assert D.same(D.patched(a, delta), b)
    assert (delta is None) == D.same(a, b)
    assert (a, b) == (x, y)


def test_delta_grammar():
    assert D.diff({"a": 1, "b": [1], "c": {"d": 1}, "e": 2}, {"a": 1.0, "b": [1, 2], "c": {"d": 2, "f": 3}}) == {"b": [[1], [1, 2]], "c": {"d": [1, 2], "f": [3]}, "e": [2, 0, 0]}


def test_typed_equality():
    assert D.same(T0, "2030-01-01T01:00:00+01:00") and not D.same("2030-01-01T00:00:00Z", "2030-01-01T01:00:00+01:00")
    assert D.same(1, 1.0) and not D.same(float("nan"), float("nan")) and not D.same(True, 1) and not D.same("1", 1)


def test_paths_and_nulls():
    doc = {"a": {"b": [{"c": 1}, None]}, "x": None}
    assert D.read_path(doc, "a.b[0].c") == 1 and D.read_path(doc, "a.z", 7) == 7
    assert D.strip_nulls(doc) == {"a": {"b": [{"c": 1}]}}
    assert D.leaves({"a": {"b": 1, "e": {}}, "l": [1]}) == {"a.b": 1, "l": [1]}
    D.write_path(doc, "n.m.k", 5)
    assert doc["n"] == {"m": {"k": 5}} and D.remove_path(doc, "a.b.[0]") and doc["a"]["b"] == [None] and not D.remove_path(doc, "q.r")
    assert D.strip_base({"ID": 1, "_ts": 2, "alternateKeys": [], "Name": "n"}) == {"alternateKeys": [], "Name": "n"}


def entry(kind, minutes, data, ts=0, ident=""):
    return {"DataSource": "S", "EntityType": "E", "EntityId": "1", "EntryType": kind, "Timestamp": (T0 + timedelta(minutes=minutes)).isoformat(), "_ts": ts, "Data": data, "id": ident}


def test_replay_ignores_what_is_older_than_the_baseline():
    log = [entry("Init", 0, {"city": "Lima", "floors": 3, "owners": [7]}), entry("Update", -9, {"city": ["Lima", "Cusco"]}), entry("Update", 4, {"floors": [3, 5], "owners": [[7], [7, 8, 9]]}), entry("Update", 6, {"city": ["Lima", 0, 0]})]
    state = D.replay(log)
    assert (state["floors"], state["owners"], "city" in state) == (5, [7, 8, 9], False)
    assert state["lastUpdated"] == (T0 + timedelta(minutes=6)).isoformat()
    assert D.replay(log, T0 + timedelta(minutes=5))["city"] == "Lima"


def test_replay_order_of_equal_times_and_lenience():
    log = [entry("Init", 0, {"n": 0}), entry("Update", 1, {"n": [0, 2]}, 20), entry("Update", 1, {"n": [0, 1]}, 10), entry("Update", 1, {"n": [0, 3]}, 0)]
    assert D.replay(log)["n"] == 3
    bad = [entry("Init", 0, {"n": 0}), entry("Update", 1, {"n": {"deep": {"x": [1]}}})]
    with pytest.raises(D.PatchError):
        D.replay(bad)
    assert D.replay(bad, lenient=True)["n"] == 0
    assert D.replay([entry("Init", 0, {}), entry("Update", 1, {"l": {"_t": "a", "0": ["v"]}})])["l"] == ["v"]


def test_patch_operations():
    doc = {"Name": "ab", "Tags": ["x"], "Other": "o"}
    new, errors = D.apply_patch(doc, [{"Operation": "add", "Path": "Name", "Value": 1}, {"Operation": "set", "Path": "Name", "Regex": "b$", "Value": "c"}, {"Operation": "add", "Path": "Tags[0]", "Value": "w"}, {"Operation": "set", "Path": "A.B", "Value": "^.Other"}, {"Operation": "remove", "Path": "Other"}, {"Operation": "remove", "Path": "None.There"}])
    assert new == {"Name": "ac", "Tags": ["w", "x"], "A": {"B": "o"}} and errors == ["Name: Path already exists"]
    assert doc["Tags"] == ["x"]


def test_numbers_and_references():
    assert [D.auto_number(7, "A-", "/z", 3), D.auto_number(-12, padding=4), D.auto_number(12345, padding=3), D.auto_number(5)] == ["A-007/z", "-0012", "12345", "5"]
    ref = {"@Tag": "ExternalEntityReference", "EntityId": "9"}
    assert D.external_references({"a": [{"b": ref}], "c": ref}) == [("a[0].b", ref), ("c", ref)]
    assert D.deep_merge({"a": [1], "b": {"c": 1}}, {"a": [1, 2], "b": {"c": None}}, null_ignored=True, union_arrays=True) == {"a": [1, 2], "b": {"c": 1}}
