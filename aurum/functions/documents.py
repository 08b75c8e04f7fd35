"""Documents as Python values: paths, null stripping, typed equality, deltas and patches.

A delta has the public JsonDiffPatch form: [new] adds, [old, new] changes, [old, 0, 0] deletes, a dict descends. A changed
array is one change of the whole value.
"""

from __future__ import annotations

import json
import math
import re
from copy import deepcopy
from datetime import datetime, timezone
from decimal import Decimal, InvalidOperation
from typing import Any

BASE_PROPERTIES = frozenset(("id", "pk", "entitytype", "createdon", "lastupdated", "nosync", "syncwhitelist", "syncblacklist", "_dt", "_etag", "_ts", "_dnf"))
MISSING = object()


class PatchError(ValueError):
    """A delta or patch that does not fit the document."""


def strip_nulls(value: Any) -> Any:
    """Nulls go from objects and arrays at every depth; empty objects and arrays stay."""
    if isinstance(value, dict):
        return {k: strip_nulls(v) for k, v in value.items() if v is not None}
    return [strip_nulls(v) for v in value if v is not None] if isinstance(value, list) else value


def leaves(value: dict, prefix: str = "") -> dict[str, Any]:
    """Dotted paths of all leaves; arrays are leaves, empty objects have none."""
    out: dict[str, Any] = {}
    for k, v in value.items():
        if isinstance(v, dict):
            out |= leaves(v, f"{prefix}{k}.")
        else:
            out[prefix + k] = v
    return out


def canonical(value: Any) -> str:
    """Keys sorted at every depth, arrays in order, no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=lambda d: d.isoformat())


def steps(path: str) -> list[str | int]:
    """a.b[0].c and a.b.[0].c alike."""
    return [int(i) if i else name for name, i in re.findall(r"([^.\[\]]+)(?![^\[]*\])|\[(\d+)\]", path)]


def read_path(value: Any, path: str, default: Any = None) -> Any:
    for step in steps(path):
        if isinstance(step, int) and isinstance(value, list) and step < len(value) or isinstance(step, str) and isinstance(value, dict) and step in value:
            value = value[step]
        else:
            return default
    return value


def write_path(document: dict, path: str, new: Any) -> None:
    """Sets a dotted path; parents that are missing or no objects become objects."""
    *parents, last = steps(path)
    here: Any = document
    for k, step in enumerate(parents):
        nxt = here[step] if isinstance(here, list) or step in here else None
        if not isinstance(nxt, (dict, list)):
            nxt = here[step] = [] if isinstance((parents + [last])[k + 1], int) else {}
        here = nxt
    if isinstance(here, list) and isinstance(last, int) and last == len(here):
        here.append(new)
    else:
        here[last] = new


def remove_path(document: dict, path: str) -> bool:
    *parents, last = steps(path)
    here: Any = document
    for step in parents:
        try:
            here = here[step]
        except (KeyError, IndexError, TypeError):
            return False
    if isinstance(here, dict) and last in here or isinstance(here, list) and isinstance(last, int) and last < len(here):
        del here[last]
        return True
    return False


def strip_base(document: dict) -> dict:
    """Top-level base properties go, alternateKeys stay; names are compared without case."""
    return {k: v for k, v in document.items() if k.lower() not in BASE_PROPERTIES}


def is_empty(value: Any) -> bool:
    return value is None or value == [] or value == {}


def is_empty_value(value: Any) -> bool:
    """For merge rules: also "", 0, 0.0, false and the first date."""
    return is_empty(value) or value == "" or isinstance(value, (bool, int, float, Decimal)) and not value or isinstance(value, datetime) and value.year == 1


def as_instant(value: Any, required: str | None = None) -> datetime | None:
    """A date with offset; null and blank give None, or an error that names the token where it is required."""
    if value is None or isinstance(value, str) and not value.strip():
        if required:
            raise ValueError(f"{required} is required")
        return None
    if not isinstance(value, datetime):
        text = re.sub(r"(\.\d{6})\d+", r"\1", str(value).strip().replace("Z", "+00:00"))
        value = datetime.fromisoformat(text)
    return value if value.tzinfo else value.replace(tzinfo=timezone.utc)


def same(a: Any, b: Any) -> bool:
    """Typed equality: numbers by exact value (NaN and infinities never), a date token equals a string of the same instant,
    two strings are compared as text."""
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    if isinstance(a, (int, float, Decimal)) and isinstance(b, (int, float, Decimal)):
        if any(isinstance(x, float) and not math.isfinite(x) for x in (a, b)):
            return False
        try:
            return Decimal(str(a)) == Decimal(str(b))
        except InvalidOperation:
            return False
    if isinstance(a, datetime) or isinstance(b, datetime):
        try:
            return (x := as_instant(a)) is not None and x == as_instant(b)
        except ValueError:
            return False
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return type(a) is type(b) and a == b


def diff(old: Any, new: Any) -> Any:
    """The delta from old to new, or None; the arguments stay as they are."""
    if isinstance(old, dict) and isinstance(new, dict):
        out = {}
        for k in [*old, *(k for k in new if k not in old)]:
            if k not in new:
                out[k] = [deepcopy(old[k]), 0, 0]
            elif k not in old:
                out[k] = [deepcopy(new[k])]
            elif (d := diff(old[k], new[k])) is not None:
                out[k] = d
        return out or None
    return None if same(old, new) else [deepcopy(old), deepcopy(new)]


def patched(value: Any, delta: Any, lenient: bool = False) -> Any:
    """The value after a delta. What does not fit raises PatchError, or is passed over if lenient."""
    if delta is None:
        return value
    if isinstance(delta, list):
        return deepcopy(delta[-1]) if len(delta) < 3 else MISSING
    if delta.get("_t") == "a":
        return _patched_array(value, delta, lenient)
    if not isinstance(value, dict):
        if lenient:
            return value
        raise PatchError("the delta descends into what is no object")
    out = dict(value)
    for k, d in delta.items():
        if isinstance(d, dict) and k not in out:
            if d.get("_t") == "a":
                out[k] = []
            elif lenient:
                continue
            else:
                raise PatchError(f"{k} is missing")
        new = patched(out.get(k), d, lenient)
        if new is MISSING:
            out.pop(k, None)
        else:
            out[k] = new
    return out


def _patched_array(value: Any, delta: dict, lenient: bool) -> Any:
    """Older logs hold deltas of single array elements: _n removes or moves, n inserts or changes."""
    if not isinstance(value, list):
        if lenient:
            return value
        raise PatchError("the delta of an array meets what is none")
    out = list(value)
    try:
        for k in sorted((k for k in delta if k[0] == "_" and k != "_t"), key=lambda k: -int(k[1:])):
            out.pop(int(k[1:]))
        for k in sorted((k for k in delta if k[0] != "_"), key=int):
            if isinstance(delta[k], list) and len(delta[k]) == 1:
                out.insert(int(k), deepcopy(delta[k][0]))
            else:
                out[int(k)] = patched(out[int(k)], delta[k], lenient)
    except (IndexError, ValueError) as e:
        if lenient:
            return value
        raise PatchError(str(e)) from e
    return out


def deep_merge(target: Any, source: Any, null_ignored: bool = False, union_arrays: bool = False) -> Any:
    """source over target: objects merge, arrays are replaced or united, nulls overwrite unless ignored."""
    if isinstance(target, dict) and isinstance(source, dict):
        out = dict(target)
        for k, v in source.items():
            if v is None and null_ignored:
                continue
            out[k] = deep_merge(out[k], v, null_ignored, union_arrays) if k in out else deepcopy(v)
        return out
    if union_arrays and isinstance(target, list) and isinstance(source, list):
        return [*target, *(deepcopy(v) for v in source if not any(same(v, t) for t in target))]
    return deepcopy(source)


def auto_number(value: int, prefix: str = "", suffix: str = "", padding: int = 0) -> str:
    digits = str(abs(value))
    return f"{prefix}{'-' if value < 0 else ''}{digits.rjust(max(padding, 0), '0')}{suffix}"


def replay_order(entry: dict) -> tuple:
    """Timestamp; within one, stored entries by _ts and then those without one; then id."""
    ts = entry.get("_ts") or 0
    return (as_instant(entry["Timestamp"]), ts == 0, ts, entry.get("id") or "")


def replay(entries: list[dict], as_of: datetime | None = None, lenient: bool = False) -> dict | None:
    """The state that Init and Update entries give: the latest Init up to as_of, then the updates since, in order."""
    held = sorted((e for e in entries if as_of is None or as_instant(e["Timestamp"]) <= as_of or e["EntryType"] == "Init"), key=replay_order)
    inits = [e for e in held if e["EntryType"] == "Init" and (as_of is None or as_instant(e["Timestamp"]) <= as_of)] or [e for e in held if e["EntryType"] == "Init"][:1]
    if not inits:
        return None
    first, state = inits[-1], deepcopy(inits[-1]["Data"])
    last = as_instant(first["Timestamp"])
    for e in held:
        if e["EntryType"] == "Update" and as_instant(e["Timestamp"]) >= as_instant(first["Timestamp"]):
            state = patched(state, e["Data"], lenient)
            last = as_instant(e["Timestamp"])
    state.setdefault("createdOn", as_instant(first["Timestamp"]).isoformat())
    return state | {"id": first["EntityId"], "entityType": first["EntityType"], "lastUpdated": last.isoformat()}


def apply_patch(document: dict, operations: list[dict]) -> tuple[dict, list[str]]:
    """add, set and remove operations; one that fails is reported and the others still count."""
    original, out, errors = deepcopy(document), deepcopy(document), []
    for op in operations:
        kind, path, new = op["Operation"].lower(), op["Path"], op.get("Value")
        if isinstance(new, str) and new.startswith("^."):
            new = read_path(original, new[2:])
        now = read_path(out, path, MISSING)
        if kind == "add" and now is not MISSING and not (isinstance(steps(path)[-1], int)):
            errors.append(f"{path}: Path already exists")
        elif kind == "add" and isinstance(steps(path)[-1], int) and isinstance(parent := read_path(out, re.sub(r"\.?\[\d+\]$", "", path)), list):
            parent.insert(steps(path)[-1], new)
        elif kind in ("add", "set"):
            if op.get("Regex") and isinstance(now, str):
                new = re.sub(op["Regex"], new or "", now)
            try:
                write_path(out, path, new)
            except (IndexError, TypeError):
                errors.append(f"{path}: cannot be set")
        elif kind == "remove":
            remove_path(out, path)
        else:
            errors.append(f"{path}: unknown operation {op['Operation']}")
    return out, errors


def external_references(value: Any, path: str = "") -> list[tuple[str, dict]]:
    """(path, reference) of every unresolved reference, at any depth."""
    if isinstance(value, dict):
        if value.get("@Tag") == "ExternalEntityReference":
            return [(path, value)]
        return [f for k, v in value.items() for f in external_references(v, f"{path}.{k}" if path else k)]
    return [f for k, v in enumerate(value) for f in external_references(v, f"{path}[{k}]")] if isinstance(value, list) else []
