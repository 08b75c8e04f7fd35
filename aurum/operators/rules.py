"""Rules: selection of merge rules, nearest property rule, property actions, pre-merge rules."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.documents import is_empty_value
from ..plans.expression import holds

CONTEXTS = ("NewEntityPreMerge", "MatchedEntityPreMerge", "UnmatchedEntityPreMerge", "ExistingEntityPreMerge", "FirstTimeMerge", "MergeUpdatedEntity")
ACTIONS = ("AlwaysOverwrite", "OverwriteIfNewer", "OverwriteIfEmpty", "OverwriteIfNotEmpty", "NeverOverwrite", "DoNotUpdate")


@dataclass(frozen=True)
class Rules:
    """A type's configuration. merge: data_source, source_entity_type, context ('*' or absent: any) and properties (name,
    action); before: the same selectors with predicate (a condition node over incoming, existing and change, or None) and
    action. Configuration is data: predicates are condition nodes, never code."""

    merge: list[dict] = field(default_factory=list)
    before: list[dict] = field(default_factory=list)

    @staticmethod
    def of(rules: list[dict] | Rules) -> Rules:
        """A plain list of property rules holds for every source and context."""
        return rules if isinstance(rules, Rules) else Rules([{"properties": rules}] if rules else [])

    def properties(self, data_source: str, source_type: str, context: str, exact: bool = False) -> list[dict] | None:
        """The property rules of the best merge rule (data source 4, source type 2, context 1, then the first); None if none
        fits. exact: by exact case, and the first that fits."""
        best: tuple[int, dict] | None = None
        for rule in self.merge:
            score = _score(rule, data_source, source_type, context, exact)
            if score is not None and (best is None or not exact and score > best[0]):
                best = score, rule
        return None if best is None else best[1]["properties"]

    def pre_merge(self, data_source: str, source_type: str, context: str, scope: dict[str, Any]) -> str | None:
        """The action of the first rule that fits and whose predicate holds; None lets the event pass."""
        for rule in self.before:
            if _score(rule, data_source, source_type, context) is None:
                continue
            if rule.get("predicate") is None:
                return None if rule["action"] == "AllowMerge" else rule["action"]
            if holds(rule["predicate"], scope):
                return rule["action"]
        return None


def _score(rule: dict, data_source: str, source_type: str, context: str, exact: bool = False) -> int | None:
    total = 0
    for name, value, worth in (("data_source", data_source, 4), ("source_entity_type", source_type, 2), ("context", context, 1)):
        wanted = rule.get(name) or "*"
        if wanted == "*":
            continue
        if wanted != value and (exact or wanted.lower() != value.lower()):
            return None
        total += worth
    return total


def select_merge_rules(events: DataFrame, rules: DataFrame, key: list[str]) -> DataFrame:
    """The best rule of each event: DataSource scores 4, SourceEntityType 2, Context 1; ties go to the first configured.

    rules (rule, idx, data_source, source_entity_type, context; '*' matches all, compared without case). A rule is looked
    up by equality on its selectors, once for each combination of '*' and exact that the rules use (8 at most)."""
    names = ("data_source", "source_entity_type", "context")
    stars = [(F.col(c) == "*").alias(f"star_{c}") for c in names]
    # the first configured of rules with equal selectors, so that a lookup gives one row at most
    lean = rules.select(*[F.lower(c).alias(f"r_{c}") for c in names], *stars, "idx", "rule")
    lean = lean.groupBy(*[f"r_{c}" for c in names], *[f"star_{c}" for c in names]).agg(F.min(F.struct("idx", "rule")).alias("r"))
    found = events
    for k in range(8):
        exact = [c for j, c in enumerate(names) if not k >> j & 1]
        part = lean.where(reduce(Column.__and__, [F.col(f"star_{c}") == (c not in exact) for c in names]))
        score = sum(w for c, w in zip(names, (4, 2, 1), strict=True) if c in exact)
        part = part.select(*[F.col(f"r_{c}").alias(f"e{k}_{c}") for c in exact], F.struct(F.lit(score).alias("score"), (-F.col("r.idx")).alias("place"), F.col("r.rule").alias("rule")).alias(f"hit{k}"))
        on = reduce(Column.__and__, [F.lower(c) == F.col(f"e{k}_{c}") for c in exact]) if exact else None
        if on is None:
            part = part.limit(1)  # rules without selectors were reduced to the first one
            found = found.join(part, how="left")
        else:
            found = found.join(part, on, "left")
    best = F.greatest(*[F.col(f"hit{k}") for k in range(8)])
    return found.withColumn("best", best).where("best is not null").select(*key, "best.rule", "best.score")


def resolve_property_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths (path), rules (idx, name, action) -> path, rule: the exact path, else the nearest ancestor, else '*'."""
    parts = F.split("path", r"\.")
    prefix = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.lower(F.array_join(F.slice(parts, F.lit(1), n), ".")).alias("name"))))
    each = paths.select("path", prefix.alias("p")).select("path", "p.depth", "p.name").unionByName(paths.select("path", F.lit(0).alias("depth"), F.lit("*").alias("name")))
    named = rules.select(F.lower("name").alias("name"), F.col("name").alias("rule"), "idx")
    rank = F.row_number().over(W.partitionBy("path").orderBy(F.desc("depth"), "idx"))
    return each.join(named, "name").withColumn("rank", rank).where("rank = 1").select("path", "rule")


def resolve_property_rule(rules: list[dict], path: str) -> dict | None:
    parts = path.lower().split(".")
    for n in range(len(parts), -1, -1):
        wanted = ".".join(parts[:n]) if n else "*"
        for rule in rules:
            if rule["name"].lower() == wanted:
                return rule
    return None


def action_allows(action: Column, old: Column, new: Column, target_updated: Column, changed: Column, is_default: Column) -> Column:
    """Whether a tracked change of a property goes through; no rule lets it through."""
    return (
        F.when(action.isNull() | (action == "AlwaysOverwrite"), True)
        .when(action == "OverwriteIfNewer", ~F.coalesce(target_updated > changed, F.lit(False)))
        .when(action == "OverwriteIfEmpty", old.isNull() | is_default)
        .when(action == "OverwriteIfNotEmpty", new.isNotNull())
        .when(action.isin("NeverOverwrite", "DoNotUpdate"), False)
        .otherwise(F.raise_error(F.concat(F.lit("unknown action "), action)))
    )


def allows(action: str | None, old: Any, new: Any, target_updated: Any, changed: Any, deletes: bool = False, unmatched: bool = True) -> bool:
    """The same for one value; `unmatched` is what holds without a rule (a first-time merge drops such properties)."""
    if action is None:
        return unmatched
    if action == "AlwaysOverwrite":
        return True
    if action == "OverwriteIfNewer":
        return not (target_updated is not None and changed is not None and target_updated > changed)
    if action == "OverwriteIfEmpty":
        return is_empty_value(old)
    if action == "OverwriteIfNotEmpty":
        return deletes or new is not None
    if action in ("NeverOverwrite", "DoNotUpdate"):
        return False
    raise ValueError(f"unknown action {action}")


def pre_merge_action(rules: list[tuple[str | None, str]]) -> Column:
    """rules: (SQL predicate or None for always, action) in order; the first that holds decides, None if none does."""
    out: Column | None = None
    for predicate, action in rules:
        when = F.expr(predicate) if predicate else F.lit(True)
        out = F.when(when, action) if out is None else out.when(when, action)
    return F.lit(None).cast("string") if out is None else out
