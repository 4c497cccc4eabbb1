"""Single-event suppression: skip the first K matches of a rule per window."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window, functions as F

_MINUTE = 60_000_000


@dataclass(frozen=True)
class SingleEventRule:
    """Rows of one of the levels whose message holds ``message_match`` (empty:
    any) and whose context holds, for every pair, the key with a value that
    contains the text.  An empty list of levels matches nothing."""

    id: str
    levels: tuple[str, ...]
    message_match: str = ""
    context_match: tuple[tuple[str, str], ...] = ()
    skip_amount: int = 1
    minutes_to_wait: int = 1


def rule_condition(rule: SingleEventRule) -> Column:
    if not rule.levels:
        return F.lit(False)
    parts = [F.col("level").isin(*rule.levels)]
    if rule.message_match:
        parts.append(F.col("message").contains(rule.message_match))
    parts += [F.col("context").getItem(k).contains(v) for k, v in rule.context_match]
    return F.coalesce(reduce(Column.__and__, parts), F.lit(False))


def first_rule(rules: list[SingleEventRule]) -> Column:
    """Number of the first rule in list order that matches, null if none."""
    out = F.when(F.lit(False), 0)
    for i, r in enumerate(rules):
        out = out.when(rule_condition(r), i)
    return out


def _by_rule(rules: list[SingleEventRule], value) -> Column:
    out = F.when(F.lit(False), F.lit(0).cast("bigint"))
    for i, r in enumerate(rules):
        out = out.when(F.col("__rule") == i, F.lit(value(r)).cast("bigint"))
    return out


def mark_suppressed(logs: DataFrame, rules: list[SingleEventRule]) -> DataFrame:
    """``logs`` with ``suppressed``.

    A row is suppressed if, itself included, at most ``skip_amount`` rows of
    its rule came in the last ``minutes_to_wait`` (by event time, then id;
    suppressed rows count).
    """
    return decide(logs.withColumn("__rule", first_rule(rules)), rules).drop("__rule")


def decide(tagged: DataFrame, rules: list[SingleEventRule]) -> DataFrame:
    """:func:`mark_suppressed` for rows that hold the number of their rule in ``__rule``.

    A rule may match a third of all rows, so its time is cut into slices of
    twice its own window; every row is sent to its own slice, and to the next
    as context if a window there can reach it.
    """
    free = tagged.where("__rule IS NULL").withColumn("suppressed", F.lit(False))
    if not rules:
        return free
    at = F.unix_micros("timestamp")
    wait = _by_rule(rules, lambda r: max(1, r.minutes_to_wait) * _MINUTE)
    own = F.floor(at / (2 * wait))
    reach = F.floor((at + wait) / (2 * wait))
    sliced = (
        tagged.where("__rule IS NOT NULL")
        .withColumns({"__at": at, "__own": own, "__slice": F.explode(F.sequence(own, reach))})
    )
    part = ("__rule", "__slice")
    peers = Window.partitionBy(*part, "__at")
    counted = sliced.withColumn("__later", F.count("*").over(peers) - F.row_number().over(peers.orderBy("id")))
    seen = F.lit(None).cast("bigint")
    for minutes in sorted({r.minutes_to_wait for r in rules}):
        frame = Window.partitionBy(*part).orderBy("__at").rangeBetween(-minutes * _MINUTE, 0)
        uses = [i for i, r in enumerate(rules) if r.minutes_to_wait == minutes]
        name = f"__seen{minutes}"
        counted = counted.withColumn(name, F.count("*").over(frame))
        seen = F.when(F.col("__rule").isin(*uses), F.col(name)).otherwise(seen)
    decided = counted.where("__slice = __own").withColumn("suppressed", seen - F.col("__later") <= _by_rule(rules, lambda r: r.skip_amount))
    return free.unionByName(decided.select(*free.columns))


def drop_suppressed(logs: DataFrame, rules: list[SingleEventRule]) -> DataFrame:
    return mark_suppressed(logs, rules).where("NOT suppressed").drop("suppressed")


class SuppressionModel:
    """The same decisions event by event, in plain Python; state per rule."""

    def __init__(self, rules: list[SingleEventRule]):
        self.rules, self.state = rules, {r.id: [] for r in rules}

    def matches(self, rule: SingleEventRule, level: str, message: str, context: dict) -> bool:
        return level in rule.levels and rule.message_match in message and all(v in context.get(k, "") and k in context for k, v in rule.context_match)

    def skip(self, micros: int, level: str, message: str, context: dict) -> bool:
        for r in self.rules:
            if self.matches(r, level, message, context):
                kept = [t for t in self.state[r.id] if t >= micros - r.minutes_to_wait * _MINUTE] + [micros]
                self.state[r.id] = kept[-(r.skip_amount + 1) :]
                return len(kept) <= r.skip_amount
        return False


class SingleEventRuleStore:
    """Rules in order, kept as JSON lines of a YAML-compatible list.

    Adding a rule of a known id replaces it and moves it to the end.
    """

    def __init__(self, path: str | None = None):
        self.path, self.rules = path, []
        if path and Path(path).exists():
            rows = json.loads(Path(path).read_text())
            self.rules = [SingleEventRule(**{**r, "levels": tuple(r["levels"]), "context_match": tuple(map(tuple, r["context_match"]))}) for r in rows]

    def _save(self) -> None:
        if self.path:
            Path(self.path).write_text(json.dumps([asdict(r) for r in self.rules], indent=1))

    def add(self, rule: SingleEventRule) -> None:
        self.rules = [r for r in self.rules if r.id != rule.id] + [rule]
        self._save()

    def delete(self, rule_id: str) -> bool:
        kept = [r for r in self.rules if r.id != rule_id]
        changed = len(kept) != len(self.rules)
        self.rules = kept
        self._save()
        return changed
