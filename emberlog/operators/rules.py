"""Ignore rules: expiring anti-filters on log rows."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.levels import parse_level

ANY = "*"
#: Rules that are broadcast at once.
RULES_IN_A_BLOCK = 20_000


@dataclass(frozen=True)
class IgnoreRule:
    """Drops rows of a level and application whose process or message holds the marker."""

    level: str
    application: str
    marker: str
    expires_at: int | None = None  # microseconds

    def key(self) -> tuple[str, str, str]:
        return self.level, self.application, self.marker

    def expired(self, now: int) -> bool:
        return self.expires_at is not None and self.expires_at <= now


def rule_matches(rule: IgnoreRule, strict: bool = True) -> Column:
    """Condition that a row falls under the rule (case-sensitive substrings).

    ``strict=False``: the level is not looked at and an application ``*`` is a name.
    """
    parts = []
    if strict:
        parts.append(F.col("level") == rule.level)
    if not (strict and rule.application == ANY):
        parts.append(F.col("application") == rule.application)
    if rule.marker != ANY:
        process = F.col("context").getItem("Process")
        parts.append(F.coalesce(process.contains(rule.marker), F.lit(False)) | F.coalesce(F.col("message").contains(rule.marker), F.lit(False)))
    return F.coalesce(reduce(Column.__and__, parts, F.lit(True)), F.lit(False))


def ignored(rules: list[IgnoreRule], now: int, strict: bool = True) -> Column:
    live = [rule_matches(r, strict) for r in rules if not r.expired(now)]
    return reduce(Column.__or__, live) if live else F.lit(False)


def filter_ignored(logs: DataFrame, rules: list[IgnoreRule], now: int, strict: bool = True) -> DataFrame:
    """Rows that no live rule matches.  A handful of rules: one pass, no join."""
    return logs.where(~ignored(rules, now, strict))


def filter_ignored_table(logs: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """As :func:`filter_ignored` for many rules in a table (level, application,
    marker, expires_at): anti-joins with broadcast blocks of rules.

    A level is no key to shuffle by, as there are five.  Rules are counted
    first; beyond ``RULES_IN_A_BLOCK`` they are dealt to blocks by hash, and
    rows pass one block after the other.
    """
    live = rules.where((F.col("expires_at").isNull()) | (F.col("expires_at") > now)).select(
        F.col("level").alias("r_level"), F.col("application").alias("r_app"), F.col("marker").alias("r_marker")
    ).distinct()
    blocks = max(1, -(-live.count() // RULES_IN_A_BLOCK))
    process = F.coalesce(F.col("context").getItem("Process"), F.lit(""))
    hit = (
        (F.col("level") == F.col("r_level"))
        & ((F.col("r_app") == ANY) | (F.col("application") == F.col("r_app")))
        & ((F.col("r_marker") == ANY) | process.contains(F.col("r_marker")) | F.coalesce("message", F.lit("")).contains(F.col("r_marker")))
    )
    for i in range(blocks):
        block = live.where(F.pmod(F.xxhash64("r_level", "r_app", "r_marker"), F.lit(blocks)) == i) if blocks > 1 else live
        logs = logs.join(F.broadcast(block), hit, "left_anti")
    return logs


def current_rules(changes: DataFrame, now: int) -> DataFrame:
    """Live rules of a change log (seq, action, level, application, marker, expires_at).

    The last change of a (level, application, marker) counts; "delete" removes.
    """
    last = Window.partitionBy("level", "application", "marker").orderBy(F.col("seq").desc())
    return (
        changes.withColumn("__n", F.row_number().over(last))
        .where((F.col("__n") == 1) & (F.col("action") == "upsert") & (F.col("expires_at").isNull() | (F.col("expires_at") > now)))
        .select("level", "application", "marker", "expires_at")
    )


class IgnoreRuleStore:
    """Rules kept in order in a JSON file; a file that cannot be read is empty."""

    def __init__(self, path: str | None = None):
        self.path, self.rules = path, []
        if path:
            try:
                self.rules = [IgnoreRule(**r) for r in json.loads(Path(path).read_text())]
            except (OSError, ValueError, TypeError):
                self.rules = []

    def _save(self) -> None:
        if self.path:
            Path(self.path).write_text(json.dumps([asdict(r) for r in self.rules]))

    def live(self, now: int) -> list[IgnoreRule]:
        """Rules not expired; expired ones are removed for good."""
        kept = [r for r in self.rules if not r.expired(now)]
        if len(kept) != len(self.rules):
            self.rules = kept
            self._save()
        return list(kept)

    def upsert(self, rule: IgnoreRule) -> bool:
        """Adds the rule or sets a new expiry; False if nothing changed."""
        for i, r in enumerate(self.rules):
            if r.key() == rule.key():
                if r.expires_at == rule.expires_at:
                    return False
                self.rules[i] = replace(r, expires_at=rule.expires_at)
                break
        else:
            self.rules.append(rule)
        self._save()
        return True

    def add(self, level: str, application: str, marker: str, now: int, expires_in_minutes: int | None = None) -> IgnoreRule:
        """As the tool does it: lenient level, expiry in minutes from now."""
        if expires_in_minutes is not None and expires_in_minutes <= 0:
            raise ValueError("expires_in_minutes must be positive")
        expires = None if expires_in_minutes is None else now + expires_in_minutes * 60_000_000
        rule = IgnoreRule(parse_level(level), application, marker, expires)
        self.upsert(rule)
        return rule

    def delete(self, level: str, application: str, marker: str) -> bool:
        kept = [r for r in self.rules if r.key() != (level, application, marker)]
        changed = len(kept) != len(self.rules)
        if changed:
            self.rules = kept
            self._save()
        return changed
