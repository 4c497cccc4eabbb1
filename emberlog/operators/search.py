"""Time-bounded search for the newest rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions.text import Fields, matches, message_like, search_text
from ..schema import HIGH_LEVELS, LOW_LEVELS
from .predicates import all_of, context_all, context_compat, levels_in, time_range


@dataclass(frozen=True)
class SearchRequest:
    low: datetime
    high: datetime
    levels: list[str] | None = None
    context: dict[str, str] = field(default_factory=dict)
    phrase: str | None = None
    take: int = 100

    def __post_init__(self):
        if self.take < 0:
            raise ValueError("take must not be negative")


def newest(rows: DataFrame, take: int) -> DataFrame:
    """The newest rows first; rows of one moment by id.  A per-partition top-N."""
    return rows.orderBy(F.col("timestamp").desc(), F.col("id")).limit(take)


def fields() -> Fields:
    return Fields(search_text(F.col("message"), F.col("context")), F.col("level"), F.col("context"))


def search_logs(logs: DataFrame, r: SearchRequest, strict_query: bool = True) -> DataFrame:
    """All conditions first, then the newest ``take`` rows over all levels."""
    return newest(
        logs.where(all_of(time_range(r.low, r.high), levels_in(r.levels), context_all(r.context), matches(r.phrase, fields(), strict_query))), r.take
    )


def read(logs: DataFrame, low: datetime, high: datetime, levels: list[str] | None, context: dict[str, str], take: int) -> DataFrame:
    """Search without a phrase; an empty list of levels means all."""
    return search_logs(logs, SearchRequest(low, high, levels or None, context, None, take))


def scan_and_search(logs: DataFrame, low: datetime, high: datetime, phrase: str, take: int) -> DataFrame:
    return search_logs(logs, SearchRequest(low, high, phrase=phrase, take=take))


def search_all(logs: DataFrame, phrase: str, strict_query: bool = True) -> DataFrame:
    """Every row that the phrase finds, of any time, in no order."""
    return logs.where(all_of(matches(phrase, fields(), strict_query)))


def search_tool(
    logs: DataFrame, low: datetime, high: datetime, application: str | None = None, version: str | None = None,
    phrase: str | None = None, levels: list[str] | None = None, take: int | None = None,
) -> DataFrame:
    """The newest rows in rising order; take is 1 to 1000, 100 if not given."""
    if high <= low:
        raise ValueError("the end must be after the start")
    context = {k: v.strip() for k, v in (("Application", application), ("Version", version)) if v and v.strip()}
    n = min(1000, max(1, 100 if take is None else take))
    found = search_logs(logs, SearchRequest(low, high, levels or None, context, phrase, n))
    return found.orderBy("timestamp", F.col("id").desc())


def two_tier_merge(logs: DataFrame, r: SearchRequest) -> DataFrame:
    """The newest rows of the high and of the low levels, merged.

    The same rows as one search; each tier gives its own newest first.
    """
    tiers = []
    for levels in (HIGH_LEVELS, LOW_LEVELS):
        wanted = [x for x in levels if r.levels is None or x in r.levels]
        if wanted:
            tiers.append(search_logs(logs, SearchRequest(r.low, r.high, wanted, r.context, r.phrase, r.take)))
    out = tiers[0]
    for t in tiers[1:]:
        out = out.unionByName(t)
    return newest(out, r.take)


def low_tier_compat(logs: DataFrame, r: SearchRequest) -> DataFrame:
    """Search of one low level as the tier answers it: the phrase is a substring
    of the message, and context pairs other than Application are tested only
    after the limit, so fewer rows than asked for may come back."""
    pushed, residual = context_compat(r.context)
    top = newest(
        logs.where(all_of(time_range(r.low, r.high), levels_in(r.levels), pushed, message_like(F.col("message"), r.phrase))), r.take
    )
    return top if residual is None else top.where(residual)


def level_first_compat(logs: DataFrame, r: SearchRequest) -> DataFrame:
    """Low levels read one after the other until ``take`` rows are there.

    Not the newest of all: with enough rows of the first level the second is
    never read.  Levels come in the order asked for, repeats included.
    """
    asked = [x for x in (r.levels if r.levels is not None else LOW_LEVELS) if x in LOW_LEVELS]
    parts = []
    for i, level in enumerate(asked):
        part = low_tier_compat(logs, SearchRequest(r.low, r.high, [level], r.context, r.phrase, r.take))
        parts.append(part.withColumn("__turn", F.lit(i)))
    if not parts:
        return logs.limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    first = out.orderBy("__turn", F.col("timestamp").desc(), "id").limit(r.take)
    return newest(first.drop("__turn"), r.take)
