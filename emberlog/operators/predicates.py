"""Conditions on log rows, and the partition bounds that go with them."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, functions as F

from ..functions.text import has_context
from ..functions.timekeys import key_of


def moment(value: datetime) -> Column:
    utc = value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value
    micros = round((utc - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds() * 1_000_000)
    return F.timestamp_micros(F.lit(micros).cast("bigint"))


def time_range(low: datetime, high: datetime) -> Column:
    """Both ends included.  The hour keys prune partitions, which Spark does
    not derive from the timestamp by itself."""
    return F.col("timestamp").between(moment(low), moment(high)) & F.col("hour_key").between(
        F.lit(key_of(low)).cast("bigint"), F.lit(key_of(high)).cast("bigint")
    )


def levels_in(levels: list[str] | None) -> Column | None:
    """None: all levels; an empty list: none."""
    if levels is None:
        return None
    return F.col("level").isin(*levels) if levels else F.lit(False)


def context_all(context: dict[str, str] | None) -> Column | None:
    """All pairs must be there, keys and values without regard to case.

    The hoisted columns serve application and version.
    """
    parts = []
    for k, v in (context or {}).items():
        hoisted = {"application": "application", "version": "version"}.get(k.lower())
        if hoisted and k in ("Application", "Version"):
            parts.append((F.lower(F.col(hoisted)) == v.lower()) | has_context(F.col("context"), k, v))
        else:
            parts.append(has_context(F.col("context"), k, v))
    return reduce(Column.__and__, parts) if parts else None


def context_compat(context: dict[str, str]) -> tuple[Column | None, Column | None]:
    """(pushed, residual) conditions of the low tier: ``Application`` exactly;
    other keys exactly with values without regard to ASCII case."""
    ctx = dict(context)
    app = ctx.pop("Application", None)
    pushed = (F.coalesce("application", F.lit("")) == app) if app is not None else None
    rest = [F.lower(F.col("context").getItem(k)) == v.lower() for k, v in ctx.items()]
    return pushed, (reduce(Column.__and__, rest) if rest else None)


def all_of(*parts: Column | None) -> Column:
    given = [p for p in parts if p is not None]
    return reduce(Column.__and__, given) if given else F.lit(True)
