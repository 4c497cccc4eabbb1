"""Decoding of request times and tool arguments."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame

from ..functions.levels import parse_level
from ..functions.timekeys import key_bounds, key_of
from ..operators.search import SearchRequest, search_logs, search_tool

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def is_ui_url(url: str) -> bool:
    """Only https addresses are taken as the address of the user interface."""
    return url.startswith("https")


def decode_range(from_time: int, to_time: int, now: datetime) -> tuple[datetime, datetime] | None:
    """(low, high), both included, or None for an empty range.

    With ``to_time`` 0, a ``from_time`` of 0 or less means the hour that many
    hours from now, and a positive one is an hour key; otherwise both are
    microseconds.
    """
    if to_time == 0:
        return key_bounds(key_of(now + timedelta(hours=from_time)) if from_time <= 0 else from_time)
    if from_time > to_time:
        return None
    return _EPOCH + timedelta(microseconds=from_time), _EPOCH + timedelta(microseconds=to_time)


def read_request(logs: DataFrame, from_time: int, to_time: int, now: datetime, levels: list[str], context: list[tuple[str, str]], take: int, phrase: str | None = None) -> DataFrame:
    bounds = decode_range(from_time, to_time, now)
    if bounds is None:
        return logs.limit(0)
    return search_logs(logs, SearchRequest(*bounds, levels or None, dict(context), phrase, take))


def tool_request(logs: DataFrame, from_date: str, to_date: str, levels: list[str] | None = None, **kwargs) -> DataFrame:
    """The search tool with ISO dates and level names as text."""
    low, high = (datetime.fromisoformat(x) for x in (from_date, to_date))
    return search_tool(logs, low, high, levels=[parse_level(x) for x in levels] if levels else None, **kwargs)
