"""Hour keys (YYYYMMDDHH, UTC) and the hours and minutes that times fall into."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, functions as F


def hour_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMddHH").cast("bigint")


def minute_of(ts: Column) -> Column:
    return F.date_trunc("minute", ts)


def key_of(moment: datetime) -> int:
    """Hour key of a driver-side moment; naive moments are UTC."""
    if moment.tzinfo:
        moment = moment.astimezone(timezone.utc)
    return int(moment.strftime("%Y%m%d%H"))


def parse_key(text: str) -> int | None:
    """Hour key from text: exactly ten digits that name an hour, else None."""
    if len(text) != 10 or not text.isdigit():
        return None
    try:
        datetime.strptime(text, "%Y%m%d%H")
    except ValueError:
        return None
    return int(text)


def key_bounds(key: int) -> tuple[datetime, datetime] | None:
    """First moment of the hour and of the next one; searches include both."""
    if parse_key(f"{key:010d}") is None:
        return None
    start = datetime.strptime(f"{key:010d}", "%Y%m%d%H").replace(tzinfo=timezone.utc)
    return start, start + timedelta(hours=1)


def iso(ts: Column) -> Column:
    """RFC 3339 with microseconds and a numeric offset."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
