"""Counters by level: current hour, hour and application, minute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timekeys import minute_of
from ..schema import LEVELS

# Counter names of the levels.
COUNTERS = {"Info": "info", "Warning": "warning", "Error": "error", "FatalError": "fatal_error", "Debug": "debug"}
#: Hours with data that the rollup keeps.
KEPT_HOURS = 48


def _counters(levels=LEVELS) -> list[Column]:
    return [F.count_if(F.col("level") == x).alias(COUNTERS[x]) for x in levels]


def level_counts(logs: DataFrame, hour: int) -> DataFrame:
    """One row: the five counters of an hour, zero where there is nothing."""
    return logs.where(F.col("hour_key") == F.lit(hour).cast("bigint")).agg(*_counters())


def hourly(logs: DataFrame) -> DataFrame:
    """hour_key, application, five counters; rows without an application are left out."""
    return logs.where("application IS NOT NULL").groupBy("hour_key", "application").agg(*_counters())


def merge_hourly(parts: DataFrame) -> DataFrame:
    """Adds up partial hourly rollups."""
    return parts.groupBy("hour_key", "application").agg(*[F.sum(c).alias(c) for c in COUNTERS.values()])


def last_hours(rollup: DataFrame, n: int) -> DataFrame:
    """Rows of the newest ``n`` hours that have data; all if ``n`` is negative.

    The newest hours are found by a top-N of distinct keys, at most n rows.
    """
    if n < 0:
        return rollup
    newest = rollup.select("hour_key").distinct().orderBy(F.col("hour_key").desc()).limit(n)
    return rollup.join(newest, "hour_key", "left_semi")


def retained(rollup: DataFrame) -> DataFrame:
    return last_hours(rollup, KEPT_HOURS)


def clamp_hours(hours: int | None) -> int:
    return min(48, max(1, 24 if hours is None else hours))


def dashboard_totals(rollup: DataFrame, hours: int | None = None) -> DataFrame:
    """One row of grand totals over the newest hours (1 to 48, 24 if not given)."""
    return last_hours(rollup, clamp_hours(hours)).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(f"total_{c}") for c in COUNTERS.values()])


def dashboard_buckets(rollup: DataFrame, hours: int | None = None) -> DataFrame:
    """hour_key, applications: an array per hour, applications by name."""
    item = F.struct("application", *COUNTERS.values())
    return last_hours(rollup, clamp_hours(hours)).groupBy("hour_key").agg(F.array_sort(F.collect_list(item)).alias("applications"))


def rollup_snapshot(rollup: DataFrame) -> DataFrame:
    """hour, apps: the persisted form, a map of counters by application per hour."""
    entry = F.struct(F.col("application"), F.struct(*COUNTERS.values()))
    return rollup.groupBy(F.col("hour_key").alias("hour")).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("apps"))


def restore_rollup(snapshot: DataFrame) -> DataFrame:
    """The rollup of a snapshot; hours without applications give nothing."""
    return snapshot.select(F.col("hour").alias("hour_key"), F.explode("apps").alias("application", "c")).select("hour_key", "application", "c.*")


def minute_counts(logs: DataFrame) -> DataFrame:
    """minute, fatal_errors, errors, warnings of minutes that have any of them."""
    named = {"FatalError": "fatal_errors", "Error": "errors", "Warning": "warnings"}
    return (
        logs.where(F.col("level").isin(*named))
        .groupBy(minute_of(F.col("timestamp")).alias("minute"))
        .agg(*[F.count_if(F.col("level") == k).alias(v) for k, v in named.items()])
    )


def minute_alerts(logs: DataFrame) -> DataFrame:
    """Minutes worth an alert: any error or fatal error."""
    return minute_counts(logs).where("errors + fatal_errors > 0")
