"""Level-aware retention."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timekeys import key_of
from ..schema import HIGH_LEVELS
from .predicates import moment


@dataclass(frozen=True)
class Retention:
    high_hours: int = 24 * 30
    debug_minutes: int = 60
    info_minutes: int = 120
    #: Rows of this age and level go one by one, None: they do not.
    warning_hours: int | None = None


def expired_partition(now: datetime, r: Retention) -> Column:
    """Whether a (level, hour_key) partition goes.  High levels go up to and
    including the key of the cutoff, low levels only before it."""
    high = key_of(now - timedelta(hours=r.high_hours))
    debug = key_of(now - timedelta(minutes=r.debug_minutes))
    info = key_of(now - timedelta(minutes=r.info_minutes))
    key = F.col("hour_key")
    return (
        F.when(F.col("level").isin(*HIGH_LEVELS), key <= F.lit(high).cast("bigint"))
        .when(F.col("level") == "Debug", key < F.lit(debug).cast("bigint"))
        .when(F.col("level") == "Info", key < F.lit(info).cast("bigint"))
        .otherwise(F.lit(False))
    )


def survivors(logs: DataFrame, now: datetime, r: Retention) -> DataFrame:
    """Rows that stay."""
    out = logs.where(~expired_partition(now, r))
    if r.warning_hours is not None:
        old = (F.col("level") == "Warning") & (F.col("timestamp") <= moment(now - timedelta(hours=r.warning_hours)))
        out = out.where(~old)
    return out


def expired_partitions(logs: DataFrame, now: datetime, r: Retention) -> DataFrame:
    """level, hour_key, n_rows of partitions to drop."""
    return logs.where(expired_partition(now, r)).groupBy("level", "hour_key").agg(F.count("*").alias("n_rows"))
