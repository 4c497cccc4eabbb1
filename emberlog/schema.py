"""The canonical log row.

A log row has id, timestamp (UTC, microseconds), level, message and a string
map ``context`` that includes "Process".  ``hour_key`` (YYYYMMDDHH in UTC) and
``level`` partition stored tables; ``application`` and ``version`` are hoisted
from the context so that scans can skip row groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .functions.timekeys import hour_key

# Names of the five levels, in the order of their wire codes.
LEVELS = ("Info", "Warning", "Error", "FatalError", "Debug")
HIGH_LEVELS = ("Warning", "Error", "FatalError")
LOW_LEVELS = ("Debug", "Info")

PROCESS, APPLICATION, VERSION = "Process", "Application", "Version"

LOG_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("timestamp", T.TimestampType(), False),
        T.StructField("message", T.StringType()),
        T.StructField("context", T.MapType(T.StringType(), T.StringType())),
        T.StructField("application", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("hour_key", T.LongType()),
    ]
)


def fold_process(process: Column, context: Column) -> Column:
    """``context`` with the process under "Process", which wins over an own entry.

    A null process leaves the context as it is; null contexts count as empty.
    """
    ctx = F.coalesce(context, F.create_map().cast("map<string,string>"))
    rest = F.map_filter(ctx, lambda k, v: k != PROCESS)
    return F.when(process.isNull(), ctx).otherwise(F.map_concat(rest, F.create_map(F.lit(PROCESS), process)))


def log_rows(df: DataFrame) -> DataFrame:
    """Rows of ``LOG_SCHEMA`` from id, timestamp, level, process, message, context."""
    return (
        df.withColumn("context", fold_process(F.col("process"), F.col("context")))
        .withColumns(
            {
                "application": F.col("context").getItem(APPLICATION),
                "version": F.col("context").getItem(VERSION),
                "hour_key": hour_key(F.col("timestamp")),
            }
        )
        .select(*LOG_SCHEMA.names)
    )
