"""The driver's tables seen as logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import log_rows

# Which level an event type stands for.
EVENT_LEVELS = {"click": "Info", "view": "Debug", "purchase": "Warning", "error": "Error", "signup": "FatalError"}


#: ``ts`` is stored without a zone and read as UTC; read so, conditions on it reach the scan.
EVENTS_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(f"{sf_dir}/events.parquet")


def events_as_items(events: DataFrame) -> DataFrame:
    """id, timestamp, level, process, message, context of each event."""
    user = F.col("user_id")
    level = F.create_map(*[F.lit(x) for kv in EVENT_LEVELS.items() for x in kv]).getItem(F.col("event_type"))
    return events.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        level.alias("level"),
        F.concat(F.lit("proc-"), (user % 3).cast("string")).alias("process"),
        F.concat("event_type", F.lit(" by user "), user.cast("string"), F.lit(" props "), "props").alias("message"),
        F.create_map(
            F.lit("Application"), F.concat(F.lit("App-"), (user % 5).cast("string")),
            F.lit("Version"), F.concat(F.lit("1."), (user % 3).cast("string"), F.lit(".0")),
            F.lit("K"), F.get_json_object("props", "$.k"),
        ).alias("context"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_rows(events_as_items(read_events(spark, sf_dir)))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as logs, one a minute from 2024 on, for full text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    level = F.element_at(F.array(*[F.lit(x) for x in ("Info", "Warning", "Error", "FatalError", "Debug")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return log_rows(
        docs.select(
            F.col("doc_id").cast("string").alias("id"),
            (F.timestamp_micros(F.lit(1704067200000000) + F.col("doc_id") * 60000000)).alias("timestamp"),
            level.alias("level"),
            F.lit(None).cast("string").alias("process"),
            F.col("text").alias("message"),
            F.create_map(F.lit("Application"), "source", F.lit("Version"), "lang").alias("context"),
        )
    )
