"""The stored log table: Parquet by level and hour."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import LOG_SCHEMA


def write_logs(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Rows of an hour and level in few files, sorted so that row groups can be skipped.

    Rows are first brought together by partition; a level and hour that is too
    large for one task is split by Spark (rebalance).
    """
    placed = rows.hint("rebalance", "level", "hour_key").sortWithinPartitions("level", "hour_key", "application", "timestamp")
    placed.write.mode(mode).partitionBy("level", "hour_key").parquet(path)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """With the schema given: inference would read hour keys as integers."""
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def drop_partitions(spark: SparkSession, path: str, expired: DataFrame) -> int:
    """Deletes the folders of ``expired`` (level, hour_key) partitions of a stored
    table, in every micro-batch if a stream wrote it.

    Returns how many were there.  Keys are bounded by hours times levels.
    """
    jvm, dropped = spark._jvm, 0
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for level, key in expired.select("level", "hour_key").distinct().collect():
        for under in (path, f"{path}/batch=*"):
            for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{under}/level={level}/hour_key={key}")) or ():
                dropped += fs.delete(found.getPath(), True)
    return dropped


def write_rollup_snapshot(snapshot: DataFrame, path: str) -> None:
    snapshot.write.mode("overwrite").json(path)


def read_rollup_snapshot(spark: SparkSession, path: str) -> DataFrame:
    counters = "struct<info:bigint,warning:bigint,error:bigint,fatal_error:bigint,debug:bigint>"
    return spark.read.schema(f"hour bigint, apps map<string,{counters}>").json(path)
