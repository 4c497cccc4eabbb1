"""Distinct context values of configured keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Longest value kept, in bytes of UTF-8.
MAX_VALUE_BYTES = 1024
LOOKUP_ROWS = 20


def distinct_values(logs: DataFrame, keys: list[str]) -> DataFrame:
    """key, value, first_at, first_id: each value with the first row that had it."""
    entries = F.filter(F.map_entries("context"), lambda e: e["key"].isin(*keys) & (F.octet_length(e["value"]) <= MAX_VALUE_BYTES))
    return (
        logs.select("timestamp", "id", F.explode(entries).alias("e"))
        .groupBy(F.col("e.key").alias("key"), F.col("e.value").alias("value"))
        .agg(F.min(F.struct("timestamp", "id")).alias("first"))
        .select("key", "value", F.col("first.timestamp").alias("first_at"), F.col("first.id").alias("first_id"))
    )


def lookup(values: DataFrame, key: str, phrase: str, rows: int = LOOKUP_ROWS) -> DataFrame:
    """Values of a key that contain the phrase (case-sensitive), first seen first."""
    return values.where((F.col("key") == key) & F.col("value").contains(phrase)).orderBy("first_at", "first_id").limit(rows)


def keys(values: DataFrame) -> DataFrame:
    """The keys that have values, each once."""
    return values.select("key").distinct()
