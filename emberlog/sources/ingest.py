"""Wire formats of log events, parsed to items.

An item has id, timestamp, level, process, message and context; ``log_rows``
makes it a stored row.  ``now`` is always given, never read from a clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.levels import level_of_code, seq_level

# Reserved keys of a Seq record.
_SEQ_LEVEL, _SEQ_TIME, _SEQ_PROCESS = "@l", "@t", "Process"
_SEQ_MESSAGES = ("@m", "MessageTemplate", "@mt")
_SEQ_RESERVED = (_SEQ_LEVEL, _SEQ_TIME, _SEQ_PROCESS, *_SEQ_MESSAGES)


def read_seq(spark: SparkSession, path: str) -> DataFrame:
    """Seq bodies from files: column ``body``, a record for each line (CR, LF or CRLF).

    Files are read line by line, so large ones are split over tasks.
    """
    return spark.read.text(path).select(F.col("value").alias("body")).where(F.trim("body") != "")


def parse_seq(records: DataFrame, now: Column, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(items, rejected records) of one JSON object per row.

    The level has four exact names, anything else or none is FatalError; a
    time that is missing or cannot be read is ``now``; of several message keys
    the last in the document wins; other keys make the context, nulls are
    skipped.  Records without a message are rejected.
    """
    m = F.from_json(body, "map<string,string>", {"mode": "PERMISSIVE"})
    entries = F.map_entries("__m")
    message = F.element_at(F.filter(entries, lambda e: e["key"].isin(*_SEQ_MESSAGES) & e["value"].isNotNull()), -1)
    parsed = records.withColumn("__m", m).withColumn("__msg", F.when(F.size(F.filter(entries, lambda e: e["key"].isin(*_SEQ_MESSAGES) & e["value"].isNotNull())) > 0, message["value"]))
    bad = parsed.where("__msg IS NULL").select(*records.columns)
    time = F.coalesce(F.try_to_timestamp(F.col("__m").getItem(_SEQ_TIME)), now)
    items = parsed.where("__msg IS NOT NULL").select(
        item_id(time, F.col(body)).alias("id"),
        time.alias("timestamp"),
        seq_level(F.col("__m").getItem(_SEQ_LEVEL)).alias("level"),
        F.col("__m").getItem(_SEQ_PROCESS).alias("process"),
        F.col("__msg").alias("message"),
        F.map_filter("__m", lambda k, v: ~k.isin(*_SEQ_RESERVED) & v.isNotNull()).alias("context"),
    )
    return items, bad


def item_id(time: Column, content: Column) -> Column:
    """A sortable id: time first, then a hash of the content (stable under retries)."""
    return F.concat(F.lpad(F.hex(F.unix_micros(time)), 16, "0"), F.lit("-"), F.lpad(F.hex(F.xxhash64(content)), 16, "0"))


V2_SCHEMA = "array<struct<time_stamp:string,level:string,process:string,message:string,context:map<string,string>>>"


def parse_v2(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Items of JSON arrays, one body per row.

    A body with a time that cannot be read, or that is no such array, fails as
    a whole: the query stops with an error.
    """
    whole = bodies.withColumn("__a", F.from_json(body, V2_SCHEMA, {"mode": "FAILFAST"}))
    rows = whole.select(F.explode("__a").alias("e"))
    time = F.try_to_timestamp(F.col("e.time_stamp"))
    checked = F.when(time.isNull(), F.raise_error(F.concat(F.lit("invalid time_stamp: "), F.coalesce("e.time_stamp", F.lit("null")))).cast("timestamp")).otherwise(time)
    return rows.select(
        item_id(time, F.to_json("e")).alias("id"), checked.alias("timestamp"), F.col("e.level").alias("level"),
        F.col("e.process").alias("process"), F.col("e.message").alias("message"), F.col("e.context").alias("context"),
    )


def parse_wire_events(events: DataFrame) -> DataFrame:
    """Items of events as they come by RPC: Timestamp (micros), ProcessName,
    Message, Level (code), Ctx (array of Key, Value; the last of a key wins)."""
    time = F.timestamp_micros("Timestamp")
    n = F.size("Ctx")
    # keep the last entry of each key
    last = F.filter("Ctx", lambda e, i: ~F.exists(F.slice("Ctx", i + 2, F.greatest(n - i - 1, F.lit(0))), lambda x: x["Key"] == e["Key"]))
    ctx = F.map_from_entries(F.transform(last, lambda e: F.struct(e["Key"].alias("key"), e["Value"].alias("value"))))
    return events.select(
        item_id(time, F.concat_ws("|", "ProcessName", "Message", F.to_json("Ctx"))).alias("id"), time.alias("timestamp"),
        level_of_code(F.col("Level")).alias("level"), F.coalesce("ProcessName", F.lit("")).alias("process"), F.col("Message").alias("message"), ctx.alias("context"),
    )
