"""Result encodings and documents for an external index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.levels import glyph, wire_name
from ..functions.timekeys import iso

_PULLED = ("Application", "Version", "Process")
# The special document of a panic.
PANIC_PROCESS, PANIC_MESSAGE, PANIC_KEY, MISSING = "Panic Handler", "Auto panic handler", "Panic Message", "N/A"


def _sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def wire_rows(logs: DataFrame) -> DataFrame:
    """tenant_id, timestamp (micros), process_name, message, level, ctx (by key)."""
    rest = F.array_sort(F.map_entries(F.map_filter("context", lambda k, v: k != "Process")))
    return logs.select(
        F.lit("").alias("tenant_id"), F.unix_micros("timestamp").alias("timestamp"),
        F.coalesce(F.col("context").getItem("Process"), F.lit("")).alias("process_name"),
        "message", wire_name(F.col("level")).alias("level"), rest.alias("ctx"),
    )


def record_json(logs: DataFrame) -> DataFrame:
    """id, record: the tool's JSON, absent keys as null, context by key."""
    ctx = F.col("context")
    rest = _sorted_map(F.map_filter("context", lambda k, v: ~k.isin(*_PULLED)))
    record = F.struct(
        iso(F.col("timestamp")).alias("iso_time"), F.unix_micros("timestamp").alias("timestamp"), F.col("level"),
        ctx.getItem("Application").alias("application"), ctx.getItem("Version").alias("version"), ctx.getItem("Process").alias("process"),
        F.col("message"), rest.alias("context"),
    )
    return logs.select("id", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


def index_documents(items: DataFrame, env: str) -> DataFrame:
    """id, index_name, document: flat JSON for the external index.

    Base fields under the context entries, which win on a clash (the
    application is not among them).  A process with "Panic Handler" gives the
    special document.
    """
    ctx = F.coalesce("context", F.create_map().cast("map<string,string>"))
    app = F.coalesce(ctx.getItem("Application"), F.lit(MISSING))
    panic = F.coalesce(F.col("process").contains(PANIC_PROCESS), F.lit(False))
    base = F.create_map(
        F.lit("inner_id"), F.col("id"), F.lit("app"), app, F.lit("log_level"), F.col("level"),
        F.lit("message"), F.when(panic, PANIC_MESSAGE).otherwise(F.col("message")),
        F.lit("env_source"), F.upper(F.lit(env)),
        F.lit("process"), F.when(panic, PANIC_PROCESS).otherwise(F.coalesce("process", F.lit(MISSING))),
    )
    extra = F.map_filter(ctx, lambda k, v: k != "Application")
    under = F.map_filter(base, lambda k, v: ~F.map_contains_key(extra, k))
    on_top = F.when(panic, F.create_map(F.lit(PANIC_KEY), F.col("message"))).otherwise(F.create_map().cast("map<string,string>"))
    flat = F.map_concat(under, F.map_filter(extra, lambda k, v: ~F.map_contains_key(on_top, k)), on_top)
    date = F.expr("unix_micros(timestamp) div 1000")
    # the date is a number among strings
    text = F.to_json(_sorted_map(flat), {"ignoreNullFields": "false"})
    document = F.when(F.map_contains_key(extra, "date"), text).otherwise(F.concat(F.lit('{"date":'), date.cast("string"), F.lit(","), F.expr("substring(__t, 2)")))
    return items.withColumn("__t", text).select("id", F.lit(f"services_logs_{env.lower()}").alias("index_name"), document.alias("document"))


def _escaped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"[\x00-\x20]", " "), r"([_*\[\]()~`>#+\-=|{}.!])", r"\\$1")


def minute_alert_text(minutes: DataFrame, env: str, ui_url: str = "") -> DataFrame:
    """minute, text: the message of each minute with its counters."""
    link = f'<a href="{ui_url}">LogsUi</a>' if ui_url else ""
    text = F.concat(
        F.lit(f"---\n📊<b>EnvInfo</b>:{env}\n<b>Statistics of minute</b>: "), iso(F.col("minute")),
        F.lit("\n☠️<b>FatalErrors</b>: "), F.col("fatal_errors").cast("string"),
        F.lit("\n🟥<b>Errors</b>: "), F.col("errors").cast("string"),
        F.lit("\n⚠️<b>Warnings</b>: "), F.col("warnings").cast("string"), F.lit(f"\n{link}\n"),
    )
    return minutes.select("minute", text.alias("text"))


def item_alert_text(items: DataFrame, env: str) -> DataFrame:
    """id, text: the message for one event, escaped."""
    text = F.concat(
        F.lit("---\n"), iso(F.col("timestamp")), F.lit("\n"), glyph(F.col("level")), F.lit("\n<b>EnvInfo</b>:"), _escaped(F.lit(env)),
        F.lit("\n<b>Process</b>: "), _escaped(F.coalesce("process", F.lit(""))), F.lit("\n<b>Msg</b>: "), _escaped(F.col("message")),
        F.lit("\n```Context:\n"), F.regexp_replace(F.to_json(_sorted_map(F.col("context"))), "([`_])", r"\\$1"), F.lit("\n```\n"),
    )
    return items.select("id", text.alias("text"))
