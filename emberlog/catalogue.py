"""Registered queries of the log engine over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions.text import message_like
from .functions.timekeys import iso
from .operators import insights, retention, rollups, rules, search, suppression
from .plans import requests
from .schema import fold_process
from .sinks import results, tables
from .sources import driver_tables, ingest
from .storage import fresh_dir
from .streaming import pipeline

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

UTC = timezone.utc
LOW, HIGH = datetime(2024, 1, 10, tzinfo=UTC), datetime(2024, 1, 20, tzinfo=UTC)
NOW = datetime(2024, 1, 20, 12, 30, tzinfo=UTC)
NOW_MICROS = int(NOW.timestamp()) * 1_000_000

_LOGS = """WITH logs AS (
  SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS id, ts, epoch_us(ts) AS moment,
    CASE event_type WHEN 'click' THEN 'Info' WHEN 'view' THEN 'Debug' WHEN 'purchase' THEN 'Warning' WHEN 'error' THEN 'Error' WHEN 'signup' THEN 'FatalError' END AS level,
    'proc-' || CAST(user_id % 3 AS VARCHAR) AS process,
    event_type || ' by user ' || CAST(user_id AS VARCHAR) || ' props ' || props AS message,
    'App-' || CAST(user_id % 5 AS VARCHAR) AS application, '1.' || CAST(user_id % 3 AS VARCHAR) || '.0' AS version,
    json_extract_string(props, '$.k') AS k, CAST(strftime(ts, '%Y%m%d%H') AS BIGINT) AS hour_key
  FROM events),
texts AS (SELECT *, lower(concat_ws(' ', message, application, k, process, version)) AS text FROM logs)
"""
_DOCS = """WITH d AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, 1704067200000000 + doc_id * 60000000 AS moment,
    CASE doc_id % 5 WHEN 0 THEN 'Info' WHEN 1 THEN 'Warning' WHEN 2 THEN 'Error' WHEN 3 THEN 'FatalError' ELSE 'Debug' END AS level,
    source AS application, lang, text AS message, lower(concat_ws(' ', text, source, lang)) AS text FROM documents),
docs AS (SELECT *, regexp_extract_all(text, '[\\p{L}\\p{N}]+') AS tokens FROM d)
"""
_COLS = "id, moment, level, application, process, message"
_COUNTS = """count(*) FILTER (level = 'Info') AS info, count(*) FILTER (level = 'Warning') AS warning, count(*) FILTER (level = 'Error') AS error,
  count(*) FILTER (level = 'FatalError') AS fatal_error, count(*) FILTER (level = 'Debug') AS debug"""
_RANGE = "ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return driver_tables.events(spark, sf_dir)


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.unix_micros("timestamp").alias("moment"), "level", "application", F.col("context").getItem("Process").alias("process"), "message")


def _doc_rows(rows: DataFrame) -> DataFrame:
    return rows.select("id", F.unix_micros("timestamp").alias("moment"), "level", "application")


# ------------------------------------------------------------------ search


@query(_LOGS + f"SELECT {_COLS} FROM logs WHERE {_RANGE} ORDER BY ts DESC, id LIMIT 100")
def search_time_range(spark, sf_dir):
    return _shown(search.search_logs(_events(spark, sf_dir), search.SearchRequest(LOW, HIGH)))


@query(_LOGS + f"SELECT {_COLS} FROM logs WHERE ts BETWEEN TIMESTAMP '2024-01-15 05:00:00' AND TIMESTAMP '2024-01-15 06:00:00' ORDER BY ts DESC, id LIMIT 1000")
def search_hour_key(spark, sf_dir):
    return _shown(requests.read_request(_events(spark, sf_dir), 2024011505, 0, NOW, [], [], 1000))


@query(_LOGS + f"SELECT {_COLS} FROM logs WHERE ts BETWEEN TIMESTAMP '2024-01-20 09:00:00' AND TIMESTAMP '2024-01-20 10:00:00' ORDER BY ts DESC, id LIMIT 1000")
def search_hours_ago(spark, sf_dir):
    return _shown(requests.read_request(_events(spark, sf_dir), -3, 0, NOW, [], [], 1000))


@query(_LOGS + f"SELECT {_COLS} FROM logs WHERE {_RANGE} AND level IN ('Error', 'FatalError') ORDER BY ts DESC, id LIMIT 200")
def search_levels(spark, sf_dir):
    return _shown(search.read(_events(spark, sf_dir), LOW, HIGH, ["Error", "FatalError"], {}, 200))


@query(_LOGS + f"SELECT {_COLS} FROM logs WHERE {_RANGE} AND lower(application) = 'app-2' ORDER BY ts DESC, id LIMIT 200")
def search_context(spark, sf_dir):
    return _shown(search.read(_events(spark, sf_dir), LOW, HIGH, None, {"Application": "app-2"}, 200))


@query(_LOGS + f"SELECT {_COLS} FROM logs WHERE {_RANGE} AND lower(application) = 'app-2' AND version = '1.1.0' AND k = '7' ORDER BY ts DESC, id LIMIT 200")
def search_context_multi(spark, sf_dir):
    return _shown(search.read(_events(spark, sf_dir), LOW, HIGH, None, {"APPLICATION": "App-2", "Version": "1.1.0", "k": "7"}, 200))


@query(_LOGS + f"SELECT {_COLS} FROM (SELECT * FROM logs WHERE {_RANGE} AND level = 'Info' AND application = 'App-2' ORDER BY ts DESC, id LIMIT 100) WHERE lower(version) = '1.1.0'")
def search_context_compat(spark, sf_dir):
    r = search.SearchRequest(LOW, HIGH, ["Info"], {"Application": "App-2", "Version": "1.1.0"}, None, 100)
    return _shown(search.low_tier_compat(_events(spark, sf_dir), r))


def _text_query(name: str, phrase: str, condition: str) -> None:
    def run(spark, sf_dir):
        return _doc_rows(search.search_all(driver_tables.documents(spark, sf_dir), phrase))

    run.__name__ = name
    query(_DOCS + f"SELECT id, moment, level, application FROM docs WHERE {condition}")(run)


_text_query("search_term", "license", "list_contains(tokens, 'license')")
_text_query("search_any_word", "license trash", "list_contains(tokens, 'license') OR list_contains(tokens, 'trash')")
_text_query("search_phrase", '"mit license"', "contains(' ' || array_to_string(tokens, ' ') || ' ', ' mit license ')")
_text_query("search_prefix", "licen*", "len(list_filter(tokens, lambda x: starts_with(x, 'licen'))) > 0")
_text_query(
    "search_boolean", '(license OR token) AND NOT apache AND level:error',
    "(list_contains(tokens, 'license') OR list_contains(tokens, 'token')) AND NOT list_contains(tokens, 'apache') AND level = 'Error'",
)
_text_query("search_must", "+license -mit +ctx:version=EN", "list_contains(tokens, 'license') AND NOT list_contains(tokens, 'mit') AND lang = 'en'")


@query(_DOCS + "SELECT id, moment, level, application FROM docs WHERE lower(message) LIKE '%licen%'")
def search_substring(spark, sf_dir):
    docs = driver_tables.documents(spark, sf_dir)
    return _doc_rows(docs.where(message_like(F.col("message"), " Licen ")))


_COMBINED = f"{_RANGE} AND level IN ('Error', 'FatalError') AND lower(application) = 'app-1' AND list_contains(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), 'user') AND NOT list_contains(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+'), '13')"


@query(_LOGS + f"SELECT {_COLS} FROM texts WHERE {_COMBINED} ORDER BY ts DESC, id LIMIT 100")
def search_combined(spark, sf_dir):
    r = search.SearchRequest(LOW, HIGH, ["Error", "FatalError"], {"Application": "app-1"}, "user AND NOT 13", 100)
    return _shown(search.search_logs(_events(spark, sf_dir), r))


@query(ORACLE_SQL["search_combined"])
def stored_search(spark, sf_dir):
    path = fresh_dir(spark, "stored")
    tables.write_logs(_events(spark, sf_dir), path)
    r = search.SearchRequest(LOW, HIGH, ["Error", "FatalError"], {"Application": "app-1"}, "user AND NOT 13", 100)
    return _shown(search.search_logs(tables.read_logs(spark, path), r))


@query(_LOGS + f"SELECT {_COLS} FROM (SELECT * FROM logs WHERE {_RANGE} AND lower(application) = 'app-3' AND level = 'Warning' ORDER BY ts DESC, id LIMIT 50) ORDER BY ts")
def search_tool_asc(spark, sf_dir):
    return _shown(requests.tool_request(_events(spark, sf_dir), "2024-01-10T00:00:00+00:00", "2024-01-20T00:00:00Z", ["warn"], application=" App-3 ", take=50))


@query(_LOGS + f"""SELECT {_COLS} FROM (
  (SELECT * FROM logs WHERE {_RANGE} AND level IN ('Warning', 'Error', 'FatalError') ORDER BY ts DESC, id LIMIT 150) UNION ALL
  (SELECT * FROM logs WHERE {_RANGE} AND level IN ('Debug', 'Info') ORDER BY ts DESC, id LIMIT 150)) ORDER BY ts DESC, id LIMIT 150""")
def search_two_tier_merge(spark, sf_dir):
    return _shown(search.two_tier_merge(_events(spark, sf_dir), search.SearchRequest(LOW, HIGH, take=150)))


@query(_LOGS + f"""SELECT {_COLS} FROM (
  SELECT * FROM ((SELECT 0 AS turn, * FROM logs WHERE {_RANGE} AND level = 'Debug' ORDER BY ts DESC, id LIMIT 3000) UNION ALL
  (SELECT 1 AS turn, * FROM logs WHERE {_RANGE} AND level = 'Info' ORDER BY ts DESC, id LIMIT 3000)) ORDER BY turn, ts DESC, id LIMIT 3000)""")
def search_level_first_compat(spark, sf_dir):
    return _shown(search.level_first_compat(_events(spark, sf_dir), search.SearchRequest(LOW, HIGH, take=3000)))


# ------------------------------------------------------------------ rollups


@query(_LOGS + f"SELECT {_COUNTS} FROM logs WHERE hour_key = 2024012012")
def level_counts_hour(spark, sf_dir):
    return rollups.level_counts(_events(spark, sf_dir), 2024012012)


@query(_LOGS + f"SELECT hour_key, application, {_COUNTS} FROM logs GROUP BY ALL")
def hourly_stats(spark, sf_dir):
    return rollups.hourly(_events(spark, sf_dir))


_LAST = _LOGS + f", h AS (SELECT hour_key, application, {_COUNTS} FROM logs GROUP BY ALL), r AS (SELECT *, dense_rank() OVER (ORDER BY hour_key DESC) AS n FROM h) "


@query(_LAST + "SELECT * EXCLUDE n FROM r WHERE n <= 12")
def hourly_stats_last_n(spark, sf_dir):
    return rollups.last_hours(rollups.hourly(_events(spark, sf_dir)), 12)


@query(_LAST + "SELECT * EXCLUDE n FROM r WHERE n <= 48")
def hourly_stats_retained(spark, sf_dir):
    return rollups.retained(rollups.hourly(_events(spark, sf_dir)))


@query(_LAST + """SELECT CAST(sum(info) AS BIGINT) AS total_info, CAST(sum(warning) AS BIGINT) AS total_warning, CAST(sum(error) AS BIGINT) AS total_error,
  CAST(sum(fatal_error) AS BIGINT) AS total_fatal_error, CAST(sum(debug) AS BIGINT) AS total_debug FROM r WHERE n <= 24""")
def dashboard_totals(spark, sf_dir):
    return rollups.dashboard_totals(rollups.hourly(_events(spark, sf_dir)))


@query(_LAST + """SELECT hour_key, '[' || string_agg('{"application":"' || application || '","info":' || info || ',"warning":' || warning || ',"error":' || error
  || ',"fatal_error":' || fatal_error || ',"debug":' || debug || '}', ',' ORDER BY application) || ']' AS applications FROM r WHERE n <= 24 GROUP BY hour_key""")
def dashboard_buckets(spark, sf_dir):
    found = rollups.dashboard_buckets(rollups.hourly(_events(spark, sf_dir)))
    return found.select("hour_key", F.to_json("applications").alias("applications"))


@query(_LAST + "SELECT * EXCLUDE n FROM r")
def rollup_round_trip(spark, sf_dir):
    return rollups.restore_rollup(rollups.rollup_snapshot(rollups.hourly(_events(spark, sf_dir))))


@query(_LOGS + """SELECT epoch_us(date_trunc('minute', ts)) AS minute, count(*) FILTER (level = 'FatalError') AS fatal_errors, count(*) FILTER (level = 'Error') AS errors,
  count(*) FILTER (level = 'Warning') AS warnings FROM logs GROUP BY 1 HAVING errors + fatal_errors > 0""")
def minute_alerts(spark, sf_dir):
    return rollups.minute_alerts(_events(spark, sf_dir)).withColumn("minute", F.unix_micros("minute"))


_VALUES = _LOGS + """, v AS (SELECT 'Application' AS key, application AS value, moment, id FROM logs UNION ALL SELECT 'K', k, moment, id FROM logs),
f AS (SELECT key, value, min(moment) AS first_at, arg_min(id, (moment, id)) AS first_id FROM v WHERE strlen(value) <= 1024 GROUP BY ALL) """


@query(_VALUES + "SELECT * FROM f")
def insights_distinct(spark, sf_dir):
    return insights.distinct_values(_events(spark, sf_dir), ["Application", "K"]).withColumn("first_at", F.unix_micros("first_at"))


@query(_VALUES + "SELECT value, first_at FROM f WHERE key = 'K' AND contains(value, '7') ORDER BY first_at, first_id LIMIT 20")
def insights_values(spark, sf_dir):
    values = insights.distinct_values(_events(spark, sf_dir), ["Application", "K"])
    return insights.lookup(values, "K", "7").select("value", F.unix_micros("first_at").alias("first_at"))


@query(_VALUES + "SELECT DISTINCT key FROM f")
def insight_keys(spark, sf_dir):
    return insights.keys(insights.distinct_values(_events(spark, sf_dir), ["Application", "K", "absent"]))


# ------------------------------------------------------------------ rules

RULES = [
    rules.IgnoreRule("Info", "App-1", "user 1"),
    rules.IgnoreRule("Debug", "*", "proc-2"),
    rules.IgnoreRule("Error", "App-3", "*", NOW_MICROS + 1),
    rules.IgnoreRule("FatalError", "App-4", "*", NOW_MICROS),
]
_RULE_VALUES = f"""rules AS (SELECT * FROM (VALUES ('Info', 'App-1', 'user 1', NULL), ('Debug', '*', 'proc-2', NULL), ('Error', 'App-3', '*', {NOW_MICROS + 1}),
  ('FatalError', 'App-4', '*', {NOW_MICROS})) AS t(r_level, r_app, r_marker, expires_at) WHERE expires_at IS NULL OR expires_at > {NOW_MICROS})"""
_MARKER = "(r_marker = '*' OR contains(process, r_marker) OR contains(message, r_marker))"
_STRICT = f"level = r_level AND (r_app = '*' OR application = r_app) AND {_MARKER}"


@query(_LOGS + f", {_RULE_VALUES} SELECT {_COLS} FROM logs WHERE NOT EXISTS (SELECT 1 FROM rules WHERE {_STRICT})")
def ignore_rules_filter(spark, sf_dir):
    return _shown(rules.filter_ignored(_events(spark, sf_dir), RULES, NOW_MICROS))


@query(_LOGS + f", {_RULE_VALUES} SELECT {_COLS} FROM logs WHERE NOT EXISTS (SELECT 1 FROM rules WHERE {_STRICT})")
def ignore_rules_table(spark, sf_dir):
    table = spark.createDataFrame([(r.level, r.application, r.marker, r.expires_at) for r in RULES], "level string, application string, marker string, expires_at bigint")
    return _shown(rules.filter_ignored_table(_events(spark, sf_dir), table, NOW_MICROS))


@query(_LOGS + f", {_RULE_VALUES} SELECT {_COLS} FROM logs WHERE NOT EXISTS (SELECT 1 FROM rules WHERE application = r_app AND {_MARKER})")
def ignore_rules_compat(spark, sf_dir):
    return _shown(rules.filter_ignored(_events(spark, sf_dir), RULES, NOW_MICROS, strict=False))


@query(_LOGS + f""", c AS (SELECT moment AS seq, CASE WHEN CAST(k AS INT) % 4 = 0 THEN 'delete' ELSE 'upsert' END AS action, level, application, 'K-' || (CAST(k AS INT) % 10) AS marker,
  CASE WHEN level <> 'Info' THEN moment + CAST(k AS BIGINT) * 3600000000 END AS expires_at FROM logs),
l AS (SELECT *, row_number() OVER (PARTITION BY level, application, marker ORDER BY seq DESC) AS n FROM c)
SELECT level, application, marker, expires_at FROM l WHERE n = 1 AND action = 'upsert' AND (expires_at IS NULL OR expires_at > {NOW_MICROS})""")
def ignore_rules_upsert(spark, sf_dir):
    k = F.col("context").getItem("K")
    at = F.unix_micros("timestamp")
    changes = _events(spark, sf_dir).select(
        at.alias("seq"), F.when(k.cast("int") % 4 == 0, "delete").otherwise("upsert").alias("action"), "level", "application",
        F.concat(F.lit("K-"), (k.cast("int") % 10).cast("string")).alias("marker"),
        F.when(F.col("level") != "Info", at + k.cast("bigint") * 3600000000).alias("expires_at"),
    )
    return rules.current_rules(changes, NOW_MICROS)


SINGLE_RULES = [
    suppression.SingleEventRule("errors", ("Error",), "error by user", (), 2, 60),
    suppression.SingleEventRule("app-1", ("Warning", "FatalError"), "", (("Application", "App-1"),), 1, 30),
    suppression.SingleEventRule("never", (), "", (), 5, 10),
    suppression.SingleEventRule("rest", ("Warning",), "", (("Process", "proc"),), 3, 60),
]
_SUPPRESS = _LOGS + """, t AS (SELECT *, CASE WHEN level = 'Error' AND contains(message, 'error by user') THEN 0
  WHEN level IN ('Warning', 'FatalError') AND contains(application, 'App-1') THEN 1 WHEN level = 'Warning' AND contains(process, 'proc') THEN 3 END AS rule FROM logs),
s AS (SELECT *, count(*) OVER (PARTITION BY rule ORDER BY ts RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND CURRENT ROW) AS n60,
  count(*) OVER (PARTITION BY rule ORDER BY ts RANGE BETWEEN INTERVAL 30 MINUTE PRECEDING AND CURRENT ROW) AS n30 FROM t),
m AS (SELECT *, CASE rule WHEN 0 THEN n60 <= 2 WHEN 1 THEN n30 <= 1 WHEN 3 THEN n60 <= 3 ELSE false END AS suppressed FROM s) """


@query(_SUPPRESS + f"SELECT {_COLS} FROM m WHERE NOT suppressed")
def single_event_suppression(spark, sf_dir):
    return _shown(suppression.drop_suppressed(_events(spark, sf_dir), SINGLE_RULES))


# ------------------------------------------------------------------ retention

RETENTION = retention.Retention(high_hours=240, debug_minutes=60, info_minutes=120, warning_hours=48)
_GONE = "CASE WHEN level IN ('Warning', 'Error', 'FatalError') THEN hour_key <= 2024011012 WHEN level = 'Debug' THEN hour_key < 2024012011 WHEN level = 'Info' THEN hour_key < 2024012010 ELSE false END"


@query(_LOGS + f"SELECT {_COLS} FROM logs WHERE NOT ({_GONE}) AND NOT (level = 'Warning' AND ts <= TIMESTAMP '2024-01-18 12:30:00')")
def retention_survivors(spark, sf_dir):
    return _shown(retention.survivors(_events(spark, sf_dir), NOW, RETENTION))


@query(_LOGS + f"SELECT level, hour_key, count(*) AS n_rows FROM logs WHERE {_GONE} GROUP BY ALL")
def retention_partitions(spark, sf_dir):
    return retention.expired_partitions(_events(spark, sf_dir), NOW, RETENTION)


@query(_LOGS + f"SELECT level, hour_key, count(*) AS n_rows FROM logs WHERE NOT ({_GONE}) GROUP BY ALL")
def stored_retention(spark, sf_dir):
    path, logs = fresh_dir(spark, "stored"), _events(spark, sf_dir)
    tables.write_logs(logs, path)
    tables.drop_partitions(spark, path, retention.expired_partitions(logs, NOW, RETENTION))
    return tables.read_logs(spark, path).groupBy("level", "hour_key").agg(F.count("*").alias("n_rows"))


# ------------------------------------------------------------------ encodings and ingest


@query(_LOGS + """SELECT id, 'services_logs_test' AS index_name, '{"date":' || (moment // 1000) || ',"K":' || to_json(k) || ',"Version":' || to_json(version) || ',"app":' || to_json(application)
  || ',"env_source":"TEST","inner_id":' || to_json(id) || ',"log_level":' || to_json(level) || ',"message":' || to_json(message) || ',"process":' || to_json(process) || '}' AS document FROM logs""")
def elastic_documents(spark, sf_dir):
    items = driver_tables.events_as_items(driver_tables.read_events(spark, sf_dir))
    return results.index_documents(items, "test")


@query(_LOGS + """SELECT id, moment AS timestamp, '' AS tenant_id, process AS process_name, message, CASE level WHEN 'FatalError' THEN 'Fatal' ELSE level END AS level,
  'Application=' || application || ';K=' || k || ';Version=' || version AS ctx FROM logs""")
def grpc_projection(spark, sf_dir):
    logs = _events(spark, sf_dir)
    ctx = F.array_join(F.transform("ctx", lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    wire = results.wire_rows(logs.withColumn("message", F.concat("id", "message")))
    return wire.select(
        F.substring("message", 1, 12).alias("id"), "timestamp", "tenant_id", "process_name", F.expr("substring(message, 13)").alias("message"), "level", ctx.alias("ctx")
    )


@query(_LOGS + """SELECT id, '{"iso_time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","timestamp":' || moment || ',"level":' || to_json(level) || ',"application":' || to_json(application)
  || ',"version":' || to_json(version) || ',"process":' || to_json(process) || ',"message":' || to_json(message) || ',"context":{"K":' || to_json(k) || '}}' AS record FROM logs""")
def record_json(spark, sf_dir):
    return results.record_json(_events(spark, sf_dir))


@query(_LOGS + """SELECT epoch_us(date_trunc('minute', ts)) AS minute, '---' || chr(10) || '📊<b>EnvInfo</b>:test' || chr(10) || '<b>Statistics of minute</b>: '
  || strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' || chr(10) || '☠️<b>FatalErrors</b>: ' || count(*) FILTER (level = 'FatalError') || chr(10)
  || '🟥<b>Errors</b>: ' || count(*) FILTER (level = 'Error') || chr(10) || '⚠️<b>Warnings</b>: ' || count(*) FILTER (level = 'Warning') || chr(10) || chr(10) AS text
  FROM logs GROUP BY date_trunc('minute', ts) HAVING count(*) FILTER (level IN ('Error', 'FatalError')) > 0""")
def alert_texts(spark, sf_dir):
    texts = results.minute_alert_text(rollups.minute_alerts(_events(spark, sf_dir)), "test")
    return texts.withColumn("minute", F.unix_micros("minute"))


_INGESTED = "id, epoch_us(ts) AS moment, level, process, message, application, version, k"


@query(_LOGS + f"SELECT {_INGESTED} FROM logs")
def seq_ingest(spark, sf_dir):
    items = driver_tables.events_as_items(driver_tables.read_events(spark, sf_dir))
    body = F.to_json(
        F.map_concat(
            F.create_map(
                F.lit("@t"), iso(F.col("timestamp")), F.lit("@l"), F.when(F.col("level") == "FatalError", "Fatal").otherwise(F.col("level")),
                F.lit("@m"), F.col("message"), F.lit("Process"), F.col("process"), F.lit("Id"), F.col("id"),
            ),
            F.col("context"),
        )
    )
    parsed, _ = ingest.parse_seq(items.select(body.alias("body")), F.timestamp_micros(F.lit(NOW_MICROS)))
    ctx = F.col("context")
    return parsed.select(
        ctx.getItem("Id").alias("id"), F.unix_micros("timestamp").alias("moment"), "level", "process", "message",
        ctx.getItem("Application").alias("application"), ctx.getItem("Version").alias("version"), ctx.getItem("K").alias("k"),
    )


@query(_LOGS + f"SELECT {_INGESTED} FROM logs")
def v2_ingest(spark, sf_dir):
    items = driver_tables.events_as_items(driver_tables.read_events(spark, sf_dir))
    event = F.struct(iso(F.col("timestamp")).alias("time_stamp"), "level", "process", "message", F.map_concat("context", F.create_map(F.lit("Id"), F.col("id"))).alias("context"))
    bodies = items.select(F.to_json(F.array(event)).alias("body"))
    parsed = ingest.parse_v2(bodies)
    ctx = F.col("context")
    return parsed.select(
        ctx.getItem("Id").alias("id"), F.unix_micros("timestamp").alias("moment"), "level", "process", "message",
        ctx.getItem("Application").alias("application"), ctx.getItem("Version").alias("version"), ctx.getItem("K").alias("k"),
    )


@query(_LOGS + f"SELECT {_INGESTED} FROM logs")
def wire_ingest(spark, sf_dir):
    items = driver_tables.events_as_items(driver_tables.read_events(spark, sf_dir))
    entries = F.transform(F.map_entries("context"), lambda e: F.struct(e["key"].alias("Key"), e["value"].alias("Value")))
    code = F.create_map(*[F.lit(x) for kv in {"Info": 0, "Warning": 1, "Error": 2, "FatalError": 3, "Debug": 4}.items() for x in kv])[F.col("level")]
    # the first Id is overridden by the one that follows
    ids = [F.struct(F.lit("Id").alias("Key"), x.alias("Value")) for x in (F.lit("stale"), F.col("id"))]
    wire = items.select(
        F.lit("").alias("TenantId"), F.unix_micros("timestamp").alias("Timestamp"), F.col("process").alias("ProcessName"), F.col("message").alias("Message"),
        code.alias("Level"), F.concat(F.array(ids[0]), entries, F.array(ids[1])).alias("Ctx"),
    )
    ctx = F.col("context")
    return ingest.parse_wire_events(wire).select(
        ctx.getItem("Id").alias("id"), F.unix_micros("timestamp").alias("moment"), "level", "process", "message",
        ctx.getItem("Application").alias("application"), ctx.getItem("Version").alias("version"), ctx.getItem("K").alias("k"),
    )


@query(_LOGS + "SELECT id, process, application, version, k FROM logs")
def process_folding(spark, sf_dir):
    items = driver_tables.events_as_items(driver_tables.read_events(spark, sf_dir))
    stale = F.map_concat("context", F.create_map(F.lit("Process"), F.lit("stale")))
    ctx = F.col("context")
    return items.withColumn("context", fold_process(F.col("process"), stale)).select(
        "id", ctx.getItem("Process").alias("process"), ctx.getItem("Application").alias("application"), ctx.getItem("Version").alias("version"), ctx.getItem("K").alias("k")
    )


# ------------------------------------------------------------------ streams


@query(ORACLE_SQL["hourly_stats"])
def stream_hourly_stats(spark, sf_dir):
    return pipeline.ingest_once(spark, sf_dir, "hourly").hourly(spark)


@query(_SUPPRESS + "SELECT id, rule, moment, suppressed FROM m WHERE rule IS NOT NULL")
def stream_suppression(spark, sf_dir):
    out = pipeline.ingest_once(spark, sf_dir, "verdicts", single_rules=SINGLE_RULES)
    return out.table(spark, "verdicts").withColumnRenamed("at", "moment")


@query(
    _LOGS + ", " + _RULE_VALUES
    + _SUPPRESS.removeprefix(_LOGS).replace("AS rule FROM logs)", f"AS rule FROM logs WHERE NOT EXISTS (SELECT 1 FROM rules WHERE {_STRICT}))")
    + f"SELECT {_COLS} FROM m WHERE NOT suppressed"
)
def stream_logs(spark, sf_dir):
    return _shown(pipeline.ingest_once(spark, sf_dir, "logs", RULES, SINGLE_RULES, NOW_MICROS).table(spark, "logs"))


@query(ORACLE_SQL["minute_alerts"] + """
  AND date_trunc('minute', min(ts)) + INTERVAL 1 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 MINUTE FROM logs WHERE level IN ('FatalError', 'Error', 'Warning'))""")
def stream_minute_windows(spark, sf_dir):
    return pipeline.minutes_once(spark, sf_dir).withColumn("minute", F.unix_micros("minute"))
