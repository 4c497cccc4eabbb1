"""Streams of log events into tables and rollups."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.insights import distinct_values
from ..operators.rollups import hourly, merge_hourly, minute_counts
from ..operators.rules import IgnoreRule, IgnoreRuleStore, filter_ignored
from ..operators.suppression import SingleEventRule, SingleEventRuleStore
from ..sinks.tables import read_logs, write_logs
from ..sources.driver_tables import EVENTS_SCHEMA, events_as_items
from ..schema import log_rows
from ..storage import fresh_dir
from .suppress import STATE_SCHEMA, judged, next_state, verdicts

FLUSH_INTERVAL = "500 milliseconds"
#: What a stream writes; rules with state also keep their "state".
OUTPUTS = ("logs", "hourly", "minutes", "insights", "verdicts")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's events as a stream of log rows."""
    raw = spark.readStream.schema(EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return log_rows(events_as_items(raw))


def minute_windows(logs: DataFrame, late: str = "1 minute") -> DataFrame:
    """Minute counters of a stream; a minute is given once, when it is over, if
    it has errors.  Rows later than ``late`` are dropped."""
    named = {"FatalError": "fatal_errors", "Error": "errors", "Warning": "warnings"}
    return (
        logs.where(F.col("level").isin(*named))
        .withWatermark("timestamp", late)
        .groupBy(F.window("timestamp", "1 minute"))
        .agg(*[F.count_if(F.col("level") == k).alias(v) for k, v in named.items()])
        .where("errors + fatal_errors > 0")
        .select(F.col("window.start").alias("minute"), *named.values())
    )


def clock() -> int:
    """Now, in microseconds."""
    return time.time_ns() // 1000


class Fanout:
    """Takes every micro-batch through ignore rules and suppression, and writes
    what stays to the log table (by level and hour) and the partial rollups.

    Each batch has its own folder under every output, so a batch that runs
    again replaces its own rows: the tables hold every event once.  Stores are
    asked for their rules, and ``now`` for the time, at every batch, so rules
    expire, and are replaced, while the stream runs.
    """

    def __init__(
        self, path: str, rules: list[IgnoreRule] | IgnoreRuleStore, insight_keys: list[str], now: int | Callable[[], int] = clock,
        single_rules: list[SingleEventRule] | SingleEventRuleStore = (), outputs: tuple[str, ...] = OUTPUTS,
    ):
        self.path, self.rules, self.keys, self.now, self.single_rules, self.outputs = path, rules, insight_keys, now, single_rules, outputs

    def _state_before(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """State after the batch before; none if that had no rules.  Older states go."""
        jvm = spark._jvm
        before, older = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/state/batch={batch_id - n}") for n in (1, 2))
        fs = before.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(older, True)
        return spark.read.schema(STATE_SCHEMA).parquet(before.toString()) if fs.exists(before) else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        now = self.now() if callable(self.now) else self.now
        rules = self.rules.live(now) if isinstance(self.rules, IgnoreRuleStore) else self.rules
        single = list(self.single_rules.rules if isinstance(self.single_rules, SingleEventRuleStore) else self.single_rules)
        state = self._state_before(batch.sparkSession, batch_id) if single else None
        all_rows = judged(filter_ignored(batch, rules, now), single, state)
        all_rows.persist()
        try:
            rows = all_rows.where("NOT __old AND NOT suppressed").select(*batch.columns)
            if "logs" in self.outputs:
                write_logs(rows, f"{self.path}/logs/batch={batch_id}", "overwrite")
            outputs = {"hourly": hourly(rows), "minutes": minute_counts(rows), "insights": distinct_values(rows, self.keys)}
            if single:
                outputs |= {"verdicts": verdicts(all_rows), "state": next_state(all_rows, single)}
            for name in outputs.keys() & {*self.outputs, "state"}:
                outputs[name].write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")
        finally:
            all_rows.unpersist()

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        path = f"{self.path}/{name}"
        return (read_logs(spark, path) if name == "logs" else spark.read.parquet(path)).drop("batch")

    def hourly(self, spark: SparkSession) -> DataFrame:
        return merge_hourly(self.table(spark, "hourly"))


def ingest(
    stream: DataFrame, path: str, checkpoint: str, rules: list[IgnoreRule] | IgnoreRuleStore = (), insight_keys: list[str] = (),
    now: int | Callable[[], int] = clock, available_now: bool = False, single_rules: list[SingleEventRule] | SingleEventRuleStore = (),
    outputs: tuple[str, ...] = OUTPUTS,
):
    """(query, outputs): a running ingest of ``stream``."""
    out = Fanout(path, rules, list(insight_keys), now, single_rules, outputs)
    trigger = {"availableNow": True} if available_now else {"processingTime": FLUSH_INTERVAL}
    return stream.writeStream.foreachBatch(out).option("checkpointLocation", checkpoint).trigger(**trigger).start(), out


def ingest_once(spark: SparkSession, sf_dir: str, output: str, rules: list[IgnoreRule] = (), single_rules: list[SingleEventRule] = (), now: int = 0) -> Fanout:
    """One output of all events at hand, by way of the stream."""
    base = fresh_dir(spark, "stream")
    query, out = ingest(events_stream(spark, sf_dir), f"{base}/out", f"{base}/checkpoint", rules, now=now, available_now=True, single_rules=single_rules, outputs=(output,))
    query.awaitTermination()
    return out


def minutes_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished minutes with errors of all events at hand, by way of the stream."""
    base = fresh_dir(spark, "minutes")
    query = (
        minute_windows(events_stream(spark, sf_dir)).writeStream.format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema("minute timestamp, fatal_errors bigint, errors bigint, warnings bigint").parquet(f"{base}/out")
