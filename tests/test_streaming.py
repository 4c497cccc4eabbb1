
import pytest
from pyspark.sql import functions as F

from emberlog.operators import rollups, rules, suppression
from emberlog.schema import LOG_SCHEMA
from emberlog.sinks import tables
from emberlog.sources import driver_tables
from emberlog.streaming import pipeline


@pytest.fixture()
def parts(spark, sf_dir, tmp_path):
    """The events in three files that rise in time."""
    logs = driver_tables.events(spark, sf_dir)
    cuts = [20240101, 20240111, 20240121, 20240201]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        part = logs.where((F.col("hour_key") >= a * 100) & (F.col("hour_key") < b * 100)).coalesce(1)
        part.write.parquet(str(tmp_path / f"in{i}"))
        for f in (tmp_path / f"in{i}").glob("part-*"):
            (tmp_path / "in").mkdir(exist_ok=True)
            f.rename(tmp_path / "in" / f"{i}.parquet")
    return tmp_path, logs


def stream(spark, folder):
    return spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def test_fanout_equals_batch(spark, parts):
    folder, logs = parts
    for _ in range(2):  # a second run finds nothing new
        q, out = pipeline.ingest(stream(spark, folder), f"{folder}/out", f"{folder}/cp", insight_keys=["K"], available_now=True)
        q.awaitTermination()
    assert sorted(map(tuple, out.hourly(spark).collect())) == sorted(map(tuple, rollups.hourly(logs).collect()))
    assert out.table(spark, "logs").count() == logs.count()


def test_suppression_in_three_batches_equals_batch(spark, parts):
    folder, logs = parts
    R = suppression.SingleEventRule
    rls = [R("e", ("Error",), "error", (), 2, 600), R("w", ("Warning", "Info"), "", (("Application", "App-1"),), 1, 300)]
    q, out = pipeline.ingest(stream(spark, folder), f"{folder}/out", f"{folder}/cps", available_now=True, single_rules=rls)
    q.awaitTermination()
    got = {r.id: r.suppressed for r in out.table(spark, "verdicts").collect()}
    want = {r.id: r.suppressed for r in suppression.mark_suppressed(logs, rls).collect()}
    assert got == {k: want[k] for k in got} and len(got) > 100
    assert {r.id for r in out.table(spark, "logs").collect()} == {k for k, gone in want.items() if not gone}
    assert len(list((folder / "out" / "state").iterdir())) == 2  # what a batch that runs again needs


def test_replaced_rule_has_no_state(spark, parts):
    folder, logs = parts
    rule = suppression.SingleEventRule("a", ("Error",), "", (), 1, 60)
    store = suppression.SingleEventRuleStore()
    store.add(rule)
    out = pipeline.Fanout(str(folder / "out"), [], [], 0, store)
    row = spark.createDataFrame(logs.where("level = 'Error'").limit(1).collect(), LOG_SCHEMA)
    later = row.selectExpr("'later' AS id", "timestamp + INTERVAL 1 MINUTE AS timestamp", *LOG_SCHEMA.names[2:])
    out(row, 0)
    out(later, 1)
    assert [r.id for r in out.table(spark, "logs").collect()] == ["later"]  # the second in the window
    store.add(suppression.SingleEventRule("a", ("Error",), "", (), 1, 61))
    out(later, 1)
    assert out.table(spark, "logs").count() == 0  # the first of the new rule


def test_rules_expire_while_a_stream_runs(spark, parts):
    folder, logs = parts
    logs = logs.where("hour_key < 2024010300")  # few folders
    store, now = rules.IgnoreRuleStore(), iter([10, 20])
    store.upsert(rules.IgnoreRule("Error", "*", "*", 15))
    out = pipeline.Fanout(str(folder / "out"), store, [], lambda: next(now))
    out(logs, 0)
    without = out.table(spark, "logs").count()
    out(logs, 1)
    errors = logs.where("level = 'Error'").count()
    assert errors > 0 and without == logs.count() - errors
    assert out.table(spark, "logs").count() == without + logs.count() and store.rules == []


def test_partitions_of_stream_tables_can_be_dropped(spark, parts):
    folder, logs = parts
    logs = logs.where("hour_key < 2024010300")  # few folders
    out = pipeline.Fanout(str(folder / "out"), [], [], 0)
    out(logs, 0)
    out(logs, 1)
    gone = logs.where("level = 'Debug'").select("level", "hour_key").distinct()
    assert tables.drop_partitions(spark, str(folder / "out" / "logs"), gone) == 2 * gone.count()
    assert out.table(spark, "logs").count() == 2 * logs.where("level <> 'Debug'").count()


def test_minute_windows_give_finished_minutes(spark, parts):
    folder, logs = parts
    q = (
        pipeline.minute_windows(stream(spark, folder)).writeStream.format("memory").queryName("minutes").outputMode("append")
        .option("checkpointLocation", f"{folder}/cpm").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    got = set(map(tuple, spark.table("minutes").collect()))
    want = set(map(tuple, rollups.minute_alerts(logs).collect()))
    assert got <= want and len(want - got) <= 2  # the last minutes are not over
