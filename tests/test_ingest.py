import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from emberlog.schema import log_rows
from emberlog.sources.ingest import parse_seq, parse_v2, parse_wire_events, read_seq

NOW = 1_700_000_000_000_000
PANIC = (
    r'{"@l":"Fatal","@t":"2025-08-14T20:04:43.343194","Process":"Panic Handler","@m":"\"status: Unavailable, message: \\\"Connection refused\\\"\"",'
    r'"Application":"bridge","Version":"0.1.17","Location":"src/x.rs:3:1"}'
)


def seq(spark, *bodies):
    return parse_seq(spark.createDataFrame([(b,) for b in bodies], "body string"), F.timestamp_micros(F.lit(NOW)))


def test_seq_fields(spark):
    items, bad = seq(spark, '{"@l":"Info","@t":"2025-01-02T03:04:05.000006+00:00","Process":"p","@m":"hello","Application":"A","Version":"1","N":5,"Z":null}')
    r = items.selectExpr("*", "unix_micros(timestamp) AS at").first()
    assert (r.level, r.process, r.message, r.at) == ("Info", "p", "hello", 1735787045000006)
    assert r.context == {"Application": "A", "Version": "1", "N": "5"}
    assert bad.count() == 0


def test_seq_panic_record(spark):
    r = seq(spark, PANIC)[0].first()
    assert r.level == "FatalError" and r.process == "Panic Handler"
    assert r.message == '"status: Unavailable, message: \\"Connection refused\\""'
    assert r.context["Location"] == "src/x.rs:3:1"


@pytest.mark.parametrize("level,want", [("Info", "Info"), ("info", "FatalError"), ("Fatal", "FatalError"), (None, "FatalError"), ("Debug", "Debug")])
def test_seq_levels(spark, level, want):
    body = '{"@m":"x"}' if level is None else f'{{"@l":"{level}","@m":"x"}}'
    assert seq(spark, body)[0].first().level == want


def test_seq_time_falls_back_to_now(spark):
    items, _ = seq(spark, '{"@m":"x"}', '{"@m":"x","@t":"no time"}')
    assert {r.at for r in items.selectExpr("unix_micros(timestamp) AS at").collect()} == {1_700_000_000_000_000}


def test_seq_last_message_wins_and_rejects(spark):
    items, bad = seq(spark, '{"@mt":"first","@m":"second"}', '{"@m":"a","MessageTemplate":"b","@mt":null}', '{"@l":"Info"}', "not json")
    assert sorted(r.message for r in items.collect()) == ["b", "second"]
    assert sorted(r.body for r in bad.collect()) == ["not json", '{"@l":"Info"}']


def test_seq_files_of_five_records(spark, tmp_path):
    line = '{"@l":"Info","@t":"2025-01-02T03:04:05.000006+02:00","Process":"p","@m":"m%d","Application":"A","Version":"1"}'
    for name, end in (("lf", "\n"), ("cr", "\r"), ("crlf", "\r\n")):
        (tmp_path / name).write_bytes(end.join(line % i for i in range(5)).encode())
        items, bad = parse_seq(read_seq(spark, str(tmp_path / name)), F.timestamp_micros(F.lit(NOW)))
        assert [r.message for r in items.orderBy("message").collect()] == [f"m{i}" for i in range(5)]
        assert bad.count() == 0


def test_seq_files_are_split(spark, tmp_path):
    (tmp_path / "big").write_text("".join(f'{{"@m":"m{i}"}}\r\n' for i in range(200_000)))
    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500000")
    try:
        rows = read_seq(spark, str(tmp_path / "big"))
        assert rows.rdd.getNumPartitions() > 3 and rows.distinct().count() == rows.count() == 200_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)


def test_v2(spark):
    good = '[{"time_stamp":"2025-01-02T03:04:05Z","level":"Error","message":"m","context":{"a":"b"}},{"time_stamp":"2025-01-02T03:04:06Z","level":"Info","process":"p","message":"n"}]'
    rows = parse_v2(spark.createDataFrame([(good,)], "body string")).orderBy("timestamp").collect()
    assert [(r.level, r.process, r.message, r.context) for r in rows] == [("Error", None, "m", {"a": "b"}), ("Info", "p", "n", None)]
    bad = '[{"time_stamp":"2025-01-02T03:04:05Z","level":"Info","message":"m"},{"time_stamp":"?","level":"Info","message":"n"}]'
    with pytest.raises(PySparkException):
        parse_v2(spark.createDataFrame([(bad,)], "body string")).collect()


def test_wire_events(spark):
    rows = [("t", 1_000_000, "", "m", 3, [("k", "1"), ("k", "2"), ("a", "x")]), ("t", 2_000_000, None, "n", 4, [])]
    df = spark.createDataFrame(rows, "TenantId string, Timestamp long, ProcessName string, Message string, Level int, Ctx array<struct<Key:string,Value:string>>")
    a, b = parse_wire_events(df).orderBy("timestamp").collect()
    assert (a.level, a.process, a.context) == ("FatalError", "", {"k": "2", "a": "x"})
    assert (b.level, b.process, b.context) == ("Debug", "", {})


def test_process_is_folded_over_the_context(spark):
    rows = [("1", "m", "p", {"Process": "old", "Application": "A"}), ("2", "m", None, {"Process": "old"}), ("3", "m", "p", None)]
    items = spark.createDataFrame(rows, "id string, message string, process string, context map<string,string>").selectExpr(
        "*", "timestamp'2024-01-01 05:00:00' AS timestamp", "'Info' AS level"
    )
    got = {r.id: (r.context, r.application, r.hour_key) for r in log_rows(items).collect()}
    assert got["1"] == ({"Process": "p", "Application": "A"}, "A", 2024010105)
    assert got["2"] == ({"Process": "old"}, None, 2024010105)
    assert got["3"][0] == {"Process": "p"}
