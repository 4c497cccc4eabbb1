import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from emberlog.functions.timekeys import key_bounds, key_of, parse_key
from emberlog.operators import insights, retention, rollups, rules, search, suppression
from emberlog.plans.requests import decode_range, is_ui_url, read_request, tool_request
from emberlog.schema import log_rows
from emberlog.sinks import results, tables
from emberlog.sources import driver_tables

UTC = timezone.utc
T0 = datetime(2024, 1, 1, 5, tzinfo=UTC)


def make(spark, rows):
    """rows: (id, micros after T0, level, process, message, context)"""
    base = int(T0.timestamp()) * 1_000_000
    df = spark.createDataFrame(rows, "id string, at long, level string, process string, message string, context map<string,string>")
    return log_rows(df.withColumn("timestamp", F.timestamp_micros(F.lit(base) + F.col("at"))))


def ids(df):
    return [r.id for r in df.collect()]


@pytest.fixture(scope="module")
def logs(spark):
    hour = 3600 * 1_000_000
    return make(
        spark,
        [
            ("a", 0, "Info", "p1", "start", {"Application": "App", "Version": "1"}),
            ("b", 1, "Debug", "p1", "step", {"Application": "App"}),
            ("c", hour - 1, "Error", "p2", "fail", {"Application": "Other", "Code": "X9"}),
            ("d", hour, "Warning", None, "edge", {}),
            ("e", hour, "Info", None, "edge", {"Application": ""}),
            ("f", hour + 1, "FatalError", "p3", "after", {"Application": "app"}),
        ],
    ).cache()


def test_hour_range_includes_the_next_hour(logs):
    low, high = key_bounds(2024010105)
    assert ids(search.read(logs, low, high, None, {}, 10)) == ["d", "e", "c", "b", "a"]


@pytest.mark.parametrize("take,want", [(0, []), (1, ["f"]), (3, ["f", "d", "e"]), (6, ["f", "d", "e", "c", "b", "a"]), (9, ["f", "d", "e", "c", "b", "a"])])
def test_take_and_order(logs, take, want):
    assert ids(search.read(logs, T0, T0 + timedelta(days=1), None, {}, take)) == want


def test_levels_none_and_empty(logs):
    r = lambda levels: search.SearchRequest(T0, T0 + timedelta(days=1), levels)
    assert len(ids(search.search_logs(logs, r(None)))) == 6
    assert ids(search.search_logs(logs, r([]))) == []
    assert len(ids(search.read(logs, T0, T0 + timedelta(days=1), [], {}, 9))) == 6
    with pytest.raises(ValueError):
        search.SearchRequest(T0, T0, take=-1)


def test_context_ignores_case_on_both_sides(logs):
    assert ids(search.read(logs, T0, T0 + timedelta(days=1), None, {"APPLICATION": "aPP"}, 9)) == ["f", "b", "a"]
    assert ids(search.read(logs, T0, T0 + timedelta(days=1), None, {"Application": "app", "version": "1"}, 9)) == ["a"]
    assert ids(search.read(logs, T0, T0 + timedelta(days=1), None, {"code": "x9"}, 9)) == ["c"]


def test_level_first_reads_one_level_after_the_other(spark):
    rows = make(spark, [(f"d{i}", i, "Debug", None, "m", {}) for i in range(9)] + [(f"i{i}", 100 + i, "Info", None, "m", {}) for i in range(9)])
    r = search.SearchRequest(T0, T0 + timedelta(days=1), take=9)
    assert ids(search.level_first_compat(rows, r)) == [f"d{i}" for i in range(8, -1, -1)]
    assert ids(search.search_logs(rows, r)) == [f"i{i}" for i in range(8, -1, -1)]
    twice = search.SearchRequest(T0, T0 + timedelta(days=1), ["Info", "Info"], take=18)
    assert len(ids(search.level_first_compat(rows, twice))) == 18


def test_residual_filter_comes_after_the_limit(spark):
    rows = make(spark, [(f"i{i}", i, "Info", None, "m", {"K": str(i % 2)}) for i in range(10)])
    r = search.SearchRequest(T0, T0 + timedelta(days=1), ["Info"], {"K": "0"}, take=4)
    assert len(ids(search.low_tier_compat(rows, r))) == 2
    assert len(ids(search.search_logs(rows, r))) == 4


def test_keys():
    assert parse_key("2024010105") == 2024010105
    assert parse_key("202401010") is None and parse_key("2024130105") is None and parse_key("2024-10105") is None
    assert key_of(datetime(2024, 1, 1, 7, tzinfo=timezone(timedelta(hours=2)))) == 2024010105


def test_decode_range(logs):
    now = T0 + timedelta(minutes=30)
    assert decode_range(0, 0, now) == (T0, T0 + timedelta(hours=1))
    assert decode_range(-2, 0, now)[0] == T0 - timedelta(hours=2)
    assert decode_range(2024010105, 0, now) == (T0, T0 + timedelta(hours=1))
    assert decode_range(7, 0, now) is None and decode_range(9, 5, now) is None
    assert ids(read_request(logs, 7, 0, now, [], [], 5)) == []
    assert decode_range(1, 5, now)[1].microsecond == 5


def test_tool(logs):
    with pytest.raises(ValueError):
        tool_request(logs, "2024-01-01T00:00:00", "2024-01-01T00:00:00")
    with pytest.raises(ValueError):
        tool_request(logs, "2024-01-01T00:00:00", "2024-01-02T00:00:00", ["nope"])
    assert ids(tool_request(logs, "2024-01-01T00:00:00", "2024-01-02T00:00:00", ["fatal", " INFO "], take=2)) == ["e", "f"]


# ------------------------------------------------------------------ rules


def test_ignore_rules(logs):
    R = rules.IgnoreRule
    left = lambda r, now=100, strict=True: set(ids(rules.filter_ignored(logs, r, now, strict)))
    every = {"a", "b", "c", "d", "e", "f"}
    assert left([]) == every
    assert left([R("Info", "App", "*")]) == every - {"a"}
    assert left([R("Info", "App", "*")], strict=False) == every - {"a", "b"}
    assert left([R("Warning", "*", "edge")]) == every - {"d"}
    assert left([R("Warning", "*", "edge")], strict=False) == every
    assert left([R("Error", "Other", "p2")]) == every - {"c"} and left([R("Error", "Other", "P2")]) == every
    assert left([R("Error", "Other", "*", 100)]) == every and left([R("Error", "Other", "*", 101)]) == every - {"c"}


def test_rule_store(tmp_path):
    path = str(tmp_path / "rules.json")
    s = rules.IgnoreRuleStore(path)
    assert s.upsert(rules.IgnoreRule("Info", "A", "*", 10)) and not s.upsert(rules.IgnoreRule("Info", "A", "*", 10))
    assert s.upsert(rules.IgnoreRule("Info", "A", "*", 20))
    assert s.add("warn", "B", "x", now=5, expires_in_minutes=1).expires_at == 60_000_005
    with pytest.raises(ValueError):
        s.add("warn", "B", "x", 5, 0)
    assert [r.application for r in rules.IgnoreRuleStore(path).rules] == ["A", "B"]
    assert [r.application for r in s.live(20)] == ["B"] and len(rules.IgnoreRuleStore(path).rules) == 1
    assert s.delete("Warning", "B", "x") and not s.delete("Warning", "B", "x")
    (tmp_path / "bad.json").write_text("{")
    assert rules.IgnoreRuleStore(str(tmp_path / "bad.json")).rules == []


def test_single_rule_store(tmp_path):
    path = str(tmp_path / "single.json")
    s = suppression.SingleEventRuleStore(path)
    R = suppression.SingleEventRule
    for r in (R("1", ("Error",)), R("2", ("Info",), context_match=(("a", "b"),)), R("1", ("Debug",))):
        s.add(r)
    assert [r.id for r in suppression.SingleEventRuleStore(path).rules] == ["2", "1"]
    assert suppression.SingleEventRuleStore(path).rules == s.rules
    assert s.delete("2") and not s.delete("2")


def test_first_two_are_skipped(spark):
    rule = suppression.SingleEventRule("1", ("Error",), "Test", (), 2, 1)
    rows = make(spark, [(str(i), i * 1_000_000, "Error", "Test", "Test", {}) for i in range(3)])
    marks = {r.id: r.suppressed for r in suppression.mark_suppressed(rows, [rule]).collect()}
    assert marks == {"0": True, "1": True, "2": False}


@pytest.mark.parametrize("seed", range(3))
def test_suppression_equals_the_event_by_event_model(spark, seed):
    r = random.Random(seed)
    R = suppression.SingleEventRule
    rls = [R("1", ("Error",), "x", (), 2, 1), R("2", ("Info", "Error"), "", (("k", "v"),), 1, 90), R("none", (), "", (), 3, 3), R("3", ("Info",), "", (), 0, 2)]
    rows, at = [], 0
    for i in range(400):
        at += r.choice([0, 0, 1_000_000, 20_000_000, 61_000_000, 2_000_000_000])
        rows.append((f"{i:05d}", at, r.choice(["Info", "Error", "Debug"]), None, r.choice(["x y", "z"]), r.choice([{}, {"k": "vv"}, {"k": "w"}])))
    model = suppression.SuppressionModel(rls)
    want = {i: model.skip(a, lv, m, c) for i, a, lv, _, m, c in sorted(rows, key=lambda x: (x[1], x[0]))}
    got = {x.id: x.suppressed for x in suppression.mark_suppressed(make(spark, rows), rls).collect()}
    assert got == want


def test_no_rules_and_no_rows(spark, logs):
    assert suppression.drop_suppressed(logs, []).count() == 6
    assert suppression.drop_suppressed(logs.limit(0), [suppression.SingleEventRule("1", ("Error",))]).count() == 0


# ------------------------------------------------------------------ rollups and the rest


def test_rollups(logs, spark):
    h = rollups.hourly(logs)
    assert {(r.hour_key, r.application): r.info for r in h.collect()} == {(2024010105, "App"): 1, (2024010105, "Other"): 0, (2024010106, ""): 1, (2024010106, "app"): 0}
    assert {r.hour_key for r in rollups.last_hours(h, 1).collect()} == {2024010106}
    assert rollups.last_hours(h, -1).count() == 4 and rollups.last_hours(h, 0).count() == 0
    assert rollups.clamp_hours(None) == 24 and rollups.clamp_hours(0) == 1 and rollups.clamp_hours(99) == 48
    assert rollups.dashboard_totals(h.limit(0)).first().total_info == 0
    assert rollups.level_counts(logs, 1999010100).first().asDict() == {"info": 0, "warning": 0, "error": 0, "fatal_error": 0, "debug": 0}
    m = {r.minute.hour: (r.errors, r.fatal_errors, r.warnings) for r in rollups.minute_counts(logs).collect()}
    assert m == {5: (1, 0, 0), 6: (0, 1, 1)}


def test_snapshot_files(spark, logs, tmp_path):
    h = rollups.hourly(logs)
    tables.write_rollup_snapshot(rollups.rollup_snapshot(h), str(tmp_path / "s"))
    back = rollups.restore_rollup(tables.read_rollup_snapshot(spark, str(tmp_path / "s")))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, h.collect()))


def test_insights_count_bytes(spark):
    rows = make(spark, [("1", 5, "Info", None, "m", {"k": "é" * 512}), ("2", 1, "Info", None, "m", {"k": "é" * 512 + "x"}), ("3", 2, "Info", None, "m", {"k": "é" * 512, "o": "z"})])
    v = insights.distinct_values(rows, ["k"])
    assert [(r.value, r.first_id) for r in v.collect()] == [("é" * 512, "3")]
    assert insights.lookup(v, "nope", "").count() == 0


def test_retention_edges(spark):
    now = datetime(2024, 1, 1, 12, 30, tzinfo=UTC)
    rows = [(f"{lv}{h}", (h - 5) * 3600 * 1_000_000, lv, None, "m", {}) for lv in ("Error", "Debug", "Info") for h in range(5, 13)]
    kept = ids(retention.survivors(make(spark, rows), now, retention.Retention(high_hours=4)))
    assert {k for k in kept if k.startswith("Error")} == {f"Error{h}" for h in range(9, 13)}
    assert {k for k in kept if k.startswith("Debug")} == {"Debug11", "Debug12"}
    assert {k for k in kept if k.startswith("Info")} == {"Info10", "Info11", "Info12"}


def test_index_documents(spark):
    items = spark.createDataFrame(
        [("1", "Error", "The Panic Handler", "boom", {"Application": "A", "Where": "x"}), ("2", "Info", None, "m", None), ("3", "Info", "p", "m", {"message": "ctx wins"})],
        "id string, level string, process string, message string, context map<string,string>",
    ).selectExpr("*", "timestamp'2024-01-01 00:00:01' AS timestamp")
    import json

    got = {r.id: json.loads(r.document) for r in results.index_documents(items, "Dev").collect()}
    assert got["1"] == {"date": 1704067201000, "inner_id": "1", "app": "A", "log_level": "Error", "message": "Auto panic handler", "env_source": "DEV", "process": "Panic Handler", "Where": "x", "Panic Message": "boom"}
    assert got["2"]["app"] == "N/A" and got["2"]["process"] == "N/A"
    assert got["3"]["message"] == "ctx wins"


def test_alert_text_is_escaped(spark):
    items = spark.createDataFrame([("1", "Error", "a_b", "x*y.\nz", {"k": "v`"})], "id string, level string, process string, message string, context map<string,string>")
    text = results.item_alert_text(items.selectExpr("*", "timestamp'2024-01-01 00:00:00' AS timestamp"), "e-1").first().text
    assert "🟥Error" in text and "a\\_b" in text and "x\\*y\\. z" in text and "e\\-1" in text and "v\\`" in text


# ------------------------------------------------------------------ plans


def plan(df):
    return df._jdf.queryExecution().toString()


def test_stored_table_is_pruned(spark, sf_dir, tmp_path):
    rows = driver_tables.events(spark, sf_dir).where("hour_key BETWEEN 2024011000 AND 2024011012")
    tables.write_logs(rows, str(tmp_path / "t"))
    back = tables.read_logs(spark, str(tmp_path / "t"))
    assert back.count() == rows.count()
    found = search.read(back, datetime(2024, 1, 10, 3), datetime(2024, 1, 10, 5), ["Error"], {"Application": "App-1"}, 10)
    p = plan(found)
    assert "TakeOrderedAndProject" in p and "hour_key" in p[p.index("PartitionFilters") :][:400] and "level" in p[p.index("PartitionFilters") :][:400]
    assert "GreaterThanOrEqual(timestamp" in p
    want = search.read(rows, datetime(2024, 1, 10, 3), datetime(2024, 1, 10, 5), ["Error"], {"Application": "App-1"}, 10)
    assert ids(found) == ids(want)


def test_conditions_reach_the_scan_of_events(spark, sf_dir):
    from emberlog.catalogue import QUERIES

    p = plan(QUERIES["search_combined"](spark, sf_dir))
    assert "GreaterThanOrEqual(ts" in p and "LessThanOrEqual(ts" in p and "value:double" not in p and "TakeOrderedAndProject" in p


def test_expired_partitions_are_deleted(spark, sf_dir, tmp_path):
    now, r = datetime(2024, 1, 5, 12, 30, tzinfo=UTC), retention.Retention(high_hours=24)
    rows = driver_tables.events(spark, sf_dir).where("hour_key BETWEEN 2024010400 AND 2024010523")
    tables.write_logs(rows, str(tmp_path / "t"))
    back = tables.read_logs(spark, str(tmp_path / "t"))
    gone = retention.expired_partitions(back, now, r)
    n = gone.count()
    assert n and tables.drop_partitions(spark, str(tmp_path / "t"), gone) == n
    left = tables.read_logs(spark, str(tmp_path / "t"))
    assert sorted(ids(left)) == sorted(ids(retention.survivors(rows, now, r)))


def test_ui_url():
    assert is_ui_url("https://x") and not is_ui_url("http://x")


def test_no_python_in_batch_plans(spark, sf_dir):
    from emberlog.catalogue import QUERIES

    for name, q in QUERIES.items():
        if not name.startswith("stream"):
            assert "Python" not in plan(q(spark, sf_dir)) and "Arrow" not in plan(q(spark, sf_dir)), name
