import pytest
from pyspark.sql import functions as F

from emberlog.functions.text import Fields, QuerySyntaxError, matches, message_like, search_text

ROWS = [
    (1, "Disk is full on node-7", "Error", {"Application": "Billing", "Key": "Value-1"}),
    (2, "connection refused by Billing", "Info", {"Application": "Web"}),
    (3, "connected; the disk is not full", "Info", {"Application": "web"}),
    (4, "Straße überfüllt 50%_x", "Debug", {}),
    (5, "", "Debug", None),
]


@pytest.fixture(scope="module")
def logs(spark):
    return spark.createDataFrame(ROWS, "id int, message string, level string, context map<string,string>").cache()


def found(logs, query, strict=True):
    f = Fields(search_text(F.col("message"), F.col("context")), F.col("level"), F.col("context"))
    c = matches(query, f, strict)
    return {r.id for r in (logs if c is None else logs.where(c)).collect()}


@pytest.mark.parametrize(
    "query,ids",
    [
        ("disk", {1, 3}), ("DISK", {1, 3}), ("billing", {1, 2}), ("refused full", {1, 2, 3}), ("refused OR full", {1, 2, 3}),
        ("disk AND full AND NOT not", {1}), ('"disk is full"', {1}), ('"is not full"', {3}), ("connect*", {2, 3}), ("node-7", {1}),
        ("+disk -not", {1}), ("NOT disk", {2, 4, 5}), ("(refused OR full) AND connected", {3}), ("level:info AND connect*", {2, 3}),
        ("ctx:application=WEB", {2, 3}), ("ctx:key=value-1", {1}), ("ctx:application=bill", set()), ("ÜBERFÜLLT", {4}), ("   ", {1, 2, 3, 4, 5}), ("absent", set()),
        ("and", set()), ("-disk", {2, 4, 5}), ("refused disk AND full", {1, 2, 3}),
    ],
)
def test_queries(logs, query, ids):
    assert found(logs, query) == ids


@pytest.mark.parametrize("query", ["(disk", "disk)", "OR disk", "disk OR", "AND", "NOT", "()", '"', "***", "ctx:nothing"])
def test_malformed(logs, query):
    with pytest.raises(QuerySyntaxError):
        found(logs, query)
    assert found(logs, query, strict=False) == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("phrase,ids", [("DISK IS", {1, 3}), ("50%", {4}), ("5_%", {4}), ("con%ed", {2, 3}), ("web", set()), ("\\", set()), (" full ", {1, 3})])
def test_substring(logs, phrase, ids):
    assert {r.id for r in logs.where(message_like(F.col("message"), phrase)).collect()} == ids


def test_blank_substring_is_no_condition():
    assert message_like(None, "  ") is None
