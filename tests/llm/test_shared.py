import random

import pytest
from pyspark.sql import functions as F

from emberlog.llm import _shared
from emberlog.storage import fresh_dir


@pytest.mark.parametrize("hub, task", [(2, 8), (1000, 8), (1000, 1 << 19)])
@pytest.mark.parametrize("kind", ["path", "star", "random", "empty"])
def test_components(spark, kind, hub, task, monkeypatch):
    monkeypatch.setattr(_shared, "TASK_EDGES", task)
    monkeypatch.setattr(_shared, "HUB_EDGES", hub)
    monkeypatch.setattr(_shared, "HEAVY_KEYS", 10_000)
    r = random.Random(1)
    edges = {
        "path": [(i, i + 1) for i in range(300)],
        "star": [(7, i) for i in range(300)],
        "random": [(r.randrange(900), r.randrange(900)) for _ in range(500)],
        "empty": [],
    }[kind]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {x.id: x.component for x in _shared.connected_components(df).collect()}
    assert got == {x: find(x) for x in parent}


def test_heavy_and_few(spark):
    rows = spark.range(5000).withColumn("k", F.when(F.col("id") < 3000, 0).otherwise(F.col("id") % 50))
    groups = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    want = sorted(map(tuple, rows.join(groups, "k").select("id", "k", "n", "m").collect()))
    assert sorted(map(tuple, _shared.join_heavy(rows, groups, ["k"], "n", 5000).select("id", "k", "n", "m").collect())) == want
    for most in (10, 1000):
        assert sorted(map(tuple, _shared.join_few(rows, groups, "k", most=most).select("id", "k", "n", "m").collect())) == want


def test_without_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c"), (2, None), (3, "a")], "doc_id long, text string")
    gone = docs.where("text in ('a', 'c') and (doc_id is null or doc_id = 1)").select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"))
    left = _shared.without_rows(docs, gone, "doc_id", "text")
    assert sorted(map(repr, map(tuple, left.collect()))) == sorted(map(repr, [(1, "b"), (2, None), (3, "a")]))
    assert _shared.without_rows(docs, gone.limit(0), "doc_id", "text").count() == 5


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        fresh_dir(Session(), "x")
    Context.master = "local[4]"
    assert fresh_dir(Session(), "x").startswith("/tmp/")


def test_global_rank(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), F.lit("x").alias("part")).repartition(9)
    got = {r.v: r.rank for r in _shared.global_rank(df, [F.col("v").desc()], "rank").collect()}
    want = {v: i + 1 for i, v in enumerate(sorted((x * 7919 % 1009 for x in range(1000)), reverse=True))}
    assert got == want
    assert _shared.global_rank(df.limit(0), [F.col("v")], "rank").count() == 0
