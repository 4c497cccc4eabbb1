"""The pipeline against a run of its decisions in plain Python where they can be told."""

import public_tokenizers as P
import pytest

import corpus_pipeline
from emberlog.llm import bpe

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, SF).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        out.append(docs)
    return out


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(staged):
    for df in staged[:-1]:
        assert df.columns == staged[0].columns
    assert {"doc_id", "token_ids", "n_tokens"} <= set(staged[-1].columns)


def test_quality_stage_keeps_good_and_drops_bad(spark, staged):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids(staged[1]))
    good = [i in kept for i, q in labels.items() if q == 1]
    bad = [i in kept for i, q in labels.items() if q == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.3


def test_exact_stage(staged):
    import re

    rows = {r.doc_id: r.text for r in staged[1].collect()}
    groups = {}
    for i, t in rows.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    assert ids(staged[2]) == sorted(min(g)[1] for g in groups.values())


def test_near_stage(staged):
    from test_jaccard import brute

    rows = [(r.doc_id, r.text) for r in staged[2].collect()]
    want = sorted({int(x.strip("()").split(", ")[2]) for x in brute(rows, 5, 8, 10)})
    assert ids(staged[3]) == want


def test_mix_stage_repeats_documents(staged):
    before, after = set(ids(staged[3])), ids(staged[4])
    assert set(after) <= before and max(after.count(i) for i in set(after)) <= 3


def test_encoding_stage(staged):
    texts = {r.doc_id: r.text for r in staged[4].collect()}
    c = bpe.codec(P.path(corpus_pipeline.RANKS), P.PATTERN)
    rows = staged[5].collect()
    assert len(rows) == staged[4].count()
    for r in rows:
        assert c.decode(list(r.token_ids)) == texts[r.doc_id].encode() and r.n_tokens == len(r.token_ids)


def test_stages_take_awkward_documents(spark, make, tmp_path):
    rows = [(1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f  g"), (4, "q" * 150_000), (5, "a b c d e f g h", None, None)]
    for n, docs in (("rows", make(rows)), ("none", make([]))):
        for i, (_, f) in enumerate(corpus_pipeline.STAGES):
            f(spark, docs, SF).write.parquet(f"{tmp_path}/{n}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{n}{i}")
        assert "token_ids" in docs.columns


def test_run_leaves_its_stages_only(spark, staged, tmp_path, monkeypatch):
    import os

    from emberlog import storage

    monkeypatch.setattr(storage, "work_dir", lambda spark: str(tmp_path))
    assert ids(corpus_pipeline.run(spark, SF)) == ids(staged[-1])
    assert [n.split("-")[1] for n in os.listdir(tmp_path)] == ["pipeline"]
