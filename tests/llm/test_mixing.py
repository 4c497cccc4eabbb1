import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberlog.llm import mixing, queries


def targets(sizes, weights=(5, 2, 1), most=3):
    """Water-filling by hand: sources in code-point order, null last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(most * sizes[s] for s in full)
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else share[s] for s in names}
        full |= over


def check(rows, result, block=mixing.BLOCK_WORDS, tolerance=None):
    words = lambda t: len((t or "").replace("\x0b", " ").split())
    by = defaultdict(int)
    for _, t, s in rows:
        by[s] += words(t)
    want, source = targets(by), {}
    for i, t, s in rows:
        source[i] = (s, words(t))
    got = defaultdict(int)
    assert len(result) == len(rows)
    for r in result:
        s, n = source[r.doc_id]
        assert r.size == n and r.source_size == by[s] and abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r.size
        got[s] += r.taken
    for s in want:
        assert abs(got[s] - want[s]) <= (tolerance or 2 * block), (s, got[s], want[s])


def make_rows(seed, n=600, sources=("a", "B", "é", None, "", "z")):
    r = random.Random(seed)
    return [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 400])), r.choices(sources, [50, 1, 5, 3, 2, 9])[0]) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_limits(make, seed):
    rows = make_rows(seed)
    df = make([(i, t, "en", s) for i, t, s in rows])
    check(rows, mixing.mix(df, shard_docs=100).collect(), tolerance=6 * mixing.BLOCK_WORDS)


def test_reruns_and_partitionings_agree(make):
    df = make([(i, t, "en", s) for i, t, s in make_rows(5)])
    a = sorted((r.doc_id, r.taken) for r in mixing.mix(df).collect())
    assert a == sorted((r.doc_id, r.taken) for r in mixing.mix(df.repartition(7)).collect())
    assert a != sorted((r.doc_id, r.taken) for r in mixing.mix(df, seed=8).collect())


def test_driver_table(spark, sf_dir, docs):
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    check(rows, queries.op8_mix_sources(spark, sf_dir).collect(), tolerance=3 * mixing.BLOCK_WORDS)


def test_awkward_rows(make):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "one two", "en", None), (None, "x y z", "en", "b"), (4, "x", "en", "b"), (4, "x", "en", "b")]
    got = mixing.mix(make(rows)).collect()
    assert len(got) == 6
    assert sorted(r.size for r in got) == [0, 0, 1, 1, 2, 3]
    assert mixing.mix(make([])).count() == 0
    assert all(r.taken == 0 for r in mixing.mix(make([(1, None, "en", "a"), (2, " ", "en", None)])).collect())


def test_whitespace_of_words(make):
    assert [r.size for r in mixing.mix(make([(1, "a b c\x1fd\te")])).collect()] == [3]


def test_documents_are_repeated_as_taken(make):
    df = make([(i, t, "en", s) for i, t, s in make_rows(1)])
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix(df).collect()}
    rows = mixing.mixed_documents(df)
    assert rows.columns == df.columns
    counts = defaultdict(int)
    for r in rows.collect():
        counts[r.doc_id] += 1
    for i, (size, n) in taken.items():
        assert counts[i] == (int(n / size + 0.5) if size else 0)


def dealt(votes, limits, seats):
    """Seat by seat, to the highest quotient, of equal ones to the first row."""
    won = [0] * len(votes)
    for _ in range(seats):
        open_ = [i for i in range(len(votes)) if won[i] < limits[i] and votes[i] > 0]
        if not open_:
            break
        won[max(open_, key=lambda i: (votes[i] / (2 * won[i] + 1), -i))] += 1
    return won


CASES = [
    ([5000] + [25 + i % 3 for i in range(200)], 10**6, 100),
    ([5002] + [50 + i % 51 for i in range(66)], 10**6, 100),
    ([7, 7, 7, 7], 10**6, 6),
    ([100, 1, 1, 0], 10, 30),
    ([3, 5], 1, 9),
    ([0, 0], 5, 3),
    ([], 5, 3),
    ([1000] * 50, 40, 333),
]


@pytest.mark.parametrize("votes, limit, seats", CASES)
def test_highest_quotients(spark, votes, limit, seats):
    limits = [limit + i % 2 for i in range(len(votes))]
    want = dealt(votes, limits, seats)
    if votes:
        assert mixing.apportion(np.array(votes), np.array(limits), seats).tolist() == want
    df = spark.createDataFrame([(i, float(v), m) for i, (v, m) in enumerate(zip(votes, limits))], "key int, votes double, most long")
    got = {r.key: r.quota for r in mixing.sainte_lague(df, [F.col("key")], "votes", "most", seats).collect()}
    assert [got[i] for i in range(len(votes))] == want


def test_quotients_of_random_rows():
    r = np.random.default_rng(3)
    for n in (1, 2, 30, 200):
        votes, limits = r.integers(0, 500, n), r.integers(0, 30, n)
        for seats in (1, n, 5 * n, 100 * n):
            assert mixing.apportion(votes, limits, seats).tolist() == dealt(votes.tolist(), limits.tolist(), seats)


@pytest.mark.parametrize("seed", range(3))
def test_small_corpora_come_near_their_targets(make, seed):
    r = random.Random(seed)
    rows = [(i, " ".join(["w"] * r.randrange(1, 6)), r.choice("ab")) for i in range(r.choice([3, 10, 40]))]
    check(rows, mixing.mix(make([(i, t, "en", s) for i, t, s in rows])).collect(), tolerance=1)


