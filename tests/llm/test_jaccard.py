import random
import re
from itertools import combinations

import numpy as np
import pytest

from emberlog.llm import _hashing, jaccard, queries


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])


def brute(rows, k, num, den):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and den * len(a & b) >= num * len(a | b):
            parent[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(repr((d, len(sets[i]), least.get(find(i)) if sets[i] else d)) for i, (d, _) in enumerate(rows))


def result(df):
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in df.collect())


def families(seed, words, n):
    """Documents and edited copies of them, at and about the threshold."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [r.choice(vocabulary) for _ in range(30)]
    rows = []
    for _ in range(n):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 3, 5, 9, 20, 60, 150]))]
        if r.random() < 0.3:
            base += passage
        for _ in range(r.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3, 5])):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            if r.random() < 0.3:
                copy = copy[: max(1, int(len(copy) * r.uniform(0.88, 1)))]
            rows.append((len(rows) * 7 % 9973, r.choice([" ", "\n", "\t "]).join(copy)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("words,num,den", [(3, 90, 100), (5, 8, 10), (1, 6, 10)])
def test_components_equal_brute_force(make, words, num, den):
    rows = families(words, words, 150)
    got = jaccard.jaccard_components(make(rows).repartition(3), words=words, num=num, den=den)
    assert result(got) == brute(rows, words, num, den)


def test_clusters_in_many_chunks_lose_nothing(make, monkeypatch):
    monkeypatch.setattr(jaccard, "POINT_CHUNK", 7)
    monkeypatch.setattr(jaccard, "SET_CHUNK", 300)
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):  # chains of small edits: neighbours link, ends do not
        base[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(base)))
    rows += families(4, 3, 40)[:80] and [(1000 + i, t) for i, (_, t) in enumerate(families(4, 3, 40))]
    got = jaccard.jaccard_components(make(rows), words=3, num=90, den=100)
    assert result(got) == brute(rows, 3, 90, 100)


def test_awkward_rows(make):
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [
        (5, None), (6, ""), (7, " \n"), (8, "a"), (3, "A"), (9, "a b"), (10, "A  B"), (11, "x y z"), (11, "x y z"), (11, "other text here"), (None, "n1 n2 n3 n4"), (None, "n1 n2 n3 n4"),
        (20, long), (19, long + " tail"), (21, "É a b"), (22, "é a b"), (2, "x y z"), (30, "q" * 200_000), (31, "q" * 200_000),
    ]
    assert result(jaccard.jaccard_components(make(rows), words=3, num=90, den=100)) == brute(rows, 3, 90, 100)
    assert jaccard.jaccard_components(make([])).count() == 0
    assert result(jaccard.jaccard_components(make([(1, None), (2, "")]))) == ["(1, 0, 1)", "(2, 0, 2)"]


def test_driver_table(spark, sf_dir, texts):
    assert result(queries.op1_jaccard_join(spark, sf_dir)) == brute(list(texts.items()), 3, 90, 100)


def test_segments_meet_for_every_link():
    """Whatever the sizes, two sets that link share a key."""
    r = np.random.default_rng(0)
    for num, den in ((90, 100), (8, 10)):
        t = jaccard.Threshold(num, den)
        for n in [1, 2, 3, 4, 9, 10, 11, 19, 30, 77, 200, 900]:
            for _ in range(20):
                a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
                keep = r.permutation(len(a))[: len(a) - r.integers(0, len(a) // 5 + 1)]
                b = np.unique(np.concatenate([a[keep], r.integers(0, 2**64, r.integers(0, n // 8 + 1), dtype=np.uint64)]))
                inter = len(np.intersect1d(a, b))
                s = jaccard.Sets(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]))
                keys, docs = jaccard.segment_keys(s, t)
                if len(b) and t.links(inter, len(a), len(b)):
                    assert len(np.intersect1d(keys[docs == 0], keys[docs == 1]))


def test_segments_meet_whatever_is_popular():
    """Segments of popular shingles are left out by no more than a pair can spare."""
    r = np.random.default_rng(2)
    for num, den in ((90, 100), (8, 10)):
        t = jaccard.Threshold(num, den)
        for n in [1, 2, 4, 10, 30, 77, 200, 900]:
            for share in (0.2, 0.5, 0.8, 0.95, 1):
                for _ in range(8):
                    a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
                    keep = r.permutation(len(a))[: len(a) - r.integers(0, len(a) // 5 + 1)]
                    b = np.unique(np.concatenate([a[keep], r.integers(0, 2**64, r.integers(0, n // 8 + 1), dtype=np.uint64)]))
                    both = np.concatenate([a, b])
                    s = jaccard.Sets(both, np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]))
                    keys, docs = jaccard.segment_keys(s, t, both >> np.uint64(32) < share * 2**32)
                    # worst for a pair that differs most: what differs is rare, what is equal popular
                    common = np.isin(both, np.intersect1d(a, b))
                    worst, at = jaccard.segment_keys(s, t, common)
                    if len(b) and t.links(len(np.intersect1d(a, b)), len(a), len(b)):
                        assert len(np.intersect1d(keys[docs == 0], keys[docs == 1]))
                        assert len(np.intersect1d(worst[at == 0], worst[at == 1]))


def test_common_passages_chain_no_clusters(make, monkeypatch):
    """Documents that share passages, but are no near copies, do not gather in one cluster."""
    largest, run = [], jaccard._chunked_components

    def spy(members, t, with_sets):
        largest.append(max([r.size for r in members.select("size").collect()], default=0))
        return run(members, t, with_sets)

    monkeypatch.setattr(jaccard, "_chunked_components", spy)
    r = random.Random(3)
    passages = [[f"p{i}x{j}" for j in range(40)] for i in range(6)]
    rows = []
    for i in range(400):
        own = [f"o{i}x{j}" for j in range(r.randrange(90, 140))]
        rows.append((i, " ".join(own + r.choice(passages) + r.choice(passages))))
        if i % 10 == 0:
            rows.append((1000 + i, rows[-1][1] + " and a tail"))
    got = jaccard.jaccard_components(make(rows).repartition(3), words=5, num=8, den=10)
    assert result(got) == brute(rows, 5, 8, 10)
    assert largest[0] <= 20


def test_packed_points():
    points = np.array([[1] * jaccard.GROUPS, [70_000] + [0] * (jaccard.GROUPS - 1)], np.int32)
    assert np.array_equal(jaccard._unpacked_points(jaccard._packed_points(points)), points)


def test_tree_finds_every_point_within_the_bound():
    r = np.random.default_rng(1)
    points = r.poisson(3, (500, jaccard.GROUPS)).astype(np.int32)
    points[100:200] = np.maximum(points[:100] + r.integers(-1, 2, (100, jaccard.GROUPS)), 0)
    sizes = points.sum(axis=1)
    t = jaccard.Threshold(8, 10)
    tree = jaccard.CountTree(sizes, points, t)
    for i in range(0, 500, 7):
        got = set(tree.order[tree.search(int(np.flatnonzero(tree.order == i)[0]))])
        bound = np.minimum(points, points[i]).sum(axis=1)
        want = set(np.flatnonzero((18 * bound >= 8 * (sizes + sizes[i])) & (sizes * 10 >= sizes[i] * 8) & (sizes * 8 <= sizes[i] * 10)))
        assert got == want


def test_word_hashes_do_not_depend_on_pieces(monkeypatch):
    text = ("Some WORDS and é " * 500 + "x" * 300 + "\n").encode()
    whole = jaccard.word_hashes(text)
    monkeypatch.setattr(jaccard, "_PIECE", 64)
    _hashing._powers.cache_clear()
    parts = jaccard.word_hashes(text)
    _hashing._powers.cache_clear()
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])


@pytest.mark.parametrize("chunk", [300, None])
def test_links_equal_brute_force(make, monkeypatch, chunk):
    """All pairs, those that others connect already too, in one chunk and in many."""
    if chunk:
        monkeypatch.setattr(jaccard, "SET_CHUNK", chunk)
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(40):  # chains: neighbours link, ends do not
        base[r.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(base)))
    rows += [(1000 + i, t) for i, (_, t) in enumerate(families(4, 3, 40))] + [(2000, rows[0][1]), (2001, None)]
    first = {}
    for d, t in sorted(rows, key=lambda x: x[0]):
        first.setdefault(shingles(t, 3), d)
    want = sorted(
        tuple(sorted((first[a], first[b]))) for a, b in combinations(first, 2) if a and b and 10 * len(a & b) >= 8 * len(a | b)
    )
    got = sorted((x.a_id, x.b_id) for x in jaccard.jaccard_links(make(rows), words=3, num=8, den=10).collect())
    assert got == want and len(want) > 60
