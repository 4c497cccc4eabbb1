import hashlib
import random

import pytest
from pyspark.sql import functions as F

from emberlog.llm import fingerprints, queries


def edited(rows):
    """(id, text, next text, edited) in falling order of ids, nulls last."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (d, t) in enumerate(order):
        t, nxt = t or "", order[(i + 1) % len(order)][1] or ""
        third = len(t) // 3
        out.append((d, t, nxt, t[: len(t) - third] + nxt[:third]))
    return out


def likeness(a, b):
    return 1 - bin(int(a, 16) ^ int(b, 16)).count("1") / 128


def by_hand(spark, texts):
    """Bits from the votes of every shingle, from the same term hashes."""
    out = {}
    for t in texts:
        w = [x for x in t.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if x]
        if not w:
            out[t] = "0" * 32
            continue
        df = spark.createDataFrame([(w,)], "w array<string>").select(F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
        if len(w) >= 5:
            terms = [F.xxhash64(*[F.element_at("h", i + k + 1) for k in range(5)]) for i in range(len(w) - 4)]
        else:
            terms = [F.xxhash64("h")]
        row = df.select(F.array(*terms).alias("t")).select("t", F.transform("t", lambda x: F.xxhash64(x, F.lit(1))).alias("g")).first()
        halves = []
        for part in (row.t, row.g):
            bits = 0
            for b in range(64):
                bits |= (2 * sum((x >> b) & 1 for x in part) > len(part)) << b
            halves.append(f"{bits:016x}")
        out[t] = "".join(halves)
    return out


@pytest.mark.parametrize("buckets", [1, 3, 8])
def test_against_votes_by_hand(spark, make, buckets):
    r = random.Random(1)
    rows = [(i * 3, " ".join(r.choice("alpha beta gamma delta é日 eps zeta".split()) for _ in range(r.choice([0, 1, 4, 5, 6, 40])))) for i in range(24)]
    rows += [(1000, None), (None, "last of all has a null id"), (7, "tab\tand\nline\x0bbreaks here now")]
    want = {d: (t, nxt, e) for d, t, nxt, e in edited(rows)}
    hand = by_hand(spark, {x for v in want.values() for x in v})
    got = fingerprints.edited_fingerprints(make(rows), buckets=buckets).collect()
    assert len(got) == len(rows)
    for x in got:
        t, nxt, e = want[x.doc_id]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(e.encode()).hexdigest(), x
        assert (x.fingerprint, x.edited_fingerprint) == (hand[t], hand[e])
        assert x.near_edited == pytest.approx(likeness(hand[t], hand[e])) and x.near_next == pytest.approx(likeness(hand[t], hand[nxt]))


def test_likeness_tells_edits_from_strangers(spark):
    got = queries.op10_fingerprints(spark, "/root/testdata/sf0.01").where("n_chars > 300").collect()
    assert sum(x.near_edited for x in got) / len(got) > 0.68
    assert sum(x.near_next for x in got) / len(got) < 0.6
    assert sum(x.near_edited > x.near_next for x in got) / len(got) > 0.95


def test_repeated_rows_and_empty_table(make):
    rows = [(1, "same text of some words here"), (1, "same text of some words here"), (2, "same text of some words here"), (1, "another text")]
    got = fingerprints.edited_fingerprints(make(rows)).collect()
    assert len(got) == 4 and len({x.fingerprint for x in got if x.n_chars > 20}) == 1
    assert fingerprints.edited_fingerprints(make([])).count() == 0
    one = fingerprints.edited_fingerprints(make([(5, "abcdef")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one.near_next == 1.0


def test_long_text_passes_the_lane_groups(spark, make):
    r = random.Random(2)
    text = " ".join(str(r.randrange(50)) for _ in range(40_000))
    got = fingerprints.fingerprints(make([(1, text), (2, text + " more")])).collect()
    assert len(got) == 2 and likeness(got[0].fingerprint, got[1].fingerprint) > 0.9


@pytest.mark.parametrize("radius", [0, 3, 7])
def test_block_tables_find_all(spark, radius):
    r = random.Random(radius)
    fps = set()
    for _ in range(60):
        base = r.getrandbits(128)
        fps.add(base)
        for _ in range(4):
            x = base
            for b in r.sample(range(128), r.randrange(0, 9)):
                x ^= 1 << b
            fps.add(x)
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    rows = [(signed(x >> 64), signed(x & (2**64 - 1))) for x in fps]
    df = spark.createDataFrame(rows, "hi long, lo long")
    asked = df.where("hi % 2 = 0")
    got = [((p.q_hi, p.q_lo), (p.hi, p.lo), p.distance) for p in fingerprints.near_fingerprints(asked, df, radius).collect()]
    u = lambda p: ((p[0] % 2**64) << 64) | (p[1] % 2**64)
    want = [(a, b, d) for a in rows if a[0] % 2 == 0 for b in rows if (d := bin(u(a) ^ u(b)).count("1")) <= radius]
    assert sorted(got) == sorted(want)


def test_near_counts(make):
    rows = [(100, "one two three four five six"), (101, "one two three four five six"), (200, "quite other words stand in here"), (300, None), (302, "")]
    got = {x.doc_id: x.n_near for x in fingerprints.edited_fingerprints(make(rows)).collect()}
    assert got == {100: 1, 101: None, 200: 0, 300: 1, 302: None}


def test_native_plan(make):
    plan = fingerprints.fingerprints(make([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("radius", [8, 19, 27, 33])
def test_wide_radius_finds_all(spark, radius):
    r = random.Random(radius)
    fps = set()
    for _ in range(12):
        base = r.getrandbits(128)
        fps.add(base)
        for _ in range(12):
            x = base
            for b in r.sample(range(128), r.randrange(0, radius + 3)):
                x ^= 1 << b
            fps.add(x)
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    rows = [(signed(x >> 64), signed(x & (2**64 - 1))) for x in sorted(fps)]
    df = spark.createDataFrame(rows, "hi long, lo long")
    asked = spark.createDataFrame(rows[::5], "hi long, lo long")
    got = [((p.q_hi, p.q_lo), (p.hi, p.lo), p.distance) for p in fingerprints.near_fingerprints(asked, df, radius).collect()]
    u = lambda p: ((p[0] % 2**64) << 64) | (p[1] % 2**64)
    want = [(a, b, d) for a in rows[::5] for b in rows if (d := bin(u(a) ^ u(b)).count("1")) <= radius]
    assert sorted(got) == sorted(want)


def test_near_copies_of_likeness_four_fifths_are_counted(make):
    r = random.Random(5)
    rows = []
    for i in range(1, 31):  # one changed word in 50: five shingles of 300 at a time, Jaccard above 0.8
        w = [f"w{r.randrange(10**6)}" for _ in range(300)]
        copy = list(w)
        for at in range(20, 300, 50):
            copy[at] = f"x{r.randrange(10**6)}"
        rows += [(i * 100, " ".join(w)), (i * 100 + 1, " ".join(copy))]
    got = [x.n_near for x in fingerprints.edited_fingerprints(make(rows)).collect() if x.doc_id % 100 == 0]
    assert max(got) == 1 and sum(got) >= 28


def test_ranges_follow_the_bytes_of_text(make, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 40)
    rows = [(i * 7 % 101, f"text of number {i}") for i in range(101)] + [(None, "null")]
    order = [t for _, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))]
    got = {r.text: r.next_text for r in fingerprints.with_next(make(rows), "doc_id", "text").collect()}
    assert got == {t: order[(i + 1) % len(order)] for i, t in enumerate(order)}


def test_queries_of_one_large_group(make):
    same, other = "the same words stand in every one of these texts", "quite another text that nobody else has written"
    rows = [(i * 100, same) for i in range(700)] + [(i * 100 + 1, same) for i in range(50)] + [(90_000, other), (90_001, None)]
    got = {r.doc_id: r.n_near for r in fingerprints.edited_fingerprints(make(rows)).collect()}
    assert {got[i * 100] for i in range(700)} == {749} and got[90_000] == 0
    assert {got[i * 100 + 1] for i in range(50)} | {got[90_001]} == {None}
