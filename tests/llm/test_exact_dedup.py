import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from emberlog.llm import exact_dedup, queries
from emberlog.llm._shared import materialize

AWKWARD = [
    (1, "a b"), (2, "ab "), (3, "a\tb\n\x0b"), (4, "ab"), (5, None), (6, ""), (7, " \n"), (8, "é x"), (9, "éx"), (10, "q" * 300_000), (11, "q" * 300_000),
    (None, "null id"), (None, "nullid"), (12, "nullid"), (13, "same"), (13, "same"), (13, "same"), (14, "s ame"),
]


def brute(rows):
    groups = defaultdict(list)
    for i, (d, t) in enumerate(rows):
        t = t or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", t)].append((-len(t), d is None, d if d is not None else 0, i))
    out = []
    for norm, m in groups.items():
        m.sort()
        keep = rows[m[0][3]][0]
        for k, (_, _, _, i) in enumerate(m):
            out.append((rows[i][0], keep, len(m), k == 0, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(map(repr, out))


def result(df):
    return sorted(repr((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in df.collect())


@pytest.mark.parametrize("bits", [32768, 2**20])
def test_awkward_rows(make, bits):
    assert result(exact_dedup.exact_groups(make(AWKWARD), max_bits=bits)) == brute(AWKWARD)


def test_empty_table(make):
    assert exact_dedup.exact_groups(make([])).count() == 0
    assert exact_dedup.drop_exact_copies(make([])).count() == 0


def test_driver_table(spark, sf_dir, texts):
    assert result(queries.op6_exact_dedup(spark, sf_dir)) == brute(list(texts.items()))


def test_ranges_of_hashes(make):
    rows = [(i, f"text {i % 4000}") for i in range(6000)]
    assert result(exact_dedup.exact_groups(make(rows, extra=False), max_bits=32768)) == brute(rows)
    left = exact_dedup.drop_exact_copies(make(rows, extra=False), max_bits=32768).collect()
    assert sorted(r.doc_id for r in left) == list(range(4000))


def test_unique_rows_pass_at_many_times_the_bound_of_a_filter(spark):
    # 20 ranges; one filter of 32768 bits would be full
    n = 40_000
    rows = spark.range(n).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("__sha"))
    twice = materialize(rows.union(rows.limit(100)))
    tested = exact_dedup.tested_rows(twice, n + 100, 32768)
    assert tested.count() == n + 100
    assert 200 <= tested.where("__maybe").count() < 0.03 * n
    whole = exact_dedup.possibly_repeated(twice, exact_dedup.repeated_bitmap(twice, 32768), 32768)
    assert whole.where("__maybe").count() > 0.4 * n


def test_bitmap_of_repeats_may_be_full(make):
    rows = [(i, f"text {i % 3000}") for i in range(6000)] + [(6000 + i, f"alone {i}") for i in range(3000)]
    left = exact_dedup.drop_exact_copies(make(rows, extra=False), max_bits=32768).collect()
    assert sorted(r.doc_id for r in left) == list(range(3000)) + list(range(6000, 9000))


def test_drop_keeps_one_row_with_all_its_columns(make):
    df = make(AWKWARD)
    left = exact_dedup.drop_exact_copies(df)
    assert left.columns == df.columns
    want = sorted({repr(x) for x in brute(AWKWARD) if "True" in x})
    assert left.count() == sum(", True, " in x for x in brute(AWKWARD)) and want
    assert {r.th for r in left.collect()} == {"x"}


def test_native_plan(make):
    plan = exact_dedup.exact_groups(make(AWKWARD))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
