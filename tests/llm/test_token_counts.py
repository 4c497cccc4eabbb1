import random
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from emberlog.llm import bpe, queries, token_counts

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def brute(text, rule):
    """Counts by walking over bytes."""
    c = bpe.codec(PATH, P.PATTERN)
    data = text.encode()
    section, owner = 0, []
    for b in data:
        owner.append(section)
        section += b == 10
    last = owner[-1] if owner else 0
    counts, at = [0] * (last + 1), 0
    ids = c.encode(text)
    for i in ids:
        mine = owner[at : at + c.sizes[i]]
        counts[mine[0] if rule == "start" else max(sorted(set(mine)), key=mine.count)] += 1
        at += c.sizes[i]
    return counts, len(ids)


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_against_bytes(make, rule):
    r = random.Random(1)
    rows = [(i, "".join(r.choice(["word", " ", "\n", "\n\n\n", "é", "日本", "12", "."]) for _ in range(60))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "no end"), (104, "end\n"), (None, "a\nb"), (105, "x" * 100_000 + "\n" + "y z" * 50_000)]
    got = defaultdict(dict)
    for x in token_counts.section_token_counts(make(rows), PATH, P.PATTERN, rule=rule).collect():
        got[x.doc_id][x.section_no] = x
    for i, t in rows:
        counts, n = brute(t or "", rule)
        assert [got[i][k].n_tokens for k in range(len(got[i]))] == counts, (i, t)
        assert {x.doc_tokens for x in got[i].values()} == {n}
        for k, x in got[i].items():
            assert (t or "")[x.start_char : x.end_char].count("\n") <= 1
        assert sum(x.end_char - x.start_char for x in got[i].values()) == len(t or "")


def test_most_rule_with_ties():
    a = token_counts.attribute
    assert list(a(np.array([4, 2]), np.array([0, 1]), "most")) == [0, 2]
    assert list(a(np.array([4, 2]), np.array([0, 2]), "most")) == [1, 1]
    assert list(a(np.array([4, 2]), np.array([0, 2]), "start")) == [1, 1]
    assert list(a(np.array([9]), np.array([0, 1, 3, 8]), "most")) == [0, 0, 1, 0]
    assert list(a(np.array([], int), np.array([0]), "most")) == [0]


def test_driver_table(spark, sf_dir, texts):
    got = defaultdict(int)
    for r in queries.op4_token_counts(spark, sf_dir).collect():
        got[r.doc_id] += r.n_tokens
    c = bpe.codec(PATH, P.PATTERN)
    assert got == {i: len(c.encode(t)) for i, t in texts.items()}


def test_fields_and_empty(make):
    df = make([(1, "some words here", "en", "src 1"), (2, None, None, "")])
    got = {(r.doc_id, r.field): r.n_tokens for r in token_counts.field_token_counts(df, PATH, P.PATTERN, "doc_id", ["source", "text"]).collect()}
    assert set(got) == {(1, "source"), (1, "text"), (2, "source"), (2, "text")}
    assert got[1, "text"] >= 3
    assert token_counts.section_token_counts(make([]), PATH, P.PATTERN).count() == 0
    with pytest.raises(ValueError):
        token_counts.section_token_counts(df, PATH, P.PATTERN, rule="other")
