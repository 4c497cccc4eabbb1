import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from emberlog.llm import bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("whole", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def noise(r, n):
    parts = ["the", " ", "  ", "\n", "\t", "don't", "é", "日本語", "1234", "!?", " ", " ", "\x1c", "\r\n", "x" * 40, "🙂", "'s", "\x00"]
    return "".join(r.choice(parts) for _ in range(n))


@pytest.mark.parametrize("seed", range(5))
def test_pieces_give_the_ids_of_the_whole(library, seed):
    c = bpe.codec(PATH, P.PATTERN)
    small = bpe.Codec.__new__(bpe.Codec)
    small.__dict__ |= c.__dict__ | {"chunk_chars": 30}
    text = noise(random.Random(seed), 3000)
    ids = small.encode(text)
    assert ids == library.encode_ordinary(text)
    assert small.decode(ids) == text.encode()
    assert len(list(small.pieces(text))) > 10 and "".join(small.pieces(text)) == text


def test_driver_table(spark, sf_dir, texts, library):
    got = queries.op3_bpe(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_awkward_rows(make, library):
    rows = [(1, None), (2, ""), (None, "x"), (3, "a" * 200_000), (3, "a" * 200_000), (4, " " * 120_000), (5, "<|endoftext|>")]
    df = make(rows)
    enc = bpe.encode(df, PATH, P.PATTERN)
    assert set(enc.columns) == {*df.columns, "token_ids", "n_tokens"}
    back = bpe.decode(enc, PATH, P.PATTERN).collect()
    assert len(back) == len(rows)
    for r in back:
        assert bytes(r.decoded) == (r.text or "").encode() and r.n_tokens == len(r.token_ids)
        assert list(r.token_ids) == library.encode_ordinary(r.text or "")
    assert bpe.encode(make([]), PATH, P.PATTERN).count() == 0 and bpe.round_trip(make([]), PATH, P.PATTERN).count() == 0
