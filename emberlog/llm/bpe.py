"""Byte-level BPE encoding and decoding with the tiktoken library.

The ranks come from a local file, read once per Python worker.  Long texts are
cut where no match of the pattern can reach across: before a blank or newline
that follows a character which is not white space.  So the ids are those of
the whole text, and decoding the ids gives back its bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, types as T

from ._shared import lean

#: Characters from which on a text is cut.
CHUNK_CHARS = 50_000
_PART_TOKENS = 1 << 19
_SAFE = re.compile(r"\S(?=[ \n])")


class Codec:
    """Encodes text to token ids and decodes ids to bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, chunk_chars: int = CHUNK_CHARS):
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.chunk_chars = chunk_chars
        n = max(ranks.values()) + 1
        self.decimal = [str(i) for i in range(n)]
        self.sizes = [0] * n
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def pieces(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > self.chunk_chars:
            cut = _SAFE.search(text, start + self.chunk_chars - 1)
            if not cut:
                break
            yield text[start : cut.end()]
            start = cut.end()
        yield text[start:]

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.chunk_chars:
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for piece in self.pieces(text):
            ids += self.encoding.encode_ordinary(piece)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding.decode_bytes(ids)

    def ids_sha256(self, ids: list[int]) -> str:
        return hashlib.sha256(",".join(map(self.decimal.__getitem__, ids)).encode()).hexdigest()


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Codec(ranks, pattern)


def _fields(df: DataFrame, names: list[str]) -> list[T.StructField]:
    return [df.schema[n] for n in names]


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", ids_col: str = "token_ids", count_col: str = "n_tokens"
) -> DataFrame:
    """``docs`` with the token ids of every whole text and their number.

    A null text counts as empty and has no ids.  Columns of these names are
    replaced, all others stay.  Rows are independent: no shuffle.
    """
    keep = [c for c in docs.columns if c not in (ids_col, count_col)]
    schema = T.StructType(
        _fields(docs, keep) + [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False)), T.StructField(count_col, T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            at = 0
            while at < b.num_rows:  # parts of about _PART_TOKENS tokens bound what the worker holds
                parts, ends, held = [], [0], 0
                while at + len(parts) < b.num_rows and held < _PART_TOKENS:
                    parts.append(np.array(c.encode(b.column(text_col)[at + len(parts)].as_py() or ""), np.int32))
                    held += len(parts[-1])
                    ends.append(held)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts)))
                rows = b.slice(at, len(parts))
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(k) for k in keep], ids, pa.array(np.diff(ends), pa.int64())], names=[*keep, ids_col, count_col]
                )
                at += len(parts)

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(lean(run), schema)


def decode(encoded: DataFrame, ranks_path: str, pattern: str, ids_col: str = "token_ids", bytes_col: str = "decoded") -> DataFrame:
    """``encoded`` with the raw bytes of the ids (null ids: empty)."""
    keep = [c for c in encoded.columns if c != bytes_col]
    schema = T.StructType(_fields(encoded, keep) + [T.StructField(bytes_col, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            out = [c.decode(x or []) for x in b.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(out, pa.binary())], names=[*keep, bytes_col])

    return encoded.mapInArrow(lean(run), schema)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text: id, n_tokens, ids_sha256, decoded_sha256.

    The same codec as :func:`encode` and :func:`decode`, in one pass, so that
    ids need not leave the Python worker.  Null counts as the empty text.
    """
    schema = T.StructType(
        [
            T.StructField(id_col, docs.schema[id_col].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        for b in batches:
            counts, of_ids, of_bytes = [], [], []
            for t in b.column(text_col):
                ids = c.encode(t.as_py() or "")
                counts.append(len(ids))
                of_ids.append(c.ids_sha256(ids))
                of_bytes.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())],
                names=schema.names,
            )

    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)
