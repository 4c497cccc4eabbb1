"""Token counts of sections by offset-mapped attribution.

Every document is encoded once as a whole.  The byte spans of its tokens are
joined to the spans of its sections, two sorted lists of intervals, and a
token that crosses a boundary goes to one section by an explicit rule, so the
counts of the sections add up to the count of the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from ._shared import lean
from .bpe import codec

RULES = ("start", "most")


def attribute(sizes: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section.  sizes: bytes of the tokens in order; bounds:
    byte offsets where sections start, the first 0, rising.

    "start": a token belongs to the section that holds its first byte.
    "most": to the one that holds most of its bytes, the earlier one on a tie.
    """
    if not len(sizes):
        return np.zeros(len(bounds), np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    at = np.searchsorted(bounds, starts, "right") - 1
    if rule == "most":
        last = np.searchsorted(bounds, ends - 1, "right") - 1
        for i in np.nonzero(last > at)[0]:
            edges = np.clip(np.append(bounds[at[i] : last[i] + 1], ends[i]), starts[i], ends[i])
            at[i] += int(np.argmax(np.diff(edges)))
    return np.bincount(at, minlength=len(bounds))


def section_bounds(data: bytes, separator: bytes) -> np.ndarray:
    """Starts of the sections of UTF-8 bytes; a separator ends its section."""
    bounds, at = [0], data.find(separator)
    while at >= 0:
        if at + len(separator) < len(data):
            bounds.append(at + len(separator))
        at = data.find(separator, at + len(separator))
    return np.array(bounds, np.int64)


def section_token_counts(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    separator: str = "\n",
    rule: str = "start",
) -> DataFrame:
    """One row per section: id, section_no, start_char, end_char, n_tokens, doc_tokens.

    Sections are the parts between separators, each with the separator that
    ends it; offsets count code points.  A null or empty text has one empty
    section of no tokens.  Repeated rows each give their sections.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = T.StructType(
        [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("section_no", T.IntegerType())]
        + [T.StructField(n, T.LongType()) for n in ("start_char", "end_char", "n_tokens", "doc_tokens")]
    )
    sep = separator.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        sizes = np.array(c.sizes, np.int64)
        for b in batches:
            rows, cols = [], [[], [], [], [], []]
            for i, t in enumerate(b.column(text_col)):
                text = t.as_py() or ""
                data = text.encode()
                ids = np.array(c.encode(text), np.int64)
                bounds = section_bounds(data, sep)
                counts = attribute(sizes[ids], bounds, rule)
                lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80  # first bytes of characters
                chars = np.append(0, np.cumsum(lead))
                edges = chars[np.append(bounds, len(data))]
                rows.append(np.full(len(bounds), i))
                for to, x in zip(cols, (np.arange(len(bounds)), edges[:-1], edges[1:], counts, np.full(len(bounds), len(ids)))):
                    to.append(x)
            if rows:
                kinds = [pa.int32(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays(
                    [b.column(id_col).take(pa.array(np.concatenate(rows))), *[pa.array(np.concatenate(x), k) for x, k in zip(cols, kinds)]],
                    names=schema.names,
                )

    return docs.select(id_col, text_col).mapInArrow(lean(run), schema)


def field_token_counts(
    rows: DataFrame, ranks_path: str, pattern: str, id_col: str, fields: list[str], separator: str = "\n\x1f", rule: str = "start"
) -> DataFrame:
    """Tokens of each of ``fields`` when a row is encoded as one joined text.

    Returns id, field, n_tokens.  Fields must not hold the separator; a
    separator belongs to the field before it, null fields are empty.
    """
    parts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    text = F.concat_ws(separator, *parts, F.lit("."))
    names = F.array(*[F.lit(f) for f in fields])
    counts = section_token_counts(rows.select(F.col(id_col), text.alias("__t")), ranks_path, pattern, id_col, "__t", separator, rule)
    return counts.where(F.col("section_no") < len(fields)).select(
        id_col, F.element_at(names, F.col("section_no") + 1).alias("field"), "n_tokens"
    )
