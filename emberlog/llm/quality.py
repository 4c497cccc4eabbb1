"""Quality classifier: interpolated modified Kneser-Ney model of word bigrams.

The model is trained on trusted text, the documents labelled good, per
language.  Tokens are runs of letters, of digits (told apart by length) or of
other signs; case counts, no script is folded, and a character from U+3000 on
is a token of its own.  The vocabulary of a language are its most frequent
tokens; all others are counted as one unknown token, whose chance is shared
by the types seen.  Trusted text is parted in two by a hash of the text, and a document is
scored by the model of the part that does not hold it, so that no document is
judged by a model that knows it by heart.

Counts are packed lists of bigrams, hash-sharded and merged shard by shard.
With the sums of contexts and continuations, which are one number per word of
the vocabulary, the cost of a bigram that the model has not seen is a sum of
two such numbers and is added up where the document is.  What a seen bigram
costs less is looked up in its shard, where the packed bigrams of the
documents meet the model; the parts of a document's sum add up to its
perplexity.

A document is rejected when a token costs more on average than the ``HIGH``
quantile of the trusted documents of its language, or when what it says once
(every different bigram counted one time) costs less per token than their
``LOW`` quantile, as text does that repeats itself.

Sums are whole numbers (millionths of a nat), so reruns agree to the bit.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from ._hashing import BYTE, U64, span_hashes
from ._shared import join_few, lean, materialize, without_rows

HIGH, LOW = 0.995, 0.003
#: Limits lie at least so far from the mean of the language, as times the mean:
#: quantiles of few documents say little.
MARGIN_HIGH, MARGIN_LOW = 1.1, 0.5
#: Tokens at the mean of the language that every score is smoothed with, so
#: that a few odd words do not condemn a short text.
PRIOR_TOKENS = 10
#: Words of a language's vocabulary at most, and of all languages together.
VOCABULARY = (1 << 16) - 3
VOCABULARY_ALL = 1 << 20
UNKNOWN, START, END = 0, 1, 2
_FIRST_WORD = 3
#: Shards of the bigrams at least, and trusted tokens of a language that one more stands for.
SHARDS = 4
SHARD_TOKENS = 1 << 23
#: Documents, times shards, whose bigrams meet one copy of a model shard.
SALT_DOCS = 16_384
#: Labelled ids up to which they are broadcast; beyond, texts are joined by a shuffle.
FEW_IDS = 1 << 22
_WORD_SHARDS = 32
_LOOSE_SALTS = 64
_PIECE = 1 << 19
_CHUNK_CHARS = 1 << 22
_CHUNK_DOCS = 4096
_HELD = 1 << 22
_MICRO = 1e6
_STEPS = 1000

# ---------------------------------------------------------------- tokens

_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_VALUE = BYTE.copy()
_VALUE[48:58] = BYTE[48]


def _parts(raw: bytes) -> Iterator[bytes]:
    """Parts of at most ``_PIECE`` bytes, cut after a blank if there is one, else between characters."""
    at = 0
    while len(raw) - at > _PIECE:
        end = max(raw.rfind(c, at, at + _PIECE) for c in (b" ", b"\n")) + 1
        if end <= at:
            end = at + _PIECE
            while end > at + 1 and raw[end] & 0xC0 == 0x80:
                end -= 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def _token_spans(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = _KIND[a]
    alone = (a >= 0xE3) & (a <= 0xED)
    first = kind != 0
    first[1:] &= kind[1:] != kind[:-1]
    first |= alone
    first[3:] |= alone[:-3] & (kind[3:] != 0)
    last = kind != 0
    last[:-1] &= (kind[1:] != kind[:-1]) | first[1:]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the text) of every token, in order."""
    hashes, docs = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    held, of, size = [], [], 0

    def flush() -> None:
        if held:
            a = np.frombuffer(b"\n".join(held), np.uint8)
            s, e = _token_spans(a)
            hashes.append(span_hashes(_VALUE[a], s, e, 2 * _PIECE))
            ends = np.cumsum([len(x) + 1 for x in held])
            docs.append(np.array(of)[np.searchsorted(ends, s, "right")])
            held.clear(), of.clear()

    for i, t in enumerate(texts):
        for part in _parts(t.encode()):
            if size + len(part) > _PIECE:
                flush()
                size = 0
            held.append(part)
            of.append(i)
            size += len(part)
    flush()
    return np.concatenate(hashes), np.concatenate(docs)


def bigrams(ids: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bigram, document) for every token and the end of each document that has tokens."""
    if not len(ids):
        return np.empty(0, np.uint64), doc
    new = np.append(True, doc[1:] != doc[:-1])
    before = np.append(START, ids[:-1])
    before[new] = START
    last = np.append(new[1:], True)
    keys = np.concatenate((before << 16 | ids, ids[last] << 16 | END)).astype(np.uint64)
    return keys, np.concatenate((doc, doc[last]))


# ---------------------------------------------------------------- packed lists


def _planes(columns: Iterable[np.ndarray]) -> bytes:
    """Columns of numbers, byte by byte, compressed."""
    raw = b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unplanes(data: bytes, kinds: str) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8), [], 0
    widths = [np.dtype(k).itemsize for k in kinds]
    n = len(raw) // sum(widths)
    for kind, width in zip(kinds, widths):
        out.append(np.ascontiguousarray(raw[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Rising keys below 2^32 and their counts."""
    return _planes((np.diff(keys, prepend=U64(0)).astype(np.uint32), counts.astype(np.uint64)))


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, n = _unplanes(data, "IQ")
    return np.cumsum(step, dtype=np.uint64), n.astype(np.int64)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Rising keys and the sums of their counts."""
    if len(parts) == 1:
        return parts[0]
    k, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.empty(0, np.int64)
    return k[start], np.add.reduceat(n, start) if len(k) else n


class _Counter:
    """Counts by name, merged as they come; flushed when they grow large."""

    def __init__(self):
        self.held: dict[tuple, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.rows = 0

    def add(self, name: tuple, keys: np.ndarray, counts: np.ndarray) -> None:
        parts = self.held.setdefault(name, [])
        parts.append((keys, counts))
        self.rows += len(keys)
        if len(parts) > 16:
            before = sum(len(k) for k, _ in parts)
            self.held[name] = [_summed(parts)]
            self.rows -= before - len(self.held[name][0][0])

    def flush(self) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
        for name, parts in self.held.items():
            yield name, *_summed(parts)
        self.held, self.rows = {}, 0


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = zip(*rows) if rows else ([] for _ in fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _chunks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    chars, a = 0, 0
    sizes = pc.fill_null(pc.utf8_length(b.column("text")), 0).to_pylist()
    for i, n in enumerate(sizes):
        if i > a and (chars + n > _CHUNK_CHARS or i - a >= _CHUNK_DOCS):
            yield b.slice(a, i - a)
            a, chars = i, 0
        chars += n
    if a < len(sizes):
        yield b.slice(a)


def _by_lang(chunk: pa.RecordBatch) -> dict[str, list[int]]:
    rows: dict[str, list[int]] = {}
    for i, x in enumerate(chunk.column("lang").to_pylist()):
        rows.setdefault(x, []).append(i)
    return rows


def _texts(chunk: pa.RecordBatch, at: list[int]) -> list[str]:
    return [x or "" for x in chunk.column("text").take(pa.array(at)).to_pylist()]


def _part_of(th: np.ndarray) -> np.ndarray:
    """The half that a text belongs to."""
    return (th >> 32) & 1


# ---------------------------------------------------------------- vocabulary


def _count_class(n: np.ndarray) -> np.ndarray:
    """Classes of counts, rising: each count below 1024, then 64 to a doubling."""
    return np.where(n < 1024, n, 1024 + np.floor(64 * np.log2(np.maximum(n, 1024) / 1024))).astype(np.int64)


@dataclass
class Vocabulary:
    """Tokens of a language: hashes, rising; their place gives the id.  ``unknown``: types beside them."""

    hashes: np.ndarray
    unknown: int
    tokens: int

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at + _FIRST_WORD, UNKNOWN)


_WORD_ROWS = "lang string, shard int, hashes binary, counts binary"


def _word_counts(trusted: DataFrame) -> DataFrame:
    """lang, shard, hashes, counts of all trusted text, one row per language and shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for (lang,), h, n in counter.flush():
                cut = np.searchsorted(h >> U64(59), np.arange(_WORD_SHARDS + 1, dtype=np.uint64))
                yield _batch(_WORD_ROWS, [(lang, s, h[a:e].tobytes(), n[a:e].tobytes()) for s, (a, e) in enumerate(zip(cut, cut[1:])) if e > a])

        for b in batches:
            for chunk in _chunks(b):
                for lang, at in _by_lang(chunk).items():
                    h, n = np.unique(token_hashes(_texts(chunk, at))[0], return_counts=True)
                    counter.add((lang,), h, n.astype(np.int64))
            if counter.rows > _HELD:
                yield from out()
        yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, shard), parts in _runs(batches, ("lang", "shard"), lambda r: (np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["counts"], np.int64))):
            yield _batch(_WORD_ROWS, [(lang, shard, parts[0].tobytes(), parts[1].tobytes())])

    counted = trusted.select("lang", "text").mapInArrow(lean(count), _WORD_ROWS)
    return counted.repartition("lang", "shard").sortWithinPartitions("lang", "shard").mapInArrow(lean(merge), _WORD_ROWS)


def _runs(batches: Iterator[pa.RecordBatch], names: tuple[str, ...], read) -> Iterator[tuple[tuple, tuple[np.ndarray, np.ndarray]]]:
    """Sums of counts over each run of rows with equal names."""
    now, parts = None, []
    for b in batches:
        for i in range(b.num_rows):
            row = {c: b.column(c)[i].as_py() for c in b.schema.names}
            name = tuple(row[c] for c in names)
            if name != now:
                if parts:
                    yield now, _summed(parts)
                now, parts = name, []
            parts.append(read(row))
            if len(parts) > 16:
                parts = [_summed(parts)]
    if parts:
        yield now, _summed(parts)


def vocabularies(trusted: DataFrame, most: int = VOCABULARY, most_all: int = VOCABULARY_ALL) -> dict[str, Vocabulary]:
    """The vocabulary of each language of ``trusted`` (lang, text).

    A language takes the largest classes of counts whose words are no more
    than ``most`` (with many languages, than its part of ``most_all``).  The
    driver gets these words and one row per language and class.
    """
    words = materialize(_word_counts(trusted))

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, n in zip(b.column("lang").to_pylist(), b.column("counts").to_pylist()):
                n = np.frombuffer(n, np.int64)
                c, at = np.unique(_count_class(n), return_inverse=True)
                sums = zip(c.tolist(), np.bincount(at).tolist(), np.bincount(at, n).astype(np.int64).tolist())
                yield _batch("lang string, class bigint, types bigint, tokens bigint", [(lang, *x) for x in sums])

    found = words.mapInArrow(lean(classes), "lang string, class bigint, types bigint, tokens bigint")
    by: dict[str, list[tuple[int, int, int]]] = {}
    for r in found.groupBy("lang", "class").agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens")).collect():
        by.setdefault(r["lang"], []).append((r["class"], r["types"], r["tokens"]))
    room = min(most, most_all // max(1, len(by)))
    least = {}
    for lang, rows in by.items():
        held, least[lang] = 0, 1 << 62
        for c, types, _ in sorted(rows, reverse=True):
            held += types
            if held > room:
                break
            least[lang] = c

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, h, n in zip(*(b.column(c).to_pylist() for c in ("lang", "hashes", "counts"))):
                keep = _count_class(np.frombuffer(n, np.int64)) >= least[lang]
                yield _batch("lang string, hashes binary", [(lang, np.frombuffer(h, np.uint64)[keep].tobytes())])

    held: dict[str, list[np.ndarray]] = {lang: [np.empty(0, np.uint64)] for lang in by}
    for r in words.mapInArrow(lean(chosen), "lang string, hashes binary").collect():
        held[r["lang"]].append(np.frombuffer(r["hashes"], np.uint64))
    out = {}
    for lang, rows in by.items():
        h = np.sort(np.concatenate(held[lang]))
        out[lang] = Vocabulary(h, sum(t for _, t, _ in rows) - len(h), sum(n for _, _, n in rows))
    return out


# ---------------------------------------------------------------- model


@dataclass
class PartModel:
    """What one part of a language's trusted text gives for each word of the vocabulary."""

    totals: np.ndarray
    gamma: np.ndarray
    chance: np.ndarray
    discounts: np.ndarray
    unknown: int

    def base(self, keys: np.ndarray) -> np.ndarray:
        """Cost of bigrams as if none had been seen."""
        rare = np.where(np.arange(len(self.chance)) == UNKNOWN, np.log(max(1, self.unknown)), 0.0)
        context = np.rint(-np.log(self.gamma) * _MICRO).astype(np.int64)
        word = np.rint((rare - np.log(self.chance)) * _MICRO).astype(np.int64)
        return context[keys >> U64(16)] + word[keys & U64(0xFFFF)]

    def gain(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What bigrams that were seen so often cost beside ``base``: nothing, or less."""
        v, w = keys >> U64(16), keys & U64(0xFFFF)
        below = self.gamma[v] * self.chance[w]
        seen = (counts - self.discounts[np.minimum(counts, 3) - 1]) / self.totals[v]
        return -np.rint(np.log1p(seen / below) * _MICRO).astype(np.int64)

    def probability(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Of bigrams with their counts (0: never seen)."""
        v, w = keys >> U64(16), keys & U64(0xFFFF)
        own = np.where(counts > 0, (counts - self.discounts[np.minimum(np.maximum(counts, 1), 3) - 1]) / np.maximum(self.totals[v], 1), 0.0)
        return (own + self.gamma[v] * self.chance[w]) / np.where(w == UNKNOWN, max(1, self.unknown), 1)


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """D1, D2 and D3+ of modified Kneser-Ney from counts of counts."""
    n, out = (n1, n2, n3, n4), []
    for i in (1, 2, 3):
        # without counts of counts to go by, half of the least possible
        d = i - (i + 1) * n1 / (n1 + 2 * n2) * n[i] / n[i - 1] if n[i - 1] and n1 else i / 2
        out.append(min(max(d, 1e-3), i - 1e-3))
    return np.array(out)


_STAT_ROWS = "lang string, part int, data binary"
_COUNT_ROWS = "lang string, part int, shard int, data binary"


def _shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys * U64(0x9E3779B97F4A7C15)) >> U64(40)) % U64(shards)


def bigram_counts(trusted: DataFrame, words, shards: int) -> DataFrame:
    """lang, part, shard, data: packed counts of the bigrams of ``trusted`` (th, lang, text).

    ``words``: broadcast vocabularies.  Each task sums its own counts first and sends a row
    per language, part and shard.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, part), k, n in counter.flush():
                to = _shard_of(k, shards)
                yield _batch(_COUNT_ROWS, [(lang, part, s, _pack(k[m], n[m])) for s in range(shards) if (m := to == s).any()])

        for b in batches:
            for chunk in _chunks(b):
                th = chunk.column("th").to_numpy()
                for lang, at in _by_lang(chunk).items():
                    own = _part_of(th[at])
                    h, doc = token_hashes(_texts(chunk, at))
                    keys, of = bigrams(words.value[lang].ids(h), doc)
                    for part in (0, 1):
                        k, n = np.unique(keys[own[of] == part], return_counts=True)
                        if len(k):
                            counter.add((lang, part), k, n.astype(np.int64))
            if counter.rows > _HELD:
                yield from out()
        yield from out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (lang, part, shard), (k, n) in _runs(batches, ("lang", "part", "shard"), lambda r: _unpack(r["data"])):
            yield _batch(_COUNT_ROWS, [(lang, part, shard, _pack(k, n))])

    keys = ("lang", "part", "shard")
    counted = trusted.select("th", "lang", "text").mapInArrow(lean(count), _COUNT_ROWS)
    return counted.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(merge), _COUNT_ROWS)


def part_models(counts: DataFrame, words: dict[str, Vocabulary], bc_words) -> dict[tuple[str, int], PartModel]:
    """The models' sums from merged ``counts``: a few numbers per word of the vocabulary."""

    def empty(lang: str) -> np.ndarray:
        size = len(bc_words.value[lang].hashes) + _FIRST_WORD
        return np.zeros(5 * size + 4, np.int64)

    def emit(held: dict[tuple[str, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
        for (lang, part), x in held.items():
            yield _batch(_STAT_ROWS, [(lang, part, _planes((x,)))])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for lang, part, data in zip(*(b.column(c).to_pylist() for c in ("lang", "part", "data"))):
                k, n = _unpack(data)
                x = held.setdefault((lang, part), empty(lang))
                size = len(x) // 5
                table = x[: 5 * size].reshape(5, size)
                v, w = (k >> U64(16)).astype(np.int64), (k & U64(0xFFFF)).astype(np.int64)
                table[0] += np.bincount(v, n, size).astype(np.int64)
                for row, some in ((1, n == 1), (2, n == 2), (3, n > 2)):
                    table[row] += np.bincount(v[some], minlength=size)
                table[4] += np.bincount(w, minlength=size)
                x[5 * size :] += [int((n == i).sum()) for i in (1, 2, 3, 4)]
        yield from emit(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for b in batches:
            for lang, part, data in zip(*(b.column(c).to_pylist() for c in ("lang", "part", "data"))):
                held.setdefault((lang, part), empty(lang))[:] += _unplanes(data, "q")[0]
        yield from emit(held)

    sums = counts.mapInArrow(lean(gather), _STAT_ROWS).repartition("lang", "part").mapInArrow(lean(add), _STAT_ROWS)
    out = {}
    for r in sums.collect():
        x = _unplanes(r["data"], "q")[0]
        size = len(x) // 5
        total, one, two, more, follow = x[: 5 * size].reshape(5, size)
        d = discounts(*x[5 * size :].tolist())
        d1 = discounts(*[int((follow == i).sum()) for i in (1, 2, 3, 4)])
        cut = np.where(follow > 0, d1[np.minimum(np.maximum(follow, 1), 3) - 1], 0.0)
        # all but START can follow
        chance = (follow - cut) / follow.sum() + cut.sum() / follow.sum() / (size - 1)
        gamma = np.where(total > 0, (d[0] * one + d[1] * two + d[2] * more) / np.maximum(total, 1), 1.0)
        out[r["lang"], r["part"]] = PartModel(total, gamma, chance, d, words[r["lang"]].unknown)
    return out


@dataclass
class KneserNey:
    """Vocabularies and sums at the driver, packed counts as a table."""

    words: dict[str, Vocabulary]
    parts: dict[tuple[str, int], PartModel]
    counts: DataFrame
    shards: int
    bc: object

    @classmethod
    def train(cls, trusted: DataFrame) -> KneserNey:
        """From ``trusted`` (th, lang, text)."""
        sc = trusted.sparkSession.sparkContext
        words = vocabularies(trusted)
        bc_words = sc.broadcast(words)
        shards = max(SHARDS, -(-max((w.tokens for w in words.values()), default=0) // SHARD_TOKENS))
        counts = materialize(bigram_counts(trusted, bc_words, shards))
        parts = part_models(counts, words, bc_words)
        return cls(words, parts, counts, shards, sc.broadcast((words, parts)))


# ---------------------------------------------------------------- scores

_WIRE = "lang string, part int, shard int, salt bigint, kind int, data binary, keys binary"
_SUMS = "id bigint, th bigint, lang string, trusted boolean, nll bigint, once bigint, n bigint, chars bigint, rows bigint"


def _packed_documents(docs: DataFrame, model: KneserNey, salts: int) -> DataFrame:
    """Rows of two kinds: the bigrams of some documents in one shard (1), what they cost if unseen (2)."""
    shards, bc = model.shards, model.bc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, parts = bc.value
        for b in batches:
            for chunk in _chunks(b):
                th = chunk.column("th").to_numpy()
                is_null = np.array(chunk.column("id").is_null())
                flags = is_null.astype(np.int64) | np.array(chunk.column("trusted")).astype(np.int64) << 1
                key = np.stack((pc.fill_null(chunk.column("id"), 0).to_numpy(), th, flags), axis=1)
                chars = pc.fill_null(pc.utf8_length(chunk.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                rows: list[tuple] = []
                for lang, at in _by_lang(chunk).items():
                    own = np.array(at)
                    sums = np.zeros((len(at), 4), np.int64)
                    sums[:, 3] = chars[own]
                    if lang not in words:
                        for salt in np.unique(th[own] % _LOOSE_SALTS):
                            some = th[own] % _LOOSE_SALTS == salt
                            rows.append((lang, -1, 0, int(salt), 2, sums[some].tobytes(), key[own[some]].tobytes()))
                        continue
                    h, doc = token_hashes(_texts(chunk, at))
                    grams, of = bigrams(words[lang].ids(h), doc)
                    other = 1 - _part_of(th[own])
                    for part in (0, 1):
                        mine = np.flatnonzero(other == part)
                        if not len(mine):
                            continue
                        by = part if (lang, part) in parts else 1 - part
                        m = parts[lang, by]
                        place = np.zeros(len(at), np.int64)
                        place[mine] = np.arange(len(mine))
                        some = other[of] == part
                        packed = np.sort(grams[some] << U64(12) | place[of[some]].astype(np.uint64))
                        start = np.flatnonzero(np.append(True, packed[1:] != packed[:-1])) if len(packed) else np.empty(0, np.int64)
                        n = np.diff(np.append(start, len(packed)))
                        packed = packed[start]
                        k, d = packed >> U64(12), (packed & U64(4095)).astype(np.int64)
                        cost = m.base(k)
                        # sums of whole numbers below 2^53
                        total = lambda x: np.bincount(d, x, len(mine)).astype(np.int64)
                        sums[mine, 0], sums[mine, 1], sums[mine, 2] = total(cost * n), total(cost), total(n)
                        salt = int(th[own[mine[0]]] % salts)
                        names = key[own[mine]].tobytes()
                        to = _shard_of(k, shards)
                        for s in range(shards):
                            if (pick := to == s).any():
                                data = _planes((np.diff(k[pick], prepend=U64(0)).astype(np.uint32), d[pick].astype(np.uint16), n[pick].astype(np.uint32)))
                                rows.append((lang, by, s, salt, 1, data, names))
                        rows.append((lang, by, salt % shards, salt, 2, sums[mine].tobytes(), names))
                if rows:
                    yield _batch(_WIRE, rows)

    return docs.mapInArrow(lean(run), _WIRE)


def _partial_sums(rows: DataFrame, model: KneserNey) -> DataFrame:
    """Parts of the sums of every document, shard by shard."""
    bc = model.bc

    def out(lang: str, key: np.ndarray, nll, once, n, chars, count: int) -> pa.RecordBatch:
        size = len(key)
        full = lambda x: pa.array(np.broadcast_to(np.asarray(x, np.int64), size))
        columns = [
            pa.array(key[:, 0], mask=(key[:, 2] & 1).astype(bool)), pa.array(key[:, 1]), pa.array([lang] * size, pa.string()),
            pa.array((key[:, 2] >> 1).astype(bool)), full(nll), full(once), full(n), full(chars), full(count),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _SUMS.split(",")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, at, known, gain = bc.value[1], None, None, None
        for b in batches:
            for i in range(b.num_rows):
                lang, part, shard, salt, kind, data, keys = (b.column(c)[i].as_py() for c in range(7))
                if kind == 0:
                    known, counts = _unpack(data)
                    at, gain = (lang, part, shard, salt), parts[lang, part].gain(known, counts)
                    continue
                key = np.frombuffer(keys, np.int64).reshape(-1, 3)
                if kind == 2:
                    sums = np.frombuffer(data, np.int64).reshape(-1, 4)
                    yield out(lang, key, *sums.T, 1)
                    continue
                if at != (lang, part, shard, salt):
                    continue  # nothing was seen in this shard
                step, doc, n = _unplanes(data, "IHI")
                k = np.cumsum(step, dtype=np.uint64)
                place = np.minimum(np.searchsorted(known, k), len(known) - 1)
                less = np.where(known[place] == k, gain[place], 0)
                nll, once = np.bincount(doc, less * n, len(key)).astype(np.int64), np.bincount(doc, less, len(key)).astype(np.int64)
                some = np.flatnonzero(nll)
                yield out(lang, key[some], nll[some], once[some], 0, 0, 0)

    return rows.mapInArrow(lean(run), _SUMS)


def score_sums(docs: DataFrame, model: KneserNey) -> DataFrame:
    """One row per id, text, language and trust: id, th, lang, trusted, nll, once, n, chars, rows.

    The sums are over ``rows`` equal rows.  ``docs`` has id, th, lang, trusted and text.
    """
    salts = max(1, docs.count() // (SALT_DOCS * model.shards))
    salt = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint")))
    models = model.counts.select("lang", "part", "shard", salt.alias("salt"), F.lit(0).alias("kind"), "data", F.lit(None).cast("binary").alias("keys"))
    rows = models.union(_packed_documents(docs.select("id", "th", "lang", "trusted", "text"), model, salts))
    keys = ("lang", "part", "shard", "salt")
    placed = rows.repartition(*keys).sortWithinPartitions(*keys, "kind")
    sums = ("nll", "once", "n", "chars", "rows")
    return _partial_sums(placed, model).groupBy("id", "th", "lang", "trusted").agg(*[F.sum(c).alias(c) for c in sums])


def with_trust(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", few: int = FEW_IDS) -> DataFrame:
    """``docs`` (id, ...) with ``trusted``: whether the id is labelled with quality 1.

    Up to ``few`` labelled ids go to all executors; beyond, texts and labels
    meet by a shuffle.
    """
    ids = materialize(labels.where("quality = 1").select(F.col(id_col).cast("bigint").alias("__t")).where("__t is not null").distinct())
    side = F.broadcast(ids) if ids.count() <= few else ids.hint("merge")
    return docs.join(side, F.col("id") == F.col("__t"), "left").withColumn("trusted", F.col("__t").isNotNull()).drop("__t")


def _lang_key(lang: Column) -> Column:
    """Null is a language of its own, apart from the empty name."""
    return F.when(lang.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), lang.cast("string")))


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    high: float = HIGH, low: float = LOW, prior: int = PRIOR_TOKENS,
) -> DataFrame:
    """One row per input row: id, lang, n_tokens, perplexity, score, novelty, threshold, least, accepted, th.

    ``score`` is the smoothed mean cost of a token in nats (the end of the
    text is one), ``novelty`` the same with every different bigram counted
    once.  A document is rejected when its score is above ``threshold`` or its
    novelty below ``least``, the ``high`` and ``low`` quantiles of the trusted
    documents of its language (in steps of 0.001), or the margins about their
    mean if those are wider.  Texts without tokens, null
    and empty ones too, are rejected.  A language (null is one) without
    trusted text has no model: its numbers are null, and its documents are
    accepted unless their text is null or empty.  Rows that are there several
    times each give a row; documents with a null id are never trusted; extra
    columns of ``docs`` are ignored.  ``th`` is a hash of the text, to tell
    rows of one id apart.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("th"), _lang_key(F.col(lang_col)).alias("lang"), F.col(text_col).alias("text"))
    flagged = with_trust(base, labels, id_col)
    trusted = flagged.where("trusted AND rlike(text, '[^\\\\x00-\\\\x20\\\\x7f]')")
    found = materialize(score_sums(flagged, KneserNey.train(trusted)))
    mean = lambda c: F.round(F.sum(F.round(F.col(c) / F.col("n")).cast("bigint")) / F.count("*") / _MICRO, 6)
    good = found.where("trusted AND n > 0")
    means = materialize(good.groupBy("lang").agg(mean("nll").alias("mean"), mean("once").alias("mean_once")))
    smooth = lambda c, m: (F.col(c) / F.col("rows") / _MICRO + F.col(m) * prior) / (F.col("n") / F.col("rows") + prior)
    steps = join_few(good, means, "lang").select(
        "lang", F.ceil(smooth("nll", "mean") * _STEPS).alias("high"), F.floor(smooth("once", "mean_once") * _STEPS).alias("low")
    )
    at = lambda q, c: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {c}) / {_STEPS}")
    quantiles = steps.groupBy("lang").agg(at(high, "high").alias("q_high"), at(low, "low").alias("q_low"))
    limits = means.join(quantiles, "lang").select(
        "lang", "mean", "mean_once", F.greatest("q_high", F.round(F.col("mean") * MARGIN_HIGH, 3)).alias("threshold"), F.least("q_low", F.round(F.col("mean_once") * MARGIN_LOW, 3)).alias("least")
    )
    has = F.col("n") > 0
    score, novelty = (F.when(has, F.round(smooth(c, m), 9)) for c, m in (("nll", "mean"), ("once", "mean_once")))
    n_rows = F.col("rows")
    return (
        join_few(found, limits, "lang", "left")
        .withColumns({"score": score, "novelty": novelty, "__k": F.explode(F.expr("sequence(1L, rows)"))})
        .withColumn("accepted", F.when(F.col("mean").isNull(), F.col("chars") > 0).otherwise(F.coalesce((F.col("score") <= F.col("threshold")) & (F.col("novelty") >= F.col("least")), F.lit(False))))
        .select(
            F.col("id").alias(id_col), F.when(F.col("lang") != "-", F.substring("lang", 2, 1 << 30)).alias("lang"),
            F.when(has, (F.col("n") / n_rows).cast("bigint") - 1).alias("n_tokens"), F.when(has, F.round(F.exp(F.col("nll") / F.col("n") / _MICRO), 6)).alias("perplexity"),
            "score", "novelty", "threshold", "least", "accepted", "th",
        )
    )


def accepted_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kwargs) -> DataFrame:
    """``docs`` without the rows that :func:`classify` rejects, columns unchanged."""
    verdicts = classify(docs, labels, id_col, text_col, **kwargs)
    gone = verdicts.where("NOT accepted").select(F.col(id_col).alias("id"), "th")
    return without_rows(docs, gone, id_col, text_col)
