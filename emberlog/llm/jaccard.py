"""N-gram Jaccard join with count vectors in an R-tree.

Documents are sets of hashed word shingles; two link when their Jaccard
similarity reaches a threshold.  The hashed shingles fall into groups.  The
counts of a document's shingles in the groups are a point; the overlap of two
documents is at most the sum of the coordinate minima of their points.  Points
are packed into an R-tree, whose nodes bound the overlap with all points below
them, and pairs that survive the bound are verified on the sets themselves.

One R-tree over a corpus would prune little (in many dimensions the boxes of
random texts all overlap) and could not be spread over machines, so points are
first parted exactly.  A pair that links differs in at most D shingles, D
following from its sizes.  Shingles are dealt by hash into more than D
segments, so some segment of the pair is equal, and documents that share no
segment can be kept apart without losing a link.  What shares segments forms a
cluster; R-trees are built per cluster, in chunks of bounded size.

Passages that many documents share would chain most of a corpus into one
cluster.  So there are more segments than D + 1, a pair has that many more equal
ones, and each document leaves out that many of its own, those with the fewest
rare shingles, in one order for all.  Which shingles are popular and not rare is
counted on a sample, so a poor sample costs time and no link.

Steps, each a shuffle of slim rows:
 0. shingles of a sample of texts are counted; popular ones become a bitmap;
 1. one pass over the texts: sizes, digests, points; equal segments give edges;
    repeats within a batch are joined before anything shuffles;
 2. clusters = components of these edges; R-trees over points part them into
    tight clusters;
 3. texts of tight clusters only: R-trees again, pairs verified on the sets;
 4. components of the verified links.
Clusters over the chunk size are cut into chunks that also get common pivots;
what the chunks leave apart is then compared across all chunks, so no link is
lost whatever the size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from ._hashing import BYTE, STEP, U64, mix, span_hashes
from ._shared import BITMAP_ROW, bitmap_size, connected_components, id_bitmap, in_bitmap, join_heavy, lean, least_of_components, materialize

#: Groups of the points; the tree's nodes hold them folded to COARSE sums.
GROUPS = 256
COARSE = 32
LEAF = 32
FAN_OUT = 16
#: Points, and shingles of sets, that one chunk of a cluster holds.
POINT_CHUNK = 16_384
SET_CHUNK = 1 << 22
PIVOTS = 4
#: Rows whose shingles are counted, about, and texts among them that a popular shingle has.
SAMPLE_ROWS = 1 << 16
POPULAR = 3
#: Segments that may be left out beside the empty ones, as a share of the differences.
EXTRA = 0.1
_PIECE = 1 << 20
_FLUSH_PAIRS = 1 << 20
_RATIO = 1.3


# ---------------------------------------------------------------- shingles


_BYTE = BYTE.copy()
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def _pieces(data: bytes) -> Iterator[tuple[int, int]]:
    """Parts of about ``_PIECE`` bytes, cut at white space."""
    at, n = 0, len(data)
    while n - at > _PIECE:
        end = max(data.rfind(c, at, at + _PIECE) for c in (b" ", b"\n", b"\t", b"\r"))
        if end <= at:
            found = [i for c in (b" ", b"\n", b"\t", b"\r") if (i := data.find(c, at + _PIECE)) >= 0]
            end = min(found, default=n - 1)
        yield at, end + 1
        at = end + 1
    yield at, n


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (A-Z as a-z) of UTF-8 bytes, and where they start."""
    hashes, starts = [], []
    for lo, hi in _pieces(data):
        a = np.frombuffer(data, np.uint8, hi - lo, lo)
        if not len(a):
            continue
        blank = _BLANK[a]
        first = ~blank
        first[1:] &= blank[:-1]
        last = ~blank
        last[:-1] &= blank[1:]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes.append(span_hashes(_BYTE[a], s, e, _PIECE))
        starts.append(s + lo)
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


@dataclass
class Sets:
    """Shingle sets of some documents: sorted distinct hashes, one after the other."""

    hashes: np.ndarray
    doc: np.ndarray
    sizes: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return np.cumsum(self.sizes)


def shingle_sets(texts: list[str], words: int) -> Sets:
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    h, at = word_hashes(b"\n".join(raw))
    doc = np.searchsorted(ends, at, "right")
    counts = np.bincount(doc, minlength=len(texts))
    k = words
    if len(h) >= k:
        s = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            s += h[j : len(h) - k + 1 + j] * STEP[j]
        whole = doc[: len(s)] == doc[k - 1 :]
        s, s_doc = mix(s[whole]), doc[: len(s)][whole]
    else:
        s, s_doc = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        begin = np.cumsum(counts) - counts
        one = np.empty(len(short), np.uint64)
        for i, d in enumerate(short):
            w = h[begin[d] : begin[d] + counts[d]]
            one[i] = np.append(w, U64(counts[d])).dot(np.append(STEP[: len(w)], STEP[62]))
        place = np.searchsorted(s_doc, short)
        s, s_doc = np.insert(s, place, mix(one)), np.insert(s_doc, place, short)
    edges = np.searchsorted(s_doc, np.arange(len(texts) + 1))
    for a, b in zip(edges[:-1], edges[1:]):
        s[a:b].sort()
    if len(s):
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (s_doc[1:] != s_doc[:-1])
        s, s_doc = s[new], s_doc[new]
    return Sets(s, s_doc, np.bincount(s_doc, minlength=len(texts)))


def digests(sets: Sets) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set as two int64; empty sets have 0, 0."""
    out = []
    filled = sets.sizes > 0
    starts = (sets.ends - sets.sizes)[filled]
    for salt in (1, 2):
        d = np.zeros(len(sets.sizes), np.uint64)
        if len(starts):
            d[filled] = mix(np.add.reduceat(mix(sets.hashes + STEP[salt]), starts) + sets.sizes[filled].astype(np.uint64))
        out.append(d.view(np.int64))
    return out[0], out[1]


def count_vectors(sets: Sets) -> np.ndarray:
    """The points: how many shingles of each document fall into each group."""
    at = sets.doc * GROUPS + (sets.hashes & U64(GROUPS - 1)).astype(np.int64)
    return np.bincount(at, minlength=len(sets.sizes) * GROUPS).reshape(-1, GROUPS).astype(np.int32)


def _packed_points(points: np.ndarray) -> list[bytes]:
    """Two bytes a count, four for the rare document that needs them."""
    return [(p.astype(np.uint16) if m < 1 << 16 else p).tobytes() for p, m in zip(points, points.max(axis=1, initial=0))]


def _unpacked_points(rows: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(r, np.uint16 if len(r) == 2 * GROUPS else np.int32).astype(np.int32) for r in rows])


# ---------------------------------------------------------------- segments


@dataclass(frozen=True)
class Threshold:
    """Documents link when den * intersection >= num * union."""

    num: int
    den: int

    def links(self, inter: int, a: int, b: int) -> bool:
        return self.den * inter >= self.num * (a + b - inter)

    def smallest(self, n):
        """Size of the smallest set that can link with one of n."""
        return -(-n * self.num // self.den)

    def most_differences(self, a: int, b: int) -> int:
        return (a + b) * (self.den - self.num) // (self.den + self.num)


@lru_cache(maxsize=8)
def levels(t: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Size levels: first size, segments, and segments that may be left out.

    A pair meets at the level of its smaller set.  Segments outnumber the
    differences of a pair by one and by the empty segments that sets of the
    level usually have (mean and three deviations), as two empty segments say
    nothing, and by a share of the differences for segments of popular shingles.
    """
    first, segments, spare = [1], [], []
    while first[-1] < 1 << 40:
        first.append(max(first[-1] + 1, int(first[-1] * _RATIO)))
    for low, beyond in zip(first, first[1:]):
        top = beyond - 1
        need = t.most_differences(top, top * t.den // t.num) + 1
        e = more = int(need * EXTRA)
        for _ in range(12):
            g = need + e
            mean = g * (1 - 1 / g) ** low if g > 1 else 0.0
            e = more + (int(np.ceil(mean + 3 * mean**0.5)) if mean > 1e-3 else 0)
        segments.append(need + e)
        spare.append(e)
    return np.array(first[:-1]), np.array(segments), np.array(spare)


def segment_keys(sets: Sets, t: Threshold, popular: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, documents): equal keys for equal segments at equal levels.

    ``popular``: for each shingle, whether it is popular.  Of two sets that link,
    one more segment than may be left out is equal.  Each set leaves out as many
    as it may: its empty segments, then those first in the order of rare
    shingles, shingles and hash, which is the same for equal segments.  The last
    in that order of the equal ones so stays in both sets.  A set with more empty
    segments than may be left out uses these as well.
    """
    first, segments, spare = levels(t)
    own = np.searchsorted(first, sets.sizes, "right") - 1
    low = np.searchsorted(first, t.smallest(sets.sizes), "right") - 1
    keys, docs = [], []
    content = mix(sets.hashes + STEP[3])
    top = sets.hashes >> U64(32)
    rare = np.ones(len(sets.hashes), bool) if popular is None else ~popular
    for down in range(int((own - low)[sets.sizes > 0].max(initial=-1)) + 1):
        level = own - down
        use = (sets.sizes > 0) & (level >= low)
        mine = use[sets.doc]
        doc, c = sets.doc[mine], content[mine]
        g = segments[np.maximum(level, 0)]
        seg = ((top[mine] * g[doc].astype(np.uint64)) >> U64(32)).astype(np.int64)
        if not len(doc):
            continue
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (seg[1:] != seg[:-1])
        starts = np.flatnonzero(new)
        d, s = doc[starts], seg[starts]
        sums = np.add.reduceat(c, starts)
        may_go = spare[np.maximum(level, 0)]
        filled = np.bincount(d, minlength=len(g))
        n_rare = np.minimum(np.add.reduceat(rare[mine], starts, dtype=np.uint64), U64(31))
        n_all = np.minimum(np.diff(starts, append=len(doc)), 31).astype(np.uint64)
        # ties end by the number of the segment; equal segments have equal numbers
        order = np.argsort(d.astype(np.uint64) << U64(40) | n_rare << U64(35) | n_all << U64(30) | sums >> U64(34), kind="stable")
        stay = order[np.arange(len(d)) - (np.cumsum(filled) - filled)[d] >= (may_go - (g - filled))[d]]
        d, s, sums = d[stay], s[stay], sums[stay]
        keys.append(mix(sums + mix(level[d].astype(np.uint64) * STEP[4] + s.astype(np.uint64) * STEP[5])))
        docs.append(d)
        for i in np.flatnonzero(use & (g - filled > may_go)):
            gone = np.setdiff1d(np.arange(g[i]), seg[doc == i]).astype(np.uint64)
            keys.append(mix(mix(level[i : i + 1].astype(np.uint64) * STEP[4] + gone * STEP[5])))
            docs.append(np.full(len(gone), i))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(docs)


def _place(hashes: np.ndarray) -> np.ndarray:
    """40 bits of each hash, of which as many as needed are the place in a bitmap."""
    return hashes >> U64(24)


def is_popular(hashes: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether the bit of each shingle is set; another shingle's bit only makes one popular more."""
    at = _place(hashes) & U64(len(bitmap) * 8 - 1)
    return (bitmap[at >> U64(3)] >> (at & U64(7)).astype(np.uint8)) & 1 == 1


def _equal_runs(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key; edges from the first node of a run of equal keys to the
    others; which rows are first of their run (in that order)."""
    order = np.argsort(keys, kind="stable")
    k, v = keys[order], nodes[order]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    pivot = v[head][np.cumsum(head) - 1]
    differ = pivot != v
    pairs = np.unique(np.stack([pivot[differ], v[differ]]), axis=1) if differ.any() else np.empty((2, 0), np.int64)
    return order, pairs, head


# ---------------------------------------------------------------- R-tree


class CountTree:
    """R-tree of points, packed by size and then by the widest coordinates."""

    def __init__(self, sizes: np.ndarray, fine: np.ndarray, t: Threshold):
        self.t, n = t, len(sizes)
        points = fine.reshape(n, -1, COARSE).sum(axis=1)
        order = np.argsort(sizes, kind="stable")
        slab = LEAF * max(1, int(np.sqrt(n / LEAF)))
        if n > slab:  # sort-tile-recursive: slabs of like size, then by the widest coordinate
            for a in range(0, n, slab):
                part = order[a : a + slab]
                wide = int(np.argmax(np.ptp(points[part], axis=0)))
                order[a : a + slab] = part[np.argsort(points[part, wide], kind="stable")]
        self.order, self.sizes, self.points, self.fine = order, sizes[order], points[order], fine[order]
        self.levels = []
        lo, hi, top, width = self.sizes, self.sizes, self.points, LEAF
        while len(lo) > 1 or not self.levels:
            cut = np.arange(0, len(lo), width)
            lo, hi, top = np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(top, cut, axis=0)
            self.levels.append((lo, hi, top))
            width = FAN_OUT

    def _may_link(self, size, point, lo, hi, top):
        t = self.t
        bound = np.minimum(top, point).sum(axis=1, dtype=np.int64)
        return ((t.den + t.num) * bound >= t.num * (size + lo)) & (hi * t.den >= size * t.num) & (lo * t.num <= size * t.den)

    def search(self, i: int) -> np.ndarray:
        """Positions (in tree order) of the points that may link with point ``i``."""
        size, point = int(self.sizes[i]), self.points[i]
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            lo, hi, top = self.levels[depth]
            at = at[self._may_link(size, point, lo[at], hi[at], top[at])]
            width = FAN_OUT if depth else LEAF
            below = len(self.levels[depth - 1][0]) if depth else len(self.sizes)
            at = (at[:, None] * width + np.arange(width)).ravel()
            at = at[at < below]
        at = at[self._may_link(size, point, self.sizes[at], self.sizes[at], self.points[at])]
        return at[self._may_link(size, self.fine[i], self.sizes[at], self.sizes[at], self.fine[at])]


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    c = np.concatenate((a, b))
    c.sort()
    return int((c[1:] == c[:-1]).sum())


def link_group(
    sizes: np.ndarray, points: np.ndarray, sets: list[np.ndarray] | None, asks: np.ndarray, part: np.ndarray, side: np.ndarray, t: Threshold
) -> list[tuple[int, int]]:
    """A spanning forest of the links between the members of one chunk.

    ``asks``: members whose partners are sought; ``part``: what is known to be
    connected has equal numbers; ``side``: members of one side, other than -1,
    have been compared before.  Without ``sets`` every pair that the bound
    leaves counts as a link.
    """
    n = len(sizes)
    tree = CountTree(sizes, points, t)
    root = np.unique(part[tree.order], return_inverse=True)[1].astype(np.int64)
    side = side[tree.order]
    left = len(np.unique(root))
    edges: list[tuple[int, int]] = []
    for i in np.flatnonzero(asks[tree.order]):
        if left == 1:
            break
        near = tree.search(i)
        near = near[(root[near] != root[i]) & ((side[near] != side[i]) | (side[i] < 0))]
        if not len(near):
            continue
        if sets is not None and len(near) > 1:
            bound = np.minimum(tree.fine[near], tree.fine[i]).sum(axis=1)
            near = near[np.argsort(-bound, kind="stable")]
        for j in near:
            if root[j] == root[i]:
                continue
            a, b = tree.order[i], tree.order[j]
            if sets is None or t.links(_overlap(sets[a], sets[b]), int(sizes[a]), int(sizes[b])):
                root[root == root[j]] = root[i]
                left -= 1
                edges.append((int(a), int(b)))
    return edges


def all_links(sizes: np.ndarray, points: np.ndarray, sets: list[np.ndarray], side: np.ndarray, across: bool, t: Threshold) -> Iterator[tuple[int, int]]:
    """Every link between two members, once; ``across``: only those from one side to the other."""
    tree = CountTree(sizes, points, t)
    side = side[tree.order]
    for i in range(len(sizes)):
        near = tree.search(i)
        near = near[near > i]
        for j in near[side[near] != side[i]] if across else near:
            a, b = int(tree.order[i]), int(tree.order[j])
            if t.links(_overlap(sets[a], sets[b]), int(sizes[a]), int(sizes[b])):
                yield a, b


# ---------------------------------------------------------------- Spark steps


def _batches_of(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of at most about ``_PIECE`` bytes of text."""
    sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False)
    a = 0
    while a < b.num_rows:
        e, size = a, 0
        while e < b.num_rows and (e == a or size + sizes[e] <= _PIECE):
            size += sizes[e]
            e += 1
        yield b.slice(a, e - a)
        a = e


def popular_shingles(docs: DataFrame, rows: int, words: int, buckets: int) -> np.ndarray:
    """A bitmap of the shingles that ``POPULAR`` or more texts of a sample of ``docs`` (th, text) have.

    The sample is bounded, so its shingles are as many whatever the table; each
    text of it counts once in a task.
    """
    one_in = max(1, rows // SAMPLE_ROWS, min(8, rows // 1000))
    sample = docs.where(F.pmod(F.xxhash64("th", F.lit(8)), F.lit(one_in)) == 0).where("text is not null").select("th", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def packed(held: list[np.ndarray]) -> pa.RecordBatch:
            p = np.concatenate(held)
            to = (p % U64(buckets)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(buckets + 1))
            p5 = p[order].view(np.uint8).reshape(-1, 8)[:, :5]
            used = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([p5[cut[x] : cut[x + 1]].tobytes() for x in used], pa.binary())], names=["bucket", "places"])

        held, n = [], 0
        for whole in batches:
            for b in _batches_of(whole):
                new = [x for th, x in zip(b.column("th").to_pylist(), b.column("text").to_pylist()) if not (th in seen or seen.add(th))]
                if new:
                    held.append(_place(shingle_sets(new, words).hashes))
                    n += len(held[-1])
                if n >= _FLUSH_PAIRS:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def common(bucket: list[bytes]) -> pa.RecordBatch:
            p5 = np.frombuffer(b"".join(bucket), np.uint8).reshape(-1, 5)
            p = np.zeros((len(p5), 8), np.uint8)
            p[:, :5] = p5
            at, k = np.unique(p.view(np.int64).ravel(), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(at[k >= POPULAR])], names=["p"])

        now, held = None, []
        for b in batches:
            for at, p in zip(b.column("bucket").to_pylist(), b.column("places").to_pylist()):
                if at != now:
                    if held:
                        yield common(held)
                    now, held = at, []
                held.append(p)
        if held:
            yield common(held)

    dealt = sample.mapInArrow(lean(scan), "bucket int, places binary").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    found = materialize(dealt.mapInArrow(lean(count), "p bigint"))
    bits = bitmap_size(found.count(), 32)
    at = found.select(F.pmod("p", F.lit(bits)).alias("p"))
    parts = at.groupBy(F.expr(f"p div {BITMAP_ROW}").alias("no")).agg(F.bitmap_construct_agg(F.col("p") % BITMAP_ROW).alias("map"))
    bitmap = np.zeros((bits // BITMAP_ROW, BITMAP_ROW // 8), np.uint8)
    for no, part in parts.collect():  # 16 MB at most
        bitmap[no] = np.frombuffer(part, np.uint8)
    return bitmap.ravel()


def _first_pass(docs: DataFrame, words: int, t: Threshold, buckets: int, popular: Broadcast) -> DataFrame:
    """Rows of two kinds: a document (id, th, n, d1, d2, point), or an edge (a, b)."""
    map_schema = "bucket int, keys binary, nodes binary, id bigint, th bigint, n bigint, d1 bigint, d2 bigint, point binary"
    names = [f.strip().split(" ")[0] for f in map_schema.split(",")]
    kinds = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.binary()]
    mask = U64((1 << 48) - 1)

    def batch(cols: dict[str, list], n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(cols.get(k, [None] * n), ty) for k, ty in zip(names, kinds)], names=names)

    def packed(keys: list[np.ndarray], nodes: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Pairs by bucket: 5 bytes of the key, 6 of the node.  A clash of the
        shortened numbers only adds a candidate."""
        if not keys:
            return
        k, v = np.concatenate(keys), np.concatenate(nodes)
        order, pairs, head = _equal_runs(k, v)
        k, v = k[order][head], v[order][head]
        to = (k % U64(buckets)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(buckets + 1))
        k5 = (k[order] >> U64(24)).view(np.uint8).reshape(-1, 8)[:, :5]
        v6 = v[order].view(np.uint8).reshape(-1, 8)[:, :6]
        used = np.flatnonzero(np.diff(cut))
        rows = {"bucket": used.tolist(), "keys": [k5[cut[b] : cut[b + 1]].tobytes() for b in used], "nodes": [v6[cut[b] : cut[b + 1]].tobytes() for b in used]}
        yield batch(rows, len(used))
        if pairs.shape[1]:
            # edges found here: no keys, both ends in nodes, dealt to any bucket
            data = np.ascontiguousarray(pairs.T)
            step = 1 << 16
            parts = [data[i : i + step].tobytes() for i in range(0, len(data), step)]
            yield batch({"bucket": [int(data[0, 0]) % buckets] * len(parts), "nodes": parts}, len(parts))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, held = [], [], 0
        for whole in batches:
            for b in _batches_of(whole):
                sets = shingle_sets([x or "" for x in b.column("text").to_pylist()], words)
                d1, d2 = digests(sets)
                points = count_vectors(sets)
                node = d1.view(np.uint64) & mask
                cols = {"bucket": (node % U64(buckets)).astype(np.int32).tolist(), "n": sets.sizes.tolist(), "d1": d1.tolist(), "d2": d2.tolist(), "point": _packed_points(points)}
                cols |= {"id": b.column("id").to_pylist(), "th": b.column("th").to_pylist()}
                yield batch(cols, b.num_rows)
                k, d = segment_keys(sets, t, is_popular(sets.hashes, popular.value))
                keys.append(k)
                nodes.append(node[d].view(np.int64))
                held += len(k)
                if held >= _FLUSH_PAIRS:
                    yield from packed(keys, nodes)
                    keys, nodes, held = [], [], 0
        yield from packed(keys, nodes)

    out_schema = "a bigint, b bigint, id bigint, th bigint, n bigint, d1 bigint, d2 bigint, point binary"
    out_names = [f.strip().split(" ")[0] for f in out_schema.split(",")]
    out_kinds = [pa.int64()] * 7 + [pa.binary()]

    def edges_of(bucket: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        if not bucket:
            return
        k5 = np.frombuffer(b"".join(k for k, _ in bucket), np.uint8).reshape(-1, 5)
        v6 = np.frombuffer(b"".join(v for _, v in bucket), np.uint8).reshape(-1, 6)
        k, v = np.zeros((len(k5), 8), np.uint8), np.zeros((len(v6), 8), np.uint8)
        k[:, :5], v[:, :6] = k5, v6
        _, pairs, _ = _equal_runs(k.view(np.uint64).ravel(), v.view(np.int64).ravel())
        yield edge_batch(pairs)

    def edge_batch(pairs: np.ndarray) -> pa.RecordBatch:
        n = pairs.shape[1]
        cols = [pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())] + [pa.nulls(n, ty) for ty in out_kinds[2:]]
        return pa.RecordBatch.from_arrays(cols, names=out_names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bucket = None, []
        for b in batches:
            is_doc = np.array(b.column("n").is_valid())
            if is_doc.any():
                d = b.filter(pa.array(is_doc))
                yield pa.RecordBatch.from_arrays([pa.nulls(d.num_rows, pa.int64())] * 2 + [d.column(c) for c in out_names[2:]], names=out_names)
            rest = b.filter(pa.array(~is_doc))
            for at, k, v in zip(rest.column("bucket").to_pylist(), rest.column("keys").to_pylist(), rest.column("nodes").to_pylist()):
                if k is None:
                    yield edge_batch(np.frombuffer(v, np.int64).reshape(-1, 2).T)
                    continue
                if at != now:
                    yield from edges_of(bucket)
                    now, bucket = at, []
                bucket.append((k, v))
        yield from edges_of(bucket)

    return (
        docs.mapInArrow(lean(scan), map_schema)
        .repartition(buckets, "bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(lean(meet), out_schema)
    )


def _in_chunks(members: DataFrame, chunk: int, weight: Column) -> DataFrame:
    """Adds size, chunks and chunk to slim ``members`` (cluster, cid, ...).

    ``chunk`` bounds what one task holds of a cluster, in sums of ``weight``.
    Done before points or sets are at hand, so that these need not move for it.
    """
    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"), F.ceil(F.sum(weight) / chunk).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("cid", F.lit(5)), F.col("chunks").cast("bigint")).cast("int")
    return members.join(sizes, "cluster").withColumn("chunk", own)


def _chunked_components(members: DataFrame, t: Threshold, with_sets: bool) -> DataFrame:
    """(id, component) of ``members`` that link with others of their cluster.

    ``members`` has cluster, cid, n, size, chunks, chunk and point or hashes.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            tb = pa.Table.from_batches(rows)
            cid = tb["cid"].to_numpy()
            _, keep = np.unique(cid, return_index=True)  # a pivot is in its own chunk already
            pick = lambda c: tb[c].to_numpy()[keep]
            if with_sets:
                sets = [np.frombuffer(x, np.uint64) for x in tb["hashes"].take(keep).to_pylist()]
                sizes = np.array([len(x) for x in sets])
                points = count_vectors(Sets(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), sizes))
            else:
                sets, points = None, _unpacked_points(tb["point"].take(keep).to_pylist())
            e = link_group(pick("n"), points, sets, pick("asks").astype(bool), pick("part"), pick("side"), t)
            ends = cid[keep[np.array(e, np.int64).reshape(-1, 2)]]
            node, least = least_of_components(ends[:, 0], ends[:, 1])
            return pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], names=["a", "b"])

        now, rows = None, []
        for b in batches:
            marks = list(zip(b.column("cluster").to_pylist(), b.column("chunk").to_pylist()))
            at = 0
            while at < len(marks):
                end = at
                while end < len(marks) and marks[end] == marks[at]:
                    end += 1
                if marks[at] != now:
                    if rows:
                        yield solve(rows)
                    now, rows = marks[at], []
                rows.append(b.slice(at, end - at))
                at = end
        if rows:
            yield solve(rows)

    def solved(df: DataFrame) -> DataFrame:
        return df.repartition("cluster", "chunk").sortWithinPartitions("cluster", "chunk").mapInArrow(lean(kernel), "a bigint, b bigint")

    cols = ["cluster", "cid", "n", "hashes" if with_sets else "point"]
    pivot = (F.col("chunks") > 1) & (F.pmod(F.xxhash64("cid", F.lit(6)), F.greatest(F.floor(F.col("size") / PIVOTS), F.lit(1))) == 0)
    first = members.withColumn("in", F.explode(F.when(pivot, F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk")))).select(
        *cols, F.col("in").cast("bigint").alias("chunk"), F.lit(True).alias("asks"), F.col("cid").alias("part"), F.lit(-1).alias("side")
    )
    edges = materialize(solved(first))
    large = members.where("chunks > 1")
    if large.isEmpty():
        # every cluster was in one chunk: its stars are its components
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    # what the chunks of a cluster leave apart: all but its largest part meets all
    # other chunks, two chunks in a task
    slim = large.select("cluster", "cid", "chunk")
    parts = connected_components(edges)
    parted = materialize(
        slim.join(parts.withColumnRenamed("id", "cid"), "cid", "left").withColumn("part", F.coalesce("component", "cid")).drop("component")
    )
    per = parted.groupBy("cluster", "part").agg(F.count("*").alias("k"))
    main = per.groupBy("cluster").agg(F.max(F.struct("k", "part")).alias("m"), F.count("*").alias("parts")).select("cluster", F.col("m.part").alias("main"), "parts")
    open_ = parted.join(main, "cluster").where("parts > 1").withColumn("asks", F.col("part") != F.col("main"))
    asking = open_.where("asks").groupBy("cluster").agg(F.collect_set("chunk").alias("asking"))
    known = materialize(open_.join(asking, "cluster").select("cid", "part", "asks", "asking"))
    others = F.when(F.col("asks"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.col("asking"))
    pair = F.least("chunk", "other").cast("bigint") * F.col("chunks") + F.greatest("chunk", "other")
    second = large.join(known, "cid").withColumn("other", F.explode(others)).where("other <> chunk")
    met = materialize(solved(second.select(*cols, pair.alias("chunk"), "asks", "part", F.col("chunk").alias("side"))))
    return connected_components(edges.union(met))


@dataclass(frozen=True)
class _Prepared:
    """Rows and distinct sets of a table, and the sets that may link, by tight cluster."""

    rows: DataFrame
    classes: DataFrame
    sets: DataFrame


def _prepared(docs: DataFrame, id_col: str, text_col: str, words: int, t: Threshold) -> _Prepared:
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    total = docs.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 20_000)
    popular = spark.sparkContext.broadcast(popular_shingles(base, total, words, buckets))
    passed = materialize(_first_pass(base, words, t, buckets, popular))
    popular.unpersist()
    node = F.expr("d1 & 281474976710655")
    rows = passed.where("n is not null").select("id", "th", "n", "d1", "d2")
    classes = materialize(
        rows.where("n > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.min(F.struct("id", "th")).alias("first"), F.first("n").alias("n"), F.count("*").alias("copies"))
    )
    cid: Column = F.xxhash64("d1", "d2")

    clusters = connected_components(passed.where("a is not null").select("a", "b"))
    near = materialize(
        classes.withColumn("node", node).join(clusters.select(F.col("id").alias("node"), F.col("component").alias("cluster")), "node")
        .select("cluster", cid.alias("cid"), "d1", "d2", F.col("first.id").alias("id"), F.col("first.th").alias("th"), "n")
    )
    at_row = lambda left, right: left.id.eqNullSafe(right.id) & left.th.eqNullSafe(right.th)
    points = in_bitmap(passed.where("n > 0").select("id", "th", "point"), "th", *id_bitmap(near, "th"))
    placed = _in_chunks(near.drop("d1", "d2"), POINT_CHUNK, F.lit(1))
    members = placed.join(points, at_row(placed, points)).select("cluster", "cid", "n", "size", "chunks", "chunk", "point")
    tight = _chunked_components(materialize(members), t, False)
    chosen = near.join(tight.select(F.col("id").alias("cid"), F.col("component").alias("tight")), "cid")
    chosen = materialize(_in_chunks(chosen.select(F.col("tight").alias("cluster"), "cid", "id", "th", "n"), SET_CHUNK, F.col("n")))
    # few rows pass the bitmap, so that few texts shuffle
    asked = in_bitmap(base, "th", *id_bitmap(chosen, "th"))
    texts = asked.join(chosen, at_row(asked, chosen)).select("cluster", "cid", "size", "chunks", "chunk", "text")

    slim = ["cluster", "cid", "size", "chunks", "chunk"]

    def reshingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sets = shingle_sets([x or "" for x in part.column("text").to_pylist()], words)
                ends = sets.ends
                hashes = [sets.hashes[e - n : e].tobytes() for e, n in zip(ends, sets.sizes)]
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in slim], pa.array(sets.sizes, pa.int64()), pa.array(hashes, pa.binary())],
                    names=[*slim, "n", "hashes"],
                )

    sets = materialize(texts.mapInArrow(lean(reshingle), "cluster bigint, cid bigint, size bigint, chunks int, chunk int, n bigint, hashes binary"))
    return _Prepared(rows, classes, sets)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """One row per input row: id, th, n_shingles, component_id.

    Two documents link when den * intersection >= num * union of their sets of
    ``words``-word shingles (A-Z lower-cased, words parted by white space; a
    shorter text is one shingle).  ``component_id`` is the smallest id that
    links reach, the row's own included.  Null and empty texts have no
    shingles and stand alone under their own id.  Rows with a null id take
    part; their component is null unless it holds an id.  Repeated rows each
    give a row.  ``th`` is a hash of the text, to tell rows of one id apart.
    """
    t = Threshold(num, den)
    found = _prepared(docs, id_col, text_col, words, t)
    rows, cid = found.rows, F.xxhash64("d1", "d2")
    links = _chunked_components(found.sets, t, True)
    named = found.classes.select("d1", "d2", "rep", "copies", cid.alias("cid")).join(links.select(F.col("id").alias("cid"), "component"), "cid", "left")
    least = named.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    final = materialize(named.join(least, "component", "left").select("d1", "d2", "copies", F.coalesce("least", "rep").alias("component_id")))
    filled, empty = rows.where("n > 0"), rows.where("n = 0").withColumn("component_id", F.col("id"))
    out = join_heavy(filled, final, ["d1", "d2"], "copies", rows.count()).drop("copies").unionByName(empty)
    return out.select(F.col("id").alias(id_col), "th", F.col("n").alias("n_shingles"), "component_id")


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """All links between different shingle sets: a_id, a_th, b_id, b_th, one row per pair.

    A set is named by the first row that has it (smallest id, null before all,
    then hash of the text); a comes before b.  No pair is left out because
    others connect it already, so a large group of near copies has as many rows
    as it has links.  Rows with equal sets link with each other and have no row
    here.
    """
    t = Threshold(num, den)
    found = _prepared(docs, id_col, text_col, words, t)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tb = pa.Table.from_batches(rows)
            cid = tb["cid"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in tb["hashes"].to_pylist()]
            sizes = np.array([len(x) for x in sets])
            points = count_vectors(Sets(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), sizes))
            ends: list[tuple[int, int]] = []

            def out() -> pa.RecordBatch:
                e = cid[np.array(ends, np.int64).reshape(-1, 2)]
                return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

            for e in all_links(sizes, points, sets, tb["side"].to_numpy(), tb["across"][0].as_py(), t):
                ends.append(e)
                if len(ends) == 1 << 16:
                    yield out()
                    ends.clear()
            yield out()

        now, rows = None, []
        for b in batches:
            marks = list(zip(b.column("cluster").to_pylist(), b.column("pair").to_pylist()))
            for i, mark in enumerate(marks):
                if mark != now:
                    if rows:
                        yield from solve(rows)
                    now, rows = mark, []
                rows.append(b.slice(i, 1))
        if rows:
            yield from solve(rows)

    # every two chunks of a cluster meet in a task, and each chunk by itself in one
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    placed = found.sets.withColumn("other", other).select(
        "cluster", "cid", "hashes", F.col("chunk").cast("bigint").alias("side"), (F.col("chunk") != F.col("other")).alias("across"),
        (F.least("chunk", "other").cast("bigint") * F.col("chunks") + F.greatest("chunk", "other")).alias("pair"),
    )
    met = placed.repartition("cluster", "pair").sortWithinPartitions("cluster", "pair").mapInArrow(lean(kernel), "a bigint, b bigint")
    first = found.classes.select(F.xxhash64("d1", "d2").alias("cid"), "first")
    named = met.join(first.select(F.col("cid").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("cid").alias("b"), F.col("first").alias("y")), "b")
    low, high = F.when(F.col("x") <= F.col("y"), F.col("x")).otherwise(F.col("y")), F.when(F.col("x") <= F.col("y"), F.col("y")).otherwise(F.col("x"))
    return named.select(low.alias("a"), high.alias("b")).select(
        F.col("a.id").alias("a_id"), F.col("a.th").alias("a_th"), F.col("b.id").alias("b_id"), F.col("b.th").alias("b_th")
    )
