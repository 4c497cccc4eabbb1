"""Helpers shared by the operators: tables, durable intermediates, components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..storage import fresh_dir

#: White space of the contracts: blank and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Rows of one batch for Python workers when a table is written.
BATCH_ROWS = 2000


def release_memory() -> None:
    """Hands memory that is free back to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow, with memory handed back when its task ends."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return task


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(docs: DataFrame, **named: str | Column) -> DataFrame:
    """All columns of ``docs`` in one struct ``__row``, so that no name of theirs
    can clash with the columns ``named`` beside it."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    return docs.select(row, *[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in named.items()])


def materialize(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder, by the values of ``by`` if
    given, and read it back.

    Cuts the lineage; a lost executor costs a re-read, not a recomputation.
    Batches for Python are small meanwhile, so that what a JVM holds beside
    its heap for whole texts stays small.
    """
    spark = df.sparkSession
    path = fresh_dir(spark, "table")
    usual = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(usual), BATCH_ROWS)))
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        spark.conf.set(_BATCH, usual)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of one bitmap row, as ``bitmap_construct_agg`` makes them.
BITMAP_ROW = 32768
#: At most 4096 bitmap rows of 4 KB: 16 MB to broadcast.
BITMAP_BITS = 2**27


def bitmap_size(n: int, bits_each: int = 16, most: int = BITMAP_BITS) -> int:
    """A power of two near ``bits_each`` bits an entry, never over ``most``."""
    return min(most, max(BITMAP_ROW, 1 << (max(1, n) * bits_each - 1).bit_length()))


def bit_is_set(bitmap: str, position: str) -> Column:
    """Whether the bit of ``position`` is set in its bitmap row (null: no)."""
    at = f"cast({position} % {BITMAP_ROW} as int)"
    byte = f"cast(conv(hex(substring({bitmap}, {at} div 8 + 1, 1)), 16, 10) as int)"
    return F.expr(f"coalesce((shiftright({byte}, {at} % 8) & 1) = 1, false)")


def id_bitmap(ids: DataFrame, col: str) -> tuple[DataFrame, int]:
    """A bitmap of bounded size that has a bit set for every id of ``col``."""
    bits = bitmap_size(ids.count())
    at = ids.select(F.pmod(F.xxhash64(col), F.lit(bits)).alias("p"))
    rows = at.groupBy(F.expr(f"p div {BITMAP_ROW}").alias("__row_no")).agg(F.bitmap_construct_agg(F.col("p") % BITMAP_ROW).alias("__map"))
    return materialize(rows), bits


def in_bitmap(df: DataFrame, col: str, bitmap: DataFrame, bits: int, negate: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``col`` may be in the bitmap, or those where it surely is not."""
    hit = bit_is_set("__map", "__at")
    return (
        df.withColumn("__at", F.pmod(F.xxhash64(col), F.lit(bits)))
        .join(F.broadcast(bitmap), F.expr(f"__at div {BITMAP_ROW}") == F.col("__row_no"), "left")
        .where(~hit if negate else hit)
        .drop("__at", "__row_no", "__map")
    )


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``, the rank from 1 on in the given order over all rows.

    Rows are dealt to ranges and ranked there; only the ranges' sizes reach the
    driver.  The order must tell all rows apart.
    """
    inside = Window.partitionBy("__part").orderBy(*order)
    placed = df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    ranked = materialize(materialize(placed).withColumn(name, F.row_number().over(inside)))
    before, rows = 0, []
    for part, n in sorted(map(tuple, ranked.groupBy("__part").count().collect())):
        rows.append((part, before))
        before += n
    if not rows:
        return ranked.drop("__part")
    offsets = df.sparkSession.createDataFrame(rows, "__part int, __before long")
    return ranked.join(F.broadcast(offsets), "__part").withColumn(name, F.col(name) + F.col("__before")).drop("__part", "__before")


#: A key counts as heavy when it has over 1 / HEAVY_KEYS of all rows, so there
#: are fewer heavy keys than this.
HEAVY_KEYS = 256


def join_heavy(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join of ``rows``, inner or left, with one row per key of ``groups``.

    ``size`` counts the rows of a key, ``total`` all rows.  The few heavy keys
    are broadcast, at most ``HEAVY_KEYS`` rows, so that their rows stay where
    they are; the others are joined by a shuffle.
    """
    limit = max(1, total // HEAVY_KEYS)
    heavy = F.broadcast(groups.where(F.col(size) > limit))
    light = groups.where(F.col(size) <= limit)
    rest = rows.join(F.broadcast(groups.where(F.col(size) > limit).select(*keys)), keys, "left_anti")
    return rows.join(heavy, keys).unionByName(rest.join(light, keys, how))


def join_few(rows: DataFrame, few: DataFrame, key: str, how: str = "inner", most: int = 10_000, salts: int = 64) -> DataFrame:
    """Join with a table that has few rows, one per key, such as one per language.

    Null is a key like any other.  Up to ``most`` rows the table is broadcast.
    Beyond, it is copied ``salts`` times and joined by key and salt, so that no
    key gathers in one task.
    """
    few = materialize(few.withColumnRenamed(key, "__few"))
    same = F.col(key).eqNullSafe(F.col("__few"))
    if few.count() <= most:
        return rows.join(F.broadcast(few), same, how).drop("__few")
    copies = few.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int"))
    return salted.join(copies, same & (F.col("__salt") == F.col("__copy")), how).drop("__few", "__salt", "__copy")


def without_rows(docs: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` without the rows of an id and text hash in ``gone`` (id, th).

    Rows whose text hash is not in a bitmap of those that go pass straight
    through; only the others shuffle.
    """
    gone = materialize(gone.select("id", "th").distinct())
    bitmap, bits = id_bitmap(gone, "th")
    rows = packed(docs, __id=F.col(id_col).cast("bigint"), __th=F.xxhash64(text_col))
    pass_, maybe = in_bitmap(rows, "__th", bitmap, bits, True), in_bitmap(rows, "__th", bitmap, bits)
    out = gone.select(F.col("id").alias("__g"), F.col("th").alias("__gth")).hint("merge")
    left = maybe.join(out, F.col("__id").eqNullSafe(F.col("__g")) & (F.col("__th") == F.col("__gth")), "left_anti")
    return pass_.select("__row.*").unionByName(left.select("__row.*"))


def least_of_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the graph of edges a - b."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, root):
            return nodes, nodes[root]
        root = new


#: Edges that a node may have in one task before it is spread over several.
HUB_EDGES = 1000
_HUB_PARTS = 64
#: Edges that a task reduces to stars at first, again while that halves them;
#: what fits one task is solved there.
TASK_EDGES = 1 << 19


def _spread(e: DataFrame, total: int) -> DataFrame:
    """Edges (a, b) with ``node`` and ``part``: a row for each end.

    A hub, a node b with over 1 / HEAVY_KEYS of all edges, has many parts: its
    neighbours are dealt to them, its own edges go to all.  So there are fewer
    hubs than HEAVY_KEYS, and none gathers in one task.
    """
    limit = max(HUB_EDGES, total // HEAVY_KEYS)
    # as many parts as a hub has times the limit
    hubs = {b: min(_HUB_PARTS, -(-n // limit)) for b, n in e.groupBy("b").count().where(F.col("count") > limit).collect()} if total > limit else {}
    part = lambda node, i: F.struct(node.alias("node"), i.cast("int").alias("part"))
    a, b, zero = F.col("a"), F.col("b"), F.lit(0)
    to_a, at_b = F.array(part(a, zero)), zero
    if hubs:
        parts = F.create_map(*[x for h, n in hubs.items() for x in (F.lit(h).cast("bigint"), F.lit(n))])
        of_a, of_b = (F.coalesce(F.element_at(parts, x), F.lit(1)) for x in (a, b))
        to_a = F.transform(F.sequence(zero, of_a - 1), lambda i: part(a, i))
        at_b = F.pmod(F.xxhash64(a), of_b).cast("int")
    return e.select("a", "b", F.explode(F.concat(to_a, F.array(part(b, at_b)))).alias("to")).select("a", "b", "to.node", "to.part")


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of the graph of ``edges(a, b)`` with long ids, a written table.

    Files are read together and reduced first.  Then each round sends every
    edge to the partitions of both its ends; a partition replaces the edges it
    holds by stars, every node joined to the smallest node of its component
    there.  Smaller ids spread and paths halve until nothing changes.  One shuffle a round; nothing is collected but a
    count, a checksum and the few hubs.  Returns (id, component) for every
    node of an edge between two different ids, the component being its
    smallest id.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [tuple(b.column(c).to_numpy() for c in ("node", "part", "a", "b")) for b in batches]
        if not held:
            return
        to, part, a, b = (np.concatenate(x) for x in zip(*held))
        node, least = least_of_components(a, b)
        # the partition that a node belongs to has its own edges and tells its
        # label; others tell only what that partition cannot know
        known = node.copy()
        at_a, at_b = np.searchsorted(node, a), np.searchsorted(node, b)
        np.minimum.at(known, at_a, b)
        np.minimum.at(known, at_b, a)
        own = np.zeros(len(node), bool)
        own[np.searchsorted(node, to[part == 0])] = True
        keep = np.where(own, least < node, least < known)
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(least[keep])], names=["a", "b"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
        if held:
            node, least = least_of_components(*(np.concatenate(x) for x in zip(*held)))
            keep = least < node
            yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(least[keep])], names=["a", "b"])

    def sign_of(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first()

    own = edges.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b")
    e, total, tasks, settled = own, own.count(), 0, False
    while not settled:
        tasks, before = max(1, -(-total // TASK_EDGES)), total
        e = materialize(e.coalesce(tasks).mapInArrow(lean(first), "a bigint, b bigint"))
        total = e.count()
        settled = tasks == 1 or 2 * total > before
    sign, rounds = sign_of(e), 0
    while tasks > 1:
        sent = _spread(e, sign[0]).repartition("node", "part")
        e = materialize(sent.mapInArrow(lean(stars), "a bigint, b bigint"))
        before, sign, rounds = sign, sign_of(e), rounds + 1
        if sign == before or sign[0] == 0:
            break
        if rounds == max_rounds:
            raise RuntimeError("connected components did not converge")
    both = e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component")))
    return both.distinct()
