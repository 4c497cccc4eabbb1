"""Exact duplicate removal behind a two-pass Bloom filter (native).

Pass one counts, for two hash functions, how many rows fall on each position
of a filter and keeps the positions met at least twice as a bitmap.  Pass two
tests every row: a row with a position that no other row has is unique for
certain and passes straight through.  Only the others shuffle, to be grouped
by the SHA-256 of the normalised text, so false positives cost a little work
and never change the result.

The filter has 16 bits a row at any number of rows.  What is broadcast at once
is bounded: beyond that, hashes are dealt to ranges, each with a filter of its
own, and rows without their texts are stored by range and tested there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..storage import fresh_dir
from ._shared import BITMAP_BITS, BITMAP_ROW, SPACE, bit_is_set, bitmap_size, join_heavy, materialize, packed

BITS_PER_ROW = 16


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def _signed(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.withColumns(
        {
            "__sha": F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)),
            "__len": F.char_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"),
        }
    )


def _positions(bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64("__sha", F.lit(k)), F.lit(bits)) for k in (1, 2)]


def repeated_bitmap(signed: DataFrame, bits: int) -> DataFrame:
    """Bitmap rows (__row, __map) of the positions met at least twice.

    At most bits / 32768 rows of 4 KB: ``BITMAP_BITS`` bounds them at 16 MB.
    """
    p, q = _positions(bits)
    twice = (
        signed.select(F.explode(F.array(p, q + F.lit(bits))).alias("pos"))
        .groupBy("pos")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select((F.col("pos") % bits).alias("pos"), (F.col("pos") >= bits).alias("second"))
    )
    return _rows_of_bits(twice)


def bitmap_of(hashes: DataFrame, bits: int) -> DataFrame:
    """Bitmap rows of the positions of all ``hashes``."""
    p, q = (F.struct(x.alias("pos"), F.lit(k).alias("second")) for k, x in zip((False, True), _positions(bits)))
    return _rows_of_bits(hashes.select(F.inline(F.array(p, q))))


def _rows_of_bits(positions: DataFrame) -> DataFrame:
    return positions.groupBy(
        "second", F.expr(f"pos div {BITMAP_ROW}").alias("__row")
    ).agg(F.bitmap_construct_agg(F.col("pos") % BITMAP_ROW).alias("__map"))


def possibly_repeated(signed: DataFrame, bitmap: DataFrame, bits: int) -> DataFrame:
    """``signed`` with ``__maybe``: false only for rows that surely are unique."""
    out = signed
    hits = []
    for k, p in enumerate(_positions(bits)):
        side = F.broadcast(
            bitmap.where(F.col("second") == F.lit(bool(k))).select(
                F.col("__row").alias(f"__row{k}"), F.col("__map").alias(f"__map{k}")
            )
        )
        out = out.withColumn(f"__pos{k}", p).join(
            side, F.expr(f"__pos{k} div {BITMAP_ROW}") == F.col(f"__row{k}"), "left"
        )
        hits.append(bit_is_set(f"__map{k}", f"__pos{k}"))
    return out.withColumn("__maybe", hits[0] & hits[1]).drop(
        *[f"__{n}{k}" for k in (0, 1) for n in ("pos", "row", "map")]
    )


def tested_rows(signed: DataFrame, total: int, max_bits: int) -> DataFrame:
    """``signed``, a written table of ``total`` rows, with ``__maybe``.

    A filter has at most ``max_bits`` bits for each of its two functions.  With
    more rows than that serves, there are as many ranges of hashes as needed:
    equal hashes are in one range, each is read once and has two jobs.
    """
    ranges = max(1, -(-total * BITS_PER_ROW // max_bits))
    bits = bitmap_size(-(-total // ranges), BITS_PER_ROW, max_bits)

    def tested(rows: DataFrame) -> DataFrame:
        return possibly_repeated(rows, materialize(repeated_bitmap(rows, bits)), bits)

    if ranges == 1:
        return tested(signed)
    spark, path = signed.sparkSession, fresh_dir(signed.sparkSession, "tested")
    at = F.pmod(F.xxhash64("__sha", F.lit(3)), F.lit(ranges)).cast("int")
    split = materialize(signed.withColumn("__range", at), by="__range")
    for r in range(ranges):
        out = tested(split.where(F.col("__range") == r).drop("__range"))
        out.write.parquet(f"{path}/range={r}")
    return spark.read.schema(out.schema).parquet(path)


def _best() -> Column:
    # most code points, then the smallest id; a null id comes last
    return F.max(F.struct("__len", F.col("__id").isNotNull(), -F.col("__id"), "__id"))["__id"]


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = BITMAP_BITS
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space.  Null counts as the
    empty text.  Of equal texts the longest original stays, then the smallest
    id (null ids last).  A row that is there several times with the same id is
    a group like any other: one of its rows is kept.  An empty table gives an
    empty result.  Other columns of ``docs`` are ignored.
    """
    signed = materialize(
        _signed(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text").drop("__text")
    )
    total = signed.count()
    tested = tested_rows(signed, total, max_bits)
    alone = tested.where(~F.col("__maybe")).select(
        F.col("__id").alias(id_col),
        F.col("__id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        F.lower(F.hex("__sha")).alias("text_sha256"),
    )
    rows = materialize(
        tested.where("__maybe").groupBy("__sha", "__id", "__len").agg(F.count("*").alias("__rows"))
    )
    groups = materialize(
        rows.groupBy("__sha").agg(_best().alias("keep_id"), F.sum("__rows").alias("group_size"), F.max("__len").alias("__keep_len"))
    )
    shared = (
        join_heavy(rows, groups, ["__sha"], "group_size", total)
        .withColumn("__k", F.explode(F.expr("sequence(1L, __rows)")))
        .select(
            F.col("__id").alias(id_col),
            "keep_id",
            "group_size",
            (F.col("__id").eqNullSafe(F.col("keep_id")) & (F.col("__len") == F.col("__keep_len")) & (F.col("__k") == 1)).alias("kept"),
            F.lower(F.hex("__sha")).alias("text_sha256"),
        )
    )
    return alone.unionByName(shared)


def drop_exact_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = BITMAP_BITS
) -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns unchanged.

    Which row stays is as in :func:`exact_groups`.  Groups are found on rows
    without their texts; then a bitmap of the hashes that are repeated tells
    which whole rows shuffle.  All others pass straight through.
    """
    signed = _signed(packed(docs, __id=id_col, __text=text_col), "__text").drop("__text")
    slim = materialize(signed.drop("__row"))
    total = slim.count()
    keep = materialize(
        tested_rows(slim, total, max_bits)
        .where("__maybe")
        .groupBy("__sha")
        .agg(_best().alias("__keep"), F.max("__len").alias("__keep_len"), F.count("*").alias("__size"))
        .where("__size > 1")
    )
    bits = bitmap_size(keep.count(), BITS_PER_ROW, max_bits)
    tested = possibly_repeated(signed, materialize(bitmap_of(keep, bits)), bits)
    alone = tested.where(~F.col("__maybe")).select("__row.*")
    stay = (
        join_heavy(tested.where("__maybe"), keep, ["__sha"], "__size", total, "left")
        .where(
            F.col("__keep_len").isNull()
            | (F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__len") == F.col("__keep_len")))
        )
        .groupBy("__sha")
        .agg(F.first("__row").alias("__row"))
        .select("__row.*")
    )
    return alone.unionByName(stay)
