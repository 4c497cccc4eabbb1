"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: every source gets a share of all words by its weight, but no more
than ``max_repeats`` times its own size; what is over is shared again.
Words are dealt in equal blocks, smaller ones in small mixes.  Blocks go to
sources by the highest quotients target / (2k + 1), and each source's blocks
go to its shards by the same rule.  Inside a shard documents stand in a seeded order; the shard's
quota is a number of full passes plus the first blocks of that order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ._shared import WORD, global_rank, join_few, materialize, packed

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Words of a block at most; a block is no more than the least target by BLOCKS_LEAST.
BLOCK_WORDS = 64
BLOCKS_LEAST = 1000
#: Documents of a shard, and shards of a source at most; beyond, shards grow.
SHARD_DOCS = 8192
MAX_SHARDS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def fill_targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sources(source, weight, source_size) -> with target, by repeated resharing.

    Each round caps the sources above their limit and shares the rest anew by
    weight; only sums reach the driver.  A source of size 0 has target 0.
    """
    s = sources.withColumn("__cap", F.col("source_size") * float(max_repeats))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    rate, capped = 0.0, -1
    while True:
        # per = words per unit of weight; a source is full when its cap is not above weight * per
        full = F.col("__cap") <= F.col("weight") * F.lit(rate)
        n_full, cap, weight = s.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, F.col("__cap"))), F.sum(F.when(~full, F.col("weight")))
        ).first()
        if n_full == capped or not weight:
            break
        capped, rate = n_full, (total - (cap or 0.0)) / weight
    return s.withColumn("target", F.least("__cap", F.col("weight") * F.lit(rate))).drop("__cap")


#: Quotients nearer than this to the last one dealt are compared one by one.
_NEAR = 1e-13
_CANDIDATES = 48


def seats_above(votes: np.ndarray, limits: np.ndarray, q: float) -> np.ndarray:
    """How many quotients votes / (2k + 1), k below the limit, are at least q."""
    return np.minimum(limits, np.floor((votes / q + 1) / 2)).astype(np.int64)


def apportion(votes: np.ndarray, limits: np.ndarray, seats: int) -> np.ndarray:
    """Seats of each row by the highest quotients votes / (2k + 1); of equal ones the first row's."""
    v, limits = votes.astype(np.float64), np.where(votes > 0, limits, 0).astype(np.int64)
    seats = min(seats, int(limits.sum()))
    if seats <= 0:
        return np.zeros(len(v), np.int64)
    high, low = v.max() * 2, v.max()
    while seats_above(v, limits, low).sum() < seats:
        high, low = low, low / 16
    while high / low > 1 + _NEAR:
        mid = (high * low) ** 0.5
        if not low < mid < high:
            break
        if seats_above(v, limits, mid).sum() < seats:
            high = mid
        else:
            low = mid
    won = seats_above(v, limits, high * (1 + _NEAR))
    open_ = seats_above(v, limits, low * (1 - _NEAR)) - won
    row = np.repeat(np.arange(len(v)), open_)
    k = won[row] + np.arange(len(row)) - np.repeat(np.cumsum(open_) - open_, open_)
    best = np.lexsort((k, row, -v[row] / (2 * k + 1)))[: seats - int(won.sum())]
    return won + np.bincount(row[best], minlength=len(v))


def sainte_lague(df: DataFrame, key: list[Column], votes: str, limit: str, seats: int) -> DataFrame:
    """Adds ``quota``: ``seats`` dealt over all rows by the highest quotients votes / (2k + 1).

    No row gets more than ``limit``; of equal quotients the first in the order
    of ``key`` wins.  The quotient of the last seat is searched by sums over
    the rows, ``_CANDIDATES`` values in each; only quotients that equal it to
    13 digits are then ranked.  Nothing but sums reaches the driver.
    """
    v, most = F.col(votes).cast("double"), F.when(F.col(votes) > 0, F.col(limit)).otherwise(0).cast("long")
    above = lambda q: F.least(most, F.floor((v / F.lit(float(q)) + 1) / 2).cast("long"))
    count = lambda qs: [x or 0 for x in df.agg(*[F.sum(above(q)) for q in qs]).first()]
    top, all_ = df.agg(F.max(v), F.sum(most)).first()
    seats = min(seats, all_ or 0)
    if seats <= 0:
        return df.withColumn("quota", F.lit(0).cast("long"))
    high, low = top * 2, top
    while count([low])[0] < seats:
        high, low = low, low / 2**20
    while high / low > 1 + _NEAR:
        step = (low / high) ** (1 / (_CANDIDATES + 1))
        grid = [q for i in range(1, _CANDIDATES + 1) if low < (q := high * step**i) < high]
        reached = list(zip(grid, count(grid))) if grid else []
        new = (min([q for q, n in reached if n < seats], default=high), max([q for q, n in reached if n >= seats], default=low))
        if new == (high, low):
            break
        high, low = new
    base = materialize(df.withColumn("__won", above(high * (1 + _NEAR))).withColumn("__reach", above(low * (1 - _NEAR))))
    given = base.agg(F.sum("__won")).first()[0]
    names = [f"__key{i}" for i in range(len(key))]
    open_ = (
        base.where("__reach > __won").withColumns(dict(zip(names, key)))
        .withColumn("__k", F.explode(F.expr("sequence(__won, __reach - 1)")))
        .select(*names, (-(v / (2 * F.col("__k") + 1))).alias("__q"), "__k", F.struct(*df.columns).alias("__row"))
    )
    order = [F.col("__q"), *[F.col(n).asc_nulls_last() for n in names], F.col("__k")]
    more = global_rank(open_, order, "__r").where(F.col("__r") <= seats - given).groupBy("__row").agg(F.count("*").alias("__more"))
    extra = more.select("__row", "__more").union(base.select(F.struct(*df.columns).alias("__row"), F.col("__won").alias("__more")))
    return extra.groupBy("__row").agg(F.sum("__more").alias("quota")).select("__row.*", "quota")


def shard_quotas(shards: DataFrame, block: int, max_repeats: int) -> DataFrame:
    """source, shard, shard_size, take: each source's blocks dealt to its shards.

    ``shards`` has at most ``MAX_SHARDS`` rows a source: source, shard,
    shard_size, blocks.
    """

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("shard", kind="stable")
        size = rows["shard_size"].to_numpy()
        quota = apportion(size, -(-size * max_repeats // block), int(rows["blocks"].iloc[0]))
        return rows.assign(take=np.minimum(quota * block, size * max_repeats))[["source", "shard", "shard_size", "take"]]

    schema = T.StructType([shards.schema["source"], *(T.StructField(c, T.LongType()) for c in ("shard", "shard_size", "take"))])
    return shards.select("source", F.col("shard").cast("long"), F.col("shard_size").cast("long"), F.col("blocks").cast("long")).groupBy("source").applyInPandas(deal, schema)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    block_words: int = BLOCK_WORDS,
    shard_docs: int = SHARD_DOCS,
    max_shards: int = MAX_SHARDS,
    seed: int = 7,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, source, row_hash.

    ``size`` counts words (null text: 0); ``target`` is that of the source, a
    null source being one of its own, ordered last.  ``taken`` counts the
    words that the mix takes from the document, repeats included, at most
    ``max_repeats`` times its size; documents without words give 0.  The order
    is a hash of seed, id and text, so reruns agree; repeated rows are
    documents of their own.  An empty table gives an empty result.
    """
    slim = materialize(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("row_hash"),
        )
    )
    per_source = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # bytes of UTF-8 stand in the order of code points
    ranked = global_rank(per_source, [F.col("source").cast("binary").asc_nulls_last()], "__i").withColumn(
        "weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("__i") - 1) % len(weights) + 1).cast("int"))
    )
    targets = materialize(fill_targets(materialize(ranked.drop("__i")), max_repeats))
    # source quotas in blocks; the whole mix is one body of seats
    seats, least = targets.agg(F.sum("target"), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    block = max(1, min(block_words, int((least or 0) // BLOCKS_LEAST)))
    dealt = sainte_lague(
        targets.withColumn("__limit", F.ceil(F.col("source_size") * max_repeats / block)), [F.col("source").cast("binary")], "target", "__limit", round((seats or 0) / block)
    )
    n_shards = F.least(F.lit(max_shards), F.ceil(F.col("n_docs") / shard_docs))
    placed = (
        join_few(slim, dealt.select("source", "source_size", "target", F.col("quota").alias("blocks"), n_shards.alias("__n")), "source")
        .withColumn("shard", F.pmod(F.xxhash64(F.lit("shard"), "row_hash", "id"), F.col("__n")))
    )
    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("blocks").alias("blocks"))
    quotas = shard_quotas(shards, block, max_repeats).select(
        F.col("source").alias("__s"), F.col("shard").alias("__h"), "shard_size", F.col("take").alias("__take")
    )
    inside = Window.partitionBy("source", "shard").orderBy("row_hash", F.col("id").asc_nulls_last())
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spread = (
        placed.join(quotas, F.col("source").eqNullSafe(F.col("__s")) & (F.col("shard") == F.col("__h")))
        .withColumn("__from", F.sum("size").over(upto) - F.col("size"))
    )
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("__take") / F.col("shard_size"))).otherwise(F.lit(0))
    rest = F.when(F.col("shard_size") > 0, F.col("__take") % F.col("shard_size")).otherwise(F.lit(0))
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("__from")))
    return spread.select(
        F.col("id").alias(id_col), "size", "source_size", F.col("target").cast("double").alias("target"),
        (passes * F.col("size") + part).cast("long").alias("taken"),
        F.col("source").alias("mix_source"), "row_hash",
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, **kwargs) -> DataFrame:
    """The mix itself: ``docs`` with every row as often as the mix takes it.

    Words taken become whole documents by rounding (half or more of a document
    is one copy); documents not taken go.  Columns are unchanged.
    """
    takes = mix(docs, id_col=id_col, text_col=text_col, seed=seed, **kwargs)
    copies = (
        takes.where("taken > 0")
        .groupBy(F.col(id_col).alias("__id"), F.col("row_hash").alias("__hash"))
        .agg(F.sum(F.round(F.col("taken") / F.col("size")).cast("int")).alias("__copies"), F.count("*").alias("__same"))
        .where("__copies > 0")
    )
    rows = packed(docs, __own=id_col, __h=F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)))
    return (
        rows.join(copies, F.col("__own").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__hash")))
        .withColumn("__n", F.round(F.col("__copies") / F.col("__same")).cast("int"))
        .where("__n > 0")
        .withColumn("__k", F.explode(F.expr("sequence(1, __n)")))
        .select("__row.*")
    )
