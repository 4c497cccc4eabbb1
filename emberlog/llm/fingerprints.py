"""Document fingerprints by SimHash and search by permuted block tables (native).

The terms of a text are its shingles of five words (a shorter text is one
term); a term's weight is the number of times it occurs.  Every term votes
with its weight on each of 128 signed bits; a bit is set when more than half
of the weight votes for it.  Two fingerprints at Hamming distance d have the
likeness 1 - d / 128.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from ._shared import SPACE, join_heavy, materialize

BITS = 128
SHINGLE_WORDS = 5
#: Sets of shingles with Jaccard 0.8 lie at 19.4 bits on average, with a standard
#: deviation of 4.1: the angle of the cosine 2 * 0.8 / 1.8.  Two deviations more.
RADIUS = 27
#: Terms summed in one lane of 16 bits before the next group of lanes begins.
_GROUP_TERMS = 16384
_LANES = 16
_MASK = 0x0001000100010001


def fingerprint_string(hi: Column, lo: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(hi), 16, "0"), F.lpad(F.hex(lo), 16, "0")))


def distance(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def simhash(texts: DataFrame, keys: list[str], text_col: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """keys, hi, lo: the fingerprint of the text of each key.

    Rows with equal keys must have equal texts.  Texts without words have no
    terms and no row here; their fingerprint is all zero.  The votes of a
    text are summed before anything shuffles: a few hundred bytes a text.
    """
    hashed = texts.select(
        *keys,
        F.transform(
            F.filter(F.split(F.coalesce(text_col, F.lit("")), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w)
        ).alias("__w"),
    )
    n = F.size("__w")
    shingles = F.transform(
        F.sequence(F.lit(1), n - (words - 1)),
        lambda i: F.xxhash64(*[F.element_at("__w", i + k) for k in range(words)]),
    )
    terms = hashed.select(
        *keys,
        F.posexplode(F.when(n >= words, shingles).when(n > 0, F.array(F.xxhash64("__w")))).alias("__at", "__h"),
    ).select(*keys, F.expr(f"__at div {_GROUP_TERMS}").alias("__group"), "__h", F.xxhash64("__h", F.lit(1)).alias("__g"))
    lanes = [
        F.sum(F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_MASK))).alias(f"__{h}{j}")
        for h in ("__h", "__g")
        for j in range(_LANES)
    ]
    summed = terms.groupBy(*keys, "__group").agg(F.count("*").alias("__n"), *lanes)
    parts = summed.groupBy(*keys).agg(
        F.sum("__n").alias("__n"),
        *[
            F.collect_list(F.array(*[F.col(f"__{h}{j}") for j in range(_LANES)])).alias(f"__{h}")
            for h in ("__h", "__g")
        ],
    )

    def half(h: str) -> Column:
        # bit j + 16 * k of the fingerprint is counted in lane k of sum j
        def bit(b):
            j, k = b % F.lit(_LANES), F.floor(b / F.lit(_LANES)).cast("int")
            ones = F.aggregate(
                F.col(h),
                F.lit(0).cast("long"),
                lambda acc, x: acc + F.call_function("shiftrightunsigned", F.get(x, j), k * 16).bitwiseAND(F.lit(0xFFFF)),
            )
            return F.when(2 * ones > F.col("__n"), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(
            F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(bit(b))
        )

    return parts.select(*keys, half("____h").alias("hi"), half("____g").alias("lo"))


def _bucket(id_col: Column, bounds: list[int]) -> Column:
    """Bucket by falling id; nulls in the last.  Two short lists are searched instead of one long."""
    step = max(1, round(len(bounds) ** 0.5))
    fine = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]

    def lists(values: list, kind: str) -> Column:
        # one constant of any size, not an expression for each number
        return F.from_json(F.lit(json.dumps(values)), kind)

    def above(values: Column) -> Column:
        return F.size(F.filter(values, lambda v: v > id_col))

    last = F.lit(len(bounds))
    coarse = above(lists([x[0] for x in fine if x], "array<bigint>"))
    inside = above(F.get(lists(fine, "array<array<bigint>>"), F.greatest(coarse - 1, F.lit(0))))
    # bounds fall: what lies in earlier lists is above, then those of the list reached
    found = F.when(coarse > 0, (coarse - 1) * step + inside).otherwise(F.lit(0))
    return F.when(id_col.isNull(), last).otherwise(found)


#: Bytes of text that a range of ids holds, about.
RANGE_BYTES = 128 << 20


def _lower_ends(ids: DataFrame, ranges: int) -> list[int]:
    """The smallest id of each range but the last, falling: at most one number a range."""
    if ranges == 1:
        return []
    dealt = ids.where("id IS NOT NULL").repartitionByRange(ranges, F.col("id").desc())
    ends = dealt.groupBy(F.spark_partition_id().alias("part")).agg(F.min("id").alias("low")).collect()
    return sorted((r["low"] for r in ends), reverse=True)[:-1]


def with_next(docs: DataFrame, id_col: str, text_col: str, buckets: int | None = None) -> DataFrame:
    """id, th, text, next_id, next_th, next_text in falling order of ids.

    The last document is followed by the first.  Ids are dealt to ranges, so
    texts shuffle once; the first document of each range is sent to the range
    before it as well.  There are as many ranges (``buckets``) as shuffle
    partitions, or more: one for each ``RANGE_BYTES`` of text.  Equal ids stand in the order of their text's hash,
    null ids come last.
    """
    base = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")
    ).withColumn("th", F.xxhash64("text"))
    if buckets is None:
        size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    bounds = _lower_ends(base.select("id"), buckets)
    placed = base.withColumn("bucket", _bucket(F.col("id"), bounds))
    # at most a row a range reaches the driver
    heads = sorted((r["bucket"], r["head"]) for r in placed.groupBy("bucket").agg(F.max("id").alias("head")).collect())
    order = [b for b, _ in heads]
    before = {b: order[i - 1] for i, b in enumerate(order)}
    spark = docs.sparkSession
    sent = F.broadcast(
        spark.createDataFrame([(h, before[b]) for b, h in heads], "head long, target int")
    )
    rows = placed.join(sent, F.col("id").eqNullSafe(F.col("head")), "left").select(
        "id", "th", "text",
        F.explode(
            F.when(
                F.col("target").isNotNull(),
                F.array(
                    F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost")),
                    F.struct(F.col("target").alias("b"), F.lit(1).alias("ghost")),
                ),
            ).otherwise(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("ghost"))))
        ).alias("at"),
    ).select("id", "th", "text", "at.b", "at.ghost")
    w = Window.partitionBy("b").orderBy("ghost", F.col("id").desc_nulls_last(), "th")
    return (
        rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in ("id", "th", "text")})
        .where("ghost = 0")
        .drop("ghost", "b")
    )


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """id, fingerprint, fp_hi, fp_lo of every row; null texts count as empty."""
    base = docs.select(F.col(id_col), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"), F.col(text_col).alias("__t"))
    fps = simhash(base, [id_col, "th"], "__t", words).select(F.col(id_col).alias("__id"), F.col("th").alias("__th"), "hi", "lo")
    zero = F.lit(0).cast("long")
    return (
        base.select(id_col, "th")
        .join(fps, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th")), "left")
        .select(id_col, F.coalesce("hi", zero).alias("fp_hi"), F.coalesce("lo", zero).alias("fp_lo"))
        .withColumn("fingerprint", fingerprint_string(F.col("fp_hi"), F.col("fp_lo")))
    )


def near_fingerprints(queries: DataFrame, corpus: DataFrame, radius: int) -> DataFrame:
    """All pairs (q_hi, q_lo, hi, lo, distance) within ``radius`` bits.

    Both inputs hold distinct fingerprints (hi, lo).  The 128 bits are cut into
    blocks; of two fingerprints within the radius, some block differs in at most
    radius / blocks bits.  Table k is keyed by block k; a query looks up its own
    block and every block as near as that, so that few and wide blocks serve a
    large radius.  A pair that meets in several tables is kept in the first.
    Nothing within the radius is missed.
    """
    # up to 7 bits: blocks of 16 bits or more, one of them equal; beyond, up to 3 bits differ
    parts = radius + 1 if radius < 8 else max(7, radius // 4 + 1)
    off = radius // parts
    edges = [round(i * BITS / parts) for i in range(parts + 1)]

    def pieces(hi: Column, lo: Column, k: int) -> list[tuple[Column, int]]:
        """The bits of block k in each word, and how many."""
        found = []
        for word, at in ((lo, 0), (hi, 64)):
            a, b = max(edges[k], at) - at, min(edges[k + 1], at + 64) - at
            if a < b:
                mask = (1 << (b - a)) - 1
                mask = mask - (1 << 64) if mask >= 1 << 63 else mask
                found.append((F.shiftrightunsigned(word, a).bitwiseAND(F.lit(mask)), b - a))
        return found

    def block(hi: Column, lo: Column, k: int) -> Column:
        bits = pieces(hi, lo, k)
        if not off:
            return F.xxhash64(F.lit(k), *[x for x, _ in bits])
        # the number of the table above the bits of the block
        low, shift = bits[0]
        value = low.bitwiseOR(F.shiftleft(bits[1][0], shift)) if len(bits) > 1 else low
        return value.bitwiseOR(F.lit(k << 32))

    def tables(df: DataFrame, prefix: str) -> DataFrame:
        hi, lo = F.col("hi"), F.col("lo")
        blocks = F.array(*[block(hi, lo, k) for k in range(parts)])
        return df.select(hi.alias(f"{prefix}hi"), lo.alias(f"{prefix}lo"), F.posexplode(blocks).alias(f"{prefix}k", f"{prefix}key"))

    q, c = tables(queries, "q_"), tables(corpus, "c_").drop("c_k")
    if off:
        # at most a few thousand rows: what may differ in a block
        widths = {e - a for a, e in zip(edges, edges[1:])}
        masks = queries.sparkSession.range(1 << max(widths)).where(F.bit_count("id") <= off).withColumnRenamed("id", "mask")
        width = F.array(*[F.lit(e - a) for a, e in zip(edges, edges[1:])])
        q = q.join(F.broadcast(masks), F.call_function("shiftrightunsigned", F.col("mask"), F.get(width, F.col("q_k"))) == 0)
        q = q.withColumn("q_key", F.col("q_key").bitwiseXOR(F.col("mask"))).drop("mask")
    x_hi, x_lo = F.col("q_hi").bitwiseXOR(F.col("c_hi")), F.col("q_lo").bitwiseXOR(F.col("c_lo"))
    apart = F.bit_count(x_hi) + F.bit_count(x_lo)
    met_before = F.lit(False)
    for k in range(parts - 1):
        bits = [F.bit_count(x) for x, _ in pieces(x_hi, x_lo, k)]
        met_before = met_before | ((F.col("q_k") > k) & (sum(bits[1:], bits[0]) <= off))
    return (
        q.join(c, (F.col("q_key") == F.col("c_key")) & (apart <= radius) & ~met_before)
        .select("q_hi", "q_lo", F.col("c_hi").alias("hi"), F.col("c_lo").alias("lo"), apart.alias("distance"))
    )


def edited_fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS,
    radius: int = RADIUS, query_every: int = 100, buckets: int | None = None,
) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last third replaced by the start of the next
    document in falling order of ids.  Returns id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next and, for ids
    divisible by ``query_every``, n_near: how many other rows have a
    fingerprint within ``radius`` bits (null for other ids).  Null texts count
    as empty, null ids come last, repeated rows give a row each; an empty
    table gives an empty result.
    """
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).withColumn(
        "th", F.xxhash64("text")
    )
    own = materialize(simhash(keyed, ["id", "th"], "text", words))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = with_next(docs, id_col, text_col, buckets).select(
        "id", "th", "next_id", "next_th", n.cast("long").alias("n_chars"),
        F.concat(F.substr("text", F.lit(1), n - third), F.substr("next_text", F.lit(1), third)).alias("edited"),
    ).withColumn("eh", F.xxhash64("edited"))
    changed = simhash(edited.select("id", "th", "eh", "edited"), ["id", "th", "eh"], "edited", words)
    meta = edited.select("id", "th", "eh", "next_id", "next_th", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))

    def named(df: DataFrame, p: str, keys: list[str]) -> DataFrame:
        return df.select(*[F.col(k).alias(f"{p}{k}") for k in keys], F.col("hi").alias(f"{p}hi"), F.col("lo").alias(f"{p}lo"))

    def same(*pairs: tuple[str, str]) -> Column:
        tests = [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    zero = F.lit(0).cast("long")
    joined = (
        meta.join(named(changed, "e_", ["id", "th", "eh"]), same(("id", "e_id"), ("th", "e_th"), ("eh", "e_eh")), "left")
        .join(named(own, "o_", ["id", "th"]), same(("id", "o_id"), ("th", "o_th")), "left")
        .join(named(own, "n_", ["id", "th"]), same(("next_id", "n_id"), ("next_th", "n_th")), "left")
        .select("id", "n_chars", "edited_sha256", *[F.coalesce(f"{p}{h}", zero).alias(f"{p}{h}") for p in "eon" for h in ("_hi", "_lo")])
    )
    rows = materialize(joined)
    pair = lambda p: (F.col(f"{p}_hi"), F.col(f"{p}_lo"))
    classes = rows.groupBy(F.col("o_hi").alias("hi"), F.col("o_lo").alias("lo")).agg(F.count("*").alias("n"))
    asked = rows.where(F.col("id") % query_every == 0).select(F.col("o_hi").alias("hi"), F.col("o_lo").alias("lo")).distinct()
    # a query's own class lies at distance 0; its size tells a heavy fingerprint
    near = materialize(
        near_fingerprints(asked, classes.select("hi", "lo"), radius)
        .join(classes, ["hi", "lo"])
        .groupBy(F.col("q_hi").alias("o_hi"), F.col("q_lo").alias("o_lo"))
        .agg((F.sum("n") - 1).alias("__near"), F.max(F.when(F.col("distance") == 0, F.col("n"))).alias("__size"))
    )
    is_query = F.coalesce(F.col("id") % query_every == 0, F.lit(False))
    answered = join_heavy(rows.where(is_query), near, ["o_hi", "o_lo"], "__size", rows.count()).drop("__size")
    others = rows.where(~is_query).withColumn("__near", F.lit(None).cast("long"))
    return others.unionByName(answered).select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        fingerprint_string(*pair("o")).alias("fingerprint"),
        fingerprint_string(*pair("e")).alias("edited_fingerprint"),
        (1 - distance(pair("o"), pair("e")) / BITS).cast("double").alias("near_edited"),
        (1 - distance(pair("o"), pair("n")) / BITS).cast("double").alias("near_next"),
        F.col("__near").alias("n_near"),
    )
