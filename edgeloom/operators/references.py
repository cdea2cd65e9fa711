"""References to records that do not exist.

A blocked Bloom filter of the parents' keys proves most orphans without a
join; only references that pass it are joined exactly. The filter's blocks are
built by ``bitmap_construct_agg`` and broadcast in slices of bounded bytes, so
a filter of any size is probed by the same plan; building and probing are
built-in expressions. Parents held for a time are reduced to one row a key;
the few references that this row doesn't settle are settled by running sums.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom.plans import skew
from edgeloom.plans.durable import materialise
from edgeloom.plans.ranking import running_sums

BLOCK_BITS = 32_768
BITS_A_KEY = 16
PROBES = 6
#: Bytes of a broadcast block, whose words of 32 bits are kept as longs.
BLOCK_BYTES = BLOCK_BITS // 4 + 64


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _within(key: Column) -> Column:
    """The hash of a key that its places within the block follow from."""
    return F.xxhash64(key, F.lit("within"))


def _positions(h: Column) -> list[Column]:
    """PROBES bit positions within a block, by double hashing."""
    start = h.bitwiseAND(F.lit(BLOCK_BITS - 1))
    step = F.shiftright(h, 15).bitwiseAND(F.lit(BLOCK_BITS - 1)).bitwiseOR(F.lit(1))
    return [F.pmod(start + F.lit(i) * step, F.lit(BLOCK_BITS)) for i in range(PROBES)]


def bloom_blocks(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """The filter's blocks as (_block, _words) and how many blocks there may be.

    Null keys are left out. The number of blocks follows the number of rows,
    which bounds the number of keys.
    """
    rows = keys.filter(F.col(key).isNotNull()).select(F.col(key).alias("_k"))
    blocks = max(1, -(-rows.count() * BITS_A_KEY // BLOCK_BITS))
    bits = rows.select(_block(F.col("_k"), blocks).alias("_block"), F.explode(F.array(*_positions(_within(F.col("_k"))))).alias("_at")).groupBy("_block").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    word = lambda i: F.conv(F.hex(F.substring("_bits", (i * 4 + 1).cast("int"), F.lit(4))), 16, 10).cast("bigint")
    return bits.select("_block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 32 - 1)), word).alias("_words")), blocks


def _all_set(words: Column, positions: list[Column]) -> Column:
    def one(at: Column) -> Column:
        # The bytes of a word are in the order of their places, the bits of a byte from the lowest.
        bit = F.lit(24) - F.shiftright(at, 3).bitwiseAND(F.lit(3)) * 8 + at.bitwiseAND(F.lit(7))
        return F.getbit(F.get(words, F.shiftright(at, 5).cast("int")), bit.cast("int")) == 1

    return reduce(lambda a, b: a & b, [one(at) for at in positions])


def probe(refs: DataFrame, key: str, bits: DataFrame, blocks: int) -> DataFrame:
    """``refs`` with ``_may_exist``: false proves that no parent has the key.

    The blocks are taken in slices that may be broadcast; each reference meets
    the slice of its own block only. References and blocks are written once,
    parted by slice if there are several, so what makes up a key is evaluated
    once.
    """
    each = max(1, skew.BROADCAST_BYTES // BLOCK_BYTES)
    slices = -(-blocks // each)
    slice_ = F.floor(F.col("_block") / each).cast("int")
    by = "_slice" if slices > 1 else None
    placed = materialise(refs.withColumn("_block", _block(F.col(key), blocks)).withColumn("_h", _within(F.col(key))).withColumn("_slice", slice_), "references", by)
    parts = materialise(bits.withColumn("_slice", slice_), "filter", by)
    found = []
    for i in range(slices):
        own = parts.filter(F.col("_slice") == i).select("_block", "_words")
        joined = placed.filter(F.col("_slice") == i).join(F.broadcast(own), "_block", "left")
        found.append(joined.withColumn("_may_exist", F.coalesce(_all_set(F.col("_words"), _positions(F.col("_h"))), F.lit(False))).select(*refs.columns, "_may_exist"))
    return reduce(lambda a, b: a.unionByName(b), found)


def _spans(held: DataFrame) -> DataFrame:
    """One row a parent key of (_parent, _from, _to, _always): whether and from when to when it was held, as far as one row can say.

    ``_whole`` says that the closed times have a moment in common, so that
    together they are one time without gaps.
    """
    timed = F.col("_from").isNotNull() & (F.col("_to").isNull() | (F.col("_to") > F.col("_from")))
    start, closed = F.when(timed, F.col("_from")), timed & F.col("_to").isNotNull()
    spans = held.groupBy("_parent").agg(
        F.bool_or("_always").alias("_always"), F.min(start).alias("_first"), F.min(F.when(timed & F.col("_to").isNull(), F.col("_from"))).alias("_open"),
        F.max(F.when(closed, F.col("_to"))).alias("_last"), F.max(F.when(closed, F.col("_from"))).alias("_late"), F.min(F.when(closed, F.col("_to"))).alias("_early"),
    )
    return spans.withColumn("_whole", F.coalesce(F.col("_late") <= F.col("_early"), F.lit(True))).drop("_late", "_early")


def _verdict(at: Column) -> Column:
    """held, orphan or open: what a parent's span says of a reference made at that time."""
    never = F.col("_always").isNull() | (~F.col("_always") & (at.isNull() | F.col("_first").isNull()))
    in_closed = F.coalesce((at >= F.col("_first")) & (at < F.col("_last")), F.lit(False))
    sure = F.col("_always") | F.coalesce(at >= F.col("_open"), F.lit(False))
    return F.when(never, "orphan").when(sure, "held").when(in_closed & F.col("_whole"), "held").when(in_closed, "open").otherwise("orphan")


def _swept(asked: DataFrame, held: DataFrame) -> DataFrame:
    """The (key, time) of ``asked`` (_k, _t) at which no parent's time is running, by running sums over starts and ends."""
    own = held.join(asked.select(F.col("_k").alias("_parent")).distinct(), "_parent", "left_semi").filter(F.col("_from").isNotNull() & (F.col("_to").isNull() | (F.col("_to") > F.col("_from"))))
    steps = own.select(F.col("_parent").alias("_k"), F.inline(F.array(F.struct(F.col("_from").alias("_t"), F.lit(1).alias("_d")), F.struct(F.col("_to").alias("_t"), F.lit(-1).alias("_d"))))).filter("_t IS NOT NULL")
    every = steps.withColumn("_q", F.lit(0)).unionByName(asked.select("_k", "_t", F.lit(0).alias("_d"), F.lit(1).alias("_q")))
    moments = materialise(every.groupBy("_k", "_t").agg(F.sum("_d").alias("_d"), F.max("_q").alias("_q")), "moments")
    return running_sums(moments, ["_k"], "_t", {"_n": "_d"}).filter("_q = 1 AND _n = 0").select("_k", "_t")


def orphan_references(refs: DataFrame, parents: DataFrame, key: str, at: str | None = None, held_from: str | None = None, held_to: str | None = None, always: str | None = None) -> DataFrame:
    """The rows of ``refs`` whose ``key`` no row of ``parents`` holds.

    With ``at``, a parent counts only if it was held then: ``held_from`` is
    not null and at most ``at``, and ``held_to`` is null or later than it;
    parents whose ``always`` is true count at any time. A null ``at`` meets
    only those. Rows with a null key are no references and never come out.
    Repeated references come out as often as they stand. An empty parent table
    makes every reference an orphan. The columns of ``parents`` other than
    those named are not read, so clashing names don't matter. A parent of any
    number of versions, and a key of any number of references, costs a row a
    reference.
    """
    null = F.lit(None).cast("timestamp_ntz")
    kind = F.coalesce(F.col(always), F.lit(False)) if always else F.lit(at is None)
    held = parents.select(F.col(key).alias("_parent"), (F.col(held_from) if at else null).alias("_from"), (F.col(held_to) if at else null).alias("_to"), kind.alias("_always")).filter(F.col("_parent").isNotNull())
    held = materialise(held, "parents")  # read for its size, the filter and the spans
    bits, blocks = bloom_blocks(held, "_parent")
    marked = probe(refs.filter(F.col(key).isNotNull()), key, bits, blocks)
    absent = marked.filter(~F.col("_may_exist")).drop("_may_exist")
    passed = marked.filter(F.col("_may_exist")).drop("_may_exist")
    judged = passed.join(_spans(held), passed[key] == F.col("_parent"), "left").withColumn("_verdict", _verdict(F.col(at) if at else null)).filter("_verdict <> 'held'").select(*refs.columns, "_verdict")
    if not at:
        return absent.unionByName(judged.drop("_verdict"))
    judged = materialise(judged, "judged")
    known, open_ = judged.filter("_verdict = 'orphan'").drop("_verdict"), judged.filter("_verdict = 'open'").drop("_verdict")
    out = absent.unionByName(known)
    if open_.isEmpty():
        return out
    free = _swept(open_.select(F.col(key).alias("_k"), F.col(at).alias("_t")).distinct(), held)
    return out.unionByName(open_.join(free, (F.col(key) == F.col("_k")) & (F.col(at) == F.col("_t")), "left_semi"))
