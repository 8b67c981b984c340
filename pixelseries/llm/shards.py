"""Sharding by jump consistent hashing, with gapless slots inside each shard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import let, utf8_bytes

#: Fixed value: the multiplier of the published generator.
MULTIPLIER = 2862933555777941757
#: A 64-bit state is kept as 22, 22 and 20 bits: products of such limbs fit a long, so nothing overflows.
BITS, LOW, TOP = 22, (1 << 22) - 1, (1 << 20) - 1
FEW_JUMPS = 64
LIMBS = (MULTIPLIER & LOW, MULTIPLIER >> BITS & LOW, MULTIPLIER >> 2 * BITS)


def _advance(key: Column) -> Column:
    """``key * MULTIPLIER + 1`` modulo 2^64, on limbs."""
    a, b, c = (key[x] for x in "abc")
    m0, m1, m2 = (F.lit(m).cast("long") for m in LIMBS)
    low = a * m0 + 1
    mid = a * m1 + b * m0 + F.shiftright(low, BITS)
    top = a * m2 + b * m1 + c * m0 + F.shiftright(mid, BITS)
    return F.struct(low.bitwiseAND(LOW).alias("a"), mid.bitwiseAND(LOW).alias("b"), top.bitwiseAND(TOP).alias("c"))


def _limbs(key: Column) -> Column:
    part = lambda at, mask: F.shiftrightunsigned(key, at).bitwiseAND(F.lit(mask).cast("long"))
    return F.struct(part(0, LOW).alias("a"), part(BITS, LOW).alias("b"), part(2 * BITS, TOP).alias("c"))


def _high(key: Column) -> Column:
    """The state's upper 31 bits."""
    return F.shiftleft(key["c"], 11) + F.shiftright(key["b"], 11)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard in ``0..shards - 1`` of a long key.

    Each jump goes up, so ``shards`` jumps always do. About ln(shards) are made;
    the few keys that need more than ``FEW_JUMPS`` go on in a second pass.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    state = lambda key, shard, following: F.struct(key.alias("key"), shard.alias("shard"), following.alias("following"))
    zero = F.lit(0).cast("long")

    def jump(s: Column, _: Column) -> Column:
        def from_next(key: Column) -> Column:
            reach = (s["following"] + 1) * (F.lit(float(1 << 31)) / (_high(key) + 1))
            return state(key, s["following"], F.least(F.floor(reach), F.lit(shards)).cast("long"))

        return F.when(s["following"] >= shards, s).otherwise(let(_advance(s["key"]), from_next))

    first = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, FEW_JUMPS))), state(_limbs(key), zero - 1, zero), jump)
    rest = lambda s: F.when(s["following"] >= shards, s).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(shards)), s, jump))
    return (let(first, rest) if shards > FEW_JUMPS else first)["shard"].cast("int")


def assign_shards(docs: DataFrame, shards: int, buckets: int = 1024) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    ``doc_id`` and the shard count alone decide the shard; ``grown_shard`` is the
    one with a shard more. Slots count from 0 in each shard. A shard is numbered
    in ``buckets`` parts: a part's first slot is the sum of the parts before it,
    so no task ranks a whole shard, and a part holds 1/buckets of one.

    A null id takes the key -1. A null text has no bytes and a null checksum.
    Repeated rows keep a slot each. Other columns are ignored; an empty table
    gives none.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))
    crc = F.crc32(F.col("text").cast("binary"))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (utf8_bytes(F.col("text")) + 8).alias("size"),
        crc.alias("text_crc32"),
        F.lit("key").alias("law"),
        jump_shard(key, shards).alias("shard"),
        jump_shard(key, shards + 1).alias("grown_shard"),
        F.pmod(_high(_advance(_limbs(key))) + F.coalesce(crc, F.lit(0)), F.lit(buckets)).cast("int").alias("part"),
    )
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    within = W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(within))
    return ranked.join(parts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), "grown_shard"
    )
