"""Exact per-group and global picks that hold up when one group has most of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salts: int = SALTS) -> DataFrame:
    """First ``k`` rows of each group by ``order``.

    The rank is taken twice: within salted parts of a group, then over the at
    most ``k * salts`` survivors, so no task sorts a whole hot group.
    """
    if k < 1:
        raise ValueError("k must be positive")
    names = [f"__o{i}" for i in range(len(order))]
    part = df.withColumns(dict(zip(names, order))).withColumn("__salt", F.pmod(F.xxhash64(*names), F.lit(salts)))
    by = [F.col(n) for n in names]
    part = part.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*by))).filter(F.col("__rn") <= k)
    whole = part.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).filter(F.col("__rn") <= k)
    return whole.drop("__rn", "__salt", *names)


def one_per_key(df: DataFrame, key: Sequence[str], taken: DataFrame | None = None, by: Sequence[str] | None = None) -> DataFrame:
    """One row per key, that with the smallest other values: the same whatever the order of the rows.

    Keys that occur in ``taken`` are left out; a key with a NULL occurs nowhere. One
    grouping does both. A single other column is kept as a plain minimum, so that
    numbers need no sort; a NULL is the smallest value. Rows meet in tasks by the key or
    those of its columns that ``by`` names: of many values, with few keys each.
    """
    rest = [c for c in df.columns if c not in key]
    if taken is not None:
        known = taken.select(*key).filter(reduce(and_, (F.col(k).isNotNull() for k in key)))
        df = df.withColumn("__taken", F.lit(False)).unionByName(known.withColumn("__taken", F.lit(True)), allowMissingColumns=True)
    found = [] if taken is None else [F.max("__taken").alias("__taken")]
    if len(rest) == 1:
        found += [F.max(F.col(rest[0]).isNull()).alias("__null"), F.min(rest[0]).alias("__rest")]
        values = {rest[0]: F.when(~F.col("__null"), F.col("__rest"))}
    else:
        found += [F.min(F.struct(*rest)).alias("__rest")] if rest else []
        values = {c: F.col(f"__rest.{c}") for c in rest}
    # Keys seldom repeat within a task, so a grouping before the shuffle would be lost work.
    rows = df.repartition(*(by or key)).groupBy(*key).agg(*found) if found else df.distinct()
    if taken is not None:
        rows = rows.filter(~F.col("__taken"))
    return rows.select(*[values[c].alias(c) if c in values else c for c in df.columns if c != "__taken"])


def first_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows overall; for report-sized ``n`` (a per-task heap, then one merge)."""
    return df.orderBy(*order).limit(n)


def mark_fraction(df: DataFrame, hash_hex: Column, tie: Sequence[str], fraction: float, flag: str) -> DataFrame:
    """Flag exactly ``int(fraction * count)`` rows, those with the smallest ``(hash, tie)``.

    Rows are counted per leading 16 bits of the hash, which shows the bucket
    the cut goes through.  Only that bucket is ranked; the last flagged key
    then splits all rows in a narrow pass, without a shuffle or a big limit.
    """
    keyed = df.withColumn("__key", F.struct(hash_hex.alias("h"), *tie)).withColumn("__bucket", F.substring("__key.h", 1, 4))
    counts = keyed.groupBy("__bucket").agg(F.count("*").alias("__n"))
    total = counts.agg(F.floor(F.lit(fraction) * F.sum("__n"))).scalar()
    running = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, 0)  # at most 65,536 rows
    cut = (
        counts.withColumn("__upto", F.sum("__n").over(running))
        .withColumn("__need", total - (F.col("__upto") - F.col("__n")))
        .filter((F.col("__need") > 0) & (F.col("__need") <= F.col("__n")))
        .select("__bucket", "__need")
    )
    rank = F.row_number().over(Window.partitionBy("__bucket").orderBy("__key"))
    last = (
        keyed.join(F.broadcast(cut), "__bucket")  # one row
        .withColumn("__rank", rank)
        .filter(F.col("__rank") == F.col("__need"))
        .select("__key")
        .scalar()
    )
    return keyed.withColumn(flag, F.coalesce(F.col("__key") <= last, F.lit(False))).drop("__key", "__bucket")
