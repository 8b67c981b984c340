"""Mixing sources to target weights: entropy balancing, then rounding into whole copies."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelseries.session import cut_lineage

from .common import spare, unit_hash, word_count

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
BINS = 1 << 16
POLISH = 3
EXACT = "decimal(38,9)"


def source_targets(sizes: DataFrame) -> DataFrame:
    """Add ``target`` to one row per source with its ``source_size``.

    Sources in code-point order, null last, weigh ``WEIGHTS`` over and over and
    share all words; a source takes at most ``MAX_COPIES`` times its size and the
    excess is shared again. Sorted by size per weight the full ones come first,
    so running sums find the common level of the others: the highest that fits.
    """
    position = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weighed = sizes.withColumn("weight", F.get(F.array(*map(F.lit, WEIGHTS)), (position - 1) % len(WEIGHTS)))
    limit = F.lit(MAX_COPIES) * F.col("source_size")
    order = W.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    fill = weighed.withColumn("limit", limit).select(
        "source",
        "source_size",
        "limit",
        "weight",
        F.sum("source_size").over(W.partitionBy()).alias("all"),
        F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("full"),
        F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)).alias("open"),
    )
    fill = fill.withColumn("level", (F.col("all") - F.col("full")) / F.col("open"))
    common = F.max(F.when(F.col("limit") > F.col("level") * F.col("weight"), F.col("level"))).over(W.partitionBy())
    target = F.least(F.col("limit").cast("double"), F.coalesce(common * F.col("weight"), F.col("limit").cast("double")))
    return fill.select("source", "source_size", target.cast("double").alias("target"))


def _rate(size: Column, mean: Column, tilt: Column) -> Column:
    return F.least(F.lit(float(MAX_COPIES)), F.exp(F.least(tilt * size / mean, F.lit(2.0))))


def solve_tilts(sizes: DataFrame, targets: DataFrame, rounds: int = 40, tolerance: float = 1e-9) -> DataFrame:
    """``source, source_size, target, mean, tilt`` with sum(count * size * rate) = target.

    A document of ``size`` words gets the rate exp(tilt * size / mean), at most
    ``MAX_COPIES``: the closest rates to one, in relative entropy, that meet the
    token constraint. The dual is convex with one multiplier per source; Newton
    steps run for all sources at once and fall back to halving where they would
    leave the bracket. ``sizes`` has one row per source and size, so a round reads
    no documents. Sums are decimals, so that reruns agree.
    """
    total = F.sum(F.col("count") * F.col("size"))
    means = sizes.groupBy("source").agg((total / F.greatest(F.sum(F.when(F.col("size") > 0, F.col("count"))), F.lit(1))).alias("mean"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    # At the upper end every document with a word is at its limit; at the lower one the shortest has a rate of exp(-60).
    reach = F.col("mean") / F.col("least")
    state = (
        targets.withColumnRenamed("source", "__source")
        .join(means, F.col("__source").eqNullSafe(F.col("source")))
        .filter("target > 0")
        .select("source", "source_size", "target", "mean", (math.log(MAX_COPIES) * 1.000001 * reach).alias("high"), (-60.0 * reach).alias("low"))
        .withColumn("tilt", F.greatest("low", F.least("high", F.log(F.col("target") / F.col("source_size")) / 2)))
        .withColumn("done", F.lit(False))
    )
    state = cut_lineage(state.coalesce(1))
    for _ in range(rounds):
        named = state.withColumnRenamed("source", "__source").filter("not done")
        rate = _rate(F.col("size"), F.col("mean"), F.col("tilt"))
        words = F.col("count") * F.col("size") * rate
        slope = F.when(rate < MAX_COPIES, words * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = (
            sizes.filter("size > 0")
            .join(named, F.col("source").eqNullSafe(F.col("__source")))
            .groupBy("source")
            .agg(F.sum(words.cast(EXACT)).cast("double").alias("got"), F.sum(slope.cast(EXACT)).cast("double").alias("slope"))
            .withColumnRenamed("source", "__source")
        )
        gap = F.col("got") - F.col("target")
        low, high = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > low) & (newton < high)
        done = F.col("done") | (F.abs(gap) <= tolerance * F.col("target")) | (F.col("high") - F.col("low") < 1e-12)
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("__source")), "left")
        state = cut_lineage(
            moved.select(
                "source",
                "source_size",
                "target",
                "mean",
                F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
                F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
                F.when(done, F.col("tilt")).when(inside, newton).otherwise((low + high) / 2).alias("tilt"),
                F.coalesce(done, F.lit(False)).alias("done"),
            ).coalesce(1)
        )
        if state.filter("not done").isEmpty():
            break
    return state.select("source", "source_size", "target", "mean", "tilt")


def _units(docs: DataFrame) -> DataFrame:
    """Per row: ``source``, ``size`` and a repeatable ``key``; rows alike in id, source and text share it."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "source", text).alias("key"), unit_hash("doc_id", F.lit(7), "source", text).alias("draw")
    )


class Mix:
    """The decisions for one corpus: ``params`` per source and the few ``special`` keys."""

    def __init__(self, params: DataFrame, special: DataFrame):
        self.params, self.special = params, special

    def copies(self, rows: DataFrame, source: str, size: str, key: str, draw: str, out: str) -> DataFrame:
        """Add the column ``out``: how often the mix takes each row."""
        named = self.params.select(*(F.col(c).alias(f"__mix_{c}") for c in self.params.columns))
        special = self.special.select(F.col("key").alias("__mix_key"), F.col("copies").alias("__mix_special"))
        rate = _rate(F.col(size), F.col("__mix_mean"), F.col("__mix_tilt"))
        up = _bin(rate, F.col(draw)) < F.col("__mix_edge")
        found = rows.join(named, F.col(source).eqNullSafe(F.col("__mix_source")), "left").join(special, F.col(key) == F.col("__mix_key"), "left")
        plain = F.floor(rate) + F.when(up & (rate > F.floor(rate)), 1).otherwise(0)
        copies = F.coalesce(F.col("__mix_special"), F.when(F.col(size) > 0, plain), F.lit(0)).cast("long")
        return found.withColumn(out, copies).select(*rows.columns, out)


def _bin(rate: Column, draw: Column) -> Column:
    """Rows with a large fraction and a small draw come first to be rounded up."""
    return F.floor((1.0 - (rate - F.floor(rate)) + draw) * (BINS / 2))


def _edge(start: DataFrame, rows: DataFrame, bins: int) -> DataFrame:
    """Per source the first bin that takes more than is ``missing`` (``bins`` if none), and the words ``taken`` before it."""
    up = rows.groupBy("source", "bin").agg(F.sum(F.when(F.col("open"), F.col("words")).otherwise(0)).alias("up"))
    so_far = F.sum("up").over(W.partitionBy("source").orderBy("bin"))
    up = up.select(F.col("source").alias("__source"), "bin", "up", so_far.alias("reached"))
    found = start.join(up, F.col("source").eqNullSafe(F.col("__source")), "left")
    reached = F.col("taken") + F.col("reached")
    first = F.min(F.when(reached > F.col("missing"), F.struct("bin", (reached - F.col("up")).alias("before"))))
    return found.groupBy("source", "missing").agg(
        F.coalesce(first["bin"], F.lit(bins)).alias("edge"), F.coalesce(first["before"], F.max(reached), F.max("taken")).alias("taken")
    )


def balance(docs: DataFrame) -> Mix:
    """Solve the tilts of ``docs`` and the rounding of its rates.

    Every row gets the whole part of its rate. Fractions are rounded up in order
    of fraction minus draw until the source's target is near: whole bins of that
    order first, then rows of the bin at the edge. What is left to the target is
    made up ``POLISH`` times by the one row whose size is closest to it.
    """
    units = cut_lineage(_units(docs).filter("size > 0").groupBy("key", "source", "size", "draw").agg(F.count(F.lit(1)).alias("rows")))
    sizes = cut_lineage(units.groupBy("source", "size").agg(F.sum("rows").alias("count")))
    # Sources without a word count too in the order of the weights.
    every = docs.select("source").distinct().withColumn("words", F.lit(0).cast("long"))
    totals = sizes.select("source", (F.col("count") * F.col("size")).alias("words")).unionByName(every)
    targets = cut_lineage(source_targets(totals.groupBy("source").agg(F.sum("words").alias("source_size"))))
    tilts = solve_tilts(sizes, targets)

    named = tilts.withColumnRenamed("source", "__source")
    rate = _rate(F.col("size"), F.col("mean"), F.col("tilt"))
    drawn = units.join(named, F.col("source").eqNullSafe(F.col("__source"))).select(
        "key", "source", "target", F.floor(rate).alias("whole"), (rate > F.floor(rate)).alias("open"), _bin(rate, F.col("draw")).alias("bin"), (F.col("size") * F.col("rows")).alias("words")
    )
    start = drawn.groupBy("source").agg((F.max("target") - F.sum(F.col("words") * F.col("whole"))).alias("missing"), F.lit(0).cast("long").alias("taken"))
    coarse = _edge(start, drawn.withColumn("bin", F.shiftright("bin", 8)), BINS >> 8)
    at = coarse.select(F.col("source").alias("__source"), F.col("edge").alias("__edge"))
    inside = drawn.join(at, F.col("source").eqNullSafe(F.col("__source")) & (F.shiftright("bin", 8) == F.col("__edge")))
    edges = cut_lineage(_edge(coarse.drop("edge"), inside, BINS))

    e = edges.withColumnRenamed("source", "__source")
    judged = drawn.drop("target").join(e, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    order = W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, 0)
    at_edge = judged.filter("open and bin = edge").withColumn("fits", F.col("taken") + F.sum("words").over(order) <= F.col("missing"))
    special = cut_lineage(at_edge.select("source", "key", (F.col("whole") + F.col("fits").cast("int")).alias("copies"), F.when(F.col("fits"), F.col("words")).otherwise(0).alias("change")))
    for _ in range(POLISH):
        changed = special.groupBy("source").agg(F.sum("change").alias("change")).withColumnRenamed("source", "__source")
        left = edges.join(changed, F.col("source").eqNullSafe(F.col("__source")), "left").select(
            F.col("source").alias("__source"), (F.col("missing") - F.col("taken") - F.coalesce("change", F.lit(0))).alias("left")
        )
        plain = F.col("whole") + (F.col("open") & (F.col("bin") < F.col("edge"))).cast("int")
        sign = F.signum("left").cast("int")
        off = F.abs(F.col("words") - F.abs("left"))
        free = judged.withColumn("copies", plain).join(special.select("key"), "key", "left_anti").join(left, F.col("source").eqNullSafe(F.col("__source")))
        free = free.filter(off < F.abs("left")).filter((F.col("copies") + sign).between(0, MAX_COPIES))
        one = free.groupBy("source").agg(F.min(F.struct(off.alias("off"), "key", (F.col("copies") + sign).alias("copies"), (F.col("words") * sign).alias("change"))).alias("one"))
        special = cut_lineage(special.unionByName(one.select("source", "one.key", "one.copies", "one.change")))
    params = edges.select(F.col("source").alias("__source"), "edge").join(tilts, F.col("__source").eqNullSafe(F.col("source"))).select("source", "mean", "tilt", "edge")
    mix = Mix(cut_lineage(params), special)
    mix.targets = targets
    return mix


def mixed_words(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every row of ``docs``.

    A null or blank text has no words and is never taken; a null source is a source
    of its own, the last one. Rows alike in id, source and text are decided together.
    An empty table gives none. Other columns are ignored.
    """
    mix = balance(docs)
    rows = mix.copies(_units(docs), "source", "size", "key", "draw", "copies")
    targets = mix.targets.withColumnRenamed("source", "__source")
    found = rows.join(targets, F.col("source").eqNullSafe(F.col("__source")))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, whatever its columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mine = [spare(docs, c) for c in ("__mixed_size", "__mixed_row", "__mixed_draw", "__mixed_copies")]
    size, key, draw, copies = mine
    rows = docs.withColumns({size: word_count(F.col("text")), key: F.xxhash64("doc_id", "source", text), draw: unit_hash("doc_id", F.lit(7), "source", text)})
    found = balance(docs).copies(rows, "source", size, key, draw, copies).filter(F.col(copies) > 0)
    return found.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*docs.columns)
