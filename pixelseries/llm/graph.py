"""Connected components, and links among the members of buckets without all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseries.session import cut_lineage

#: Rounds in which every bucket compares its members with one of them.
STAR_ROUNDS = 1
#: Members that a task holds at once when components are compared completely.
CHUNK = 512


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``; the root is a component's smallest node.

    Alternating large and small stars: each round hangs every node on a smaller
    neighbour, until all hang on their root. The number of rounds grows with the
    logarithm of the size; a round is groupings and joins on nodes, written out.
    """
    current = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("c"), F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, F.col("a") == F.col("c")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        # Each neighbour hangs on the lowest one, and so does the node itself.
        hung = F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b"))
        small = large.join(low.withColumnRenamed("a", "c"), F.col("a") == F.col("c")).select(hung.alias("a"), F.col("low").alias("b"))
        current = cut_lineage(small.distinct())
        # All is done once every node hangs on one that hangs on none.
        twice = current.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a")
        inner = current.join(current.select(F.col("a").alias("c")), F.col("b") == F.col("c"), "left_semi").select("a")
        if twice.unionByName(inner).isEmpty():
            break
    else:
        raise RuntimeError("components: not settled")
    roots = current.select("b").distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def _crossed(compare: Callable):
    """Links between members of different components of a group, a chunk of the group at a time.

    A chunk's own rows come first and are held; the group's outer rows stream past.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, chunk = None, [], None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["major"], row["chunk"]) != place:
                    place, held, chunk = (row["major"], row["chunk"]), [], None
                if not row["passing"]:
                    held.append(row)
                    continue
                if not held:
                    continue
                if chunk is None:
                    chunk = compare(held)
                    nodes, roots, outer = (np.array([r[c] for r in held]) for c in ("node", "root", "outer"))
                # Two outer rows meet twice, once either way.
                found = chunk.like(row, np.flatnonzero((roots != row["root"]) & ~(outer & (nodes >= row["node"]))))
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[found]), pa.array([row["node"]] * len(found), pa.int64())], names=["a", "b"])

    return run


def _cross_links(state: DataFrame, open_: DataFrame, payload: DataFrame, compare: Callable) -> DataFrame:
    """All links across components that share a bucket.

    A bucket goes to the group of its largest component; members outside that one
    are compared with all members of the group. One of any such pair is outside, so
    none is missed, and members of the largest component do not meet. Rows are as
    many as members, and outer ones once per chunk: no pair is ever a row.
    """
    placed = state.join(open_.select("bucket", "major"), "bucket").select("major", "node", "root").distinct()
    placed = cut_lineage(placed.withColumn("outer", F.col("root") != F.col("major")).join(payload, "node"))
    sizes = placed.groupBy("major").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    sized = placed.join(sizes, "major")
    own = sized.withColumns({"chunk": F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"), "passing": F.lit(False)})
    outer = sized.filter("outer").withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "passing": F.lit(True)})
    rows = own.unionByName(outer).drop("chunks").repartition("major", "chunk").sortWithinPartitions("major", "chunk", "passing")
    return rows.mapInArrow(_crossed(compare), "a long, b long")


def link(buckets: DataFrame, prepare: Callable) -> tuple[DataFrame, DataFrame]:
    """``node, root`` of the nodes that links tie together, and the confirmed links ``a, b``.

    Nodes without a link are absent. ``buckets`` has ``bucket, node``, also repeated:
    members of a bucket may be linked. ``prepare`` gets the nodes that share a bucket
    and returns a table with what a comparison needs of each ``node``, a function that
    keeps the linked ones of pairs ``a, b`` (with these columns for either side, named
    ``_a`` and ``_b``), and a class that compares a list of rows with one more (``like``).
    If that class only sorts out, a fourth function keeps the linked ones of its pairs.

    In each of ``STAR_ROUNDS`` rounds a bucket compares its members with one of them,
    another one each time, and leaves out those already in its component: a bucket of
    n copies costs n comparisons, not n squared. What is still apart then is compared
    completely, component against component.
    """
    shared = buckets.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").select("bucket")
    members = cut_lineage(buckets.join(shared, "bucket").distinct())
    none = members.filter("false")
    labels, edges = none.select("node", F.col("node").alias("root")), none.select(F.col("node").alias("a"), F.col("node").alias("b"))
    if members.isEmpty():
        return labels, edges
    payload, confirm, compare, *check = prepare(cut_lineage(members.select("node").distinct()))
    payload = cut_lineage(payload)
    for turn in range(STAR_ROUNDS + 1):
        state = members.withColumn("root", F.col("node")) if turn == 0 else cut_lineage(members.join(labels, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root")))
        star = F.struct(F.xxhash64("node", F.lit(turn)), F.col("node").alias("centre"), F.col("root").alias("centre_root"))
        parts = state.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("n"), F.min(star).alias("star"))
        whole = parts.groupBy("bucket").agg(F.min("star").alias("star"), F.max(F.struct("n", "root")).alias("major"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("members"))
        # Two members were compared in the first round.
        open_ = cut_lineage(whole.filter("parts > 1" if turn == 0 else "parts > 1 and members > 2").select("bucket", "star.centre", "star.centre_root", F.col("major.root").alias("major")))
        if open_.isEmpty():
            break
        if turn < STAR_ROUNDS:
            pairs = state.join(open_, "bucket").filter("root != centre_root")
            pairs = pairs.select(F.greatest("node", "centre").alias("a"), F.least("node", "centre").alias("b")).distinct()
            for side in "ab":
                pairs = pairs.join(payload.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in payload.columns if c != "node")), side)
            found = confirm(pairs)
        else:
            found = _cross_links(state, open_, payload, compare)
            found = check[0](found) if check else found
        edges = edges.unionByName(cut_lineage(found.select("a", "b")))
        labels = cut_lineage(components(edges))
    return labels, edges
