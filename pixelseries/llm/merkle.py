"""A Merkle manifest of a table: one tree per group, one over the groups, and a proof for every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelseries.session import cut_lineage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Leaves that one window partition holds at most: a power of the arity, so that no run crosses its edge.
SPAN = 4096
PATH = "array<struct<left: string, right: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts' joined text."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 length, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    return digest(*map(field, values))


def _group_key(value: Column) -> Column:
    """Never null, and in the order of the value with null first."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


def _numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``pos``, from 0 by ``order`` in each ``grp``, and ``count``, the size of the group; and the largest group's size.

    Ranges of (group, order) are ranked apart and start where those before them
    end, so a group of any size is spread; rows alike in all are told apart by
    their place in the input.
    """
    keys = [*order, "tie"]
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("grp", *keys)
    ranged = cut_lineage(ranged.withColumn("part", F.spark_partition_id()))
    parts = W.partitionBy("grp").orderBy("part")
    starts = ranged.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("size")).select(
        "grp", "part",
        F.coalesce(F.sum("size").over(parts.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.sum("size").over(W.partitionBy("grp")).alias("count"),
    )
    most = ranged.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    ranked = ranged.withColumn("rank", F.row_number().over(W.partitionBy("grp", "part").orderBy(*keys)))
    return ranked.join(starts, ["grp", "part"]).withColumn("pos", F.col("start") + F.col("rank") - 1).drop("part", "tie", "rank", "start"), most


def _climbed(nodes: DataFrame, arity: int, span: int) -> DataFrame:
    """``nodes`` (``grp, pos, count, node``) with ``block``, ``path`` and, in a block's first row, the node ``top`` above it.

    A level's node stands in the row of its first leaf. Lag and lead at the level's
    fixed offsets give the others of its run, masked by the slot; beyond the end of
    the run they are null. The first child hashes the run for the level above. All
    levels share one shuffle and one sort by block. ``path`` has the siblings left
    and right of a row's ancestors, level by level.
    """
    rows = nodes.withColumns({"block": F.floor(F.col("pos") / span).cast("long"), "top": F.col("node")})
    by_block = W.partitionBy("grp", "block").orderBy("pos")
    sides, size, before = [], 1, rows.columns
    while size < span:
        slot = F.floor(F.col("pos") / size) % arity
        stands = (F.col("pos") % size == 0) & (F.col("count") > size)  # one node left is the root
        left = [F.when(slot >= d, F.lag("top", d * size).over(by_block)) for d in range(arity - 1, 0, -1)]
        right = [F.when(slot + d < arity, F.lead("top", d * size).over(by_block)) for d in range(1, arity)]
        joined = lambda parts: F.concat(*(F.coalesce(p, F.lit("")) for p in parts))
        side = f"side{len(sides)}"
        rows = rows.withColumns({side: F.when(stands, F.struct(joined(left).alias("left"), joined(right).alias("right")))})
        parent = F.when(slot == 0, digest(F.col("top"), F.col(f"{side}.right")))
        rows = rows.withColumn("top", F.when(stands, parent).otherwise(F.when(F.col("count") <= size, F.col("top"))))
        sides.append(side)
        size *= arity
    running = by_block.rowsBetween(W.unboundedPreceding, W.currentRow)
    steps = F.array(*(F.last(s, ignorenulls=True).over(running) for s in sides))
    return rows.select(*before, F.filter(steps, lambda s: s.isNotNull()).cast(PATH).alias("path"))


def _trees(nodes: DataFrame, most: int, arity: int) -> tuple[DataFrame, DataFrame]:
    """The climbed ``nodes`` and their blocks as ``grp, block, tail, tree``: the path from there up, and the group's root.

    ``most`` is the largest ``count``.
    """
    if arity < 2:
        raise ValueError("arity must be at least 2")
    span = arity
    while span < most and span * arity <= SPAN:
        span *= arity
    floors = [_climbed(nodes, arity, span)]
    while True:
        above = floors[-1].filter(F.col("pos") % span == 0).select("grp", F.col("block").alias("pos"), F.ceil(F.col("count") / span).cast("long").alias("count"), F.col("top").alias("node"))
        above, most = cut_lineage(above), -(-most // span)
        if most <= 1:
            break
        floors.append(_climbed(above, arity, span))
    tops = above.select("grp", F.col("pos").alias("block"), F.array().cast(PATH).alias("tail"), F.col("node").alias("tree"))
    for climbed in reversed(floors[1:]):
        tops = climbed.join(tops, ["grp", "block"]).select("grp", F.col("pos").alias("block"), F.concat("path", "tail").alias("tail"), "tree")
    return floors[0], tops


def manifest(docs: DataFrame, group: str = "lang", order: str = "doc_id", leaf_of: dict[str, Column] | None = None, arity: int = 2) -> DataFrame:
    """``docs``' columns ``order`` and ``group`` with ``leaf``, ``subroot``, ``root`` and ``path`` for every row.

    A group's leaves ascend by ``order`` (null first, ties by leaf; repeated rows
    take a place each). Every ``arity`` consecutive nodes become their digest, the
    last ones of a level also if fewer, until one is left: the group's subroot. The
    subroots, in the order of their groups (null first, then by UTF-8 bytes), give
    the root likewise. ``path`` holds the digests left and right of the row's
    ancestors, from the leaf to the root; see ``folded`` and ``proof``.

    ``leaf_of`` names more columns of digests to carry along; ``leaf`` itself, if not
    given, covers ``FIELDS``. Null texts and other nulls are fields of their own kind.
    An empty table gives no rows. Other columns, whatever their names, are ignored.

    Texts are hashed once and not shuffled. Ranks, trees and paths move digests:
    one shuffle to number the leaves, one per ``SPAN`` to climb.
    """
    leaf_of = {"leaf": leaf(*map(F.col, FIELDS))} | (leaf_of or {})
    rows = docs.select(F.col(order).alias("key"), F.col(group).alias("value"), _group_key(F.col(group)).alias("grp"), *(c.alias(f"hash_{n}") for n, c in leaf_of.items()))
    leaves, most = _numbered(cut_lineage(rows), ["key", "hash_leaf"])
    climbed, tops = _trees(leaves.withColumn("node", F.col("hash_leaf")), most, arity)
    groups = tops.filter("block = 0").select("grp", F.col("tree").alias("node"))
    climbed_groups, roots = _trees(*_numbered(groups.select(F.col("grp").alias("name"), "node").withColumn("grp", F.lit("")), ["name"]), arity)
    ends = climbed_groups.join(roots.withColumnRenamed("tree", "root"), ["grp", "block"])
    ends = cut_lineage(ends.select(F.col("name").alias("grp"), F.concat("path", "tail").alias("end"), "root"))
    # Blocks learn the way from their group's root on, so leaves meet blocks only.
    tops = tops.join(ends, "grp").select("grp", "block", F.concat("tail", "end").alias("tail"), F.col("tree").alias("subroot"), "root")
    return climbed.join(tops, ["grp", "block"]).select(
        F.col("key").alias(order), F.col("value").alias(group), *(F.col(f"hash_{n}").alias(n) for n in leaf_of), "subroot", "root", F.concat("path", "tail").alias("path")
    )


def folded(leaf_: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf_, lambda node, step: digest(step["left"], node, step["right"]))


def proof(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""), 256)


def tampered_check(docs: DataFrame, one_in: int = 7) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: each row's proof tried on what is claimed of it.

    Where ``one_in`` divides the CRC-32 of the id in decimals, the claimed row has
    one more character in ``n_chars`` (null stays null, a null id is never chosen);
    all others are claimed as they are.
    """
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % one_in == 0
    claimed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in FIELDS]
    rows = manifest(docs, leaf_of={"claimed": F.when(chosen, leaf(*claimed))})
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.coalesce("claimed", "leaf"), F.col("path")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
