"""Nearest neighbours by inner product: a vantage-point tree per shard, with relaxed pruning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pixelseries.session import cut_lineage

#: Vectors per tree and per leaf, and queries searched at once.
SHARD_ROWS, LEAF, BLOCK = 8192, 128, 1024
#: Production setting of the pruning factor; recall is measured in the tests.
FACTOR = 0.25
TINY = 1e-9


class Tree:
    """A vantage-point tree over ``vectors``.

    Inner products become distances by one more coordinate, which gives every vector
    the length ``reach``, the largest length of all shards: the nearest then has the
    largest product. A node splits its vectors at the median distance to its vantage
    point and keeps the range of distances on either side.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, reach: float):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.square = ids[order], vectors[order], reach * reach
        self.lift = np.sqrt(np.maximum(self.square - (self.vectors**2).sum(axis=1), 0))
        self.root = self._node(np.arange(len(ids)))

    def _distances(self, point: int, rows: np.ndarray) -> np.ndarray:
        products = self.vectors[rows] @ self.vectors[point] + self.lift[rows] * self.lift[point]
        return np.sqrt(np.maximum(2 * (self.square - products), 0))

    def _node(self, rows: np.ndarray):
        if len(rows) <= LEAF:
            return np.sort(rows)
        # The vantage point is the farthest from the first row: a point at the rim splits best.
        point = rows[int(self._distances(rows[0], rows).argmax())]
        away = self._distances(point, rows)
        order = np.argsort(away, kind="stable")
        half = len(rows) // 2
        parts = (order[:half], order[half:])
        return point, [(self._node(rows[p]), float(away[p].min()), float(away[p].max())) for p in parts]

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and products of the ``k`` best per query, best first; -1 fills up rows that have fewer.

        A side is left out if its least possible distance passes ``factor`` times the
        distance of the k-th best so far. With factor one no better vector is missed.
        """
        lengths = (queries**2).sum(axis=1)
        best_ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        best = np.full((len(queries), k), -np.inf)

        def bound(q: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(lengths[q] + self.square - 2 * best[q, -1], 0))

        def leaf(rows: np.ndarray, q: np.ndarray) -> None:
            # Not a matrix product: that adds up in an order that depends on the place, and copies would differ.
            products = np.einsum("qd,nd->qn", queries[q], self.vectors[rows])
            products[ids[q][:, None] == self.ids[rows]] = -np.inf
            better = (products >= best[q, -1:]).any(axis=1)
            q, products = q[better], products[better]
            scores = np.concatenate([best[q], products], axis=1)
            names = np.concatenate([best_ids[q], np.broadcast_to(self.ids[rows], products.shape)], axis=1)
            names = np.where(np.isneginf(scores), np.iinfo(np.int64).max, names)
            order = np.lexsort((names, -scores), axis=-1)[:, :k]
            best[q], best_ids[q] = np.take_along_axis(scores, order, 1), np.take_along_axis(names, order, 1)

        def visit(node, q: np.ndarray) -> None:
            if isinstance(node, np.ndarray):
                leaf(node, q)
                return
            point, sides = node
            products = queries[q] @ self.vectors[point]
            away = np.sqrt(np.maximum(lengths[q] + self.square - 2 * products, 0))
            inner = away <= sides[0][2]
            for first, group in ((0, q[inner]), (1, q[~inner])):
                distance = away[inner] if first == 0 else away[~inner]
                for side in (first, 1 - first):
                    child, low, high = sides[side]
                    least = np.maximum(np.maximum(distance - high, low - distance), 0)
                    open_ = least <= factor * bound(group) + TINY
                    if open_.any():
                        visit(child, group[open_])

        visit(self.root, np.arange(len(queries)))
        return np.where(np.isneginf(best), -1, best_ids), best


def _searched(k: int, factor: float, reach: float):
    """Per shard: its vectors come first and make the tree, then its queries are answered block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, held = None, None, []

        def answers(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, part.num_rows, BLOCK):
                block = part.slice(at, BLOCK)
                ids, found = _matrix(block)
                names, scores = tree.search(ids, found, k, factor)
                full = names >= 0
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, full.sum(axis=1))), pa.array(names[full]), pa.array(scores[full])], names=["query_id", "vec_id", "score"])

        for batch in batches:
            shards, kinds = batch.column("shard").to_numpy(), batch.column("query").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(kinds.astype(np.int8)) != 0)) + 1
            for start, stop in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if stop == start:
                    continue
                part = batch.slice(start, stop - start)
                if shards[start] != shard:
                    shard, tree, held = shards[start], None, []
                if not kinds[start]:
                    held.append(_matrix(part))
                    continue
                if tree is None and held:
                    tree = Tree(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), reach)
                    held = []
                if tree is not None:
                    yield from answers(part)

    return run


def _matrix(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    flat = part.column("vector").flatten().to_numpy().astype(np.float64)
    return part.column("vec_id").to_numpy(), flat.reshape(part.num_rows, -1)


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector, square`` of the vectors that take part: not null, not zero, all components finite.

    Vectors of another length than most have no product with them and take no part.
    Rows alike in id and vector count once.
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector")).filter(F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)))
    rows = rows.withColumn("square", F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)).filter("square > 0").distinct()
    rows = cut_lineage(rows)
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.filter(F.size("vector") == (sizes["size"] if sizes else 0))


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, factor: float = FACTOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query, best first, ties to smaller ids.

    Queries are the vectors whose id is a multiple of ``every``, candidates all
    vectors with another id. Vectors are dealt to shards by a hash; a task holds one
    shard's tree and streams the queries past it. With ``factor`` one the result is
    exact. Fewer candidates give fewer ranks; without a usable vector the result is
    empty. Other columns are ignored.
    """
    rows = usable(vectors)
    n, square = rows.agg(F.count(F.lit(1)), F.max("square")).first()
    shards = max(1, -(-n // shard_rows))
    dealt = rows.select("vec_id", "vector", F.lit(False).alias("query"), F.pmod(F.xxhash64("vec_id", "vector"), F.lit(shards)).cast("int").alias("shard"))
    asked = rows.filter(F.col("vec_id") % every == 0).select("vec_id", "vector", F.lit(True).alias("query"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    placed = dealt.unionByName(asked).repartition(shards, "shard").sortWithinPartitions("shard", "query")
    found = placed.mapInArrow(_searched(k, factor, float(square or 0) ** 0.5), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
