"""Nearest neighbours against a scan of all vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseries.llm import vptree

SF = "/root/testdata/sf0.01"


def scan(ids, v, every=20, k=20):
    want = {}
    for i, q in zip(ids, v):
        if i % every == 0:
            order = sorted((-float(q @ x), int(j)) for j, x in zip(ids, v) if j != i)[:k]
            want[int(i)] = [(j, s) for s, j in order]
    return want


def answers(df):
    found = {}
    for r in df.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    return found


def test_factor_one_is_exact_and_production_recall(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = df.orderBy("vec_id").collect()
    want = scan(np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float))
    assert answers(vptree.nearest(df, factor=1.0, shard_rows=200)) == {q: [j for j, _ in a] for q, a in want.items()}
    got = answers(vptree.nearest(df))
    hits = sum(len({j for j, _ in want[q]} & set(a)) for q, a in got.items())
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_lengths_differ_and_clusters(spark):
    """Products, not angles: lengths from 0.1 to 50, copies of one vector, ties to the smaller id."""
    rng = np.random.default_rng(0)
    v = rng.normal(size=(1500, 6)) * rng.uniform(0.1, 10, (1500, 1))
    v[:400] = v[0]
    v[400:700] = v[400] + rng.normal(size=(300, 6)) / 100
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    want = scan(np.arange(1500), v, 100, 7)
    got = answers(vptree.nearest(df, every=100, k=7, factor=1.0, shard_rows=400))
    for q, near in want.items():
        # equal products may differ in their last digit between two ways to add them up
        assert np.allclose([v[q] @ v[j] for j in got[q]], [-s for _, s in near], rtol=1e-12)


def test_pruning_leaves_parts_out():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 30
    v = np.concatenate([c + rng.normal(size=(100, 8)) for c in centres])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    tree = vptree.Tree(np.arange(len(v)), v, 1.0)
    seen = []
    plain = tree.vectors

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                seen.append(len(key))
            return np.ndarray.__getitem__(self, key)

    tree.vectors = plain.view(Counted)
    ids, _ = tree.search(np.array([-1]), v[:1], 10, 1.0)
    assert sum(seen) < len(v) / 2
    assert set(ids[0].tolist()) == set(np.argsort(-(v @ v[0]), kind="stable")[:10].tolist())


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (6, [inf, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (40, [0.0, 0.0]), (9, [-2.0, 1.0])]
    df = spark.createDataFrame([(*r, 1, 0.5, 3) for r in rows], "vec_id long, embedding array<double>, rank int, score double, shard int")
    found = vptree.nearest(df)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(tuple(r) for r in found.collect()) == [
        (0, 1, 1, 1.0), (0, 2, 20, 0.0), (0, 3, 9, -2.0), (20, 1, 9, 1.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0),
    ]
    assert vptree.nearest(df.limit(0)).count() == 0 and vptree.nearest(df.filter("vec_id = 0")).count() == 0
    assert vptree.nearest(df.withColumn("embedding", F.col("embedding").cast("array<float>"))).count() == 6


@pytest.mark.parametrize("k", [1, 3])
def test_fewer_candidates_than_asked(spark, k):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vptree.nearest(df, k=k).collect()] == [(0, 1, 1, 2.0)]
