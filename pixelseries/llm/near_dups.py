"""Near-duplicate documents: banded MinHash candidates, sequential Bayesian pruning, exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseries.session import cut_lineage

from .batches import byte_words, slices
from .common import spare
from .graph import link

#: 24 bands of 5: a pair of similarity 0.8 shares no band with a chance of 7 in 100,000.
BANDS, WIDTH = 24, 5
HASHES = BANDS * WIDTH
#: Signature hashes compared at a time, and the chance to lose a similar pair that ends a comparison.
STEP, MISS = 24, 1e-4
REMEMBERED = 400_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread permutation of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _random_words(seed: int, n: int) -> np.ndarray:
    return _mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


FACTORS, SHIFTS = _random_words(1, HASHES) | np.uint64(1), _random_words(2, HASHES)
_KNOWN: dict[bytes, int] = {}


def _word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_KNOWN) > REMEMBERED:
        _KNOWN.clear()
    for w in words:
        if w not in _KNOWN:
            _KNOWN[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles of ``size`` words; of all its words if they are fewer."""
    hashes = _word_hashes(byte_words(text))
    if len(hashes) == 0:
        return hashes
    size = min(size, len(hashes))
    found = np.full(len(hashes) - size + 1, size, np.uint64)
    for i in range(size):
        found = _mixed(found * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(hashes) - size + 1 + i])
    return np.unique(found)


def signature(found: np.ndarray) -> np.ndarray:
    """``HASHES`` 16-bit minima over a set, in blocks so that a long text needs no more memory."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 2048):
        low = np.minimum(low, ((found[at : at + 2048, None] ^ SHIFTS) * FACTORS).min(axis=0))
    return (_mixed(low) >> np.uint64(48)).astype(np.uint16)


def least_matches(similarity: float) -> list[tuple[int, int]]:
    """``(hashes compared, matches needed)`` per step.

    With a flat prior the similarity after m matches among n is a Beta variable;
    the chance that it reaches ``similarity`` is a binomial sum. Fewer matches than
    needed put it below ``MISS``.
    """
    found = []
    for n in range(STEP, HASHES + 1, STEP):
        m, chance = 0, (1 - similarity) ** (n + 1)
        while chance < MISS:
            m += 1
            chance += comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        found.append((n, m))
    return found


def _passing(left: np.ndarray, right: np.ndarray, steps: list[tuple[int, int]]) -> np.ndarray:
    """Rows whose signatures agree often enough, a batch of hashes at a time."""
    alive, matches = np.arange(len(right)), np.zeros(len(right), np.int64)
    for n, needed in steps:
        part = slice(n - STEP, n)
        own = left[part] if left.ndim == 1 else left[alive, part]
        matches[alive] += (own == right[alive, part]).sum(axis=1)
        alive = alive[matches[alive] >= needed]
    return alive


class Documents:
    """Documents of one group, to be compared with others one at a time.

    Signatures come first; then exact sizes of intersections, from a list of the
    documents that have each shingle.
    """

    def __init__(self, rows: list[dict], size: int, percent: int):
        self.size, self.percent, self.steps = size, percent, least_matches(percent / 100)
        self.sigs = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint16).reshape(-1, HASHES)
        sets = [shingles(r["text"], size) for r in rows]
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.keys, self.owners = every[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def like(self, row: dict, among: np.ndarray) -> np.ndarray:
        """Which of the documents numbered ``among`` are similar to ``row``."""
        near = among[_passing(np.frombuffer(row["sig"], np.uint16), self.sigs[among], self.steps)]
        if len(near) == 0:
            return near
        own = shingles(row["text"], self.size)
        first, last = np.searchsorted(self.keys, own), np.searchsorted(self.keys, own, side="right")
        n = last - first
        at = np.repeat(last - np.cumsum(n), n) + np.arange(int(n.sum()))
        both = np.bincount(self.owners[at], minlength=len(self.sizes))[near]
        return near[100 * both >= self.percent * (len(own) + self.sizes[near] - both)]


def _described(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, key, node, n, sig`` per row: a node is a distinct shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            nodes, counts, sigs = [], [], []
            for text in batch.column("text").to_pylist():
                found = shingles(text, size)
                counts.append(len(found))
                nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()) - (1 << 63) if len(found) else None)
                sigs.append(signature(found).tobytes() if len(found) else None)
            columns = [batch.column("doc_id"), batch.column("key"), pa.array(nodes, pa.int64()), pa.array(counts, pa.int64()), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "key", "node", "n", "sig"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), "text")
    return rows.mapInArrow(run, "doc_id long, key long, node long, n long, sig binary")


def _key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, BANDS, WIDTH).astype(np.uint64)
        found = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), sigs.shape[:2])
        for i in range(WIDTH):
            found = _mixed(found * np.uint64(0x9E3779B97F4A7C15) + sigs[:, :, i])
        nodes = np.repeat(batch.column("node").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), pa.array(nodes)], names=["bucket", "node"])


def _confirmed(pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (with signatures and texts) that no batch of hashes rules out and whose full sets are similar enough."""
    steps = least_matches(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text_a"):
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            likely = batch.take(pa.array(_passing(left, right, steps)))
            keep = []
            for x, y in zip(likely.column("text_a").to_pylist(), likely.column("text_b").to_pylist()):
                a, b = shingles(x, size), shingles(y, size)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            kept = likely.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _classified(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``doc_id, key, n_shingles, component_id, group`` for every row of ``docs``; ``group`` is null without words."""
    rows = cut_lineage(_described(docs, size))
    nodes = cut_lineage(rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("key").alias("key"), F.first("sig").alias("sig")))

    def prepare(shared: DataFrame):
        wanted = nodes.join(shared, "node", "left_semi").select("node", F.col("key").alias("__key"), "sig")
        texts = docs.select(_key().alias("key"), "text").join(wanted, F.col("key") == F.col("__key"))
        payload = texts.groupBy("node").agg(F.first("sig").alias("sig"), F.first("text").alias("text"))
        return payload, lambda pairs: _confirmed(pairs, size, percent), lambda rows: Documents(rows, size, percent)

    labels, _ = link(nodes.select("node", "sig").mapInArrow(_banded, "bucket long, node long").distinct(), prepare)
    rooted = nodes.select("node", "first").join(labels, "node")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("lowest"))
    linked = rooted.join(lowest, "root").select("node", "lowest", "root")
    classes = nodes.select("node", "first").join(linked, "node", "left").select("node", F.coalesce("lowest", "first").alias("component"), F.coalesce("root", "node").alias("group"))
    found = rows.select("doc_id", "key", "node", "n").join(classes, "node", "left")
    return found.select("doc_id", "key", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"), "group")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row.

    Documents are linked if their sets of ``size``-word shingles have an
    intersection of at least ``percent`` of their union; the component is the
    smallest id that links reach. Equal sets are one node, so copies cost nothing
    after the first. A text without words is linked with nothing. Null ids count as
    none in the smallest id, and rows with one are not kept; rows that share an id
    are judged by their own texts. Other columns are ignored.
    """
    found = _classified(docs, size, percent)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates in ``docs``; all columns stay.

    It has the group's smallest id (null only if no row of the group has one); of several texts with
    that id one stays, and of rows alike in id and text the one with the smallest other
    columns. Rows without words are in no group and all stay.
    """
    found = cut_lineage(_classified(docs, size, percent))
    first = found.filter("group is not null and (component_id is null or doc_id = component_id)")
    sizes = first.groupBy("group", "key").agg(F.count(F.lit(1)).alias("n"))
    chosen = sizes.groupBy("group").agg(F.min(F.struct("key", "n")).alias("k")).select("k.key", "k.n")
    wordless = found.filter("group is null").select("key").distinct()
    key, kept_key = spare(docs, "__near_key"), spare(docs, "__near_kept")
    rows = docs.withColumn(key, _key())
    among = lambda keys: rows.join(keys.select(F.col("key").alias(kept_key)), F.col(key) == F.col(kept_key), "left_semi")
    single = among(chosen.filter("n = 1").select("key").unionByName(wordless)).select(*docs.columns)
    repeated = among(chosen.filter("n > 1")).groupBy(key).agg(F.min(F.struct(*docs.columns)).alias("__row"))
    return single.unionByName(repeated.select("__row.*"))
