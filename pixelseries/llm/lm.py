"""Scoring by a word bigram model: deleted interpolation with weights learned on held-out counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseries.session import cut_lineage

from .batches import byte_words, slices
from .langid import remainder

#: Tokens of a block: the documents that a task counts and scores together.
BLOCK_TOKENS = 1_400_000
#: Remainders of the documents that are not learned from, and of those that the weights are learned on.
OUT, WEIGH = 2, 3
#: The token that ends a text, and stands before its first word; no word has a blank.
END = b" "
#: Context frequencies fall in buckets by powers of two; probabilities are grouped by these fractions of one.
BUCKETS, CONTEXT_STEPS, WORD_STEPS = 48, 8, 4
ROUNDS, LEAST = 60, 1e-6
#: Bits of a word's and of a pair's key.
WORD_BITS, KEY_BITS = 56, 48


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes: small ones take little room."""
    planes = np.ascontiguousarray(values.astype(np.uint64)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=6).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


# --- blocks ------------------------------------------------------------------

BLOCK_SCHEMA = "block long, docs array<long>, parts binary, sizes binary, tokens binary, words binary"


def _blocked(most: int):
    """Texts as numbers: a block has its own list of words and refers to them by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made = TaskContext.get().partitionId(), 0
        ids: dict[bytes, int] = {END: 0}
        docs, parts, sizes, tokens, held = [], [], [], [], 0

        def finished() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids)) >> np.uint64(64 - WORD_BITS)
            row = [[(task << 32) + made], [docs], [pack(np.array(parts))], [pack(np.array(sizes))], [pack(np.concatenate(tokens))], [pack(hashes)]]
            types = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)], names=["block", "docs", "parts", "sizes", "tokens", "words"])

        for batch in slices(batches):
            for doc, part, text in zip(batch.column("doc_id").to_pylist(), batch.column("part").to_pylist(), batch.column("text").to_pylist()):
                words = byte_words(text)
                for w in words:
                    if w not in ids:
                        ids[w] = len(ids)
                found = np.zeros(len(words) + 1, np.int32)
                found[:-1] = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
                docs.append(doc)
                parts.append(part)
                sizes.append(len(found))
                tokens.append(found)
                held += len(found)
                if held >= most:
                    yield finished()
                    made, ids, docs, parts, sizes, tokens, held = made + 1, {END: 0}, [], [], [], [], 0
        if docs:
            yield finished()

    return run


class Block:
    """A block's tokens and distinct pairs, with the counts it adds to the corpus itself."""

    def __init__(self, row: dict):
        self.block, self.docs = row["block"], row["docs"]
        self.sizes = unpack(row["sizes"]).astype(np.int64)
        self.parts = unpack(row["parts"]).astype(np.int64)
        self.tokens = unpack(row["tokens"]).astype(np.int32)
        self.words = unpack(row["words"])
        part = np.repeat(self.parts, self.sizes)
        self.known, self.kept = part != OUT, (part != OUT) & (part != WEIGH)

    def word_counts(self) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.words)
        return np.bincount(self.tokens[self.known], minlength=n), np.bincount(self.tokens[self.kept], minlength=n)

    def pairs(self) -> None:
        """``key`` (sorted), ``first`` and ``second`` per distinct pair of neighbours; ``at`` per token."""
        codes = np.empty(len(self.tokens), np.int64)
        codes[1:] = self.tokens[:-1]
        codes[np.cumsum(self.sizes) - self.sizes] = 0
        codes *= len(self.words)
        codes += self.tokens
        codes, at = np.unique(codes, return_inverse=True)
        first, second = (x.astype(np.int32) for x in np.divmod(codes, len(self.words)))
        x = self.words[first] * np.uint64(0x9E3779B97F4A7C15) + self.words[second]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        key = (x ^ (x >> np.uint64(29))) >> np.uint64(64 - KEY_BITS)
        order = np.argsort(key, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.key, self.first, self.second, self.at = key[order], first[order], second[order], place[at]
        n = len(codes)
        self.all_, self.kept_pairs = np.bincount(self.at[self.known], minlength=n), np.bincount(self.at[self.kept], minlength=n)


def _answered(own: np.ndarray, keys: np.ndarray, answers: list[tuple[bytes, bytes]]) -> np.ndarray:
    """A block's own counts, with the corpus's where an answer gives them. ``keys`` are sorted."""
    total = own.copy()
    for names, values in answers:
        found = unpack_sorted(names)
        left, right = np.searchsorted(keys, found), np.searchsorted(keys, found, side="right")
        # Pairs whose keys collide share one count.
        for shift in range(int((right - left).max(initial=0))):
            some = left + shift < right
            total[(left + shift)[some]] = unpack(values)[some]
    return total


def _word_totals(block: Block, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(block.words, kind="stable")
    rows = answers.filter(pc.equal(answers.column("kind"), "word")).to_pylist()
    totals = []
    for own, name in zip(block.word_counts(), ("known", "kept")):
        found = np.empty_like(own)
        found[order] = _answered(own[order], block.words[order], [(r["keys"], r[name]) for r in rows])
        totals.append(found)
    return totals[0], totals[1]


# --- counting ----------------------------------------------------------------

ASK_SCHEMA = "bucket int, block long, keys binary, known binary, kept binary, context binary, word binary"
ANSWER_SCHEMA = "kind string, block long, keys binary, known binary, kept binary, cells array<long>, counts array<long>"


def _asked(block: Block, keys: np.ndarray, bits: int, buckets: int, columns: list[np.ndarray], held: np.ndarray | None = None) -> pa.RecordBatch:
    """A block's distinct keys and counts, cut into buckets by the key's upper bits.

    The columns after the second are for the keys that are ``held`` alone.
    """
    bucket = ((keys >> np.uint64(bits - 32)) * np.uint64(buckets)) >> np.uint64(32)
    edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
    rows = [(b, edges[b], edges[b + 1]) for b in range(buckets) if edges[b] < edges[b + 1]]
    arrays = [pa.array([b for b, _, _ in rows], pa.int32()), pa.array([block.block] * len(rows), pa.int64()), pa.array([pack_sorted(keys[i:j]) for _, i, j in rows], pa.binary())]
    arrays += [pa.array([pack(c[i:j]) for _, i, j in rows], pa.binary()) for c in columns[:2]]
    arrays += [pa.array([pack(c[i:j][held[i:j]]) for _, i, j in rows], pa.binary()) for c in columns[2:]]
    arrays += [pa.nulls(len(rows), pa.binary())] * (4 - len(columns))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "block", "keys", "known", "kept", "context", "word"])


def _ask_words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                order = np.argsort(block.words, kind="stable")
                yield _asked(block, block.words[order], WORD_BITS, buckets, [c[order] for c in block.word_counts()])

    return run


def _logs(values: np.ndarray, steps: int) -> np.ndarray:
    """Rounded logarithms of counts, from 1 on; 0 for a count of 0."""
    return np.where(values > 0, np.rint(steps * np.log2(np.maximum(values, 1))) + 1, 0).astype(np.int64)


def _ask_pairs(buckets: int):
    def run(_key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        tables = []
        for row in blocks.to_pylist():
            block = Block(row)
            block.pairs()
            _, kept = _word_totals(block, answers)
            weighed = block.all_ > block.kept_pairs
            context, word = _logs(kept[block.first], CONTEXT_STEPS), _logs(kept[block.second], WORD_STEPS)
            tables.append(_asked(block, block.key, KEY_BITS, buckets, [block.all_, block.kept_pairs, context, word], weighed))
        return pa.Table.from_batches(tables, schema=ASK_ARROW)

    return run


_BINARY = pa.binary()
ASK_ARROW = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), *((n, _BINARY) for n in ("keys", "known", "kept", "context", "word"))])
ANSWER_ARROW = pa.schema([("kind", pa.string()), ("block", pa.int64()), *((n, _BINARY) for n in ("keys", "known", "kept")), ("cells", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def _summed(kind: str):
    """Add up one bucket's keys over all blocks; answer each block where the sum is not its own count."""

    def run(asked: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        keys = [unpack_sorted(r["keys"]) for r in rows]
        ends = np.cumsum([0, *map(len, keys)])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)

        def total(name: str) -> tuple[np.ndarray, np.ndarray]:
            own = np.concatenate([unpack(r[name]) for r in rows]).astype(np.int64)
            sums = np.zeros(len(distinct), np.int64)
            np.add.at(sums, at, own)
            return own, sums

        (own, known), (own_kept, kept) = total("known"), total("kept")
        differs = (known[at] != own) | (kept[at] != own_kept) if kind == "word" else known[at] != own
        out = []
        for r, k, i, j in zip(rows, keys, ends, ends[1:]):
            some = differs[i:j]
            if some.any():
                here = at[i:j][some]
                out.append({"kind": kind, "block": r["block"], "keys": pack_sorted(k[some]), "known": pack(known[here]), "kept": pack(kept[here]) if kind == "word" else None})
        if kind == "word":
            cells, counts = [0, 1, 2, 3], [known.sum(), np.count_nonzero(known), kept.sum(), np.count_nonzero(kept)]
        else:
            most = [np.zeros(len(distinct), np.int64) for _ in range(2)]
            for values, name in zip(most, ("context", "word")):
                np.maximum.at(values, at[own > own_kept], np.concatenate([unpack(r[name]) for r in rows]).astype(np.int64))
            held = known - kept
            some = held > 0
            pair = kept[some]
            pair = np.where(pair <= 8, pair, 8 + _logs(pair, WORD_STEPS))
            code = (most[0][some] << 40) | (most[1][some] << 20) | pair
            cells, where = np.unique(code, return_inverse=True)
            counts = np.zeros(len(cells), np.int64)
            np.add.at(counts, where, held[some])
        out.append({"kind": "cells", "cells": [int(c) for c in cells], "counts": [int(c) for c in counts]})
        return pa.Table.from_pylist(out, schema=ANSWER_ARROW)

    return run


def _exp(logs: np.ndarray, steps: int) -> np.ndarray:
    return np.where(logs > 0, 2.0 ** ((logs - 1) / steps), 0.0)


def bucket_of(count: np.ndarray) -> np.ndarray:
    """0 for an unknown context, then one bucket per power of two."""
    return np.where(count > 0, np.floor(np.log2(np.maximum(count, 1))).astype(np.int64) + 1, 0)


def learn_weights(bucket: np.ndarray, chances: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per bucket the weights of the columns of ``chances`` that make ``n`` held-out events likely.

    Expectation: each event is shared among the parts that could have made it.
    Maximisation: a part's weight is its share of all events of the bucket.
    """
    weights = np.full((BUCKETS, chances.shape[1]), 1 / chances.shape[1])
    events = np.zeros(BUCKETS)
    np.add.at(events, bucket, n)
    for _ in range(ROUNDS):
        parts = weights[bucket] * chances
        parts *= (n / np.maximum(parts.sum(axis=1), 1e-300))[:, None]
        sums = np.zeros_like(weights)
        np.add.at(sums, bucket, parts)
        weights = np.where(events[:, None] > 0, sums / np.maximum(events, 1)[:, None], weights)
    weights = np.maximum(weights, [0.0, LEAST, LEAST])
    weights /= weights.sum(axis=1, keepdims=True)
    seen = np.flatnonzero(events > 0)
    for b in range(BUCKETS):  # a bucket without events takes the weights of the nearest one that has some
        if events[b] == 0:
            weights[b] = weights[seen[np.abs(seen - b).argmin()]] if len(seen) else [0.0, 0.9, 0.1]
    # A context that was never met says nothing: what its bucket gives to pairs goes to the words.
    weights[0] = [0.0, weights[0, 0] + weights[0, 1], weights[0, 2]]
    return weights


def _weights_of(cells: DataFrame, kept: int, distinct: int) -> np.ndarray:
    """From groups of held-out pairs with near-equal counts: a table whose size is bounded by its steps."""
    rows = cells.select(F.explode(F.map_from_arrays("cells", "counts")).alias("code", "n")).groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()
    code, n = rows.column("code").to_numpy(), rows.column("n").to_numpy().astype(float)
    context, word = _exp(code >> 40, CONTEXT_STEPS), _exp((code >> 20) & 0xFFFFF, WORD_STEPS)
    pair = code & 0xFFFFF
    pair = np.where(pair <= 8, pair, _exp(pair - 8, WORD_STEPS))
    chances = np.stack([np.minimum(pair / np.maximum(context, 1), 1.0), word / max(kept, 1), np.full(len(code), 1 / (distinct + 1))], axis=1)
    return learn_weights(bucket_of(np.floor(context + 0.5)), chances, n)


# --- scoring -----------------------------------------------------------------

SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _scored(tokens: int, distinct: int, weights: np.ndarray):
    def run(_key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        tables = []
        for row in blocks.to_pylist():
            block = Block(row)
            block.pairs()
            known, _ = _word_totals(block, answers)
            rows = answers.filter(pc.equal(answers.column("kind"), "pair")).to_pylist()
            pairs = _answered(block.all_, block.key, [(r["keys"], r["known"]) for r in rows])
            context, word = known[block.first], known[block.second]
            w = weights[bucket_of(context)]
            chance = w[:, 0] * np.minimum(pairs / np.maximum(context, 1), 1.0) + w[:, 1] * word / max(tokens, 1) + w[:, 2] / (distinct + 1)
            if tokens == 0:
                chance = np.ones(len(pairs))
            starts = np.cumsum(block.sizes) - block.sizes
            summed = lambda values: np.add.reduceat(values, starts)
            base = np.log10((known + 1) / (tokens + distinct + 1))
            arrays = [block.docs, (block.parts == OUT).tolist(), block.sizes, summed((known > 0)[block.tokens].astype(np.int64)), summed(base[block.tokens]), summed(np.log10(chance)[block.at])]
            tables.append(pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, SCORE_TYPES)], names=SCORE_NAMES))
        return pa.Table.from_batches(tables, schema=pa.schema(list(zip(SCORE_NAMES, SCORE_TYPES))))

    return run


SCORE_NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]
SCORE_TYPES = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]


def score(docs: DataFrame, parts: int = 7, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Tokens are lower-cased words and one end per text. Rows whose crc32(id) modulo
    ``parts`` is ``OUT`` are held out; the others are counted. The chance of a token
    is mixed from the shares of its pair among its context's, of the word among all
    words, and of one in all words and an unknown one. Contexts fall in buckets by
    their frequency, and each bucket's weights are learned by expectation and
    maximisation on the pairs of the rows with remainder ``WEIGH``, against counts
    without those rows.

    Texts are cut into blocks. A block asks for the corpus counts of its distinct
    words and pairs once, and gets answers only where they differ from its own, so
    rare pairs, most of all, travel once; no task sees more than a block or a bucket,
    and the number of buckets follows that of blocks.

    Null texts are empty: they have the end alone. A null id is counted. Rows that
    share an id are scored one by one. An empty table gives none.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), remainder("doc_id", parts).alias("part"), "text")
    # -1 (no id) is counted like any other remainder.
    source = source.withColumn("part", F.when(F.col("part") < 0, 0).otherwise(F.col("part")))
    blocks = cut_lineage(source.mapInArrow(_blocked(block_tokens), BLOCK_SCHEMA))
    buckets = max(16, 2 * blocks.count())
    words = blocks.mapInArrow(_ask_words(buckets), ASK_SCHEMA).groupBy("bucket").applyInArrow(_summed("word"), ANSWER_SCHEMA)
    words = cut_lineage(words)
    counts = dict(words.filter("kind = 'cells'").select(F.explode(F.map_from_arrays("cells", "counts")).alias("code", "n")).groupBy("code").agg(F.sum("n")).collect())
    tokens, distinct, kept, kept_distinct = (int(counts.get(i, 0)) for i in range(4))

    by_block = lambda df: df.groupBy("block")
    answers = words.filter("kind = 'word'")
    asked = by_block(blocks).cogroup(by_block(answers)).applyInArrow(_ask_pairs(buckets), ASK_SCHEMA)
    pairs = cut_lineage(asked.groupBy("bucket").applyInArrow(_summed("pair"), ANSWER_SCHEMA))
    weights = _weights_of(pairs.filter("kind = 'cells'"), kept, kept_distinct)
    answers = answers.unionByName(pairs.filter("kind = 'pair'"))
    found = by_block(blocks).cogroup(by_block(answers)).applyInArrow(_scored(tokens, distinct, weights), SCORE_SCHEMA)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
