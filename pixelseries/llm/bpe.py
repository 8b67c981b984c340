"""Encoding and decoding with a public BPE vocabulary: speculate, verify, and merge only what fails."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .common import spare

END = "</w>"
#: Words that a worker remembers; beyond it the memory starts anew.
REMEMBERED = 400_000
PAIR, NONE, LONG = 1 << 20, 1 << 62, 200
#: Text bytes encoded at once.
BATCH = 2 << 20


def byte_symbols() -> list[str]:
    """One printable character per byte value: itself if printable in Latin-1, else one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare_code = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare_code)) for b in range(256)]


def token_names(spec: dict) -> pa.Array:
    """Token strings by id."""
    ids = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
    names = [""] * (max(ids.values()) + 1)
    for name, i in ids.items():
        names[i] = name
    return pa.array(names)


class Vocabulary:
    """A word-level BPE: lower case, words end in ``</w>``, bytes as symbols."""

    def __init__(self, spec: dict):
        model = spec["model"]
        ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern, regex.V0)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.symbols = byte_symbols()
        self.names = token_names(spec).to_pylist()
        self.inner = {k: i for k, i in ids.items() if not k.endswith(END)}
        self.final = {k[: -len(END)]: i for k, i in ids.items() if k.endswith(END)}
        self.longest = max(map(len, [*self.inner, *self.final]))
        self.reach: dict[str, int] = {}
        for name in self.inner:
            self.reach[name[:2]] = max(self.reach.get(name[:2], 1), len(name))
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[ids[a] * PAIR + ids[b]] = rank * PAIR + ids[a + b]
        self.good_pairs: dict[int, bool] = {}
        self.good_tokens: dict[int, bool] = {}
        self.forget()

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        self.lengths, self.table = np.empty(0, np.int64), np.empty(0, np.int32)

    # --- exact merging -------------------------------------------------------

    def units(self, token: int) -> list[int]:
        """The one-byte tokens a token is made of."""
        name = self.names[token]
        if name.endswith(END) and token in (self.final.get(name[: -len(END)]),):
            body = name[: -len(END)]
            return [*(self.inner[c] for c in body[:-1]), self.final[body[-1]]]
        return [self.inner[c] for c in name]

    def merge(self, ids: list[int]) -> list[int]:
        """Merge the pair of lowest rank, the leftmost first, until none is left."""
        if len(ids) > LONG:
            return self.merge_long(ids)
        ids, get = list(ids), self.merges.get
        steps = [get(a * PAIR + b, NONE) for a, b in zip(ids, ids[1:])]
        while steps and (best := min(steps)) != NONE:
            i = steps.index(best)
            ids[i] = best % PAIR
            del ids[i + 1], steps[i]
            if i:
                steps[i - 1] = get(ids[i - 1] * PAIR + ids[i], NONE)
            if i < len(steps):
                steps[i] = get(ids[i] * PAIR + ids[i + 1], NONE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap, for words of many symbols."""
        n, ids, get = len(ids), list(ids), self.merges.get
        following, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(step, i, ids[i], ids[i + 1]) for i in range(n - 1) if (step := get(ids[i] * PAIR + ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            step, i, left, right = heappop(heap)
            j = following[i]
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j], following[i] = step % PAIR, -1, following[j]
            if following[j] >= 0:
                before[following[j]] = i
            for a, b in ((before[i], i), (i, following[i])):
                if a >= 0 and b >= 0 and (step := get(ids[a] * PAIR + ids[b])) is not None:
                    heappush(heap, (step, a, ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    # --- speculation ---------------------------------------------------------

    def longest_match(self, word: str) -> list[int]:
        found, at, n, inner, final, reach = [], 0, len(word), self.inner, self.final, self.reach
        while at < n:
            token = final.get(word[at:]) if n - at <= self.longest else None
            if token is not None:
                found.append(token)
                break
            for stop in range(min(n - 1, at + reach.get(word[at : at + 2], 1)), at, -1):
                token = inner.get(word[at:stop])
                if token is not None:
                    break
            found.append(token)
            at = stop
        return found

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Token ids of byte-symbol words.

        A sequence is what merging gives exactly if merging gives back each pair of
        neighbours, so the guesses of all words are tested together: every distinct
        pair once, then one lookup per neighbour. Only words with a failing pair are
        merged.
        """
        guesses = [self.longest_match(w) for w in words]
        lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
        tokens = np.fromiter((t for g in guesses for t in g), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        joined = owner[1:] == owner[:-1]
        pairs = (tokens[:-1] * PAIR + tokens[1:])[joined]
        distinct, where = np.unique(pairs, return_inverse=True)
        sound = np.fromiter((self.compatible(p) for p in distinct.tolist()), bool, len(distinct))
        failing = np.zeros(len(words), bool)
        failing[owner[1:][joined][~sound[where]]] = True
        alone = np.flatnonzero(lengths == 1)
        starts = np.cumsum(lengths) - lengths
        failing[alone] = [not self.stable(t) for t in tokens[starts[alone]].tolist()]
        found = np.split(tokens.astype(np.int32), np.cumsum(lengths)[:-1]) if len(words) else []
        for i in np.flatnonzero(failing).tolist():
            word = words[i]
            found[i] = np.array(self.merge([*(self.inner[c] for c in word[:-1]), self.final[word[-1]]]), np.int32)
        return found

    def compatible(self, pair: int) -> bool:
        if pair not in self.good_pairs:
            if len(self.good_pairs) > REMEMBERED:
                self.good_pairs.clear()
            a, b = divmod(pair, PAIR)
            self.good_pairs[pair] = self.merge(self.units(a) + self.units(b)) == [a, b]
        return self.good_pairs[pair]

    def stable(self, token: int) -> bool:
        if token not in self.good_tokens:
            self.good_tokens[token] = self.merge(self.units(token)) == [token]
        return self.good_tokens[token]

    # --- texts ---------------------------------------------------------------

    def normalised(self, text: str) -> str:
        # The library lowers letter by letter, so the last sigma of a word is no exception.
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def parts(self, text: str) -> list[str]:
        """Pieces of a text; special tokens, if any, as they stand."""
        if self.cut is None or not (marks := self.cut.findall(text)):
            return self.pieces.findall(self.normalised(text))
        found: list[str] = []
        for between, mark in zip(self.cut.split(text), [*marks, None]):
            found += self.pieces.findall(self.normalised(between))
            if mark is not None:
                found.append("\0" + mark)
        return found

    def encode(self, texts: list[str]) -> pa.ListArray:
        if len(self.words) > REMEMBERED:
            self.forget()
        known, cut = self.words, [self.parts(t) for t in texts]
        fresh = list({p: None for c in cut for p in c if p not in known})
        marks = {p: [self.special[p[1:]]] for p in fresh if p.startswith("\0") and p[1:] in self.special}
        plain = [p for p in fresh if p not in marks]
        symbols = self.symbols
        coded = self.encode_words(["".join([symbols[b] for b in p.encode()]) for p in plain]) + [np.array(i, np.int32) for i in marks.values()]
        known.update(zip([*plain, *marks], range(len(known), len(known) + len(fresh))))
        self.lengths = np.concatenate([self.lengths, np.fromiter(map(len, coded), np.int64, len(coded))])
        self.table = np.concatenate([self.table, *coded])
        lengths, table = self.lengths, self.table
        starts = np.cumsum(lengths) - lengths
        rows = []
        for c in cut:
            at = np.fromiter(map(known.__getitem__, c), np.int64, len(c))
            n = lengths[at]
            ends = np.cumsum(n)
            rows.append(table[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
        offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.empty(0, np.int32)))


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(shared: "_Shared") -> Vocabulary:
    """The worker's vocabulary; built once per process."""
    if shared.id not in _LOADED:
        _LOADED.clear()
        _LOADED[shared.id] = Vocabulary(json.loads(shared.value))
    return _LOADED[shared.id]


class _Shared:
    """The vocabulary file, sent to each executor once: its size does not grow with the data."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as file:
            text = file.read()
        self.id, self.sent = hash(text), spark.sparkContext.broadcast(text)

    @property
    def value(self) -> str:
        return self.sent.value


def encode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``docs`` with the array ``ids`` of token ids of its whole text.

    Null and empty texts have no ids. Special tokens written in a text are encoded
    as such. A column named ``ids`` is replaced. Rows stay as they are otherwise.
    """
    shared = _Shared(docs.sparkSession, path)
    text, out = spare(docs, "__bpe_text"), spare(docs, "__bpe_ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared)
        for batch in slices(batches, text, BATCH):
            coded = vocabulary.encode(batch.column(text).to_pylist())
            kept = [n for n in batch.schema.names if n != text]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), coded], names=[*kept, out])

    rows = docs.drop(ids).withColumn(text, F.coalesce("text", F.lit("")))
    schema = rows.drop(text).withColumn(out, F.lit(None).cast("array<int>")).schema
    return rows.mapInArrow(run, schema).withColumnRenamed(out, ids)


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """``rows`` with the column ``text`` of the tokens' names joined by a space; this vocabulary has no decoder of its own.

    Null ids give a null text.
    """
    shared = _Shared(rows.sparkSession, path)
    out = spare(rows, "__bpe_decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = token_names(json.loads(shared.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                coded = part.column(ids)
                lists = pa.ListArray.from_arrays(_offsets(coded), names.take(coded.flatten()))
                joined = pc.if_else(pc.is_valid(coded), pc.binary_join(lists, " "), pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, joined], names=[*part.schema.names, out])

    schema = rows.withColumn(out, F.lit(None).cast("string")).schema
    kept = [c for c in rows.columns if c != text]
    return rows.mapInArrow(run, schema).select(*kept, F.col(out).alias(text))


def _offsets(lists: pa.ListArray) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` for every row: encoded, then decoded again."""
    coded = decode(encode(docs.select("doc_id", "text"), path).drop("text"), path)
    digest = lambda text: F.sha2(text, 256)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join("ids", " ")).alias("ids_sha256"), digest(F.col("text")).alias("decoded_sha256"), "ids"
    )
