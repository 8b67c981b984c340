"""Language identification by bit-sliced Bloom filters of letter trigrams."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseries.session import cut_lineage

from .batches import slices

UNKNOWN = "und"
#: Slots of the filter (a bit per language in each) and slots per trigram.
SLOTS, PROBES = 1 << 20, 3
#: A language has a trigram if that is this share of its trigrams, and this share of the largest share that a language gives it.
MIN_SHARE, MIN_RELATIVE = 2e-5, 0.1
REMEMBERED = 200_000
LETTERS = regex.compile(r"\p{L}+")


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words' trigrams, each word with a blank at either end, and the word each is from.

    A word of n letters has n trigrams: one around each letter. A code is the three
    letters side by side, 21 bits each.
    """
    letters = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    middle = letters[1:-1] != 32
    codes = (letters[:-2] << np.uint64(42)) | (letters[1:-1] << np.uint64(21)) | letters[2:]
    return codes[middle], (np.cumsum(letters[:-2] == 32) - 1)[middle]


def places(codes: np.ndarray) -> np.ndarray:
    """The slots of each trigram: one row per probe."""
    found = []
    for probe in range(PROBES):
        x = (codes + np.uint64(probe + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        found.append((x >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64))
    return np.stack(found) if len(codes) else np.empty((PROBES, 0), np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``lang, code, n``: trigrams of a task's texts; as many as there are different ones."""
    totals: dict[str, Counter] = defaultdict(Counter)

    def flushed(lang: str, words: Counter) -> pa.RecordBatch:
        codes, owner = trigrams(list(words))
        distinct, where = np.unique(codes, return_inverse=True)
        n = np.bincount(where, np.fromiter(words.values(), np.int64, len(words))[owner], len(distinct)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(distinct.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    for batch in slices(batches):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            words = totals[lang]
            words.update(LETTERS.findall(text.lower()))
            if len(words) > REMEMBERED:
                yield flushed(lang, totals.pop(lang))
    for lang, words in totals.items():
        if words:
            yield flushed(lang, words)


class Filter:
    """``slots``: a row of 64-bit masks per slot; ``noise``: each language's chance of a false hit."""

    def __init__(self, langs: list[str], slots: np.ndarray):
        self.langs, self.slots = langs, slots
        fill = np.array([np.count_nonzero(slots[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) for i in range(len(langs))]) / len(slots)
        self.noise = fill**PROBES

    def hits(self, codes: np.ndarray) -> np.ndarray:
        """Codes by languages: whether the filter has them. One lookup per probe answers for all languages."""
        masks = self.slots[places(codes)]
        both = np.bitwise_and.reduce(masks, axis=0)
        return np.unpackbits(both.view(np.uint8), axis=1, bitorder="little")[:, : len(self.langs)]


def learn(docs: DataFrame) -> Filter:
    """The filter of rows with ``text`` and ``lang``.

    Trigrams are counted over all rows. A language keeps at most 1/MIN_SHARE of
    them, and the filter has a fixed number of slots, so what comes to the driver
    does not grow with the documents.
    """
    known = docs.filter("lang is not null and text is not null").select("lang", "text")
    counts = cut_lineage(known.mapInArrow(_counted, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).withColumnRenamed("lang", "__lang")
    shares = counts.join(totals, F.col("lang") == F.col("__lang")).select("lang", "code", (F.col("n") / F.col("total")).alias("share")).filter(F.col("share") >= MIN_SHARE)
    shares = cut_lineage(shares)
    top = shares.groupBy("code").agg(F.max("share").alias("top"))
    kept = shares.join(top, "code").filter(F.col("share") >= MIN_RELATIVE * F.col("top")).select("lang", "code").toArrow()
    langs = sorted(set(kept.column("lang").to_pylist()))
    index = {lang: i for i, lang in enumerate(langs)}
    numbers = np.array([index[x] for x in kept.column("lang").to_pylist()], np.int64)
    slots = np.zeros((SLOTS, max(1, -(-len(langs) // 64))), np.uint64)
    at = places(kept.column("code").to_numpy().view(np.uint64))
    for probe in at:
        np.bitwise_or.at(slots, (probe, numbers // 64), np.uint64(1) << (numbers % 64).astype(np.uint64))
    return Filter(langs, slots)


class Memory:
    """Hits per language and trigrams of the words that a worker has met."""

    def __init__(self, found: Filter):
        self.filter = found
        self.forget()

    def forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.counts = np.empty((0, len(self.filter.langs) + 1), np.int64)

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """Per text: hits of each language, and trigrams."""
        if len(self.ids) > REMEMBERED:
            self.forget()
        fresh = list({w: None for words in texts for w in words if w not in self.ids})
        if fresh:
            codes, owner = trigrams(fresh)
            starts = np.searchsorted(owner, np.arange(len(fresh)))
            hits = np.add.reduceat(self.filter.hits(codes), starts, axis=0, dtype=np.int64)
            sizes = np.diff(np.append(starts, len(owner)))
            self.counts = np.concatenate([self.counts, np.column_stack([hits, sizes])])
            self.ids.update(zip(fresh, range(len(self.ids), len(self.ids) + len(fresh))))
        found = np.zeros((len(texts), self.counts.shape[1]), np.int64)
        for i, words in enumerate(texts):
            if words:
                found[i] = self.counts[np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))].sum(axis=0)
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score: the share of its trigrams that the language has, less what chance alone would hit."""
        langs, noise = self.filter.langs, self.filter.noise
        sums = self.sums([LETTERS.findall(t.lower()) if t else [] for t in texts])
        total = sums[:, -1]
        if not langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        share = np.clip((sums[:, :-1] / np.maximum(total, 1)[:, None] - noise) / (1 - noise), 0, 1)
        best = share.argmax(axis=1)
        score = np.where(total > 0, share[np.arange(len(texts)), best], 0.0)
        return [langs[b] if n else UNKNOWN for b, n in zip(best.tolist(), total.tolist())], score


def identify(docs: DataFrame, found: Filter) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``, from its text alone.

    ``und`` with score 0 if the text is null or has no letter, or if no language was
    learned; equal shares go to the first language in code-point order. Other
    columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast((found.langs, found.slots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(Filter(*sent.value))
        for batch in slices(batches):
            langs, score = memory.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def remainder(doc_id, parts: int):
    """crc32 of the id as text, modulo ``parts``; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(-1))


def predict_languages(docs: DataFrame, parts: int = 4, held_out: int = 2) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: learned from the rows that are not held out, for all rows."""
    found = learn(docs.filter(remainder("doc_id", parts) != held_out))
    return identify(docs, found).select("doc_id", (remainder("doc_id", parts) == held_out).alias("held_out"), "lang_pred", "score")
