"""Spelling variants: words one letter apart, found with bit sets by position and letter."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseries.session import cut_lineage

from .batches import slices

#: The letters of a word, and which occurrences lose one.
LETTERS = [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]
CHOSEN = 97
#: Letters that a word has, and its occurrences in all texts, at least.
LEAST, OFTEN = 5, 3
#: How many times as frequent as a word its form is at least.
TIMES = 2
#: Words of one bit index, and words looked up at once.
INDEXED, ASKED = 8192, 2048
#: Words per shard that the number of shards is chosen for.
SHARD = 4096
REMEMBERED = 400_000
BATCH = 4 << 20
#: One byte per code point: letters in lower case, all else a blank.
FOLDED = bytes(ord(chr(b).lower()) if b < 128 and b in LETTERS else b if b in LETTERS else 32 for b in range(256))
#: Prefix checksums are moved on by up to so many bytes together; longer words one at a time.
MOVED = 32


def _byte_table() -> np.ndarray:
    """The checksum's step for each byte value, from its polynomial."""
    found = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        found = np.where(found & 1, found >> 1 ^ np.uint32(0xEDB88320), found >> 1).astype(np.uint32)
    return found


_STEP = _byte_table()


class Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: bytes) -> int:
        number = self[key] = len(self)
        return number


class Runs:
    """Counts the letter runs of texts, with a letter taken out of the chosen occurrences."""

    def __init__(self):
        self.ids = Numbered()
        self.crcs, self.sizes = np.empty(0, np.uint32), np.empty(0, np.int64)
        self.counts, self.changed = np.zeros(0, np.int64), Counter()

    def add(self, doc_ids: list, texts: list[str]) -> None:
        # Code points above one byte become a mark, which is no letter.
        runs = [t.encode("latin-1", "replace").translate(FOLDED).split() for t in texts]
        sizes = np.fromiter(map(len, runs), np.int64, len(runs))
        before = len(self.ids)
        ids = np.fromiter(map(self.ids.__getitem__, chain.from_iterable(runs)), np.int64, int(sizes.sum()))
        fresh = [w.decode("latin-1").encode() for w in islice(self.ids, before, None)]
        self.crcs = np.concatenate([self.crcs, np.fromiter(map(zlib.crc32, fresh), np.uint32, len(fresh))])
        self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, fresh), np.int64, len(fresh))])
        self.counts = np.concatenate([self.counts, np.zeros(len(fresh), np.int64)])
        prefixes = [b"%s:" % (b"" if d is None else str(d).encode()) for d in doc_ids]
        # The checksum of prefix and word: the prefix's moved on by the word's bytes, and the word's own.
        moved = np.empty((MOVED + 1, len(prefixes)), np.uint32)
        moved[0] = np.fromiter(map(zlib.crc32, prefixes), np.uint32, len(prefixes))
        for i in range(MOVED):
            moved[i + 1] = _STEP[moved[i] & 255] ^ moved[i] >> 8
        of, lengths = np.repeat(np.arange(len(runs)), sizes), self.sizes[ids]
        hashes = moved[np.minimum(lengths, MOVED), of] ^ self.crcs[ids]
        long = np.flatnonzero(lengths > MOVED)
        if len(long):
            names = list(self.ids)
            hashes[long] = [zlib.crc32(names[i].decode("latin-1").encode(), int(moved[0, d])) for i, d in zip(ids[long].tolist(), of[long].tolist())]
        chosen = hashes % CHOSEN == 0
        self.counts += np.bincount(ids[~chosen], minlength=len(self.counts))
        if chosen.any():
            names = list(self.ids)
            for i, h in zip(ids[chosen].tolist(), hashes[chosen].tolist()):
                at = h % len(names[i])
                self.changed[names[i][:at] + names[i][at + 1 :]] += 1

    def counted(self) -> pa.RecordBatch:
        total = self.changed
        for word, n in zip(self.ids, self.counts.tolist()):
            if n:
                total[word] += n
        words = [w for w in total if len(w) >= LEAST]
        return pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in words], pa.string()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n``: the words of ``LEAST`` letters or more that occur ``OFTEN`` times or more in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs()
        for batch in slices(batches, most=BATCH):
            runs.add(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            if len(runs.ids) > REMEMBERED:
                yield runs.counted()
                runs = Runs()
        yield runs.counted()

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)


# --- the bit index ------------------------------------------------------------


def _coded(words: list[bytes], width: int) -> np.ndarray:
    """A row of letters per word, filled up with zeros."""
    found = np.zeros((len(words), width), np.uint8)
    for i, w in enumerate(words):
        found[i, : len(w)] = np.frombuffer(w, np.uint8)
    return found


class Index:
    """Words of ``size`` or one letter more, as bit sets: which of them have a letter at a position."""

    def __init__(self, words: list[bytes], size: int):
        self.words, self.size = words, size
        self.codes = _coded(words, size + 1)
        self.letters = np.zeros(256, np.int64)
        present = np.unique(self.codes[self.codes > 0])
        self.present = np.r_[np.uint8(0), present]  # the first set is that of letters in no word: empty
        self.letters[present] = np.arange(1, len(present) + 1)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        self.same, self.longer = self._bits(lengths == size), self._bits(lengths == size + 1)

    @staticmethod
    def _bits(rows: np.ndarray) -> np.ndarray:
        """Booleans along the last axis as 64-bit numbers."""
        packed = np.packbits(rows, axis=-1, bitorder="little")
        fill = -packed.shape[-1] % 8
        return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, fill)])).view(np.uint64)

    def at(self, position: int) -> np.ndarray:
        """The set of words for each letter at a position."""
        has = self.codes[None, :, position] == self.present[:, None]
        has[0] = False
        return self._bits(has)

    def near(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``codes``, word) that differ by exactly one replaced letter, or one more in the indexed word.

        ``codes`` has words of ``size`` letters. After each letter three sets per word are
        known: who agrees so far, who agrees but for one letter, and who agrees with one
        letter added, whose positions are shifted by one. A letter taken from the
        indexed word is a letter added seen from there.
        """
        asked = self.letters[codes]
        exact = np.full((len(codes), len(self.same)), ~np.uint64(0))
        replaced, added = np.zeros_like(exact), exact.copy()
        here = self.at(0)
        for i in range(self.size):
            following = self.at(i + 1)
            fits = here[asked[:, i]]
            replaced &= fits
            replaced |= exact
            exact &= fits
            added &= following[asked[:, i]]
            added |= exact
            here = following
        found = (replaced & ~exact & self.same) | (added & self.longer)
        row, number = np.nonzero(found)
        bits = np.unpackbits(found[row, number].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        pair, bit = np.nonzero(bits)
        return row[pair], number[pair] * 64 + bit


def _best(words: list[bytes], counts: np.ndarray, source: np.ndarray, target: np.ndarray) -> pa.RecordBatch:
    """Of each source: how many targets, and the most frequent one (ties: smallest) with its count."""
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[target], -counts[target], source))
    source, target = source[order], target[order]
    first = np.flatnonzero(np.r_[True, source[1:] != source[:-1]]) if len(source) else np.empty(0, np.int64)
    text = lambda at: pa.array([words[i].decode("latin-1") for i in at.tolist()], pa.string())
    sizes = np.diff(np.r_[first, len(source)])
    return pa.RecordBatch.from_arrays([text(source[first]), pa.array(sizes.astype(np.int64)), text(target[first]), pa.array(counts[target[first]])], names=["word", "n_near", "near", "near_n"])


def _found(size: int, side: str, members: list[tuple], asking: list[tuple]) -> Iterator[pa.RecordBatch]:
    """The near pairs of one shard's index and questions.

    Two near words have the first half in common, or else the second: a pair with the same
    first half belongs to that half's shard, any other to that of the second.
    """
    names = [w for w, _ in members]
    counts = np.array([n for _, n in members], np.int64)
    index, half = Index(names, size), size // 2
    for at in range(0, len(asking), ASKED):
        some = asking[at : at + ASKED]
        codes = _coded([w for w, _ in some], size)
        row, target = index.near(codes)
        fits = (codes[row, :half] == index.codes[target, :half]).all(axis=1) == (side == "first")
        row, target = row[fits], target[fits]
        words = names + [w for w, _ in some]
        every = np.r_[counts, np.array([n for _, n in some], np.int64)]
        back = index.codes[target, size] > 0  # words of one letter more ask nothing here: told from the other side
        yield _best(words, every, np.r_[row + len(names), target[back]], np.r_[target, row[back] + len(names)])


def _sharded(vocabulary: DataFrame, shards: int) -> DataFrame:
    """``size, side, shard, word, n, asks``: a word and its half, for pairs of its own length and with words one letter shorter."""
    length = F.char_length("word")
    size = F.explode(F.array(length, length - 1)).alias("size")
    rows = vocabulary.select("word", "n", size).filter(F.col("size") >= LEAST)
    first = F.expr("left(word, int(size / 2))")
    second = F.expr("right(word, size - int(size / 2))")
    halves = F.explode(F.array(F.struct(F.lit("first").alias("side"), first.alias("part")), F.struct(F.lit("second").alias("side"), second.alias("part")))).alias("half")
    rows = rows.select("size", "word", "n", halves)
    return rows.select("size", "half.side", F.pmod(F.xxhash64("half.part"), F.lit(shards)).alias("shard"), "word", "n", (F.char_length("word") == F.col("size")).alias("asks"))


def near_words(vocabulary: DataFrame) -> DataFrame:
    """``word, n_near, near, near_n``: for each word with a near one, their number and the most frequent of them.

    ``vocabulary`` has distinct words and their counts. Words are dealt to shards by their length and
    either half, so that near words meet in one; the shards are as many as keep them small, and a
    large one is cut into indexes of about ``INDEXED`` words that all its words ask.
    """
    shards = vocabulary.count() // SHARD + 1
    key = ["size", "side", "shard"]
    rows = cut_lineage(_sharded(vocabulary, shards))
    sizes = rows.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / INDEXED).cast("int").alias("chunks"))
    rows = rows.join(sizes, key)
    members = rows.withColumns({"chunk": F.pmod(F.xxhash64("word", F.lit(1)), F.col("chunks")).cast("int"), "asking": F.lit(False)})
    asking = rows.filter("asks").withColumns({"chunk": F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)), "asking": F.lit(True)})
    place = [*key, "chunk"]
    rows = members.unionByName(asking).repartition(*place).sortWithinPartitions(*place, "asking").select(*place, "asking", "word", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, asking = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*place, "asking", "word", "n")]
            for size, side, shard, chunk, asks, word, n in zip(*columns):
                if (size, side, shard, chunk) != at:
                    if asking and members:
                        yield from _found(at[0], at[1], members, asking)
                    at, members, asking = (size, side, shard, chunk), [], []
                (asking if asks else members).append((word.encode("latin-1"), n))
        if asking and members:
            yield from _found(at[0], at[1], members, asking)

    found = rows.mapInArrow(run, "word string, n_near long, near string, near_n long")
    # Most frequent first, then smallest.
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.near").alias("near"), (-F.col("best.less")).alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of the words with a ``form``: where following the forms ends.

    A form is at least ``TIMES`` as frequent, so there are no rings; each round doubles the steps.
    """
    current = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = current.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        moved = cut_lineage(current.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        current = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return current


def spellings(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the texts.

    Words are runs of Latin letters (to U+00FF), A-Z in lower case, of five letters or more that
    occur three times or more. Occurrences whose CRC-32, with the document's id, is a multiple
    of 97 lose one letter before they are counted. ``n_near`` words differ by exactly one letter added,
    taken or replaced; of these the most frequent (ties: smallest) is the ``form`` if it is
    at least twice as frequent. ``root`` is where the forms lead, the word itself without one.

    Null and empty texts have no words; a null id counts as no characters. Repeated rows count each.
    Words of any length take part. Other columns are ignored; an empty table gives no rows.
    """
    words = cut_lineage(word_counts(docs))
    near = words.join(near_words(words), "word", "left")
    is_form = F.col("near_n") >= TIMES * F.col("n")
    rows = cut_lineage(near.select("word", F.when(is_form, F.col("near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near_n")).alias("form_n")))
    rooted = rows.join(_roots(rows.filter("form is not null")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
