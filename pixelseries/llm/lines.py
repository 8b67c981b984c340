"""Fuzzy line deduplication: SimHash blocks, edit similarity, one line per group."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelseries.session import cut_lineage, delete_scratch, scratch_scope

from .batches import slices
from .common import spare
from .graph import link

#: Similar lines differ in at most one word in so many; shorter ones are similar only if equal.
WORDS_AN_EDIT = 20
#: Of 128 bits, blocks of so many bits; similar lines are looked for where two blocks are equal.
BITS, BLOCKS, WIDTH = 128, 10, 12
#: Lines meet in classes of word counts, each this much wider than the one before.
CLASS = 1.2
#: Rows of one block value, or of a slot, that a task holds at once; beyond it they are passed on unsorted.
HELD = 1 << 20
#: Lines dealt at once, and entries of one slot: block values are dealt over slots, rows of a slot travel packed.
DEALT, SLOT = 1 << 15, 1 << 17
#: Rows that share two blocks are compared there and then, if they are no more than this.
FEW = 64
#: Numbers of 64 bits that hold the parities of a line's words.
SIGNS = 4
REMEMBERED = 240_000
#: Text bytes worked on at once.
BATCH = 4 << 20
#: The heaviest word, and the words whose weights a counter of one byte holds.
HEAVIEST = 8
PART = 255 // HEAVIEST
#: Digits become 0 and ASCII marks vanish, so that counters and punctuation do not tell lines apart; all blanks within a line are alike.
DIGITS = bytes.maketrans(b"123456789\t\v\f\r", b"000000000    ")
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
SKETCH = ["n_words", "high", "low", *(f"sign{i}" for i in range(SIGNS))]
#: The bits of a word's last eight bytes or fewer, by their number.
FILLED = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
MIXED = np.uint64(0x9E3779B97F4A7C15)


def normalised(text: str) -> list[list[bytes]]:
    """The words of each line of a text."""
    return [line.split() for line in text.lower().encode("utf-8", "surrogatepass").translate(DIGITS, MARKS).split(b"\n")]


def weights(sizes: np.ndarray) -> np.ndarray:
    """Of words of so many bytes. Long words are rare and tell lines apart; short ones would make all lines alike."""
    return np.clip(sizes - 3, 1, HEAVIEST).astype(np.uint8)


def weight(word: bytes) -> int:
    return int(weights(np.int64(len(word))))


class Lines:
    """The lines with a word of several texts, as ``normalised`` gives them, found in one buffer."""

    def __init__(self, texts: list[str]):
        raw = np.frombuffer("\n".join([*texts, ""]).lower().encode("utf-8", "surrogatepass").translate(DIGITS, MARKS), np.uint8)
        breaks = raw == ord("\n")
        blank = breaks | (raw == ord(" "))
        starts = np.flatnonzero(np.r_[True, blank[:-1]] & ~blank)
        ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
        # Words and one blank after each are left.
        keep = ~blank
        keep[ends] = True
        self.words = raw[keep]
        self.offsets = np.r_[0, np.cumsum(ends - starts + 1)]
        self.words[self.offsets[1:] - 1] = ord(" ")
        before = np.searchsorted(ends, np.flatnonzero(breaks), side="right")
        sizes = np.diff(before, prepend=0)
        line = np.flatnonzero(sizes)
        self.sizes = sizes[line]
        self.first = before[line] - self.sizes
        counts = np.fromiter((t.count("\n") + 1 for t in texts), np.int64, len(texts))
        stops = np.cumsum(counts)
        self.rows = np.searchsorted(stops, line, side="right")
        self.numbers = line - (stops - counts)[self.rows]
        data, begins, closes = self.words.tobytes(), self.offsets[self.first].tolist(), (self.offsets[self.first + self.sizes] - 1).tolist()
        self.texts = [data[a:b] for a, b in zip(begins, closes)]

    def words_of(self, some: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Of the lines ``some``, in their order, each word's number, and the words these stand for; words are told apart by 64 bits."""
        wanted = np.zeros(len(self.sizes), bool)
        wanted[some] = True
        at = np.flatnonzero(np.repeat(wanted, self.sizes))
        starts, left = self.offsets[at], self.offsets[at + 1] - self.offsets[at] - 1
        eights = np.ndarray(len(self.words), "<u8", np.r_[self.words, np.zeros(8, np.uint8)], strides=(1,))
        keys, rest, place = left.astype(np.uint64) * MIXED, np.arange(len(at)), starts
        while len(rest):
            mixed = (keys[rest] ^ eights[place] & FILLED[np.minimum(left, 8)]) * MIXED
            keys[rest] = mixed ^ mixed >> np.uint64(29)
            more = np.flatnonzero(left > 8)
            rest, place, left = rest[more], place[more] + 8, left[more] - 8
        numbers = pa.array(keys.view(np.int64)).dictionary_encode().indices.to_numpy()
        place = np.empty(int(numbers.max(initial=-1)) + 1, np.int64)
        place[numbers] = at
        data = self.words.tobytes()
        return numbers, [data[a:b] for a, b in zip(self.offsets[place].tolist(), (self.offsets[place + 1] - 1).tolist())]


class Words:
    """What a task knows of words: weighted bits as 128 counters of one byte, eight to a number, and one bit each for parities."""

    def __init__(self, room: int = 0):
        self.ids: dict[bytes, int] = {}
        self.lanes, self.weights, self.signs = np.empty((BITS // 8, room), np.uint64), np.empty(room, np.uint8), np.zeros((SIGNS, room), np.uint64)

    def lookup(self, words: list[bytes]) -> np.ndarray:
        fresh = [w for w in dict.fromkeys(words) if w not in self.ids]
        if len(self.ids) + len(fresh) > len(self.weights):
            fresh = list(dict.fromkeys(words))
            self.__init__(max(REMEMBERED, len(fresh)))
        if fresh:
            new = np.arange(len(self.ids), len(self.ids) + len(fresh))
            self.ids.update(zip(fresh, new.tolist()))
            digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, fresh)), np.uint8).reshape(-1, BITS // 8)
            heavy = self.weights[new] = weights(np.fromiter(map(len, fresh), np.int64, len(fresh)))
            self.lanes[:, new[0] : new[-1] + 1] = (np.unpackbits(digests, axis=1) * heavy[:, None]).view(np.uint64).T
            hashes = digests[:, :8].copy().view(np.uint64).ravel()
            self.signs[(hashes >> np.uint64(6)) % np.uint64(SIGNS), new] = np.uint64(1) << (hashes & np.uint64(63))
        return np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))

    def sketches(self, lines: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Per line (with a word) two numbers, the weighted majority of its words' bits, and the parities of its words' own bits."""
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        return self.summed(self.lookup(list(chain.from_iterable(lines))), sizes)

    def summed(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of lines of ``sizes`` words, by the words' ids.

        Counters hold 255, so a line of many words is summed in parts.
        """
        parts = -(-sizes // PART)
        first = np.cumsum(sizes) - sizes
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = np.repeat(first, parts) + PART * nth
        # A number of all words at a time: what is fetched then stays in the processor's cache.
        fetched = np.empty(len(ids), np.uint64)
        counts = np.stack([np.add.reduceat(np.take(lane, ids, out=fetched, mode="clip"), starts) for lane in self.lanes], axis=1).view(np.uint8)
        ones = np.add.reduceat(counts.astype(np.int32), np.cumsum(parts) - parts, axis=0)
        total = np.add.reduceat(self.weights[ids], first, dtype=np.int32)
        signs = np.stack([np.bitwise_xor.reduceat(np.take(sign, ids, out=fetched, mode="clip"), first) for sign in self.signs], axis=1)
        return np.packbits(2 * ones > total[:, None], axis=1).view(np.int64), signs.view(np.int64)


def _described(docs: DataFrame) -> DataFrame:
    """``doc_id, key, line, node`` for every line with a word; a node is a normalised line.

    Where a batch first has a line long enough to be similar to another, also its
    ``text`` and what ``SKETCH`` names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()  # goes with the task: later stages need the memory
        for batch in slices(batches, most=BATCH):
            lines = Lines(batch.column("text").to_pylist())
            if not lines.texts:
                continue
            nodes = np.fromiter(map(xxhash.xxh3_64_intdigest, lines.texts), np.uint64, len(lines.texts)).view(np.int64) ^ np.int64(-1 << 63)
            long = np.flatnonzero(lines.sizes >= WORDS_AN_EDIT - 1)
            at = np.sort(long[np.unique(nodes[long], return_index=True)[1]])
            place = np.full(len(nodes), -1)
            place[at] = np.arange(len(at))
            where = pa.array(place, mask=place < 0)
            sims, signs = np.empty((0, 2), np.int64), np.empty((0, SIGNS), np.int64)
            if len(at):
                numbers, words = lines.words_of(at)
                sims, signs = known.summed(known.lookup(words)[numbers], lines.sizes[at])
            values = [pa.array([lines.texts[i] for i in at], pa.binary()), pa.array(lines.sizes[at], pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in (*sims.T, *signs.T))]
            take = pa.array(lines.rows)
            columns = [batch.column("doc_id").take(take), batch.column("key").take(take), pa.array(lines.numbers, pa.int32()), pa.array(nodes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(v.take(where) for v in values)], names=["doc_id", "key", "line", "node", "text", *SKETCH])

    return _keyed(docs).mapInArrow(run, "doc_id long, key long, line int, node long, text binary, n_words int" + "".join(f", {c} long" for c in SKETCH[1:]))


def _key():
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), F.coalesce("text", F.lit("")).alias("text"))


def _cut(high: np.ndarray, low: np.ndarray, number: int) -> np.ndarray:
    """The bits of a block."""
    start, stop = number * WIDTH, (number + 1) * WIDTH
    words = high.view(np.uint64), low.view(np.uint64)
    bits = lambda word, at, n: words[word] >> np.uint64(64 - at - n) & np.uint64((1 << n) - 1)
    if stop <= 64:
        found = bits(0, start, WIDTH)
    elif start >= 64:
        found = bits(1, start - 64, WIDTH)
    else:
        found = bits(0, start, 64 - start) << np.uint64(stop - 64) | bits(1, 0, stop - 64)
    return found.astype(np.int64)


def _class(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / np.log(CLASS)).astype(np.int64)


class Entered:
    """Rows of ``_buckets`` in a task: their part, node, word count, SimHash and parities, folded to one number."""

    NAMES = "part", "node", "n_words", "high", "low", "fold"

    def __init__(self, columns: list[np.ndarray]):
        self.columns = columns
        self.part, self.nodes, self.sizes, self.high, self.low, self.fold = columns

    @classmethod
    def unpacked(cls, held: list[np.ndarray]) -> Entered:
        """Packed rows in the order of their parts, each node once in a part."""
        found = np.concatenate(held)
        found = found[np.lexsort((found["node"], found["part"]))]
        found = found[np.r_[True, (found["node"][1:] != found["node"][:-1]) | (found["part"][1:] != found["part"][:-1])]]
        return cls([found[c].astype(np.int64) for c in cls.NAMES])

    @classmethod
    def of(cls, held: list[list[np.ndarray]]) -> Entered:
        return cls([np.concatenate(c) for c in zip(*held)])

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c) for c in self.columns], names=list(self.NAMES))

    def packed(self) -> np.ndarray:
        rows = np.empty(len(self.part), ENTRY)
        for name, column in zip(self.NAMES, self.columns):
            rows[name] = column
        return rows

    def some(self, start: int, stop: int) -> Entered:
        return Entered([c[start:stop] for c in self.columns])

    def may_be_similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """As ``_may_be_similar``, on the folded parities: no similar pair fails it."""
        edits, apart = np.maximum(self.sizes[a], self.sizes[b]) // WORDS_AN_EDIT, np.abs(self.sizes[a] - self.sizes[b])
        differing = np.bitwise_count((self.fold[a] ^ self.fold[b]).view(np.uint64)).astype(np.int64)
        return (apart <= edits) & (differing <= 2 * edits - apart)

    def met_before(self, a: np.ndarray, b: np.ndarray, second: int) -> np.ndarray:
        """Whether rows that meet with ``second`` as later block also meet in an earlier pair of blocks or a lower class."""
        first = self.part[a] >> WIDTH & 15
        before = _class(np.maximum(self.sizes[a], self.sizes[b])) != self.part[a] >> 4 + WIDTH
        for block in range(second):
            before |= (block != first) & (_cut(self.high[a], self.low[a], block) == _cut(self.high[b], self.low[b], block))
        return before

    def partnered(self, key: np.ndarray, some: np.ndarray, second: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Of ``key`` and the rows ``some`` that have it, those with a row of the same key that they may be similar to.

        Rows of a key that more than ``FEW`` share all stay. With ``second``, the later
        block of ``key``, keys go where all that may be similar have met before.
        """
        order = np.argsort(key, kind="stable")
        some, key = some[order], key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[starts, len(key)])
        kept, ends = np.repeat(n > FEW, n), np.repeat(np.where(n > FEW, 0, starts + n), n)
        new, group = n > FEW, np.repeat(np.arange(len(n)), n)
        at, step = np.arange(len(key)), 1
        while len(at := at[at + step < ends[at]]):
            near = at[self.may_be_similar(some[at], some[at + step])]
            kept[near] = kept[near + step] = True
            if second is not None:
                new[group[near[~self.met_before(some[near], some[near + step], second)]]] = True
            step += 1
        if second is not None:
            kept &= new[group]
        return key[kept], some[kept]

    def entries(self, partnered_only: bool, once: bool = False) -> pa.RecordBatch:
        """``bucket, node`` for every later second block, or for those alone where a row has a partner (with ``once``, if some have not met before)."""
        first, buckets, found = self.part >> WIDTH & 15, [], []
        for second in range(1, BLOCKS):
            some = np.flatnonzero(first < second)
            key = self.part[some] << 4 + WIDTH | second << WIDTH | _cut(self.high[some], self.low[some], second)
            if partnered_only and len(some):
                key, some = self.partnered(key, some, second if once else None)
            buckets.append(key)
            found.append(self.nodes[some])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(buckets)), pa.array(np.concatenate(found))], names=["bucket", "node"])


def _paired(batches: Iterator[pa.RecordBatch], once: bool = False) -> Iterator[pa.RecordBatch]:
    """``bucket, node`` of rows that share a second block with another of their ``part`` which may be similar; rows come in its order.

    Whole parts are sorted in memory. Of a part beyond ``HELD`` rows all entries are given,
    as they come: who shares one is found later, as for all buckets.
    """
    held, n, enough, broken = [], 0, 1 << 16, None
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append([batch.column(c).to_numpy() for c in Entered.NAMES])
            n += batch.num_rows
            if n < enough:
                continue
        if not n:
            continue
        rows = Entered.of(held)
        part = rows.part
        begun = int(np.searchsorted(part, broken, side="right")) if part[0] == broken else 0
        stop = n if batch is None else max(begun, int(np.searchsorted(part, part[-1])))  # the last part may go on
        last, broken = (n, part[-1]) if n - stop > HELD else (stop, broken)
        for low, high, partnered_only in ((0, begun, False), (begun, stop, True), (stop, last, False)):
            if high > low:
                yield rows.some(low, high).entries(partnered_only, once)
        held, n = [rows.some(last, n).columns], n - last
        enough = max(1 << 16, 2 * n)


#: A row of ``Entered`` as it travels.
ENTRY = np.dtype([(name, "<i4" if name in ("part", "n_words") else "<i8") for name in Entered.NAMES])


def _dealt(slots: int):
    """``slot, rows``: the lines once for each of their parts, those of one slot packed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
                n += batch.num_rows
                if n < DEALT:
                    continue
            if not n:
                continue
            column = lambda name: np.concatenate([b.column(name).to_numpy() for b in held])  # noqa: E731, B023
            high, low, sizes = column("high"), column("low"), column("n_words").astype(np.int64)
            lines = np.empty(n, ENTRY)
            lines["node"], lines["n_words"], lines["high"], lines["low"] = column("node"), sizes, high, low
            lines["fold"] = np.bitwise_xor.reduce([column(f"sign{i}") for i in range(SIGNS)])
            # Similar lines have a class in common: their own one, or that of the longest line either may be similar to.
            own, longest = _class(sizes), _class(sizes + sizes // (WORDS_AN_EDIT - 1))
            wider = np.flatnonzero(own != longest)
            at, classes = np.r_[np.arange(n), wider], np.r_[own, longest[wider]]
            part = np.concatenate([classes << 4 + WIDTH | i << WIDTH | _cut(high, low, i)[at] for i in range(BLOCKS - 1)])
            slot = ((part.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(slots)).astype(np.int32)
            order = np.argsort(slot)
            rows, slot = lines[np.tile(at, BLOCKS - 1)[order]], slot[order]
            rows["part"] = part[order]
            starts = np.flatnonzero(np.diff(slot, prepend=-1))
            offsets = (np.r_[starts, len(rows)] * ENTRY.itemsize).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(rows.view(np.uint8))])
            yield pa.RecordBatch.from_arrays([pa.array(slot[starts].astype(np.int64)), packed], names=["slot", "rows"])
            held, n = [], 0

    return run


def _met(once: bool):
    """``_paired`` for each slot. Of a slot beyond ``HELD`` rows all entries are given, as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = chain.from_iterable(zip(b.column("slot").to_pylist(), b.column("rows")) for b in batches)
        place, held, n, crowd = None, [], 0, False
        for slot, rows in chain(packed, [(None, None)]):
            if slot != place:
                if held:
                    yield from _paired(iter([Entered.unpacked(held).batch()]), once)
                place, held, n, crowd = slot, [], 0, False
            if rows is None:
                continue
            held.append(np.frombuffer(rows.as_buffer(), ENTRY))
            n += len(held[-1])
            if crowd or n > HELD:
                found = Entered.unpacked(held)
                if crowd := crowd or 2 * len(found.part) > HELD:
                    yield found.entries(False)
                    held = []
                else:
                    held, n = [found.packed()], len(found.part)

    return run


def _buckets(nodes: DataFrame, once: bool = False) -> DataFrame:
    """``bucket, node``: two equal blocks, and a class that holds the word counts of similar lines.

    Lines are dealt by one block and class; the second block is compared there, and
    with the parities it is seen who has nothing to be compared with. With ``once``
    buckets are left out whose lines that may be similar all meet in others. Nodes may
    stand in several rows.
    """
    slots = nodes.count() * (BLOCKS - 1) * 5 // 4 // SLOT + 1
    rows = nodes.select("node", *SKETCH).mapInArrow(_dealt(slots), "slot long, rows binary")
    return rows.repartition("slot").sortWithinPartitions("slot").mapInArrow(_met(once), "bucket long, node long")


def edit_distance(a: list[bytes], b: list[bytes]) -> int:
    """Words to insert, delete or replace, a row of the table at a time as bits of one number (Myers, Hyyrö)."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    places: dict[bytes, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << i
    full, last, score = (1 << len(a)) - 1, len(a) - 1, len(a)
    up, down = full, 0
    for word in b:
        same = places.get(word, 0)
        diagonal = same | down
        across = (((same & up) + up) ^ up) | same
        plus, minus = (down | ~(across | up)) & full, up & across
        score += (plus >> last & 1) - (minus >> last & 1)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal
    return score


def similar(a: list[bytes], b: list[bytes]) -> bool:
    edits = max(len(a), len(b)) // WORDS_AN_EDIT
    return abs(len(a) - len(b)) <= edits and edit_distance(a, b) <= edits


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text_a", BATCH):
        keep = [similar(a.split(), b.split()) for a, b in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist())]
        kept = batch.filter(pa.array(keep, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], names=["a", "b"])


class SignedLines:
    """Lines of one group, of which those are found that may be similar to another."""

    def __init__(self, rows: list[dict]):
        self.signs = np.array([[r[f"sign{i}"] for i in range(SIGNS)] for r in rows], np.int64).reshape(-1, SIGNS).view(np.uint64)  # bits of negative numbers are not counted
        self.sizes = np.array([r["n_words"] for r in rows], np.int64)

    def like(self, row: dict, among: np.ndarray) -> np.ndarray:
        sizes, own = self.sizes[among], row["n_words"]
        edits, apart = np.maximum(sizes, own) // WORDS_AN_EDIT, np.abs(sizes - own)
        differing = np.bitwise_count(self.signs[among] ^ np.array([row[f"sign{i}"] for i in range(SIGNS)], np.int64).view(np.uint64)).sum(axis=1, dtype=np.int64)
        return among[(apart <= edits) & (differing <= 2 * edits - apart)]


def _may_be_similar():
    """An added or taken word changes one parity, another word in its place two: no similar pair fails this."""
    edits, apart = F.floor(F.greatest("n_words_a", "n_words_b") / WORDS_AN_EDIT), F.abs(F.col("n_words_a") - F.col("n_words_b"))
    differing = sum((F.bit_count(F.col(f"sign{i}_a").bitwiseXOR(F.col(f"sign{i}_b"))) for i in range(SIGNS)), F.lit(0))
    return (apart <= edits) & (differing <= 2 * edits - apart)


def _linked(rows: DataFrame) -> DataFrame:
    """``node, root`` of the lines that share a bucket with a similar one."""
    described = rows.filter("n_words is not null").drop("doc_id", "key", "line")
    signs = ["node", "n_words", *(f"sign{i}" for i in range(SIGNS))]

    def prepare(nodes: DataFrame):
        known = cut_lineage(described.select("text", *signs).join(nodes.hint("shuffle_hash"), "node", "left_semi").dropDuplicates(["node"]))

        def check(pairs: DataFrame) -> DataFrame:
            close = pairs.select("a", "b").distinct()
            for side in "ab":
                close = close.join(known.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side)
            return close.mapInArrow(_confirmed, "a long, b long")

        return known.select(*signs), lambda pairs: check(pairs.filter(_may_be_similar())), SignedLines, check

    return link(cut_lineage(_buckets(described, once=True)), prepare)[0]


def _dropped(docs: DataFrame) -> DataFrame:
    """``doc_id, key, drop``: the line numbers that go, per document that loses any."""
    with scratch_scope() as made:
        rows = cut_lineage(_described(docs))
        lines = rows.select("doc_id", "key", "line", "node")
        nodes = lines.groupBy("node").agg(F.count(F.lit(1)).alias("n")).join(_linked(rows), "node", "left")
        grouped = cut_lineage(nodes.filter("n > 1 or root is not null").select("node", F.coalesce("root", "node").alias("root")))
        repeated = cut_lineage(lines.join(grouped, "node").select("root", "doc_id", "key", "line"))
        position = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "line")
        kept = repeated.groupBy("root").agg(F.min(position).alias("kept"))
        gone = repeated.join(kept, "root").filter(~position.eqNullSafe(F.col("kept")))
        drops = cut_lineage(gone.groupBy("doc_id", "key").agg(F.collect_set("line").alias("drop")))
    delete_scratch(docs.sparkSession, made, drops.inputFiles())
    return drops


def dedup_lines(docs: DataFrame, n_lines: str | None = None, n_dropped: str | None = None) -> DataFrame:
    """``docs`` with ``text`` (and ``n_chars``, if it is there) without repeated lines.

    Lines are compared in lower case, without ASCII marks and with 0 for each digit.
    Equal lines form groups, and with them lines that differ in at most one word of
    ``WORDS_AN_EDIT`` (of the longer line): all whose SimHashes agree in two blocks, as
    most such pairs do (README), and some others. Of each connected group the line of
    the smallest id stays (of one document's lines the first) and the others go, in
    all documents. Lines without a word stay. Null texts stay null; a null id counts after all
    others. Rows alike in id and text are treated alike. ``n_lines`` and ``n_dropped``
    name columns to add.
    """
    drops = _dropped(docs).select(F.col("key").alias("__lines_key"), F.col("drop").alias("__lines_drop")).hint("shuffle_hash")
    key = spare(docs, "__lines_of")
    rows = docs.withColumn(key, _key()).join(drops, F.col(key) == F.col("__lines_key"), "left")
    lines = F.split("text", "\n")
    left = F.array_join(F.filter(lines, lambda _, i: ~F.array_contains("__lines_drop", i)), "\n")
    text = F.when(F.col("__lines_drop").isNull(), F.col("text")).otherwise(left)
    counts = {n_lines: F.coalesce(F.size(lines), F.lit(0)).cast("long"), n_dropped: F.coalesce(F.size("__lines_drop"), F.lit(0)).cast("long")}
    rows = rows.withColumns({name: value for name, value in counts.items() if name}).withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns, *(name for name in (n_lines, n_dropped) if name))
