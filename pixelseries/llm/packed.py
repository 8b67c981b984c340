"""Token ids as files of fixed-width bits: written in the order of the ids, read back whole or by position."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .batches import slices
from .bpe import byte_symbols

#: A block ends with the document that takes it to this many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 16
#: Files of one group when positions are summed up.
FILES = 1024
#: Text bytes encoded at once; distinct words and their bytes that a worker remembers.
BATCH = 2 << 20
REMEMBERED, REMEMBERED_BYTES = 400_000, 64 << 20
#: All but the last of several blanks, or the blanks that end a text; blanks besides the two common ones; characters that libraries class differently.
BLANK_RUN = re.compile(r"(\s+(?=\s\S)|\s+\Z)")
OTHER_BLANK = re.compile(r"[^\S \n]")
DOUBTFUL = re.compile("[\x1c-\x1f\x85\u180e]")
#: Marks a word that no blank stands before; a line end and the mark of the word after it; new words in one call.
FIRST = "\0"
LINE = f" \n {FIRST}"
#: Fixed value: how byte-level vocabularies of this kind split a text.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this character both libraries class all others alike.
ALIKE = "\u0250"
BLOCKS = "file int, block int, start long, n int, width int, packed binary, doc_ids array<long>, ends array<int>"


def width_of(size: int) -> int:
    """Bits that the ids of a vocabulary of ``size`` need."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids of at most 32 bits one after another, low bits first, in little-endian words of 32."""
    if not len(ids):
        return b""
    bits = np.arange(len(ids), dtype=np.int64) * width
    word, shifted = bits >> 5, ids.astype(np.uint64) << (bits & 31).astype(np.uint64)
    out = np.zeros((len(ids) * width + 31 >> 5) + 1, np.uint32)
    # In each word begins an id, so the words' parts stand together; at most one id reaches into the next.
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out[word[first]] = np.bitwise_or.reduceat((shifted & np.uint64(0xFFFFFFFF)).astype(np.uint32), first)
    over = (shifted >> np.uint64(32)).astype(np.uint32)
    reaching = np.flatnonzero(over)
    out[word[reaching] + 1] |= over[reaching]
    return out[:-1].astype("<u4").tobytes()


def unpack(packed: bytes, width: int, first: int, n: int) -> np.ndarray:
    """The ids ``first .. first + n - 1`` of a block, without touching the others."""
    bits = np.arange(first, first + n, dtype=np.int64) * width
    low, high = first * width >> 5, ((first + n) * width + 31 >> 5) + 1
    words = np.frombuffer(packed, "<u4")[low:high].astype(np.uint64)
    words = np.r_[words, np.zeros(2, np.uint64)]
    at = (bits >> 5) - low
    both = words[at] | words[at + 1] << np.uint64(32)
    return ((both >> (bits & 31).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.uint32)


class Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key: str) -> int:
        number = self[key] = len(self)
        return number


class Encoder:
    """The library's ids of whole texts; each distinct word is encoded once.

    This vocabulary cuts a text before any blank between two other characters and
    around any line end between two such, whatever stands farther off. Cut there, the parts
    have the ids they have in the text. Texts with a special token, or with
    characters whose class libraries differ about, are encoded as a whole. New words
    of Latin letters go to a second, faster library with the same vocabulary.
    """

    def __init__(self, text: str):
        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        self.size = self.library.get_vocab_size()
        spec = json.loads(text)
        self.special = [t["content"] for t in spec["added_tokens"]]
        # Only the byte-level split is known to cut there; any other vocabulary gets whole texts.
        self.cuts = spec["normalizer"] is None and (spec["pre_tokenizer"] or {}).get("type") == "ByteLevel" and not spec["pre_tokenizer"]["add_prefix_space"]
        self.quick = self._quick(spec["model"]) if self.cuts else None
        self.forget()

    @staticmethod
    def _quick(model: dict) -> tiktoken.Encoding | None:
        """The same vocabulary for the faster library, if its ids are in the order of its merges; that library wants no more."""
        marks = {c: b for b, c in enumerate(byte_symbols())}
        ids = {name: i for name, i in model["vocab"].items() if all(c in marks for c in name)}
        merged = [ids.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        if merged != list(range(256, 256 + len(merged))) or {ids.get(c) for c in marks} != set(range(256)):
            return None
        ranks = {bytes(marks[c] for c in name): i for name, i in ids.items() if i < 256 + len(merged)}
        return tiktoken.Encoding("packed", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def forget(self) -> None:
        self.words, self.held = Numbered(), 0
        self.lengths, self.table = np.empty(0, np.int64), np.empty(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def learn(self, words: list[str]) -> None:
        """Add the ids of new words."""
        real = [w[1:] if w[0] == FIRST else w if w[0].isspace() else " " + w for w in words]
        other = [i for i, w in enumerate(real) if self.quick is None or not (w.isascii() or max(w) < ALIKE)]
        coded = [self.quick.encode_ordinary(w) for w in real] if self.quick else [[]] * len(real)
        for i, own in zip(other, self.whole([real[i] for i in other])):
            coded[i] = own
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        self.lengths = np.concatenate([self.lengths, lengths])
        self.table = np.concatenate([self.table, np.fromiter(chain.from_iterable(coded), np.uint32, int(lengths.sum()))])
        self.held += sum(map(len, real))

    def parts(self, text: str) -> list[str] | None:
        """The words of a text: with the blank before them, but for runs of blanks, line ends, and words marked ``FIRST``. None if it can't be cut."""
        if not self.cuts or FIRST in text or "\u180e" in text or any(s in text for s in self.special):
            return None
        other = OTHER_BLANK.search(text) is not None
        if other and DOUBTFUL.search(text):
            return None
        if not other and not any(pair in text for pair in ("  ", "\n\n", " \n", "\n ")) and not text[-1:].isspace():
            return (FIRST + text).replace("\n", LINE).split(" ")
        found: list[str] = []
        for number, segment in enumerate(BLANK_RUN.split(text)):
            found += [segment] if number % 2 else (FIRST + segment).replace("\n", LINE).split(" ")
        return found

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.words) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.forget()
        rows: list = [None] * len(texts)
        cut = {i: parts for i, t in enumerate(texts) if (parts := self.parts(t)) is not None}
        odd = [i for i in range(len(texts)) if i not in cut]
        for i, ids in zip(odd, self.whole([texts[i] for i in odd])):
            rows[i] = ids
        before, sizes = len(self.words), np.fromiter(map(len, cut.values()), np.int64, len(cut))
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(cut.values())), np.int32, int(sizes.sum()))
        if len(self.words) > before:
            self.learn(list(islice(self.words, before, None)))
        starts, n = np.cumsum(self.lengths) - self.lengths, self.lengths[at]
        ends = np.cumsum(n)
        ids = self.table[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
        upto = np.r_[0, ends][np.cumsum(sizes)]
        for i, part in zip(cut, np.split(ids, upto[:-1])):
            rows[i] = part
        return rows


_LOADED: dict[int, Encoder] = {}


def _encoder(number: int, text: str) -> Encoder:
    if number not in _LOADED:
        _LOADED.clear()
        _LOADED[number] = Encoder(text)
    return _LOADED[number]


def _blocks(docs: DataFrame, vocabulary: str, end_id: int, block_ids: int) -> DataFrame:
    with open(vocabulary, encoding="utf-8") as file:
        text = file.read()
    number, sent = hash(text), docs.sparkSession.sparkContext.broadcast(text)  # of a size that does not grow with the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = _encoder(number, sent.value), TaskContext.get().partitionId()
        width, block, start = width_of(encoder.size), 0, 0
        doc_ids, held, n = [], [], 0

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(h) for h in held])
            values = [file, block, start, n, width, pack(np.concatenate(held), width), doc_ids, ends.tolist()]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["file", "block", "start", "n", "width", "packed", "doc_ids", "ends"])

        for batch in slices(batches, most=BATCH):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(batch.column("text").to_pylist())):
                doc_ids.append(doc_id)
                held.append(np.append(ids, np.uint32(end_id)))
                n += len(ids) + 1
                if n >= block_ids:
                    yield row()
                    block, start = block + 1, start + n
                    doc_ids, held, n = [], [], 0
        if held:
            yield row()

    key = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", key[1].alias("tie"), key[2].alias("place"))
    ordered = rows.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place")
    return ordered.select("doc_id", "text").mapInArrow(run, BLOCKS)


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text, add ``end_id``, and write all ids in ascending order of ``doc_id``.

    ``path/blocks`` has one row per block of about ``block_ids`` ids, one file per range of
    documents: the number of the file and of the block, the block's ``start``
    in its file, its ids in ``width`` bits each (the fewest that hold the vocabulary), and the ids
    and ends of its documents. ``path/files`` has the position at which each file
    begins among all ids. A block can be read without any other.

    Null and empty texts have the end id alone. Null ids come first. Rows of one id are ordered by
    their texts' hashes, equal rows take a place each. A table without rows gives
    files without rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    _blocks(docs, vocabulary, end_id, block_ids).write.parquet(f"{path}/blocks")
    sizes = read_blocks(spark, path).groupBy("file").agg(F.sum("n").cast("long").alias("n")).withColumn("part", F.floor(F.col("file") / FILES))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", before(W.orderBy("part")).alias("base"))  # a row per 1,024 files
    within = sizes.withColumn("inner", before(W.partitionBy("part").orderBy("file")))
    within.join(parts, "part").select("file", (F.col("base") + F.col("inner")).alias("base"), "n").write.parquet(f"{path}/files")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


def _placed(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """``rows`` with the ``base`` of their file: a table of one row per file."""
    return rows.join(spark.read.schema("file int, base long, n long").parquet(f"{path}/files").select("file", "base"), "file")


def read_documents(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if wanted, ``ids`` (end id included) of every document of the files.

    ``start`` counts the ids of all documents before; the checksum is that of the
    ids as little-endian numbers of 32 bits.
    """
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                r = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                found = unpack(r["packed"], r["width"], 0, r["n"])
                ends = np.array(r["ends"], np.int64)
                starts, data = np.r_[0, ends[:-1]], memoryview(found.astype("<u4").tobytes())
                crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                arrays = [pa.array([r["file"]] * len(ends), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["start"]), pa.array(ends - starts), pa.array(crcs, pa.int64())]
                names = ["file", "doc_id", "inner", "n_tokens", "ids_crc32"]
                if ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(found.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "file int, doc_id long, inner long, n_tokens long, ids_crc32 long" + (", ids array<int>" if ids else "")
    rows = _placed(spark, path, read_blocks(spark, path).mapInArrow(run, schema))
    return rows.select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))


def read_range(spark: SparkSession, path: str, first: int, n: int) -> DataFrame:
    """``position, id`` of the ``n`` ids from position ``first`` on (fewer at the end): only the blocks that hold them are unpacked."""
    blocks = _placed(spark, path, read_blocks(spark, path).select("file", "start", "n", "width", "packed"))
    blocks = blocks.withColumn("start", F.col("base") + F.col("start")).filter((F.col("start") < first + n) & (F.col("start") + F.col("n") > first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                low, high = max(first - row["start"], 0), min(first + n - row["start"], row["n"])
                found = unpack(row["packed"], row["width"], low, high - low)
                yield pa.RecordBatch.from_arrays([pa.array(row["start"] + np.arange(low, high)), pa.array(found.astype(np.int32))], names=["position", "id"])

    return blocks.select("start", "n", "width", "packed").mapInArrow(run, "position long, id int")
