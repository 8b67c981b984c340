"""A small table with everything that may go wrong in it, and plain references."""

import re
import zlib
from collections import Counter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, kept boolean, size long, key string, node long, line int, ids string, bucket long, score double"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(seed: int, n: int) -> str:
    state, found = seed * 7919 + 17, []
    for _ in range(n):
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        found.append("".join("etaoinshrdlu"[(state >> (8 + 5 * i)) % 12] for i in range(2 + (state >> 60) % 6)))
    return " ".join(found)


LONG = sentence(1, 60_000)


def texts() -> list[tuple]:
    """``doc_id, text, lang, source``: copies, near copies, nulls, blanks, ties and one very long text."""
    base = sentence(2, 120)
    near = base.replace(base.split()[60], "zzz", 1)
    shared = "A line that many documents share, word for word, to be sure."
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", "b"), (3, near, "en", "b"), (4, base.upper(), "fr", "b"),
        (5, None, None, None), (6, "", "en", None), (7, " \t\n \x0b", None, "a"), (8, "One", "de", "c"), (9, "Two words", "de", "c"),
        (None, sentence(3, 80), "en", "a"), (None, None, "en", "a"), (10, LONG, "en", "a"), (11, "\u00c4 \u00df \u20ac \U0001f600 \u0130 x", "fr", "\u00e9"),
        (12, "### $$$ " * 40 + sentence(4, 60), "en", "a"), (13, "a b c " * 50, "en", "a"), (14, "<|endoftext|> it's <|startoftext|>", "en", "c"),
    ]
    rows += [(20 + i, f"{shared}\n{sentence(50 + i, 70)}\nA line that many documents share, word for word, to be {i}.", "en" if i % 3 else "de", f"s{i % 2}") for i in range(12)]
    return rows


def frame(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), 1, False, 2, "k", 3, 4, "i", 5, 6.0) for r in rows], SCHEMA)


def lower(text):
    return (text or "").translate(ASCII_LOWER)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def crc(value, parts):
    return None if value is None else zlib.crc32(str(value).encode()) % parts


def shingles(text, size):
    found = words(lower(text))
    if not found:
        return frozenset()
    size = min(size, len(found))
    return frozenset(tuple(found[i : i + size]) for i in range(len(found) - size + 1))


class Groups:
    """Connected components, the plain way."""

    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def root(self, n):
        while self.up[n] != n:
            n = self.up[n] = self.up[self.up[n]]
        return n

    def tie(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)


def counted(rows):
    return Counter(map(tuple, rows))
