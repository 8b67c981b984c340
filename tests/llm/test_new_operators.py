"""Manifest, packed ids and spelling variants against plain references."""

import hashlib
import random
import zlib
from collections import Counter

import messy
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pixelseries.llm import merkle, packed, spellings
from pixelseries.llm.queries import byte_vocabulary

TAKEN = "doc_id long, text string, lang string, source string, n_chars long, grp string, pos long, path string, top string, part int, tie long, word string, n long, form string, root string, start long, base long, file string"


def frame(spark, rows):
    """Rows of ``doc_id, text, lang, source`` among columns whose names operators use themselves."""
    full = [(*r, None if r[1] is None else len(r[1]), "g", 7, "p", "t", 1, 2, "w", 3, "f", "r", 5, 6, "x") for r in rows]
    return spark.createDataFrame(full, TAKEN)


# --- manifest ----------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes, arity):
    """The root, and per leaf the ``(left, right)`` digests of its ancestors."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + arity] for i in range(0, len(nodes), arity)]
        for i, place in enumerate(at):
            run, slot = runs[place // arity], place % arity
            paths[i].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
        at, nodes = [a // arity for a in at], [sha("".join(r)) for r in runs]
    return nodes[0], paths


def plain_manifest(rows, arity=2):
    groups = {}
    for doc_id, text, lang, source in rows:
        n_chars = None if text is None else len(text)
        groups.setdefault(lang, []).append((doc_id, leaf(doc_id, source, lang, n_chars, text), doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and leaf(doc_id, source, lang, None if n_chars is None else n_chars + 1, text)))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = plain_tree([r[1] for r in groups[lang]], arity)
    root, ends = plain_tree([trees[g][0] for g in langs], arity)
    out = []
    for lang, end in zip(langs, ends):
        for (doc_id, own, claimed), path in zip(groups[lang], trees[lang][1]):
            folded = claimed or own
            for left, right in path + end:
                folded = sha(left + folded + right)
            out.append((doc_id, own, trees[lang][0], root, sha("".join(a + b for a, b in path + end)), folded, folded == root))
    return Counter(out)


def test_manifest_equals_the_plain_trees(spark):
    rows = messy.texts() + [(700 + i, f"text {i % 5}", "en" if i % 3 else None, "s") for i in range(61)]
    found = merkle.tampered_check(frame(spark, rows))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = Counter(map(tuple, found.collect()))
    assert got == plain_manifest(rows)
    assert 0 < sum(n for r, n in got.items() if not r[-1]) < len(rows) / 2


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_manifest_over_many_blocks_and_any_arity(spark, monkeypatch, arity):
    monkeypatch.setattr(merkle, "SPAN", arity**2)
    rows = [(i, f"t{i}", "ab"[i % 40 == 0], "s") for i in range(3 * arity**4 + 7)]
    found = merkle.manifest(frame(spark, rows), arity=arity)
    assert found.columns == ["doc_id", "lang", "leaf", "subroot", "root", "path"]
    checked = found.select("leaf", "root", merkle.proof(F.col("path")).alias("proof"), merkle.folded(F.col("leaf"), F.col("path")).alias("folded")).collect()
    want = plain_manifest(rows, arity)
    assert all(r.root == r.folded for r in checked)
    assert Counter((r.leaf, r.root, r.proof) for r in checked) == Counter((w[1], w[3], w[4]) for w in want)


def test_manifest_of_few_rows(spark):
    assert merkle.tampered_check(frame(spark, [])).collect() == []
    for rows in ([(None, None, None, None)], [(1, "a", "en", "s")] * 5, [(None, "x", None, None)] * 3 + [(0, "", "", "")]):
        assert Counter(map(tuple, merkle.tampered_check(frame(spark, rows)).collect())) == plain_manifest(rows)
    only = merkle.tampered_check(frame(spark, [(1, "a", "en", "s")])).first()
    assert only.leaf == only.subroot == only.root and only.proof_sha256 == sha("")


def test_any_change_of_a_row_fails_its_proof(spark):
    rows = [(i, f"t{i}", "en", "s") for i in range(20)]
    wrong = merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.concat("text", F.lit(" ")))
    found = merkle.manifest(frame(spark, rows), leaf_of={"wrong": wrong})
    assert found.filter(merkle.folded(F.col("wrong"), F.col("path")) == F.col("root")).isEmpty()


# --- packed ids --------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 2, 7, 8, 13, 16, 17, 24, 31, 32])
def test_packing_returns_every_range(width):
    rng = np.random.default_rng(width)
    for n in (0, 1, 2, 31, 32, 33, 1000):
        ids = rng.integers(0, 2**width, n, dtype=np.uint64).astype(np.uint32)
        data = packed.pack(ids, width)
        assert len(data) == 4 * -(-n * width // 32)
        assert (packed.unpack(data, width, 0, n) == ids).all()
        for _ in range(20 if n else 0):
            first = int(rng.integers(0, n))
            size = int(rng.integers(0, n - first + 1))
            assert (packed.unpack(data, width, first, size) == ids[first : first + size]).all()


def test_bits_of_a_vocabulary():
    assert [packed.width_of(n) for n in (1, 2, 3, 256, 257, 50_257, 65_536, 65_537)] == [1, 1, 2, 8, 9, 16, 16, 17]


BLANKS = [" ", "  ", "\n", "\n\n", " \n", "\n ", "\t", " \t ", "\r\n", "\xa0", " \xa0", "　", "\x85", "\x1c", "᠎", "​", "\v\f", "   \n\n  ", ""]
WORDS = ["it's", "we'll", "'s", "don't'", "a", "Zürich", "123", "1st", "...", "<|endoftext|>", "x<|endoftext|>y", "<|endof", "日本語", "😀", "é", "İ", "_", "#!?", "ﬁ", "؀", "x" * 300, "1" * 50]


def test_words_encoded_apart_are_the_librarys_ids():
    with open(byte_vocabulary(), encoding="utf-8") as file:
        encoder = packed.Encoder(file.read())
    library = Tokenizer.from_file(byte_vocabulary())
    rng = random.Random(5)
    texts = ["", " ", "\n", "a ", " a", "a\n", *BLANKS]
    plain, usual = [w for w in WORDS if "<|endoftext|>" not in w], [b for b in BLANKS if not packed.DOUBTFUL.search(b)]
    for words, blanks in ((plain, usual), (WORDS, BLANKS)):
        texts += ["".join(rng.choice(words) + rng.choice(blanks if rng.random() < 0.5 else [" ", "\n"]) for _ in range(rng.randrange(1, 30))) for _ in range(1000)]
    texts += [rng.choice(usual) + t for t in texts[:200]]
    assert sum(encoder.parts(t) is not None for t in texts) > len(texts) / 2
    for some in (texts[:700], texts[700:]):
        for text, ids in zip(some, encoder.encode(some)):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def plain_packed(rows):
    """Rows of ``doc_id, start, n_tokens, crc``; the order of rows with one id is the files' own."""
    library = Tokenizer.from_file(byte_vocabulary())
    return [(d, [*library.encode(t or "", add_special_tokens=False).ids, 0]) for d, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))]


def test_files_hold_all_ids_in_order(spark, tmp_path):
    rows = messy.texts()
    path = str(tmp_path / "ids")
    packed.write_ids(frame(spark, rows), path, byte_vocabulary(), block_ids=500)
    found = packed.read_documents(spark, path).orderBy("start").collect()
    want = plain_packed(rows)
    assert [r.doc_id for r in found] == [d for d, _ in want]
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == Counter((d, tuple(i)) for d, i in want)
    position = 0
    for r in found:
        assert (r.start, r.n_tokens) == (position, len(r.ids))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        position += r.n_tokens
    every = [i for r in found for i in r.ids]
    for first, n in ((0, 10), (490, 30), (position - 5, 50), (1000, 0), (position, 3)):
        got = packed.read_range(spark, path, first, n).orderBy("position").collect()
        assert [r.id for r in got] == every[first : first + n] and [r.position for r in got] == list(range(first, min(first + n, position)))
    blocks = packed.read_blocks(spark, path).collect()
    assert len(blocks) > 3 and {b.width for b in blocks} == {16} and all(len(b.packed) == 4 * -(-b.n // 2) for b in blocks)


def test_files_of_an_empty_table_and_of_repeats(spark, tmp_path):
    packed.write_ids(frame(spark, []), str(tmp_path / "none"), byte_vocabulary())
    assert packed.read_documents(spark, str(tmp_path / "none")).collect() == [] and packed.read_range(spark, str(tmp_path / "none"), 0, 5).collect() == []
    packed.write_ids(frame(spark, [(1, "same", "en", "s")] * 40 + [(None, None, None, None)] * 2).repartition(5), str(tmp_path / "same"), byte_vocabulary())
    found = packed.read_documents(spark, str(tmp_path / "same"), ids=False).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in found] == [(None, 0, 1), (None, 1, 1)] + [(1, 2 + 2 * i, 2) for i in range(40)]


# --- spelling variants -------------------------------------------------------


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_spellings(rows):
    import re

    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(messy.ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return plain_forms({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})


def plain_forms(words):
    near = {w: [v for v in words if one_apart(v, w)] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return out


def variants(seed, n):
    """Words and their misspellings, with umlauts, doubled letters and a chain of forms."""
    rng = random.Random(seed)
    letters = "aabbcdeéüÿß"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 10))) for _ in range(n)]
    out = []
    for stem in stems:
        at = rng.randrange(len(stem))
        out += [stem] * rng.choice([3, 7, 20]) + [stem[:at] + rng.choice(letters) + stem[at + rng.randrange(2) :]] * 3 + [stem[:at] + stem[at + 1 :]] * 3
    return out


def test_spellings_equal_all_pairs(spark):
    rows = messy.texts() + [(900 + i, " ".join(variants(i, 12)), "en", "s") for i in range(6)]
    rows += [(None, "Wordy wordy, WORDY! wörds×words", "en", "s")] * 4 + [(7, "×÷ aaaaa " + "aaaa " * 9 + "aaaaaa " * 9, "en", "s")] * 3
    rows += [(950, " ".join(["chainx"] * 3 + ["chainxy"] * 8 + ["chainxyz"] * 30 + ["chainxyzz"] * 90), "en", "s")]
    found = spellings.spellings(frame(spark, rows))
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = list(map(tuple, found.collect()))
    want = plain_spellings(rows)
    assert len(got) == len(want) and set(got) == want
    assert sum(r[1] is not None for r in got) > 20 and any(r[1] != r[2] and r[1] for r in got)


def test_long_runs_and_chosen_occurrences():
    long, runs = "é" * 40 + "b" * 30, spellings.Runs()
    ids = list(range(400))
    runs.add(ids, [f"{long} abcdef" for _ in ids])
    found = dict(zip(*(c.to_pylist() for c in runs.counted().columns)))
    want = Counter()
    for i in ids:
        for w in (long, "abcdef"):
            h = zlib.crc32(f"{i}:{w}".encode())
            want[w if h % 97 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    assert found == want and len(want) > 2


def test_near_words_of_a_shard_cut_into_many_indexes(spark, monkeypatch):
    words = {w: 3 + i % 17 for i, w in enumerate(sorted(set(variants(1, 150)) | {"prefix" + a + b for a in "abcdefghij" for b in "klmnopqrst"} | {"z" * 3000, "z" * 3001}))}
    words = {w: n for w, n in words.items() if len(w) >= 5}
    near = lambda: {tuple(r) for r in spellings.near_words(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    whole = near()
    monkeypatch.setattr(spellings, "INDEXED", 20)
    monkeypatch.setattr(spellings, "ASKED", 7)
    want = set()
    for w in words:
        found = [v for v in words if one_apart(v, w)] if len(w) < 2000 else [v for v in words if abs(len(v) - len(w)) == 1]
        if found:
            best = min(found, key=lambda v: (-words[v], v))
            want.add((w, len(found), best, words[best]))
    assert whole == want and near() == want


def test_spellings_of_an_empty_table(spark):
    assert spellings.spellings(frame(spark, [])).collect() == []
    assert spellings.spellings(frame(spark, [(1, None, None, None), (2, "", "en", "s"), (3, "once upon", "en", "s")])).collect() == []
