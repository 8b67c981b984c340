"""Language model, near-duplicates, tokens, languages and lines against plain references."""

import hashlib
import json
import math
from collections import Counter, defaultdict

import messy
import numpy as np
import public_tokenizers
import pytest
import tokenizers

from pixelseries.llm import bpe, graph, langid, lines, lm, near_dups

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def corpus(spark, n=240):
    """Repeating words with rare ones between."""
    rows = []
    for i in range(n):
        common, rare = messy.sentence(i % 7, 30), messy.sentence(1000 + i, 6)
        rows.append((i, f"{common} {rare} {common}", "en", "a"))
    return messy.frame(spark, rows), rows


# --- language model ----------------------------------------------------------

def plain_base(rows):
    tokens = [[*messy.words(messy.lower(t)), None] for _, t, _, _ in rows]
    counts = Counter(w for (i, *_), ws in zip(rows, tokens) if messy.crc(i, 7) != 2 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return [(i, messy.crc(i, 7) == 2, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, *_), ws in zip(rows, tokens)]


def plain_model(rows):
    """The same model from dictionaries, its weights learned on the single events."""
    docs = [(messy.crc(i, 7), [*messy.words(messy.lower(t)), None]) for i, t, _, _ in rows]
    def count(keep):
        one, two = Counter(), Counter()
        for part, ws in docs:
            if keep(part):
                one.update(ws)
                two.update(zip([None, *ws], ws))
        return one, two
    one, two = count(lambda p: p not in (2, 3))
    n, v = sum(one.values()), len(one)
    bucket, chances = [], []
    for part, ws in docs:
        if part == 3:
            for a, b in zip([None, *ws], ws):
                bucket.append(0 if one[a] == 0 else int(math.log2(one[a])) + 1)
                chances.append([two[a, b] / max(one[a], 1), one[b] / n, 1 / (v + 1)])
    weights = lm.learn_weights(np.array(bucket), np.array(chances), np.ones(len(bucket)))
    one, two = count(lambda p: p != 2)
    n, v = sum(one.values()), len(one)
    found = {}
    for (i, *_), (_, ws) in zip(rows, docs):
        total = 0.0
        for a, b in zip([None, *ws], ws):
            w = weights[0 if one[a] == 0 else int(math.log2(one[a])) + 1]
            total += math.log10(w[0] * two[a, b] / max(one[a], 1) + w[1] * one[b] / n + w[2] / (v + 1))
        found[i] = total
    return found


@pytest.mark.parametrize("block", [200, 10**6])
def test_scores_equal_plain_counts(spark, block):
    docs, rows = corpus(spark)
    found = lm.score(docs.repartition(3), block_tokens=block).collect()
    assert messy.counted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == messy.counted(plain_base(rows))
    want = plain_model(rows)
    # weights come from rounded chances, so scores agree closely, not to the last digit
    assert all(r.score == pytest.approx(want[r.doc_id], rel=0.01) for r in found)
    out = [r for r in found if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_scores_do_not_depend_on_the_blocks(spark):
    docs, _ = corpus(spark)
    few, many = ({r.doc_id: r.score for r in lm.score(docs.repartition(p), block_tokens=b).collect()} for p, b in ((1, 10**6), (5, 100)))
    assert few == pytest.approx(many, rel=1e-9)


def test_scores_of_a_messy_table(spark):
    docs = messy.frame(spark)
    found = lm.score(docs, block_tokens=500).collect()
    assert messy.counted((r.doc_id, bool(r.held_out), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in found) == messy.counted((*r[:-1], round(r[-1], 4)) for r in plain_base(messy.texts()))
    assert all(math.isfinite(r.score) and r.score <= 0 for r in found)
    assert lm.score(docs.limit(0)).count() == 0
    assert lm.score(docs.filter("doc_id is null")).count() == 2


def test_weights_raise_the_likelihood():
    rng = np.random.default_rng(5)
    chances = rng.random((500, 3))
    bucket = rng.integers(1, 4, 500)
    learned = lm.learn_weights(bucket, chances, np.ones(500))
    assert np.allclose(learned.sum(axis=1), 1)
    def loss(w):
        return -np.log((w[bucket] * chances).sum(axis=1)).sum()
    for _ in range(50):
        other = rng.dirichlet(np.ones(3), lm.BUCKETS)
        assert loss(learned) <= loss(other) + 1e-3


def test_packing():
    for values in (np.array([], np.uint64), np.array([0, 1, 2**63, 2**64 - 1], np.uint64)):
        assert (lm.unpack(lm.pack(values)) == values).all() and (lm.unpack_sorted(lm.pack_sorted(values)) == values).all()


# --- near-duplicates ---------------------------------------------------------

def plain_components(rows, size, percent=80):
    sets = [messy.shingles(t, size) for _, t, _, _ in rows]
    groups = messy.Groups(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                groups.tie(i, j)
    lowest = {}
    for i, (doc, *_) in enumerate(rows):
        if doc is not None:
            r = groups.root(i)
            lowest[r] = min(lowest.get(r, doc), doc)
    return [(doc, len(s), lowest.get(groups.root(i)) if s else doc) for i, ((doc, *_), s) in enumerate(zip(rows, sets))]


def edited(text, every, offset, word):
    found = text.split()
    found[offset::every] = [word] * len(found[offset::every])
    return " ".join(found)


def near_rows():
    """A hub of near copies at several distances, chains, and strangers."""
    rows = list(messy.texts())
    hub = messy.sentence(77, 300)
    rows += [(100 + i, edited(hub, 40, i % 40, f"w{i}"), "en", "a") for i in range(60)]
    step = messy.sentence(78, 200)
    for i in range(8):
        rows.append((200 + i, step, "en", "a"))
        step = edited(step, 45, 5 * i + 3, f"c{i}")
    rows += [(None, messy.sentence(3, 80), "en", "a"), (None, messy.sentence(9, 80), "fr", "b"), (None, messy.sentence(9, 80), "fr", "b")]
    return rows + [(300 + i, messy.sentence(300 + i, 40), "en", "a") for i in range(40)]


@pytest.mark.parametrize("size", [2, 5])
def test_components_equal_all_pairs(spark, size):
    rows = near_rows()
    docs = messy.frame(spark, rows)
    found = near_dups.near_duplicates(docs, size).collect()
    assert messy.counted((r.doc_id, r.n_shingles, r.component_id) for r in found) == messy.counted(plain_components(rows, size))
    assert all(r.kept == (r.doc_id is not None and r.doc_id == r.component_id) for r in found)
    kept = near_dups.keep_one(docs, size)
    assert kept.columns == docs.columns
    plain = plain_components(rows, size)
    want = Counter({c for _, n, c in plain if n and c is not None}) + Counter(i for i, n, _ in plain if not n)
    want[None] += len({t for (i, t, *_), (_, n, c) in zip(rows, plain) if n and c is None})
    assert Counter(r.doc_id for r in kept.collect()) == want and want[None] == 3


def test_of_repeated_rows_one_stays(spark):
    text = messy.sentence(400, 30)
    rows = [(1, text, "fr", "b"), (1, text, "en", "z"), (1, text, "en", "a")] + [(None, messy.sentence(401, 30), "en", "a")] * 5 + [(2, text, "en", "a"), (3, "", "en", "a"), (3, "", "en", "a")]
    kept = near_dups.keep_one(messy.frame(spark, rows)).collect()
    assert Counter((r.doc_id, r.lang, r.source) for r in kept) == Counter({(1, "en", "a"): 1, (None, "en", "a"): 1, (3, "en", "a"): 2})


def test_no_documents_no_groups(spark):
    empty = messy.frame(spark, [])
    assert near_dups.near_duplicates(empty, 2).count() == near_dups.keep_one(empty).count() == 0


def test_pruning_keeps_similar_pairs():
    rng = np.random.default_rng(1)
    steps = near_dups.least_matches(0.8)
    lost = 0
    for _ in range(4000):
        hits = rng.random(near_dups.HASHES) < 0.8
        lost += any(hits[:n].sum() < need for n, need in steps)
    assert lost <= 40 and all(need > 0.5 * n for n, need in steps[1:])


def test_signatures_estimate_similarity():
    base = messy.sentence(5, 800).split()
    other = base[:600] + messy.sentence(6, 200).split()
    a, b = near_dups.shingles(" ".join(base), 2), near_dups.shingles(" ".join(other), 2)
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert (near_dups.signature(a) == near_dups.signature(b)).mean() == pytest.approx(exact, abs=0.15)


def test_links_cross_buckets_whatever_the_centre(spark, monkeypatch):
    """Members of one bucket that only some pairs tie together, more than the star rounds can test."""
    rng = np.random.default_rng(2)
    true = {(a, b) for a, b in ((int(x), int(y)) for x, y in rng.integers(0, 60, (30, 2))) if a > b}
    buckets = spark.createDataFrame([(1, n) for n in range(60)] + [(2, n) for n in range(30)] + [(3, 99)], "bucket long, node long")
    links = spark.createDataFrame(sorted(true), "a long, b long")

    class Listed:
        def __init__(self, rows):
            self.nodes = [r["node"] for r in rows]

        def like(self, row, among):
            return np.array([i for i in among.tolist() if {(self.nodes[i], row["node"]), (row["node"], self.nodes[i])} & true], int)

    def prepare(nodes):
        return nodes, lambda pairs: pairs.join(links, ["a", "b"], "left_semi"), Listed

    monkeypatch.setattr(graph, "CHUNK", 7)
    labels, edges = graph.link(buckets, prepare)
    groups = messy.Groups(range(60))
    for a, b in true:
        groups.tie(a, b)
    assert {r.node: r.root for r in labels.collect()} == {n: groups.root(n) for ab in true for n in ab}
    assert {(max(r.a, r.b), min(r.a, r.b)) for r in edges.collect()} <= true


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([((i * 37) % 101, ((i + 1) * 37) % 101) for i in range(100)] + [(500, 600), (7, 7)], "a long, b long")
    found = {r.node: r.root for r in graph.components(edges).collect()}
    assert found == {**{i: 0 for i in range(101)}, 500: 500, 600: 500}


# --- tokens ------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(VOCABULARY)


ODD = ["<|endoftext|><|startoftext|>", "it's I'LL we'Ve", "Σ ΑΣ İ ß ǅ ﬁ", "1234 ½ Ⅷ", "áá", "\x00\x1c\u0085   x", "</w> <w>", "中文 😀 ñ", "x" * 5000, "ab" * 300 + "!" * 700, " ", "'''s"]


def test_ids_equal_the_library(library):
    vocabulary = bpe.Vocabulary(json.load(open(VOCABULARY)))
    texts = ODD + [t or "" for _, t, _, _ in messy.texts()] + [messy.sentence(i, 200) for i in range(40)]
    got = vocabulary.encode(texts).to_pylist()
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert got == want
    vocabulary.forget()
    assert vocabulary.encode(texts[:5]).to_pylist() == want[:5]


def test_short_and_long_merging_agree():
    vocabulary = bpe.Vocabulary(json.load(open(VOCABULARY)))
    for i in range(200):
        word = messy.sentence(i, 1 + i % 4).replace(" ", "")
        ids = [*(vocabulary.inner[c] for c in word[:-1]), vocabulary.final[word[-1]]]
        assert vocabulary.merge(ids) == vocabulary.merge_long(ids)


def test_digests_of_a_messy_table(spark, library):
    docs = messy.frame(spark)
    found = bpe.digests(docs, VOCABULARY).collect()
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    want = []
    for i, t, _, _ in messy.texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)), tuple(ids)))
    assert messy.counted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in found) == messy.counted(want)
    coded = bpe.encode(docs, VOCABULARY)
    assert coded.columns == [c for c in docs.columns if c != "ids"] + ["ids"] and coded.count() == docs.count()
    assert bpe.digests(docs.limit(0), VOCABULARY).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(nulls, VOCABULARY).collect()} == {1: None, 2: ""}


# --- languages ---------------------------------------------------------------

SOUNDS = {"xx": "bako miru sena tolu", "yy": "schra pfunt gloch weing", "zz": "eaux quoi lleau ieuse"}


def speech(lang, seed, n):
    parts = SOUNDS[lang].split()
    return " ".join(parts[(seed * 31 + i * i) % 4] + parts[(seed + i * 7) % 4][:3] for i in range(n))


def test_languages_held_out(spark):
    rows = [(i, speech(lang, i, 5 + i % 60), None if i % 50 == 0 else lang, lang) for i in range(300) for lang in [sorted(SOUNDS)[i % 3]]]
    found = langid.predict_languages(messy.frame(spark, rows)).collect()
    truth = {i: s for i, _, _, s in rows}
    out = [r for r in found if r.held_out]
    assert len(found) == 300 and 50 < len(out) < 100 and all(r.lang_pred == truth[r.doc_id] for r in out)
    assert all(0.8 < r.score <= 1 for r in out)
    assert all(r.held_out == (messy.crc(r.doc_id, 4) == 2) for r in found)


def test_trigrams_and_counts(spark):
    codes, owner = langid.trigrams(["ab", "é", "abc"])
    spelt = ["".join(chr(int(c) >> s & 0x1FFFFF) for s in (42, 21, 0)) for c in codes]
    assert spelt == [" ab", "ab ", " é ", " ab", "abc", "bc "] and owner.tolist() == [0, 0, 1, 2, 2, 2]
    rows = [(i, t, "l", "a") for i, t in enumerate(["ab ab", "AB-abc 12", "é"])]
    got = messy.frame(spark, rows).select("lang", "text").mapInArrow(langid._counted, "lang string, code long, n long").collect()
    total = defaultdict(int)
    for r in got:
        total["".join(chr(r.code >> s & 0x1FFFFF) for s in (42, 21, 0))] += r.n
    assert total == {" ab": 4, "ab ": 3, "abc": 1, "bc ": 1, " é ": 1}


def test_filter_has_no_false_negatives_and_many_languages():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 2**62, 2000, dtype=np.uint64)
    langs = [f"l{i:03}" for i in range(70)]
    slots = np.zeros((langid.SLOTS, 2), np.uint64)
    own = np.arange(2000) % 70
    for probe in langid.places(codes):
        np.bitwise_or.at(slots, (probe, own // 64), np.uint64(1) << (own % 64).astype(np.uint64))
    hits = langid.Filter(langs, slots).hits(codes)
    assert hits.shape == (2000, 70) and hits[np.arange(2000), own].all() and hits.mean() < 0.02


def test_languages_of_a_messy_table(spark):
    docs = messy.frame(spark)
    found = langid.predict_languages(docs).collect()
    assert Counter(r.doc_id for r in found) == Counter(i for i, *_ in messy.texts())
    for r in found:
        texts = [t for i, t, _, _ in messy.texts() if i == r.doc_id]
        if not any(c.isalpha() for t in texts for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None:
            assert r.lang_pred in {"en", "de", "fr"} and 0 <= r.score <= 1
    assert {r.lang_pred for r in langid.predict_languages(docs.filter("lang is null")).collect()} == {"und"}
    assert langid.predict_languages(docs.limit(0)).count() == 0


# --- lines -------------------------------------------------------------------

def plain_lines(rows, linked):
    """Lines to drop per row: groups of equal lines tied by the links given."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    nodes, places = {}, []
    for at, (doc, text, *_) in enumerate(rows):
        for k, line in enumerate(lines.normalised(text or "")):
            joined = b" ".join(line)
            if joined:
                nodes.setdefault(joined, len(nodes))
                places.append((at, k, joined))
    groups = messy.Groups(range(len(nodes)))
    names = list(nodes)
    for i, a in enumerate(names):
        for j in range(i):
            if linked(a, names[j]):
                groups.tie(i, j)
    seen, drop = set(), defaultdict(set)
    for at, k, joined in places:
        root = groups.root(nodes[joined])
        if root in seen:
            drop[at].add(k)
        seen.add(root)
    return [(doc, None if text is None else "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop[at])) for at, (doc, text, *_) in enumerate(rows)]


def line_rows():
    common = messy.sentence(8, 40)
    rows = [(i, f"{messy.sentence(20 + i, 35)}\n{common}\nhi\n{messy.sentence(20 + i, 35).upper()}, 12!", "en", "a") for i in range(10)]
    rows += [(50 + i, edited(common, 1000, i, "zz") + f"\nPage {i} of 99 in the whole book\n\n{messy.sentence(60 + i, 25)}", "en", "a") for i in range(10)]
    return rows + [(90, None, "en", None), (91, "", "en", None), (None, common, "en", "a"), (92, "\n\n \n", "en", "a"), (93, messy.LONG, "en", "a"), (94, messy.LONG + " end", "en", "a")]


def in_blocks(words):
    high, low = lines.Words().sketches([words])[0][0].tolist()
    bits = f"{high & 2**64 - 1:064b}{low & 2**64 - 1:064b}"
    return [bits[i * lines.WIDTH : (i + 1) * lines.WIDTH] for i in range(lines.BLOCKS)]


def linked_by_blocks():
    """Whether two lines are similar and agree in two blocks."""
    known = {}

    def linked(a, b):
        for x in (a, b):
            if x not in known:
                known[x] = in_blocks(x.split())
        return sum(x == y for x, y in zip(known[a], known[b])) >= 2 and lines.similar(a.split(), b.split())

    return linked


def test_lines_equal_brute_force(spark):
    rows = line_rows()
    docs = messy.frame(spark, rows)
    found = lines.dedup_lines(docs, "all", "gone")
    assert found.columns == [*docs.columns, "all", "gone"]
    got = found.collect()
    assert messy.counted((r.doc_id, r.text) for r in got) == messy.counted(plain_lines(rows, linked_by_blocks()))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[0].gone == 1 and by_id[5].gone == 3 and by_id[5].all == 4 and by_id[94].text == "" and by_id[59].text.startswith("\n")
    assert by_id[90].all == 0 and by_id[91].all == 1 and by_id[92].text == "\n\n \n"
    empty = docs.limit(0)
    assert lines.dedup_lines(empty, "all", "gone").collect() == [] and lines.dedup_lines(docs).columns == docs.columns


def edited_lines():
    """Lines of 4 to 200 words, each with copies of as many words changed, added and taken as may be, and of more."""
    rng, rows, least = np.random.default_rng(9), [], lines.WORDS_AN_EDIT
    for n in [4, 14, least - 2, least - 1, least, least + 7, 60, 2 * least - 1, 2 * least, 3 * least, 150, 200] * 4:
        base = messy.sentence(4000 + len(rows), n).split()
        rows.append((len(rows), " ".join(base), "en", "a"))
        for edits in (1, n // least, n // least + 1, n // least + 2):
            words = list(base)
            for i in range(edits):
                at, kind = int(rng.integers(0, len(words))), int(rng.integers(0, 3))
                words[at : at + (kind != 1)] = [] if kind == 2 else [f"q{len(rows)}x{'abcdefghij'[i % 10]}"]
            rows.append((len(rows), " ".join(words), "en", "a"))
    return rows


def test_edited_lines_equal_brute_force(spark):
    rows = line_rows() + [(1000 + r[0], *r[1:]) for r in edited_lines()]
    # Groups that meet are compared whole: a similar pair may be found that does not agree in two blocks itself.
    got = {r.doc_id: r.text for r in lines.dedup_lines(messy.frame(spark, rows)).collect() if r.doc_id is not None}
    by_blocks, by_edits = dict(plain_lines(rows, linked_by_blocks())), dict(plain_lines(rows, lambda a, b: lines.similar(a.split(), b.split())))
    left = lambda text: Counter((text or "").split("\n"))
    for doc, text in got.items():
        assert not left(text) - left(by_blocks[doc]) - Counter([""]) and not left(by_edits[doc]) - left(text) - Counter([""]), doc
    assert sum(got[doc] != by_blocks[doc] for doc in got) <= 0.02 * len(got)


def test_similar_lines_pass_the_parities_and_most_are_found():
    rows = [lines.normalised(r[1])[0] for r in edited_lines()]
    signs, blocks = lines.Words().sketches(rows)[1], [in_blocks(r) for r in rows]
    described = [{"n_words": len(w), **{f"sign{i}": int(v) for i, v in enumerate(s)}} for w, s in zip(rows, signs)]
    held, n, met = lines.SignedLines(described), 0, 0
    for i, a in enumerate(rows):
        near = set(held.like(described[i], np.arange(len(rows))).tolist())
        for j, b in enumerate(rows):
            if a != b and lines.similar(a, b):
                n += 1
                met += sum(x == y for x, y in zip(blocks[i], blocks[j])) >= 2
                assert j in near
    assert n > 100 and met >= 0.8 * n  # most of these differ in as many words as may be, and in heavier ones


def test_buckets_equal_the_blocks(spark):
    rng, number = np.random.default_rng(3), lambda: int(rng.integers(-(2**63), 2**63))
    plain = [(i, int(rng.integers(20, 60)), number(), number(), *(number() for _ in range(4))) for i in range(40)]
    rows = plain + [(100 + r[0], r[1], r[2], number(), r[4] ^ 1, *r[5:]) for r in plain]  # one parity apart
    rows += [(200 + r[0], r[1], r[2], number(), *(number() for _ in range(4))) for r in plain]  # the same blocks, other words
    rows += [(300 + i, 40, 5, i, number(), 0, 0, 0) for i in range(30)]  # many of one block, not alike
    names = ["node", "n_words", "high", "low", *(f"sign{i}" for i in range(4))]
    nodes = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'n_words' else 'long'}" for c in names))
    want = defaultdict(set)
    for node, n, high, low, *_ in rows:
        bits = f"{high & 2**64 - 1:064b}{low & 2**64 - 1:064b}"
        cut = [int(bits[i * lines.WIDTH : (i + 1) * lines.WIDTH], 2) for i in range(lines.BLOCKS)]
        for size in {int(np.log(x) / np.log(lines.CLASS)) for x in (n, n + n // (lines.WORDS_AN_EDIT - 1))}:
            for i in range(lines.BLOCKS):
                for j in range(i + 1, lines.BLOCKS):
                    want[(size, i, j, cut[i], cut[j])].add(node)
    by_node = {r[0]: r for r in rows}

    def near(a, b):
        a, b = by_node[a], by_node[b]
        edits, apart = max(a[1], b[1]) // lines.WORDS_AN_EDIT, abs(a[1] - b[1])
        folds = [(r[4] ^ r[5] ^ r[6] ^ r[7]) & 2**64 - 1 for r in (a, b)]
        return apart <= edits and (folds[0] ^ folds[1]).bit_count() <= 2 * edits - apart

    partnered = [frozenset(x for x in m if len(m) > lines.FEW or any(x != y and near(x, y) for y in m)) for m in want.values()]
    found = defaultdict(set)
    for r in lines._buckets(nodes).collect():
        found[r.bucket].add(r.node)
    assert Counter(map(frozenset, found.values())) == Counter(m for m in partnered if m)


def test_partners_are_found_and_crowds_stay_whole(monkeypatch):
    rng = np.random.default_rng(5)
    n = 600
    rows = lines.Entered([np.zeros(n, np.int64), np.arange(n), rng.integers(20, 60, n), *np.zeros((2, n), np.int64), rng.integers(0, 256, n)])
    key, some = rng.integers(0, 60, n) ** 2 // 60, rng.permutation(n)
    sizes = Counter(key.tolist())
    for few in (4, 12, 1000):
        monkeypatch.setattr(lines, "FEW", few)
        want = set()
        for i in range(n):
            others = np.array([some[j] for j in range(n) if j != i and key[j] == key[i]], np.int64)
            if sizes[int(key[i])] > few or rows.may_be_similar(np.full(len(others), some[i]), others).any():
                want.add((int(key[i]), int(some[i])))
        got = list(zip(*(c.tolist() for c in rows.partnered(key, some))))
        assert len(got) == len(set(got)) and set(got) == want


def test_parts_beyond_the_limit_are_passed_on_whole():
    import pyarrow as pa

    rng, rows = np.random.default_rng(4), []
    for part, n in ((1, 5), (2, 300_000), (3, 10), (4, 200_000), (5, 1)):
        rows.append(np.column_stack([np.full(n, part << 16), rng.integers(0, 2**40, n), np.full(n, 30), rng.integers(-(2**63), 2**63, (n, 2)), np.zeros(n, np.int64)]))
    table = np.concatenate(rows)
    names = lines.Entered.NAMES
    batches = [pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in table[at : at + 10_000].T], names=names) for at in range(0, len(table), 10_000)]

    def shared(held):
        before, lines.HELD = lines.HELD, held
        try:
            found = [b.to_pandas().to_numpy() for b in lines._paired(iter(batches))]
        finally:
            lines.HELD = before
        found = np.concatenate(found)
        _, at, n = np.unique(found[:, 0], return_inverse=True, return_counts=True)
        return sorted(map(tuple, found[n[at] > 1].tolist())), len(found)

    (whole, few), (broken, many) = shared(1 << 30), shared(100_000)
    assert whole == broken and many >= few


def test_lines_of_a_buffer_equal_the_split():
    texts = [messy.sentence(1, 30), "", "\n\n", " a\t b\v\fc \r\nΟΔΟΣ", "Σας\n", "x\x1cy z\x85 12-34, ..\n!!\nend", messy.LONG, "a a\x00 a\x00\x00 abcdefgh abcdefghi abcdefgh\x00"]
    found = lines.Lines(texts)
    want = [(i, k, words) for i, t in enumerate(texts) for k, words in enumerate(lines.normalised(t)) if words]
    assert list(zip(found.rows.tolist(), found.numbers.tolist(), found.texts)) == [(i, k, b" ".join(words)) for i, k, words in want]
    assert found.sizes.tolist() == [len(words) for *_, words in want]
    for some in (np.arange(len(want)), np.arange(1, len(want), 2), np.arange(0)):
        numbers, words = found.words_of(some)
        assert [words[i] for i in numbers] == [w for i in some for w in want[i][2]] and len(set(words)) == len(words)
    assert lines.Lines(["", "\n"]).texts == []


def crossing_rows():
    """Many near-copies that share some of their blocks, of word counts in one class and two."""
    rng, rows = np.random.default_rng(12), []
    for group in range(60):
        high, low, n, fold = (int(x) for x in (*rng.integers(-(2**63), 2**63, 2), rng.integers(40, 60), rng.integers(-(2**63), 2**63)))
        for _ in range(int(rng.integers(2, 12))):
            flips = [1 << int(b) for b in rng.integers(0, 62, 4)]
            rows.append((len(rows) // 2 * 2, n + int(rng.integers(0, 3)), high ^ flips[0] ^ flips[1], low ^ flips[2] ^ flips[3], fold ^ (1 << int(rng.integers(0, 9))), 0, 0, 0))
    return [(i, *r[1:]) for i, r in enumerate(rows)] + [(i, *r[1:]) for i, r in enumerate(rows) if i % 7 == 0]  # some nodes twice


def met_pairs(found, rows):
    """Of entries ``bucket, node`` all pairs that may be similar."""
    sizes, folds = {r[0]: r[1] for r in rows}, {r[0]: r[4] & 2**64 - 1 for r in rows}
    members, met = defaultdict(set), set()
    for bucket, node in found:
        members[bucket].add(node)
    for m in members.values():
        for a in m:
            for b in m:
                edits, apart = max(sizes[a], sizes[b]) // lines.WORDS_AN_EDIT, abs(sizes[a] - sizes[b])
                if a < b and apart <= edits and (folds[a] ^ folds[b]).bit_count() <= 2 * edits - apart:
                    met.add((a, b))
    return met


def test_buckets_met_before_are_left_out_and_no_pair_is_lost(spark):
    rows = crossing_rows()
    names = ["node", "n_words", "high", "low", *(f"sign{i}" for i in range(4))]
    nodes = spark.createDataFrame(rows, ", ".join(f"{c} {'int' if c == 'n_words' else 'long'}" for c in names))
    every, once = ([(r.bucket, r.node) for r in lines._buckets(nodes, once).collect()] for once in (False, True))
    assert len(met_pairs(every, rows)) > 300 and met_pairs(once, rows) == met_pairs(every, rows)
    assert set(once) < set(every) and len(set(once)) < 0.5 * len(set(every)) and len(once) == len(set(once))


def test_slots_beyond_the_limit_lose_no_pair(monkeypatch):
    import pyarrow as pa

    rows = crossing_rows()
    names = ["node", "n_words", "high", "low", *(f"sign{i}" for i in range(4))]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in map(list, zip(*rows))], names=names)
    monkeypatch.setattr(lines, "DEALT", 50)
    dealt = list(lines._dealt(2)(batch.slice(at, 40) for at in range(0, len(rows), 40)))
    slots = sorted((x for b in dealt for x in b.to_pylist()), key=lambda x: x["slot"])
    again = [pa.RecordBatch.from_pylist(slots[at : at + 3], dealt[0].schema) for at in range(0, len(slots), 3)]
    met = []
    for held in (1 << 20, 3000, 200):
        monkeypatch.setattr(lines, "HELD", held)
        met.append(met_pairs([(x["bucket"], x["node"]) for b in lines._met(True)(iter(again)) for x in b.to_pylist()], rows))
    assert len(met[0]) > 300 and met[0] == met[1] == met[2]


def test_line_scratch_goes_but_for_what_is_read(spark):
    import os

    from pixelseries.session import scratch_scope

    with scratch_scope() as made:
        found = lines.dedup_lines(messy.frame(spark, line_rows()), "all", "gone")
    left = [p for p in made if os.path.exists(p.removeprefix("file:"))]
    assert len(made) > 5 and len(left) == 1
    assert sum(r.gone for r in found.collect()) > 10


def test_edit_distance_equals_the_table():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a, b = ([bytes([97 + int(c)]) for c in rng.integers(0, 4, rng.integers(0, 12))] for _ in range(2))
        table = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, table[0] = table[0], i
            for j, y in enumerate(b, 1):
                old, table[j] = table[j], min(table[j] + 1, table[j - 1] + 1, old + (x != y))
        assert lines.edit_distance(a, b) == table[-1], (a, b)


def test_simhash_equals_the_majority_of_bits():
    import xxhash

    some = [b"a bcdefg cdef".split(), [b"wxyzvu%d" % (i % 90) for i in range(700)], b"x".split(), b"longlonglong a".split()]
    got = lines.Words().sketches(some)[0]
    for words, (high, low) in zip(some, got.tolist()):
        sums = [0] * 128
        for w in words:
            for i, bit in enumerate(f"{xxhash.xxh3_128_intdigest(w):0128b}"):
                sums[i] += lines.weight(w) * int(bit)
        want = "".join("1" if 2 * s > sum(map(lines.weight, words)) else "0" for s in sums)
        raw = np.array([high, low], np.int64).tobytes()
        assert "".join(f"{b:08b}" for b in raw) == want
