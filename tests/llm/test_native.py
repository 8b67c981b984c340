"""Sharding, mixing, quality rules and URL filters against plain references."""

import re
import zlib
from collections import Counter, defaultdict

import messy
import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelseries.llm import mixing, quality, shards, urls

PYTHON = re.compile("Python|Pandas|Arrow")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- sharding ----------------------------------------------------------------

def jump(key, n):
    key, b, j = key & (2**64 - 1), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) & (2**64 - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("n", [1, 2, 24, 65, 700])
def test_jump_equals_the_published_loop(spark, n):
    keys = [*range(-30, 60), 2**62 + 5, -(2**63), 2**63 - 1]
    df = spark.createDataFrame([(k,) for k in keys], "k long").select("k", shards.jump_shard(F.col("k"), n).alias("s"))
    assert {r.k: r.s for r in df.collect()} == {k: jump(k, n) for k in keys}


def test_shards_of_a_messy_table(spark):
    found = shards.assign_shards(messy.frame(spark), 5, buckets=3)
    assert not PYTHON.search(plan(found))
    rows = found.collect()
    assert found.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and len(rows) == len(messy.texts())
    want = Counter((i, len((t or "").encode()) + 8, None if t is None else zlib.crc32(t.encode()), jump(-1 if i is None else i, 5), jump(-1 if i is None else i, 6)) for i, t, _, _ in messy.texts())
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.grown_shard) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(r.grown_shard in (r.shard, 5) for r in rows)
    assert shards.assign_shards(messy.frame(spark, []), 5).count() == 0


def test_growth_moves_only_into_the_new_shard(spark):
    df = spark.range(20000).select(shards.jump_shard(F.col("id"), 24).alias("a"), shards.jump_shard(F.col("id"), 25).alias("b"))
    assert df.filter("a <> b and b <> 24").count() == 0
    assert df.filter("b = 24").count() == pytest.approx(800, rel=0.2)
    sizes = [r["count"] for r in df.groupBy("a").count().collect()]
    assert len(sizes) == 24 and max(sizes) < 1.25 * min(sizes)


# --- mixing ------------------------------------------------------------------

def water(sizes):
    """Targets, shared out again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        open_ = [s for s in order if s not in full]
        level = left / max(sum(weight[s] for s in open_), 1)
        over = [s for s in open_ if level * weight[s] >= 3 * sizes[s]]
        if not over:
            return {**full, **{s: level * weight[s] for s in open_}}
        for s in over:
            full[s] = 3.0 * sizes[s]
            left -= full[s]


def test_targets(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 7, "d": 0}, {"a": 100, "b": 100, "c": 100}, {None: 9}, {"x": 0, "y": 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(water(sizes))


def test_mix_meets_its_targets(spark):
    rows = [(i, messy.sentence(i, 20 + (i * 37) % 300), "en", "abcd"[(i * i) % 7 % 4]) for i in range(400)]
    found = mixing.mixed_words(messy.frame(spark, rows))
    assert not PYTHON.search(plan(found))
    first = messy.counted(found.collect())
    assert first == messy.counted(mixing.mixed_words(messy.frame(spark, rows[::-1])).collect())
    taken, target = Counter(), {}
    source = {r[0]: r[3] for r in rows}
    for r in found.collect():
        assert r.taken % r.size == 0 and 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.005 * target[s] + 1 for s in target), (taken, target)


def test_tilts_solve_the_constraint(spark):
    sizes = spark.createDataFrame([("a", s, n) for s, n in ((1, 5), (10, 7), (200, 3))] + [("b", 4, 1), ("c", 50, 2)], "source string, size long, count long")
    targets = spark.createDataFrame([("a", 675, 500.0), ("b", 4, 12.0), ("c", 100, 3.0)], "source string, source_size long, target double")
    for r in mixing.solve_tilts(sizes, targets).collect():
        own = {"a": [(1, 5), (10, 7), (200, 3)], "b": [(4, 1)], "c": [(50, 2)]}[r.source]
        got = sum(n * s * min(3.0, np.exp(min(2.0, r.tilt * s / r.mean))) for s, n in own)
        assert got == pytest.approx(r.target, rel=1e-6)


def test_mix_of_a_messy_table(spark):
    docs = messy.frame(spark)
    rows = mixing.mixed_words(docs).collect()
    assert len(rows) == docs.count()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((i, len(messy.words(t))) for i, t, _, _ in messy.texts())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len(messy.words(r.text)) for r in mixed.collect()) == sum(r.taken for r in rows)
    assert mixing.mix(docs.limit(0)).count() == mixing.mixed_words(docs.limit(0)).count() == 0


# --- quality -----------------------------------------------------------------

def statistics(text):
    w = messy.words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    covered = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if messy.words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


REPEATS = ["a b c a b c", "a a a a", "x y z w x y z", "p q r s p q r t q r s", "one\n one\none\n\n\none", "a b", "", None, "| <> &#", "a b a b a b c"]


def test_statistics_equal_plain_counts(spark):
    texts = REPEATS + [t for _, t, _, _ in messy.texts()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string").select("i", quality.statistics(F.col("text")).alias("s"))
    assert not PYTHON.search(plan(df))
    assert {r.i: tuple(r.s) for r in df.collect()} == {i: statistics(t) for i, t in enumerate(texts)}


def test_assess_a_messy_table(spark):
    docs = messy.frame(spark)
    rows = quality.assess(docs).collect()
    assert messy.counted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == messy.counted((i, *statistics(t)) for i, t, _, _ in messy.texts())
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    good = quality.keep_good(docs)
    assert good.columns == docs.columns
    assert messy.counted((r.doc_id,) for r in good.collect()) == messy.counted((r.doc_id,) for r in rows if r.kept)
    assert quality.assess(docs.limit(0)).count() == quality.keep_good(docs.limit(0)).count() == 0


def distances(x, core=0.75):
    """Concentration steps on all rows with exact quantiles, from the median and from the mean."""
    floors, best = np.diag(np.square(quality.FLOORS)), None
    mad = 1.4826 * np.median(np.abs(x - np.median(x, 0)), 0)
    for m, c in ((np.median(x, 0), np.diag(mad**2) + floors), (x.mean(0), np.cov(x.T, bias=True) + floors)):
        for _ in range(quality.STEPS):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            near = x[d <= np.quantile(d, core)]
            m, c = near.mean(0), np.cov(near.T, bias=True) + floors
        if best is None or np.linalg.slogdet(c)[1] < best[0]:
            best = (np.linalg.slogdet(c)[1], m, c)
    _, m, c = best
    d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    return d / max(1.0, np.median(d) / quality.chi_square(quality.DIMENSIONS, 0.5))


def test_outliers_equal_a_plain_estimate(spark):
    rows = [(i, messy.sentence(i, 60 + (i * 53) % 400), "en", "a") for i in range(300)]
    rows += [(300 + i, " ".join(w + "***" for w in messy.sentence(900 + i, 150).split()), "en", "a") for i in range(40)]
    rows += [(400 + i, messy.sentence(700 + i, 90) + " & #", "fr", f"s{i}") for i in range(70)]
    found = {r.doc_id: r for r in quality.assess(messy.frame(spark, rows)).collect()}
    def features(r):
        n = max(r.n_words, 1)
        return [np.log(n), np.log(max(r.word_chars, 1) / n), *(min(v / n, 3.0) ** 0.5 for v in (r.n_symbols, r.n_dup_lines, r.n_repeat_words))]
    for ids in (range(340), range(400, 470)):
        x = np.array([features(found[i]) for i in ids])
        d, limit = distances(x), quality.chi_square(quality.DIMENSIONS, quality.TAIL)
        sure = np.abs(d / limit - 1) > 0.3
        assert all(found[i].kept == (v <= limit) for i, v, s in zip(ids, d, sure) if s)
    assert not any(found[i].kept for i in range(300, 340)) and all(found[i].kept for i in [*range(300), *range(400, 470)])


def test_clear_repeats_are_outliers_on_their_own(spark):
    rows = [(i, messy.sentence(i, 60 + (i * 53) % 400), "en", "a") for i in range(300)]
    for i in range(10):
        part = messy.sentence(5000 + i, 30)
        rows.append((300 + i, f"{part} {messy.sentence(5100 + i, 68)} {part}", "en", "a"))  # 47 % repeated words
        marks = "\n".join(f"x{j} {w}" for j, w in enumerate(messy.sentence(5200 + i, 12).split()))
        rows.append((320 + i, f"{messy.sentence(5300 + i, 150)}\n{marks}\n" + "\n".join(f"{w}\n{m}" for w, m in zip(messy.sentence(5400 + i, 12).split(), marks.split("\n"))), "en", "a"))  # a tenth duplicate lines, no repeated windows
        once = messy.sentence(5500 + i, 3)
        rows.append((340 + i, f"{once} {messy.sentence(5600 + i, 54)} {once}\nNote\n{messy.sentence(5700 + i, 9)}\nNote", "en", "a"))  # harmless
    found = {r.doc_id: r for r in quality.assess(messy.frame(spark, rows)).collect()}
    for i in range(10):
        assert found[300 + i].n_dup_lines == 0 and found[320 + i].n_repeat_words == 0 and found[320 + i].n_dup_lines >= 12
        assert not found[300 + i].base_failed and not found[300 + i].kept
        assert not found[320 + i].base_failed and not found[320 + i].kept
    assert all(found[i].kept for i in [*range(300), *range(340, 350)])


def test_chi_square():
    assert quality.chi_square(5, 0.5) == pytest.approx(4.351, rel=0.01)
    assert quality.chi_square(5, 0.01) == pytest.approx(15.086, rel=0.01)


# --- URL filters -------------------------------------------------------------

URLS = [
    None, "", "no scheme/net/", "http://example.net", "HTTP://A.Example.NET/en/x?q", "https://x.net/a", "http://net/", "http://notexample.com/de/1", "http://www.example.com/de/1#t",
    "http://example.com/DE/1", "http://w.example.org/fr/", "http://example.org/de/", "http://é.org/fr/x", "x://y://z.net/", "http://u.org?x=/fr/", "http://example.net/en", "//a.net/",
]


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    h = re.match(r"[^/?#]*", rest)[0]
    p = re.match(r"[^?#]*", rest[len(h) :])[0]
    h, best = h.translate(messy.ASCII_LOWER), None
    for kind, domain, prefix in urls.DOMAIN_RULES:
        if (h == domain or h.endswith("." + domain)) and p.startswith(prefix) and (best is None or len(domain + prefix) > len(best[0])):
            best = (domain + prefix, kind)
    return (h, p, *(best or (None, None)))


def test_domain_rules(spark):
    pages = spark.createDataFrame([(i, u, "h", True, "r") for i, u in enumerate(URLS * 2)], "page_id long, url string, html string, mined boolean, rule string")
    labels = spark.createDataFrame([(0, 0, 1)], "doc_id long, quality int, toxic int")
    found = urls.filter_urls(pages, labels)
    assert not PYTHON.search(plan(found))
    rows = {r.page_id: r for r in found.collect()}
    assert len(rows) == len(URLS) * 2
    for i, u in enumerate(URLS * 2):
        h, p, rule, kind = plain_verdict(u)
        assert (rows[i].host, rows[i].path, rows[i].rule, rows[i].verdict) == (h, p, rule, kind or "allow"), u
    assert urls.filter_urls(pages.limit(0), labels).count() == 0
    assert urls.filter_urls(pages, labels.limit(0)).count() == len(URLS) * 2


def test_mined_rules_equal_brute_force(spark):
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        site = ["spam", "shop", "news"][i % 3] if i % 10 else "mixed"
        rows.append((i, f"http://{site}{'-x' if i % 5 == 0 else ''}.example.org/{'win' if bad or i % 7 == 0 else 'read'}/{i}", bad and i % 11 > 0))
    labelled = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    rules = {frozenset(r.antecedent): r for r in urls.mine_rules(labelled.select("url", "bad"), min_support=0.05, min_confidence=0.8).collect()}
    tokens = {r.url: frozenset(r.t) for r in labelled.select("url", urls.tokens(F.col("url")).alias("t")).collect()}
    from itertools import combinations

    support, bads = Counter(), Counter()
    for _, url, bad in rows:
        own = sorted(tokens[url])
        for k in range(1, len(own) + 1):
            for c in combinations(own, k):
                support[frozenset(c)] += 1
                bads[frozenset(c)] += bad
    n, rate = len(rows), sum(r[2] for r in rows) / len(rows)
    good = {s: bads[s] / support[s] for s in support if bads[s] >= max(0.05 * n, urls.MIN_COUNT) and bads[s] / support[s] >= 0.8 and bads[s] / support[s] / rate >= urls.MIN_LIFT}
    want = {s for s in good if not any(len(o) < len(s) and o <= s and good[o] >= good[s] for o in good)}
    assert set(rules) == want and want
    assert all(rules[s].confidence == pytest.approx(good[s]) for s in want)
    judged = urls.judge(labelled, urls.mine_rules(labelled.select("url", "bad"), min_support=0.05, min_confidence=0.8)).collect()
    assert {r.page_id: r.mined for r in judged} == {i: sum(s <= tokens[u] for s in want) for i, u, _ in rows}
    assert {r.page_id: r.verdict for r in judged} == {i: "block" if any(s <= tokens[u] for s in want) else "allow" for i, u, _ in rows}
