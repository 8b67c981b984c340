"""One query per corpus operator over its whole table, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelseries.session import scratch_path

from .bpe import digests
from .common import table
from .langid import predict_languages
from .lines import dedup_lines
from .lm import score
from .merkle import tampered_check
from .mixing import mixed_words
from .near_dups import near_duplicates
from .packed import read_documents, write_ids
from .quality import assess
from .shards import assign_shards
from .spellings import spellings
from .urls import filter_urls
from .vptree import nearest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if text is not None:
            ORACLE[fn.__name__] = text
        return fn

    return register


# --- sharding ----------------------------------------------------------------

SHARDS, PARTS = 24, 1024


def _sql_jump(n: int) -> str:
    """The shard of ``key`` among ``n``: the same generator on 128-bit integers."""
    return f"""list_reduce(range({n}), lambda s, k: CASE WHEN s.j >= {n} THEN s ELSE
      {{'key': (s.key * 2862933555777941757 + 1) & m, 'b': s.j,
        'j': least(floor((s.j + 1) * (2147483648.0 / ((((s.key * 2862933555777941757 + 1) & m) >> 33) + 1))), {n})::BIGINT}} END,
      {{'key': key, 'b': -1::BIGINT, 'j': 0::BIGINT}}).b::INT"""


#: The checksum's table of 256, worked out from the polynomial.
CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t"


def _sql_crc(text: str) -> str:
    """The CRC-32 of a text's bytes, one after another, with the table ``t``."""
    return f"xor(list_reduce(regexp_extract_all(hex(encode({text})), '..'), lambda c, h: xor(c >> 8, t[(xor(c, ('0x' || h)::BIGINT) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


#: The jump generator on 128-bit integers.
JUMP_SQL = f"""
WITH tab AS (
  {CRC_TABLE}
), keyed AS (
  SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size,
    {_sql_crc("text")} AS text_crc32,
    CASE WHEN coalesce(doc_id, -1) < 0 THEN coalesce(doc_id, -1)::HUGEINT + 18446744073709551616::HUGEINT ELSE doc_id::HUGEINT END AS key,
    18446744073709551615::HUGEINT AS m
  FROM documents, tab
), dealt AS (
  SELECT doc_id, size, text_crc32, {_sql_jump(SHARDS)} AS shard, {_sql_jump(SHARDS + 1)} AS grown_shard,
    ((((key * 2862933555777941757 + 1) & m) >> 33) + coalesce(text_crc32, 0)) % {PARTS} AS part
  FROM keyed
)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, text_crc32 NULLS FIRST, size) - 1 AS slot, grown_shard
FROM dealt
"""


@query(JUMP_SQL)
def op5_jump_shards(spark, sf):
    return assign_shards(table(spark, sf, "documents"), SHARDS, PARTS)


# --- mixing ------------------------------------------------------------------

@query()
def op7_entropy_mix(spark, sf):
    return mixed_words(table(spark, sf, "documents"))


# --- quality -----------------------------------------------------------------

@query()
def op2_robust_outliers(spark, sf):
    return assess(table(spark, sf, "documents"))


# --- URL filters -------------------------------------------------------------

@query()
def op6_association_rules(spark, sf):
    return filter_urls(table(spark, sf, "pages"), table(spark, sf, "labels"))


# --- tokens ------------------------------------------------------------------

def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query()
def op8_speculative_bpe(spark, sf):
    return digests(table(spark, sf, "documents"), word_vocabulary()).drop("ids")


# --- near-duplicates ---------------------------------------------------------

@query()
def op4_bayes_minhash(spark, sf):
    return near_duplicates(table(spark, sf, "documents"), size=2, percent=80)


# --- lines -------------------------------------------------------------------

@query()
def op10_simhash_lines(spark, sf):
    found = dedup_lines(table(spark, sf, "documents"), "n_lines", "n_dropped")
    return found.select("doc_id", "text", "n_lines", "n_dropped")


# --- language ----------------------------------------------------------------

@query()
def op9_bloom_language(spark, sf):
    return predict_languages(table(spark, sf, "documents"))


# --- nearest neighbours ------------------------------------------------------

@query()
def op3_vantage_trees(spark, sf):
    return nearest(table(spark, sf, "embeddings"))


# --- language model ----------------------------------------------------------

@query()
def op1_deleted_interpolation(spark, sf):
    return score(table(spark, sf, "documents"))


# --- manifest ----------------------------------------------------------------

def _sql_field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE octet_length(encode(({value})::VARCHAR)) || ':' || ({value})::VARCHAR END"


def _sql_leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(map(_sql_field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"


def _sql_levels(name: str, leaves: str, key: str) -> str:
    """Each tree's levels as lists of nodes."""
    return f"""{name} AS (
  SELECT {key}, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM {leaves} GROUP BY {key}
  UNION ALL
  SELECT {key}, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda i: sha256(nodes[2 * i + 1] || coalesce(nodes[2 * i + 2], ''))) FROM {name} WHERE len(nodes) > 1
)"""


def _sql_path(name: str, leaves: str, levels: str, key: str) -> str:
    """Per leaf the sibling on either side, level by level."""
    return f"""{name} AS (
  SELECT l.{key} AS {key}, l.pos, list({{'l': CASE WHEN (l.pos >> v.level) % 2 = 1 THEN v.nodes[(l.pos >> v.level)] ELSE '' END,
    'r': CASE WHEN (l.pos >> v.level) % 2 = 0 THEN coalesce(v.nodes[(l.pos >> v.level) + 2], '') ELSE '' END}} ORDER BY v.level) AS path
  FROM {leaves} l JOIN {levels} v ON l.{key} IS NOT DISTINCT FROM v.{key} AND len(v.nodes) > 1 GROUP BY ALL
)"""


MERKLE_SQL = f"""
WITH RECURSIVE tab AS ({CRC_TABLE}), hashed AS (
  SELECT doc_id, lang, {_sql_leaf("n_chars")} AS leaf,
    CASE WHEN {_sql_crc("doc_id::VARCHAR")} % 7 = 0 THEN {_sql_leaf("n_chars + 1")} ELSE {_sql_leaf("n_chars")} END AS claimed
  FROM documents, tab
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed
), {_sql_levels("levels", "leaves", "lang")}, {_sql_path("paths", "leaves", "levels", "lang")},
subroots AS (
  SELECT 0 AS forest, lang, nodes[1] AS leaf, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS pos FROM levels WHERE len(nodes) = 1
), {_sql_levels("tops", "subroots", "forest")}, {_sql_path("top_paths", "subroots", "tops", "forest")}, ended AS (
  SELECT l.*, s.leaf AS subroot, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root, coalesce(p.path, []) || coalesce(t.path, []) AS path
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos LEFT JOIN top_paths t ON t.pos = s.pos
), folded AS (
  SELECT *, list_reduce(path, lambda node, step: sha256(step.l || node || step.r), claimed) AS folded_root FROM ended
)
SELECT doc_id, leaf, subroot, root, sha256(list_reduce(path, lambda a, step: a || step.l || step.r, '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


@query(MERKLE_SQL)
def op11_merkle_windows(spark, sf):
    return tampered_check(table(spark, sf, "documents"))


# --- packed ids --------------------------------------------------------------

def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op12_bit_packing(spark, sf):
    path = scratch_path(spark)
    write_ids(table(spark, sf, "documents"), path, byte_vocabulary())
    return read_documents(spark, path, ids=False)


# --- spelling variants -------------------------------------------------------

#: Near words meet by what is left of them without one letter.
SPELLING_SQL = f"""
WITH RECURSIVE tab AS ({CRC_TABLE}), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents
), lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c FROM runs GROUP BY ALL
), hashed AS (
  SELECT run, c, {_sql_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM lowered, tab
), spelt AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM hashed
), words AS (
  SELECT word, sum(c)::BIGINT AS n FROM spelt WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), without AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM without a JOIN without b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(near, (-near_n, encode(near))) AS near, max(near_n) AS near_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), walk AS (
  SELECT word, word AS reached FROM formed
  UNION ALL
  SELECT walk.word, f.form FROM walk JOIN formed f ON f.word = walk.reached WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, r.reached AS root, f.n, f.n_near, f.form_n FROM formed f JOIN (SELECT word, reached FROM walk WHERE reached IN (SELECT word FROM formed WHERE form IS NULL)) r ON r.word = f.word
"""


@query(SPELLING_SQL)
def op13_bitset_spellings(spark, sf):
    return spellings(table(spark, sf, "documents"))
