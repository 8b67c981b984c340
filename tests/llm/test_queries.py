"""The registered queries over the smallest tables, and the pipeline against its stages' references."""

import os
import sys

import messy
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from checks.compare import _rows, duck  # noqa: E402
from pixelseries.llm.queries import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_deleted_interpolation": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op2_robust_outliers": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op3_vantage_trees": "query_id rank vec_id score",
    "op4_bayes_minhash": "doc_id n_shingles component_id kept",
    "op5_jump_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op6_association_rules": "page_id host path rule verdict mined",
    "op7_entropy_mix": "doc_id size source_size target taken",
    "op8_speculative_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op9_bloom_language": "doc_id held_out lang_pred score",
    "op10_simhash_lines": "doc_id text n_lines n_dropped",
    "op11_merkle_windows": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op12_bit_packing": "doc_id start n_tokens ids_crc32",
    "op13_bitset_spellings": "word form root n n_near form_n",
}


def test_every_operator_has_its_query():
    assert set(QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, name):
    found = QUERIES[name](spark, SF)
    assert found.columns == COLUMNS[name].split()
    rows = found.collect()
    table = {"op3_vantage_trees": None, "op13_bitset_spellings": None, "op6_association_rules": "pages"}.get(name, "documents")
    if table:
        assert len(rows) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in ORACLE:
        con = duck(SF)
        cursor = con.execute(ORACLE[name])
        assert _rows(found.columns, [tuple(r) for r in rows]) == _rows([d[0] for d in cursor.description], cursor.fetchall())


def test_language_accuracy_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    out = [r for r in QUERIES["op9_bloom_language"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in out) >= 0.98 * len(out)


def test_stages_take_effect_and_keep_the_columns(spark):
    docs = messy.frame(spark, messy.texts() + [(500 + i, messy.sentence(500 + i, 90), "en", "ab"[i % 2]) for i in range(30)])
    rows = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert "ids" in docs.columns and docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name in ("quality rules", "MinHash near-dedup"):
            assert docs.count() <= rows
        elif name == "line dedup":
            assert docs.count() == rows
        rows = docs.count()
        assert rows > 0
    final = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert final.count() == rows and final.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]


def test_pipeline_run(spark):
    found = corpus_pipeline.run(spark, SF)
    known = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    ids = [r.doc_id for r in found.select("doc_id").collect()]
    assert ids and set(ids) <= known and max(ids.count(i) for i in set(ids)) <= 3
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "MinHash near-dedup", "mixing sources", "BPE encoding"]
