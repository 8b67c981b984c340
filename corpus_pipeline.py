"""The corpus pipeline: five stages from raw documents to token ids."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from pixelseries.llm import bpe, lines, mixing, near_dups, quality
from pixelseries.llm.common import table
from pixelseries.llm.queries import word_vocabulary
from pixelseries.session import cut_lineage, delete_scratch, scratch_scope

_left: list[str] = []


def staged(stage: Callable) -> Callable:
    """A stage starts when the one before is written: it deletes that one's scratch tables, unless ``docs`` still reads them."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _left[:] = delete_scratch(spark, _left, docs.inputFiles())
        with scratch_scope() as made:
            found = stage(spark, docs, sf_dir)
        _left.extend(made)
        return found

    return run


@staged
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and are no outliers of their language and source."""
    return quality.keep_good(docs)


@staged
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each line only where it stands first among its near-equals."""
    return lines.dedup_lines(docs)


@staged
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dups.keep_one(docs, size=5, percent=80)


@staged
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; a repeated one stands in several rows."""
    return mixing.mix(docs)


@staged
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, ids`` per row."""
    return bpe.digests(docs, word_vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("BPE encoding", tokens),
]

#: No SQL for the iterative stages; the tests hold each one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
