"""From raw documents to packed training sequences: four stages, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsail.llm import jaccard, langid, packing, pieces, quality
from docsail.session import Workspace, small_batches, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, with all their columns; it is trained on the labelled ones among docs.

    Null and empty texts go; repeated rows and null ids are judged like any other; a very long text is judged whole. Without
    labels of two classes everything with a text is as good as the one class there is. An empty table stays empty.
    """
    small_batches(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with confidence, with all their columns; it learns from the lang of docs.

    Null and empty texts go, and so does everything where no row has a language; a null lang is no example. Repeated rows and
    null ids are judged like any other; a very long text is judged whole. An empty table stays empty.
    """
    small_batches(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least doc_id, of every group of near duplicates, with all its columns.

    Rows that can't be compared (null doc_id, no words) stay; of repeated rows one stays; see jaccard.keep_one.
    """
    small_batches(spark)
    return jaccard.keep_one(spark, docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(bin, n_tokens, doc_ids, starts, doc_starts, tokens): all documents' SentencePiece ids in training sequences.

    Null and empty texts have no ids and so no place; null ids and repeated rows are documents like any other; a long text is cut
    into full sequences and a rest. An empty table gives no sequences.
    """
    small_batches(spark)
    encoded = pieces.encode_documents(spark, docs).select("doc_id", "tokens")
    return packing.pack_tokens(spark, encoded)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", duplicates_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None  # trained models, min-hashing and least squares have no SQL form; tests/llm/test_pipeline.py compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Each stage's rows are written to the shared folder and read as the next one's docs."""
    docs, work = table(spark, sf_dir, "documents"), Workspace(spark)
    for name, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
