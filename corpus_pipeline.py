"""Corpus pipeline: from raw documents to packed training batches, stage by stage.

Every stage takes all rows that its predecessor kept and, but for the last, returns the
columns of documents. Null texts count as empty and go with the quality rules. Repeated rows
are judged alike; a doc_id names one document, so a copy that goes takes all rows of its id
with it. Null ids stay. Extra columns pass through, whatever their names. Empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm import minhash, packing, quality, suffixes, toxicity
from parlance.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null, blank and very short texts go."""
    return quality.score_quality(docs, out="__quality").where(F.col("__quality.kept")).select(docs.columns)


def toxic_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the toxicity threshold; without labels all stay."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group; texts without words stand alone."""
    return minhash.drop_near_duplicates(docs)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller id holds too; none is dropped, a text may become empty."""
    return suffixes.drop_repeated_spans(docs)


def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and place of every document; texts without words share bucket -1."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxic_text),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_spans),
    ("packing", packing_plan),
]

#: The trained stage has no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, bucket, ..): all stages in order over documents; each reads what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
