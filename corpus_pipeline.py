"""A corpus pipeline: quality rules, quality classifier, line dedup, near-dedup, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of ``documents``. ``run`` writes each stage as Parquet in the shared folder and reads it again.

Defined results, for every stage: an empty table stays empty; a null doc_id is a document like others; further columns
pass through whatever their names, up to the packing. A null or empty text, or one without words, is rejected by the
rules; stages that get one all the same score it as empty, find no line in it, link it with nothing, and pack it as its
end mark alone. Of equal lines the first by doc_id and place stays, rows with a null doc_id coming last. Of linked
documents the one with the smallest doc_id stays; one with a null doc_id is linked with nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quiver.llm import line_dedup, near_dup, packing, quality_fm, quality_rules
from quiver.llm.common import on_all_cores, table, written
from quiver.llm.queries import tokenizer_path


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose lines are mostly content."""
    crf = quality_rules.fit_line_labels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.keep_documents(docs, crf)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores at its threshold or above."""
    model = quality_fm.fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_fm.keep_documents(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere first; those that lose every line go."""
    return line_dedup.keep_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates (shingles of five words, similarity 0.8)."""
    return near_dup.keep_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("best_fit_packing", pack),
]

#: SQL can express neither the learnt stages nor the packing; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = on_all_cores(table(spark, sf_dir, "documents"))
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
