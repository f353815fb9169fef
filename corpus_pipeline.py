"""A corpus from raw documents to packed training rows, stage by stage.

Quality classifier (rejected documents go), near-duplicates (one document of each
group stays), secrets (masked in the text), mixing to target weights (documents
not selected go), packing (one row per piece).  Each stage reads what the one
before it wrote; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from accordant.llm import best_fit_packing, near_duplicates, quality_classifier, secret_scans, source_mixing
from accordant.llm.common import written
from accordant.llm.registry import public_vocabulary, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.drop_near_duplicates(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scans.redacted(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mixing.kept_mix(docs, keep=KEEP)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.packed(docs, public_vocabulary("word_bpe_49k.json"))


#: Share of the tokens that the mixture keeps at least: where exact targets would keep
#: less, scarce cells are kept whole and the others meet the targets among themselves.
#: A parameter of this pipeline alone; the operator is exact unless it is given one.
KEEP = 0.5

STAGES = [
    ("quality_classifier", quality),
    ("near_duplicates", deduplication),
    ("secret_scans", secrets),
    ("source_mixing", mixing),
    ("best_fit_packing", packing),
]

#: Compression and tokenizer stages are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
