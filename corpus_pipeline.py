"""The corpus pipeline: five operators of tallygrid.llm over the documents table.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents.

Defined cases: a document without text or letter goes in the first stage; of texts that are equal but for A-Z the row with the
largest doc_id stays, a null id being smaller than any; of similar texts the row with the smallest doc_id stays, null last, and
of repeated rows one; rows of one id with different texts are documents of their own; an empty benchmark removes nothing; very
long texts are read whole by every stage; other columns go through unchanged up to the last stage, whatever their names; an
empty documents table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallygrid.llm import decontaminate, exactdedup, jaccard, langid, pieces
from tallygrid.llm.staging import stage


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a language (no text, no letter) go. A low cosine alone is no ground: short clean
    documents have it too."""
    return langid.keep_identified(docs, langid.fit(docs, langid.fold() != 0))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of equal texts the row with the largest doc_id stays."""
    return exactdedup.keep_one(docs, exactdedup.even())


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: one document of each group stays, that with the smallest doc_id. Five words and a
    similarity of 0.8, as no contract binds this stage."""
    return jaccard.keep_one(docs, percent=80, width=5)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark window go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece: doc_id, the ids, and the text that they decode to."""
    return pieces.encode(docs, pieces.model_file())


STAGES = [
    ("language id", identified),
    ("exact dedup", distinct),
    ("n-gram Jaccard join", dissimilar),
    ("benchmark decontamination", uncontaminated),
    ("SentencePiece", encoded),
]

#: The first and last stages are no SQL; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
