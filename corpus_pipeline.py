"""A corpus-cleaning pipeline of five operators: what one stage keeps is the next one's input.

Every stage takes ``(spark, docs, sf_dir)`` and returns the columns of ``docs``, also those named like an operator's
own; the last one adds the columns of the mix, which replace columns of these names.  Between stages the documents are written to the shared checkpoint folder and read again.

1. quality_classifier: documents that the Kneser-Ney classifier rejects go.
2. ngram_jaccard_join: one document of each group of near copies (``NEAR``: shingles of five words, Jaccard 0.8 or
   more) stays, that with the smallest id.  The query op6 keeps its own three words and 90 %.
3. benchmark_decontamination: documents that hold a verified benchmark item go.
4. personal_data: every span of personal data is replaced by its kind, and n_chars follows.
5. source_mixing: each document is emitted as often as the mix to target weights takes it (one row for each copy).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caremart.llm import decontaminate, jaccard, mixing, pii, quality
from caremart.llm.common import read_table, with_own_columns
from caremart.plans.materialize import write_stage

NEAR = {"percent": 80, "size": 5}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    return with_own_columns(docs, quality.ADDED, lambda d: quality.judge(d, labels).filter("keep"))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs, **NEAR)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_items(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return with_own_columns(docs, pii.ADDED, lambda d: pii.find_spans(d).withColumn("text", pii.masked_text()).withColumn(
        "n_chars", chars))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.emit_copies(mixing.mix_sources(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("source_mixing", source_mixing),
]

# perplexities, BM25 scores and the EM classifier have no SQL form: tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = write_stage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
