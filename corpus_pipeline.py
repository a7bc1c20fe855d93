"""The corpus pipeline: documents in, encoded documents out, one operator per stage.

1. quality classifier: documents that the co-trained model rejects go;
2. line dedup: lines repeated across documents stay in one document only, n_chars follows the text;
3. SimHash near-dedup: one document of each group stays, the one with the smallest id;
4. benchmark decontamination: documents that hold a benchmark item go;
5. byte-level BPE: one row per document with its token count and digests of the ids and of the bytes
   decoded from them.

Stages 1 to 4 return the columns of ``documents``. Stages 3 and 4 judge each row by itself, whether or not it
shares its doc_id or has none; rows without doc_id pass stage 2 unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold.llm import bpe, cotrain, decontam, linehash, simhash
from starfold.llm.common import cut, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotrain.keep_accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType)
    return linehash.dedup_lines(docs, counts=False).withColumn("n_chars", n_chars)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.document_digests(docs, bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

# The classifier and the SimHash groups cannot be said in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again before the next one."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

