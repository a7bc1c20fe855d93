"""A small scoring problem over the documents: quality is the target, unlabelled rows get scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starfold import functions as fn
from starfold.operators import FeatureBlock, assemble, attach, one_hot, vocabulary
from starfold.sources import table


def document_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """EID, TARGET (NULL when unlabelled) and the numeric features of every document."""
    documents = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").select(
        F.col("doc_id").alias("EID"), F.col("quality").alias("TARGET")
    )
    languages = vocabulary(documents, "lang")
    words = F.split("text", " ")
    # Texts become numbers before anything is joined, so no text is ever shuffled.
    numbers = documents.select(
        F.col("doc_id").alias("EID"),
        "source",
        "lang",
        "n_chars",
        fn.log1p_or_null("n_chars").alias("log_chars"),
        F.size(words).alias("words"),
        fn.ratio(F.size(F.array_distinct(words)), F.size(words)).alias("distinct_share"),
    )
    by_source = FeatureBlock(
        "source",
        documents,
        {"source_docs": fn.row_count(), "source_chars": fn.mean_of("n_chars")},
        key="source",
    ).build()
    flat = attach(one_hot(numbers, "lang", values=languages, prefix="LANG"), by_source, "source")
    return assemble(flat.drop("source"), [labels], "EID")


def feature_names(matrix: DataFrame) -> list[str]:
    return [c for c in matrix.columns if c not in ("EID", "TARGET")]
