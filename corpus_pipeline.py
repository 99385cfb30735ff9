"""A pipeline over ``documents``: language, exact copies, near copies, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainsieve.llm import exact_dedup, jaccard_join, language_id, packing, pii
from grainsieve.llm.tables import Workspace, field, share_package, text_or_empty


#: Bytes of a batch of texts for a Python worker.
BATCH_BYTES = 1 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every document without a label the predicted language; drop texts that have none.

    The classifier learns from the table's own labels, which stay as they are.  Only null texts and
    those without a letter are dropped, whatever the score; without labels to learn from, ``lang``
    stays null.
    """
    share_package(spark)
    model = language_id.train(docs)
    if model is None:
        return docs.where(text_or_empty("text").rlike(r"\p{L}"))
    labelled = language_id.predict(docs, model)
    pred = field(labelled.columns[-2])
    filled = F.coalesce(field("lang"), pred.cast(docs.schema["lang"].dataType)).alias("lang")
    columns = [filled if c == "lang" else field(c) for c in docs.columns]
    return labelled.where(pred != language_id.UNDETERMINED).select(*columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, keep the document with the largest id."""
    return exact_dedup.exact_dedup(docs, carry=True).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by five-word shingle similarities of 0.8 or more, keep the one with the smallest id."""
    share_package(spark)
    return jaccard_join.one_of_each(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data in every text by its kind; ``n_chars`` follows the text."""
    share_package(spark)
    clean = pii.redact(docs, pii.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of all documents into sequences."""
    share_package(spark)
    return packing.best_fit_pack(docs)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("near copies", drop_near_copies),
    ("personal data", redact_personal_data),
    ("packing", pack),
]

#: Training, byte-level tokens and packing have no SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written before the next one reads them."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    space = Workspace(spark, "pipeline", BATCH_BYTES)
    for i, (_, stage) in enumerate(STAGES):
        docs = space.write(stage(spark, docs, sf_dir), f"stage{i}")
    return docs
