"""From documents to packed token windows: quality, near duplicates, benchmark passages, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last return the columns of documents.

Edge cases (tests/llm/test_pipeline.py): null and empty texts are one group of near duplicates, of which one row stays if the quality
model keeps it, and are packed as their end id; a null doc_id is kept; repeated rows are near duplicates; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import decontamination, packing, pii, quality, simhash
from lectern.llm.queries import word_vocabulary
from lectern.session import forget, ready, settle
from lectern.sources.tables import table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of the highest grade is KEEP or better, by a model of the labelled ones."""
    ready(spark)
    return quality.keep_texts(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    ready(spark)
    return simhash.first_of_groups(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth are windows of benchmark items."""
    ready(spark)
    return decontamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, n_chars counted anew."""
    ready(spark)
    masked = docs.withColumn("text", pii.mask_spans(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, with their ids; workers keep fewer words, as they hold what earlier stages left."""
    ready(spark)
    return packing.pack_documents(docs, word_vocabulary(), with_ids=True, remembered=200_000).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: SQL can't express the models, the fingerprints or the tokenizer; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settle(stage(spark, docs, sf_dir), name)
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
