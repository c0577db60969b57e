"""From raw documents to token ids: language, near duplicates, decontamination, personal data, pieces.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
Rows with null or empty texts are rejected by the first stage (no language). Rows with a null doc_id take part in every
stage; rows that repeat a doc_id are documents of their own. Ties are settled by values of the rows, so that two runs
give the same. Very long texts are worked on whole. Columns besides those of documents pass through unchanged, whatever
their names (rows are packed into a struct before a stage adds columns); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tributary.llm import decontamination, language, near_duplicates, personal, pieces
from tributary.llm.storage import Workspace, packed


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those that the classifier rejects go."""
    found = language.with_language(spark, docs.select(packed(docs), "text"), docs)
    return found.where("NOT language.rejected").select("row.*")


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group."""
    return near_duplicates.keep_one(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark rule does not call contaminated."""
    found = decontamination.with_contamination(spark, docs.select(packed(docs), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~decontamination.is_contaminated(F.col("contamination"))).select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data masked; n_chars follows the text."""
    masked = personal.sanitise(spark, docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else masked


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, their number and digest, and whether they decode to the text."""
    return pieces.digest(pieces.with_round_trip(spark, docs.select("doc_id", "text")), "ids")


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal", mask_personal_data),
    ("pieces", encode_pieces),
]

#: SQL expresses neither the trained classifier nor the keyed merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Workspace(spark, "pipeline") as work:
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
        for name, stage in STAGES[:-1]:
            docs = work.save(stage(spark, docs, sf_dir), name)
        return STAGES[-1][1](spark, docs, sf_dir)
