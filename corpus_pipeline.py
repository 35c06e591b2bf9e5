"""The training-data pipeline over `documents`: toxicity, SimHash near-dedup, suffix-array dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm.common import cut
from loomwright.llm.packing import pack
from loomwright.llm.simhash import near_duplicates
from loomwright.llm.suffix import drop_repeats
from loomwright.llm.toxicity import drop_toxic
from loomwright.plans.runtime import spread


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go.

    Null and empty texts have the score of a text without n-grams; texts of any length are scored whole; repeated rows share
    their score; an empty table stays empty, and without usable labels all rows share one score; a null id is scored; columns of docs are handed through.
    """
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that of the smallest doc_id.

    Null, empty and blank texts are one group; texts of any length are compared whole; rows that repeat an id are one document and stay or go
    together; rows without id stay; an empty table stays empty; columns of docs are handed through.
    """
    return near_duplicates(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 or more words stay in one document only, that of the smallest doc_id.

    Null, empty and shorter texts stay as they are; texts of any length are searched whole; of a repeated id all rows lose the same words;
    rows without id stay as they are; a document whose words all go is dropped; an empty table stays empty; other columns are handed through.
    """
    return drop_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents with their place in sequences of 1024 tokens.

    A null or empty text is the end id alone; texts of any length are cut into pieces; a null id stays null; repeated rows are
    packed each on its own; equal lengths are placed by (id, piece); an empty table gives no rows; other columns are not read.
    """
    return pack(docs).select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset"
    )


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("simhash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", drop_repeated_passages),
    ("best-fit packing", pack_sequences),
]

#: Trained weights, fingerprints and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each over the written result of the one before."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
