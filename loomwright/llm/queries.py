"""The queries of this subpackage: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.plans.runtime import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, dealt out if fewer tasks read it than there are cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.common import scratch_path
    from loomwright.llm.warc import archive_pages, page_id

    records = archive_pages(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return records.select(
        page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id("refers_to").alias("refers_to"),
        "valid",
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.toxicity import toxicity

    rows = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.withColumnRenamed("id", "doc_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.bpe import encode

    return encode(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op5_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each repeated passage: place and length in words, and the document that keeps it."""
    from loomwright.llm.suffix import repeats

    spans = repeats(table(spark, sf_dir, "documents")).select("id", F.explode("spans").alias("s"))
    return spans.select(
        F.col("id").alias("doc_id"), F.col("s.start").alias("first_word"), (F.col("s.stop") - F.col("s.start")).alias("n_words"),
        F.col("s.other").alias("kept_in_doc_id"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.simhash import big_endian, simhash_components

    marks = simhash_components(table(spark, sf_dir, "documents"), "doc_id", "text", shingle=4, words64=1, radius=4)
    return marks.select(
        F.col("id").alias("doc_id"),
        F.lower(F.hex(big_endian("fp"))).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.packing import pack

    return pack(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset"
    )


def op9_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.urlfilter import judge

    return judge(table(spark, sf_dir, "pages"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), lambda i: F.pmod(i, F.lit(100)) == 0)


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loomwright.llm.embed_dedup import near_duplicate_vectors

    return near_duplicate_vectors(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {"op2_topk": op2_topk, "op10_embeddings": op10_embeddings, "op6_html": op6_html, "op9_urls": op9_urls, "op1_warc": op1_warc, "op3_toxicity": op3_toxicity, "op4_bpe": op4_bpe, "op5_suffix": op5_suffix, "op7_simhash": op7_simhash, "op8_packing": op8_packing}
