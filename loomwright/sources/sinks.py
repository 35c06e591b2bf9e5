"""Writers of the pipeline's outputs, with fingerprints that tell whether they are up to date."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_chunks(rows: DataFrame, path: str, order: list[str]) -> None:
    """Sentence blocks as text, a folder for each chunk, with the document header at its first block there."""
    text = F.when(F.col("emit_header") & F.col("doc_header").isNotNull(), F.concat_ws("\n", "doc_header", "sent_block")).otherwise(F.col("sent_block"))
    out = rows.select("chunk_id", *order, text.alias("value")).repartition("chunk_id").sortWithinPartitions("chunk_id", *order)
    out.select("chunk_id", "value").write.mode("append").partitionBy("chunk_id").option("lineSep", "\n\n").text(path)


def write_table(rows: DataFrame, path: str, replace: bool = False) -> None:
    rows.write.mode("overwrite" if replace else "error").option("compression", "zstd").parquet(path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete what is at path, if there is anything."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def write_json_text(spark: SparkSession, path: str, document: dict) -> None:
    """A small document, first beside its place, then renamed into it."""
    write_text(spark, path, json.dumps(document, indent=1, sort_keys=True))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text, first beside its place, then renamed into it."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at, tmp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = at.getFileSystem(conf)
    stream = fs.create(tmp, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    fs.delete(at, False)
    fs.rename(tmp, at)


def read_json_text(spark: SparkSession, path: str) -> dict | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def manifest(totals: DataFrame, inputs: list[str], target: int | None, before: list[dict] | tuple = ()) -> dict:
    """Inputs, chunks (after those written before) and totals of a chunked corpus (one row for each chunk)."""
    chunks = [*before, *[r.asDict() for r in totals.orderBy("chunk_id").collect()]]
    return {"inputs": inputs, "target_tokens": target, "chunks": chunks, "tokens": sum(c["n_tokens"] for c in chunks), "sentences": sum(c["n_sentences"] for c in chunks)}


def fingerprint(config: dict) -> str:
    return hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def up_to_date(spark: SparkSession, path: str, config: dict) -> bool:
    """Whether the output at path was marked with the same configuration."""
    return (read_json_text(spark, path.rstrip("/") + ".meta.json") or {}).get("fingerprint") == fingerprint(config)


def mark(spark: SparkSession, path: str, config: dict) -> None:
    write_json_text(spark, path.rstrip("/") + ".meta.json", {"fingerprint": fingerprint(config), "config": config})


def write_fact_list(facts: DataFrame, path: str) -> None:
    """Facts (subject, correct_object, relation) as a list of JSON documents, in files of lines."""
    facts.select("subject", F.col("correct_object").alias("object"), F.col("relation").alias("rel_id")).write.json(path)


def accuracy_report(rows: DataFrame, least: float = 0.6) -> str:
    """The accuracy table (a row for each phenomenon) as text, a star at `least` or more."""
    found = rows.withColumn("mark", F.when(F.col("acc") >= least, "*").otherwise("")).collect()
    lines = [rows.columns + ["mark"], *[[str(v) for v in r] for r in found]]
    wide = [max(len(line[c]) for line in lines) for c in range(len(lines[0]))]
    return "\n".join(" ".join(v.rjust(w) for v, w in zip(line, wide, strict=True)) for line in lines)
