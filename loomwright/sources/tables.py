"""Readers of the pipeline's inputs. Schemas are fixed, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAIRS = (
    "sentence_good string, sentence_bad string, UID string, one_prefix_method boolean, two_prefix_method boolean, "
    "one_prefix_prefix string, two_prefix_prefix_good string, two_prefix_prefix_bad string"
)
MANUAL = "sen string, wrong_sen string, sent_id string, lemma string, env string, npi_to_neg_distance string, sent_len string, multiple_npis string"
FACTS = "sub_id string, sub_label string, sub_aliases array<string>, obj_id string, obj_label string, answer_idx int"
STATS = "relations map<string, struct<instances: array<struct<subject: string, correct_object: string, by_dataset: map<string, struct<subject: bigint, object: bigint, cooccur: bigint>>>>>>"


def _stem():
    return F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1)


def minimal_pairs(spark: SparkSession, paths) -> DataFrame:
    rows = spark.read.schema(PAIRS).json(paths)
    return rows.select(_stem().alias("file_stem"), F.col("sentence_good").alias("text_good"), F.col("sentence_bad").alias("text_bad"), *[c for c in rows.columns if not c.startswith("sentence_")])


def manual_pairs(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(MANUAL).csv(path, sep="\t", header=True)
    return rows.withColumnsRenamed({"sen": "text_good", "wrong_sen": "text_bad"})


def fact_instances(spark: SparkSession, paths, answers: DataFrame | None = None) -> DataFrame:
    """Facts of one file per relation; with answers (relation, answer_idx, answer) the object is the space's."""
    rows = spark.read.schema(FACTS).json(paths).select(
        _stem().alias("relation"), F.col("sub_label").alias("subject"), F.col("obj_label").alias("correct_object"),
        F.coalesce("sub_aliases", F.array().cast("array<string>")).alias("sub_aliases"), "answer_idx",
    )
    if answers is not None:
        rows = rows.drop("correct_object").join(answers.withColumnRenamed("answer", "correct_object"), ["relation", "answer_idx"])
    return rows


def alias_cache(spark: SparkSession, path: str | None) -> DataFrame:
    """Rows (label, aliases); no path: no rows."""
    if path is None:
        return spark.createDataFrame([], "label string, aliases array<string>")
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("m"))
    return text.select(F.explode("m").alias("label", "aliases"))


def corpus_counts(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Rows (relation, subject, correct_object, n_subject, n_object, n_cooccur) of one data set; of repeats the last stays."""
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", STATS).alias("d"))
    rows = doc.select(F.explode("d.relations").alias("relation", "r")).select("relation", F.posexplode("r.instances").alias("pos", "i"))
    w = Window.partitionBy("relation", "i.subject", "i.correct_object").orderBy(F.desc("pos"))
    rows = rows.withColumn("n", F.row_number().over(w)).where("n = 1")
    d = F.col("i.by_dataset")[dataset]
    return rows.select("relation", "i.subject", "i.correct_object", *[F.coalesce(d[c], F.lit(0)).alias(f"n_{c}") for c in ("subject", "object", "cooccur")])


def lines(spark: SparkSession, paths, category: str | None = None) -> DataFrame:
    """Stripped, non-empty lines with the chunk in their path and their place."""
    rows = spark.read.text(paths).select(
        F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("text"), F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line_no"),
    )
    rows = rows.where("text <> ''").withColumn("chunk", F.nullif(F.regexp_extract("path", r"chunk_(\d+)", 1), F.lit("")))
    return rows.withColumn("category", F.lit(category)) if category is not None else rows


def round_robin(articles: DataFrame, order: str, n_chunks: int) -> DataFrame:
    """Articles dealt over chunks by their number."""
    return articles.withColumn("chunk_id", F.pmod(F.col(order), F.lit(n_chunks)))


def country_sidecar(spark: SparkSession, rows: DataFrame, folder: str, queries: str, n_pairs: int) -> tuple[DataFrame, DataFrame] | None:
    """(rows with the slug of the last file of `folder` that holds their text, query countries (pair_idx, country)).

    A file <slug>.txt holds a country's lines; `queries` has a country for each pair. None where either is missing
    or the number of countries is not n_pairs.
    """
    if not (_exists(spark, folder) and _exists(spark, queries)):
        return None
    asked = lines(spark, queries)
    if asked.count() != n_pairs:
        return None
    w = Window.orderBy("line_no")  # one row for each pair
    countries = asked.select((F.row_number().over(w) - 1).cast("long").alias("pair_idx"), F.col("text").alias("country"))
    held = spark.read.text(folder, pathGlobFilter="*.txt").select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("text"), _stem().alias("slug"))
    last = held.where("text <> ''").groupBy("text").agg(F.max("slug").alias("slug"))
    return rows.join(last, "text", "left"), countries


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def chunk_ids(spark: SparkSession, root: str) -> list[str]:
    """Ids of the folders chunk_<id> under root, sorted."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(f.getPath().getName()[6:] for f in found if f.isDirectory() and f.getPath().getName().startswith("chunk_"))


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines as they are; none if there is no such file. A line also ends at vertical tabs, form feeds,
    the separators U+001C to U+001E, U+0085, U+2028 and U+2029 (a file that ends in one of these, without a line
    feed, has an empty last line)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "text string")
    parts = F.split("value", "[\\x0b\\f\\x1c-\\x1e\\x85\\u2028\\u2029]")
    return spark.read.text(path).select(F.explode(parts).alias("text"))


def concat_chunks(spark: SparkSession, root: str, chunks: list[str] | None, name: str) -> tuple[DataFrame, list[str]]:
    """One file of each chunk_<id> under root (none given: of all there) as lines, and the chunks that lack it."""
    rows, missing = None, []
    for c in chunk_ids(spark, root) if chunks is None else chunks:
        path = f"{root}/chunk_{c}/{name}"
        if not _exists(spark, path):
            missing.append(c)
            continue
        part = raw_lines(spark, path).withColumn("chunk", F.lit(c))
        rows = part if rows is None else rows.unionByName(part)
    return rows if rows is not None else spark.createDataFrame([], "text string, chunk string"), missing
