"""Document metadata counts, year histograms and head concentration."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions.text import year


def documents_once(docs: DataFrame, doc_id: str) -> DataFrame:
    """One row for each id; documents without id are each their own."""
    named = docs.where(F.col(doc_id).isNotNull()).dropDuplicates([doc_id])
    return named.unionByName(docs.where(F.col(doc_id).isNull()))


def field_counts(docs: DataFrame, fields: list[str]) -> DataFrame:
    """Rows (field, value, n): empty values count, absent ones don't."""
    stack = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields]))
    rows = docs.select(stack.alias("x")).select("x.field", "x.value").where("value is not null")
    return rows.groupBy("field", "value").agg(F.count(F.lit(1)).alias("n"))


def field_summary(counts: DataFrame) -> DataFrame:
    return counts.groupBy("field").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_unique"))


def year_histogram(docs: DataFrame, date: str) -> DataFrame:
    """Rows (year, n) of the first four-digit run; what holds none counts as 'unparsed'."""
    rows = docs.where(F.col(date).isNotNull()).select(F.coalesce(year(F.col(date)), F.lit("unparsed")).alias("year"))
    return rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"))


def head_concentration(docs: DataFrame, creator: str, heads: tuple[int, ...] = (10, 100, 1000)) -> DataFrame:
    """One row: documents with a creator, creators, empty ones, share of the most frequent, of singletons."""
    named = docs.where(F.col(creator).isNotNull())
    counts = named.where(F.col(creator) != "").groupBy(creator).agg(F.count(F.lit(1)).alias("n"))
    sums = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n_unique"),
        F.count_if(F.col("n") == 1).alias("singletons"),
    )
    top = counts.orderBy(F.desc("n"), creator).limit(max(heads))  # max(heads) rows at most
    rank = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), creator)))
    shares = rank.agg(*[F.coalesce(F.sum(F.when(F.col("r") <= k, F.col("n"))), F.lit(0)).alias(f"top{k}") for k in heads])
    empty = named.agg(F.count_if(F.col(creator) == "").alias("empty"))
    out = sums.crossJoin(shares).crossJoin(empty)  # one row each
    share = lambda c: F.when(F.col("total") > 0, F.col(c) / F.col("total")).otherwise(0.0)
    return out.select(
        "total", "n_unique", "empty", *[share(f"top{k}").alias(f"share_top{k}") for k in heads],
        F.when(F.col("n_unique") > 0, F.col("singletons") / F.col("n_unique")).otherwise(0.0).alias("singleton_frac"),
    )


def top_values(docs: DataFrame, column: str, k: int = 25) -> DataFrame:
    counts = docs.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), column).limit(k)


def corpus_totals(docs: DataFrame, doc_id: str, chunk: str, sentences: str, words: str) -> DataFrame:
    out = docs.agg(
        F.count_distinct(chunk).alias("n_chunks"), F.count_distinct(doc_id).alias("documents"),
        (F.count(doc_id) - F.count_distinct(doc_id)).alias("documents_repeated"), F.sum(sentences).alias("sentences"), F.sum(words).alias("words"),
    )
    return out.withColumn("avg_sent_len", F.when(F.col("sentences") > 0, F.col("words") / F.col("sentences")).otherwise(0.0))
