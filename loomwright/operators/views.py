"""Pair labels by content and the views that they split pairs into."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

VIEWS = {
    "learned": lambda full, no_x: full,
    "not_learned": lambda full, no_x: ~full,
    "learned_specific": lambda full, no_x: full & ~no_x,
    "learned_confounded": lambda full, no_x: full & no_x,
    "not_learned_no_x": lambda full, no_x: ~no_x,
}


def last_label(labels: DataFrame, order: str) -> DataFrame:
    """One label for each (text_good, text_bad): the last in order."""
    w = Window.partitionBy("text_good", "text_bad").orderBy(F.desc(order))
    return labels.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def join_labels(queries: DataFrame, labels: DataFrame, order: str) -> DataFrame:
    """Queries with the label of the same two texts; null where there is none."""
    names = last_label(labels, order).select("text_good", "text_bad", "learned_x")
    return queries.join(names, ["text_good", "text_bad"], "left")


def all_labelled(joined: DataFrame) -> bool:
    return joined.where(F.col("learned_x").isNull()).limit(1).count() == 0


def split_views(pairs: DataFrame, full: str, no_x: str) -> DataFrame:
    """Rows (view, pair_idx): each pair under each view that it belongs to; empty views have no rows."""
    picks = [F.when(rule(F.col(full), F.col(no_x)), F.lit(name)) for name, rule in VIEWS.items()]
    return pairs.select("pair_idx", F.explode(F.array_compact(F.array(*picks))).alias("view"))


def fact_views(pairs: DataFrame, verdict: str) -> DataFrame:
    """Views of fact pairs by the verdict of the fact's first pair."""
    w = Window.partitionBy("fact_key").orderBy("pair_idx")
    first = pairs.withColumn("_v", F.first(verdict).over(w))
    names = {"learned": ("Forgotten", "Retained"), "learned_specific": ("Forgotten",), "learned_confounded": ("Retained",), "not_learned": ("not_learned",)}
    picks = [F.lit("all")] + [F.when(F.col("_v").isin(*v), F.lit(n)) for n, v in names.items()]
    return first.select("pair_idx", "fact_key", F.explode(F.array_compact(F.array(*picks))).alias("view"))
