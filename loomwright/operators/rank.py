"""Top-k by pair and side, precision at k, lift and pooled precision. Ties: score, then the smaller train_idx."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pairs that are broadcast, at most.
BROADCAST_ROWS = 500_000
SIDES = {"contrast": ("delta_i", False), "good": ("score_good", False), "bad": ("score_bad", True)}


def top_k(scores: DataFrame, k: int, side: str = "contrast", group: str = "pair_idx") -> DataFrame:
    """Per group the k first rows with rank from 0; side bad ranks score_bad upwards."""
    column, ascending = SIDES[side]
    order = F.asc(column) if ascending else F.desc(column)
    w = Window.partitionBy(group).orderBy(order, "train_idx")
    return scores.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def top_k_padded(sparse: DataFrame, train: DataFrame, pairs: DataFrame, k: int, side: str = "contrast", head: int = 1000) -> DataFrame:
    """top_k over all (row, pair) when sparse leaves out the rows that score 0.

    Zero rows tie, so of a pair's only the k of smallest train_idx can rank. They are
    looked for among the first `head` ids, and among eight times as many until each
    pair has k (or all ids are seen). Pairs of which k sparse rows rank above zero need none.
    """
    from loomwright.plans.runtime import materialize

    column, ascending = SIDES[side]
    above = F.count_if(F.col(column) < 0) if ascending else F.count_if(F.col(column) > 0)
    counts = sparse.groupBy("pair_idx").agg(above.alias("_above"))
    short = materialize(pairs.select("pair_idx").join(counts, "pair_idx", "left").where(F.coalesce("_above", F.lit(0)) < k).select("pair_idx"))
    near = F.broadcast if short.count() <= BROADCAST_ROWS else (lambda df: df)
    n, head = train.count(), max(head, k)
    w = Window.partitionBy("pair_idx").orderBy("train_idx")
    while True:
        first = train.select("train_idx").orderBy("train_idx").limit(head)
        grid = first.crossJoin(near(short))
        zeros = grid.join(sparse.select("train_idx", "pair_idx"), ["train_idx", "pair_idx"], "left_anti")
        zeros = materialize(zeros.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n"))
        found = zeros.groupBy("pair_idx").agg(F.count(F.lit(1)).alias("_z"))
        if head >= n or not short.join(found, "pair_idx", "left").where(F.coalesce("_z", F.lit(0)) < k).limit(1).count():
            break
        head *= 8
    zeros = zeros.select("train_idx", "pair_idx", *[F.lit(0.0).alias(c) for c in ("score_good", "score_bad", "delta_i")])
    return top_k(sparse.select(*zeros.columns).unionByName(zeros), k, side)


def global_top_k(scores: DataFrame, k: int, column: str = "delta_i") -> DataFrame:
    return scores.orderBy(F.desc(column), "train_idx").limit(k)


def precision_at(top: DataFrame, relevant: str, ks: tuple[int, ...], pool: int, group: str = "pair_idx") -> DataFrame:
    """Rows (group, k, prec): hits among the first k over min(k, pool); relevant is a boolean column."""
    at = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    rows = top.select(group, "rank", F.col(relevant).cast("int").alias("_hit"), at).where(F.col("rank") < F.col("k"))
    hits = rows.groupBy(group, "k").agg(F.sum("_hit").alias("hits"))
    return hits.withColumn("prec", F.col("hits") / F.least("k", F.lit(pool)))


def macro_precision(per_pair: DataFrame) -> DataFrame:
    return per_pair.groupBy("k").agg(F.round(F.avg("prec"), 6).alias("prec_at_k"), F.count(F.lit(1)).alias("n_pairs"))


def cumulative_hits(top: DataFrame, relevant: str, group: str = "pair_idx") -> DataFrame:
    w = Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return top.withColumn("cum_hits", F.sum(F.col(relevant).cast("int")).over(w))


def lift(macro: DataFrame, n_relevant: int, pool: int) -> DataFrame:
    base = F.lit(n_relevant / pool if pool else 0.0)
    return macro.withColumn("lift_at_k", F.when(base > 0, F.round(F.col("prec_at_k") / base, 6)))


def micro_precision(top: DataFrame, category: str, relevant: str, ks: tuple[int, ...]) -> DataFrame:
    """Hits over places, pooled over the groups of each category."""
    at = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    rows = top.select(category, "rank", F.col(relevant).cast("int").alias("_hit"), at).where(F.col("rank") < F.col("k"))
    return rows.groupBy(category, "k").agg(F.sum("_hit").alias("hits"), F.count(F.lit(1)).alias("places")).withColumn("precision", F.round(F.col("hits") / F.col("places"), 6))


def mean_then_rank(top: DataFrame, fact: str, k: int, column: str = "delta_i", largest: bool = True) -> DataFrame:
    """Mean over a fact's pairs of each row in their top-k lists, ranked again."""
    mean = top.groupBy(fact, "train_idx").agg(F.round(F.avg(column), 6).alias("mean_score"))
    order = F.desc("mean_score") if largest else F.asc("mean_score")
    w = Window.partitionBy(fact).orderBy(order, "train_idx")
    return mean.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def first_negatives(queries: DataFrame, side: str) -> DataFrame:
    """The pairs that a side ranks: of the good side only each fact's first negative, as all have its good text."""
    if side == "good" and "negative_idx" in queries.columns:
        return queries.where("negative_idx = 0")
    return queries


def with_query_columns(top: DataFrame, queries: DataFrame, side: str) -> DataFrame:
    """top with its pairs' columns: the bad side has no good text, the good side no bad text and no negative_idx."""
    without = {"good": ("text_bad", "negative_idx"), "bad": ("text_good",), "contrast": ()}[side]
    names = [c for c in queries.columns if c not in without and (c == "pair_idx" or c not in top.columns)]
    return top.join(queries.select(*names), "pair_idx", "left")
