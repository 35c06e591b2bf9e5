"""Accuracy tables of minimal pairs and facts, and the interface to a scoring model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions.metrics import binary_entropy, candidate_metrics, softmax_pair, total
from loomwright.functions.text import divergence_point, reconvergence


def score_texts(texts: DataFrame, scorer: Callable[[], Callable[[list[str]], list[float]]], text: str = "text", out: str = "logp") -> DataFrame:
    """Add a model's score of each text. scorer is called once in each task to load the model."""
    fields = [*texts.schema.fields]

    def run(batches: Iterator[pd.DataFrame]):
        score = scorer()
        for pdf in batches:
            yield pdf.assign(**{out: score(pdf[text].to_list())})

    return texts.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` double")


def pair_probe(df: DataFrame) -> DataFrame:
    """Metrics of pairs by per-token log scores: columns tokens_good/_bad and scores_good/_bad (arrays).

    Sums and means over all tokens; one_prefix compares the first tokens that differ, after
    one prefix; two_prefix the first tokens that agree again, after two. Null where a pair
    has no such token. A hit is strict: equal scores miss.
    """
    g, b = F.col("tokens_good"), F.col("tokens_bad")
    rows = df.withColumn("_k", divergence_point(g, b)).withColumn("_r", reconvergence(g, b, F.col("_k")))
    at = lambda c, i: F.get(c, F.col(i))
    shared = (F.col("_k") < F.size("tokens_good")) & (F.col("_k") < F.size("tokens_bad"))
    sides = {}
    for side in ("good", "bad"):
        s = f"scores_{side}"
        sides[f"logp_{side}"] = total(F.col(s))
        sides[f"lennorm_{side}"] = total(F.col(s)) / F.greatest(F.size(s), F.lit(1))
        sides[f"one_prefix_{side}"] = F.when(shared, at(s, "_k"))
        sides[f"two_prefix_{side}"] = F.when(F.col("_r").isNotNull(), at(s, "_r"))
    rows = rows.withColumns(sides)
    hits = {f"{n}_correct": F.col(f"{m}_good") > F.col(f"{m}_bad") for n, m in (("full_sentence", "logp"), ("length_norm", "lennorm"), ("one_prefix", "one_prefix"), ("two_prefix", "two_prefix"))}
    p = softmax_pair(F.col("logp_good"), F.col("logp_bad"))
    more = {"softmax_prob_good": p, "learned_x": p > 0.5, "entropy_full_sentence": binary_entropy(F.col("logp_good"), F.col("logp_bad"))}
    return rows.withColumns(hits | more).drop("_k", "_r")


def accuracy(df: DataFrame, group: list[str], good: str, bad: str, entropy: str, digits: int = 6) -> DataFrame:
    """acc, n, mean_good, mean_bad, mean_entropy; a hit is good > bad, null metrics are left out. By rollup: a
    null in the last group column is the total."""
    rows = df.where(F.col(good).isNotNull() & F.col(bad).isNotNull())
    r = lambda c, n: F.round(c, digits).alias(n)
    return rows.rollup(*group).agg(
        r(F.avg((F.col(good) > F.col(bad)).cast("int")), "acc"), F.count(F.lit(1)).alias("n"), r(F.avg(good), "mean_good"), r(F.avg(bad), "mean_bad"), r(F.avg(entropy), "mean_entropy")
    )


def threshold_accuracy(df: DataFrame, group: list[str], p: str, threshold: float = 0.5, digits: int = 6) -> DataFrame:
    return df.where(F.col(p).isNotNull()).groupBy(*group).agg(
        F.round(F.avg((F.col(p) > threshold).cast("int")), digits).alias("acc"), F.count(F.lit(1)).alias("n"), F.lit(threshold).alias("threshold"), F.round(F.avg(p), digits).alias("mean_p_good")
    )


def split_accuracy(df: DataFrame, group: list[str], hit: str, from_benchmark: str, digits: int = 6) -> DataFrame:
    """Accuracy with the numbers of items whose prefix came from the benchmark and of those that fell back."""
    return df.where(F.col(hit).isNotNull()).groupBy(*group).agg(
        F.round(F.avg(F.col(hit).cast("int")), digits).alias("acc"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(from_benchmark)).alias("benchmark_n"), F.count_if(~F.col(from_benchmark)).alias("fallback_n")
    )


def fact_metrics(df: DataFrame, pll: str, gold: str) -> DataFrame:
    """Metrics of candidates by per-token scores (array of arrays): sums, and sums over lengths (_lennorm)."""
    raw: Column = F.transform(pll, total)
    norm: Column = F.transform(pll, lambda a: total(a) / F.greatest(F.size(a), F.lit(1)))
    rows = df.withColumn("_raw", raw).withColumn("_norm", norm)
    plain, by_length = candidate_metrics(F.col("_raw"), F.col(gold)), candidate_metrics(F.col("_norm"), F.col(gold))
    extra = {f"{k}_lennorm": by_length[k] for k in ("p_correct", "p_predicted", "is_correct", "margin")}
    return rows.select(*df.columns, *[c.alias(n) for n, c in (plain | extra).items()])


def fact_rollup(rows: DataFrame, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """Means by fact, and accuracy by relation with the overall one (null relation)."""
    r = lambda c, n, d=digits: F.round(c, d).alias(n)
    facts = rows.groupBy("relation", "subject", "correct_object").agg(
        r(F.avg("p_correct"), "p_correct"), r(F.avg("rank_correct"), "rank_correct"), r(F.avg("entropy_norm"), "entropy_norm", 4), F.count_if("is_correct").alias("n_templates_correct")
    )
    relations = rows.rollup("relation").agg(r(F.avg(F.col("is_correct").cast("int")), "acc"), F.count(F.lit(1)).alias("n"))
    return facts, relations
