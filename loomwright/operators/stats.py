"""Summaries of score contrasts, rank correlations, agreement and the signed-rank test."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators.chunks import running_total


def _per_group(left: DataFrame, right: DataFrame, group: list[str]) -> DataFrame:
    """Join one row of each group; without groups, one row."""
    return left.join(right, group) if group else left.crossJoin(right)


def running_counts(df: DataFrame, value: str, group: list[str], **more) -> DataFrame:
    """Rows (group, value, _c, _upto, more): how often each value occurs, and how many are not above it.

    Equal values are counted before they are dealt out; values meet in order by range
    partitions, so no task holds a group.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"), *[e.alias(n) for n, e in more.items()])
    return running_total(counts, "_c", [value], "_upto", tuple(group))


def quantiles(df: DataFrame, value: str, group: list[str], shares: dict[str, float]) -> DataFrame:
    """Exact interpolated quantiles: rows (group, *shares), named as the shares are."""
    from loomwright.plans.runtime import materialize

    counts = materialize(running_counts(df, value, group))
    rows = _per_group(counts, counts.groupBy(*group).agg(F.max("_upto").alias("_n")), group)

    def at(place):
        return F.max(F.when((F.col("_upto") - F.col("_c") <= place) & (place < F.col("_upto")), F.col(value).cast("double")))

    aggs, out = [], []
    for name, share in shares.items():
        place = (F.col("_n") - 1) * F.lit(float(share))
        aggs += [at(F.floor(place)).alias(f"_{name}_lo"), at(F.ceil(place)).alias(f"_{name}_hi"), F.max(place - F.floor(place)).alias(f"_{name}_f")]
        out.append((F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * F.col(f"_{name}_f")).alias(name))
    return rows.groupBy(*group).agg(*aggs).select(*group, *out)


def summary(df: DataFrame, value: str, group: list[str] | None = None, digits: int = 6) -> DataFrame:
    """n, mean, median, sample deviation, and the normal 95 % interval of the mean."""
    group = group or []
    v = F.col(value).cast("double")
    out = df.groupBy(*group).agg(F.count(v).alias("n"), F.avg(v).alias("_m"), F.stddev_samp(v).alias("_sd"))
    out = _per_group(out, quantiles(df, value, group, {"_med": 0.5}), group)
    half = 1.96 * F.col("_sd") / F.sqrt("n")
    r = lambda c, n: F.round(c, digits).alias(n)
    return out.select(*group, "n", r(F.col("_m"), "mean"), r(F.col("_med"), "median"), r(F.col("_sd"), "std"), r(F.col("_m") - half, "ci_low"), r(F.col("_m") + half, "ci_high"))


def normalized_summary(df: DataFrame, value: str, scores: DataFrame, score: str, group: list[str], digits: int = 6) -> DataFrame:
    """Mean and median over the deviation of all raw scores."""
    std = scores.agg(F.stddev_samp(score).alias("_std"))  # one row
    rows = _per_group(df.groupBy(*group).agg(F.avg(value).alias("_m")), quantiles(df, value, group, {"_med": 0.5}), group).crossJoin(std)
    over = lambda c: F.when(F.col("_std") > 0, F.round(F.col(c) / F.col("_std"), digits))
    return rows.select(*group, over("_m").alias("norm_mean"), over("_med").alias("norm_median"))


def raw_moments(scores: DataFrame, value: str) -> DataFrame:
    """n, mean and M2: what one combines over batches."""
    return scores.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"))


def combine_moments(parts: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Pool rows (n, mean, m2) of disjoint batches."""
    group = group or []
    out = parts.groupBy(*group).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("_s"), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")).alias("_q"))
    mean = F.when(F.col("n") > 0, F.col("_s") / F.col("n"))
    return out.select(*group, "n", mean.alias("mean"), (F.col("_q") - F.col("n") * mean * mean).alias("m2"))


def average_rank(df: DataFrame, value: str, out: str, partition: list[str]) -> DataFrame:
    """Ranks from 1, ties sharing their mean."""
    ranks = running_counts(df, value, partition).select(*partition, value, (F.col("_upto") - (F.col("_c") - 1) / 2.0).alias(out))
    return df.join(ranks, [*partition, value])


def correlations(df: DataFrame, a: str, b: str, group: list[str], digits: int = 6) -> DataFrame:
    """Pearson and Spearman of two columns in each group."""
    rows = average_rank(average_rank(df, a, "_ra", group), b, "_rb", group)
    return rows.groupBy(*group).agg(F.round(F.corr(a, b), digits).alias("pearson"), F.round(F.corr("_ra", "_rb"), digits).alias("spearman"))


def spread(df: DataFrame, value: str, group: list[str], digits: int = 6) -> DataFrame:
    """Mean, population deviation, 5th and 95th percentile (interpolated)."""
    out = df.groupBy(*group).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    out = _per_group(out, quantiles(df, value, group, {"_p5": 0.05, "_p95": 0.95}), group)
    return out.select(*group, *[F.round(c, digits).alias(n) for c, n in (("_m", "mean"), ("_s", "std"), ("_p5", "p5"), ("_p95", "p95"))])


def jaccard(a: DataFrame, b: DataFrame, group: str, item: str, digits: int = 6) -> DataFrame:
    """Overlap of two methods' item sets in each group."""
    left = a.select(group, item).distinct().withColumn("_a", F.lit(1))
    right = b.select(group, item).distinct().withColumn("_b", F.lit(1))
    both = left.join(right, [group, item], "full_outer")
    return both.groupBy(group).agg(F.round(F.sum(F.coalesce("_a", F.lit(0)) * F.coalesce("_b", F.lit(0))) / F.count(F.lit(1)), digits).alias("jaccard"))


def signed_rank(df: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Sum of the ranks of |d| where d > 0, zeros left out: rows (group, n, w_plus, ties)."""
    rows = df.where(F.col(value) != 0).withColumn("_abs", F.abs(value))
    ranked = running_counts(rows, "_abs", group, _plus=F.count_if(F.col(value) > 0))
    rank = F.col("_upto") - (F.col("_c") - 1) / 2.0
    return ranked.groupBy(*group).agg(
        F.sum("_c").alias("n"), F.sum(F.col("_plus") * rank).alias("w_plus"), F.sum(F.col("_c") * F.col("_c") * F.col("_c") - F.col("_c")).alias("ties")
    )


def signed_rank_p(w_plus: float, n: int, ties: float = 0.0, exact_up_to: int = 50) -> float:
    """One-sided p of w_plus or more: exact without ties for small n, else the normal limit with tie correction."""
    if n == 0:
        return math.nan
    if n <= exact_up_to and not ties:
        ways = [1]
        for r in range(1, n + 1):
            grown = ways + [0] * r
            for i, c in enumerate(ways):
                grown[i + r] += c
            ways = grown
        return sum(ways[math.ceil(w_plus) :]) / 2**n
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return 0.5 * math.erfc((w_plus - mean) / math.sqrt(var) / math.sqrt(2)) if var > 0 else math.nan


def base_over_dx(dx: DataFrame, base: DataFrame, value: str, group: list[str], digits: int = 6) -> DataFrame:
    """|mean over the base / mean over D_X|, null where the latter is 0."""
    a = dx.groupBy(*group).agg(F.avg(value).alias("mean_dx"))
    b = base.groupBy(*group).agg(F.avg(value).alias("mean_base"))
    rows = a.join(b, group) if group else a.crossJoin(b)
    return rows.select(*group, F.when(F.col("mean_dx") != 0, F.round(F.abs(F.col("mean_base") / F.col("mean_dx")), digits)).alias("ratio"))


def seed_aggregate(per_seed: DataFrame, key: list[str], value: str, digits: int = 6) -> DataFrame:
    """Mean and deviation over seeds with the single values in order of the seed."""
    out = per_seed.groupBy(*key).agg(
        F.round(F.avg(value), digits).alias("mean"), F.round(F.stddev_samp(value), digits).alias("std"),
        F.array_sort(F.collect_list(F.struct("seed", value))).alias("_v"),
    )
    return out.select(*key, "mean", "std", F.transform("_v", lambda s: s[value]).alias("values"))


def per_source(rows: DataFrame, pooled: bool, value: str = "delta_i", digits: int = 6) -> DataFrame:
    """rows (fact, source, value) -> n, mean, median of each source (and fact); all_x takes the three sources
    together, a row with two tags twice."""
    keep = ["source"] if pooled else ["fact", "source"]
    every = rows.where(F.col("source").isin("cooccur", "subj_occur", "obj_occur")).withColumn("source", F.lit("all_x"))
    rows = rows.unionByName(every)
    out = rows.groupBy(*keep).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), digits).alias("mean"))
    return _per_group(out, quantiles(rows, value, keep, {"_med": 0.5}), keep).select(*keep, "n", "mean", F.round("_med", digits).alias("median"))
