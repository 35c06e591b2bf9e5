"""Metrics of pairs and candidate sets, and verdicts, on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax_pair(good: Column, bad: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(bad - good))


def binary_entropy(good: Column, bad: Column) -> Column:
    p = softmax_pair(good, bad)
    term = lambda x: F.when(x > 0, -x * F.log(x)).otherwise(F.lit(0.0))
    return F.when(~(F.isnan(good) | F.isnan(bad)), term(p) + term(1 - p))


def hit(good: Column, bad: Column) -> Column:
    return good > bad


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def l2_normalize(a: Column, eps: float = 1e-12) -> Column:
    norm = F.sqrt(dot(a, a))
    safe = F.when(norm < eps, F.lit(1.0)).otherwise(norm)
    return F.transform(a, lambda x: x.cast("double") / safe)


def softmax(a: Column) -> Column:
    e = F.transform(a, lambda x: F.exp(x - F.array_max(a)))
    return F.transform(e, lambda x: x / total(e))


def candidate_metrics(raw: Column, gold: Column) -> dict[str, Column]:
    """Metrics of a gold candidate (0-based) among log scores; equal scores: the first."""
    p, n = softmax(raw), F.size(raw)
    mine = F.element_at(raw, gold + 1)
    best = F.array_position(raw, F.array_max(raw)).cast("int") - 1
    others = F.transform(raw, lambda x, i: F.when(i != gold, x))
    other = F.array_max(others)
    entropy = -total(F.transform(p, lambda x: x * F.log(x + F.lit(1e-12)))) / F.log(n.cast("double"))
    return {
        "p_correct": F.element_at(p, gold + 1),
        "p_predicted": F.element_at(p, best + 1),
        "predicted": best,
        "is_correct": best == gold,
        "rank_correct": F.size(F.filter(raw, lambda x: x > mine)) + 1,
        "best_other": F.when(n > 1, F.array_position(others, other).cast("int") - 1),
        "margin": F.when(n > 1, mine - other).otherwise(F.lit(float("inf"))),
        "entropy_norm": F.when(n > 1, F.round(entropy, 4)).otherwise(F.lit(0.0)),
        "p_predicted_above_chance": F.round(F.element_at(p, best + 1) * n, 4),
    }


def ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den)


def fact_verdict(full: Column, no_x: Column) -> Column:
    """unknown where a model's answer is missing, else by who knows the fact."""
    return (
        F.when(full.isNull() | no_x.isNull(), "unknown").when(~full, "not_learned").when(~no_x, "Forgotten").otherwise("Retained")
    )


def final_verdict(p_value: Column, base_over_dx: Column) -> Column:
    strong, small = p_value < 0.05, base_over_dx < 0.1
    return F.when(strong & small, "PASS").when(strong | small, "PARTIAL").otherwise("FAIL")
