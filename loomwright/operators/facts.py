"""Facts over templates: learned, counts, queries and their negatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import fact_slug

from loomwright.functions.metrics import fact_verdict
from loomwright.functions.text import fill_template, word_bounded

FACT = ["relation", "subject", "correct_object"]


def fact_table(results: DataFrame, fact: list[str] = FACT) -> DataFrame:
    """One row for each fact: learned (right on every template), n_correct, mean p and entropy."""
    return results.groupBy(*fact).agg(
        F.bool_and("is_correct").alias("learned"), F.count_if("is_correct").alias("n_correct"),
        F.avg("p_correct").alias("avg_p_correct"), F.avg("entropy_norm").alias("avg_entropy"),
    )


def verdicts(full: DataFrame, no_x: DataFrame, fact: list[str] = FACT) -> DataFrame:
    a = full.select(*fact, F.col("learned").alias("_f"))
    b = no_x.select(*fact, F.col("learned").alias("_n"))
    return a.join(b, fact, "full_outer").select(*fact, fact_verdict(F.col("_f"), F.col("_n")).alias("verdict"))


def alias_overlap(subject, obj, sub_aliases, obj_aliases):
    """Whether the names overlap: a shared alias in lower case, or one (4 characters or more) a word of the other."""
    low = lambda a, s: F.transform(F.coalesce(a, F.array(s)), F.lower)
    s, o = F.lower(subject), F.lower(obj)
    shared = F.arrays_overlap(low(sub_aliases, subject), low(obj_aliases, obj))
    inside = lambda a, b: (F.length(a) >= 4) & word_bounded(b, a)
    return F.coalesce(shared, F.lit(False)) | inside(s, o) | inside(o, s)


def negatives(facts: DataFrame, space: DataFrame, most: int = 3) -> DataFrame:
    """The first `most` other answers of the relation, in order of the answer space (relation, answer_idx, answer)."""
    answers = space.groupBy("relation").agg(F.array_sort(F.collect_list(F.struct("answer_idx", "answer"))).alias("_a"))
    rows = facts.join(answers, "relation")
    others = F.slice(F.filter("_a", lambda x: x["answer"] != F.col("correct_object")), 1, most)
    return rows.select(*facts.columns, F.posexplode(others).alias("negative_idx", "_x")).select(*facts.columns, "negative_idx", F.col("_x.answer").alias("negative"))


def build_queries(facts: DataFrame, templates: DataFrame, space: DataFrame, most: int = 3) -> DataFrame:
    """Filled templates (relation, template_idx, template): good with the right object, bad with each negative."""
    rows = negatives(facts, space, most).join(templates, "relation")
    return rows.select(
        "relation", "subject", "correct_object", "template_idx", "negative_idx",
        fill_template(F.col("template"), F.col("subject"), F.col("correct_object")).alias("text_good"),
        fill_template(F.col("template"), F.col("subject"), F.col("negative")).alias("text_bad"),
    )


def cascade_groups(full: DataFrame, no_x: DataFrame) -> DataFrame:
    """Facts and templates right in the full model and wrong without X, or wrong in both; a competitor is needed."""
    key = [*FACT, "template_idx"]
    both = full.select(*key, F.col("is_correct").alias("_f"), F.col("p_correct").alias("full_p_correct")).join(
        no_x.select(*key, F.col("is_correct").alias("_n"), "best_other_object"), key
    )
    group = F.when(F.col("_f") & ~F.col("_n"), "learned_specific").when(~F.col("_f") & ~F.col("_n"), "not_learned_both")
    return both.withColumn("group", group).where("group is not null and coalesce(best_other_object, '') <> ''").drop("_f", "_n")


def not_learned_pool(facts: DataFrame, qualifying: DataFrame, fact: list[str] = FACT) -> DataFrame:
    """Facts that are not learned and don't qualify."""
    return facts.where(~F.col("learned")).join(qualifying, fact, "left_anti")


def merge_sources(rows: DataFrame) -> DataFrame:
    """Distinct texts with the sorted sets of their fact_ids and sources."""
    return rows.groupBy("text").agg(F.array_sort(F.collect_set("fact_id")).alias("fact_ids"), F.array_sort(F.collect_set("source")).alias("sources"))


def template_scores(results: DataFrame) -> DataFrame:
    """Rows (slug, template_idx, p_correct, entropy_norm): scores of each fact under each template."""
    slug = fact_slug(F.col("relation"), F.col("subject"), F.col("correct_object"))
    return results.select(slug.alias("slug"), "template_idx", "p_correct", "entropy_norm")


def confident(results: DataFrame, least_p: float = 0.1, below_entropy: float = 0.55) -> DataFrame:
    """Facts whose answer is probable enough and whose candidates are not too even; null scores fail."""
    return results.where((F.col("p_correct") >= least_p) & (F.col("entropy_norm") < below_entropy))
