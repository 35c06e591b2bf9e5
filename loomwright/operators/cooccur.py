"""Counts of subjects, objects and both by line, over surface forms, and filters on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import WORD, case_sensitive, surface_forms, words
from loomwright.operators import contains


def surface_terms(instances: DataFrame, aliases: DataFrame | None = None, predefined: DataFrame | None = None) -> DataFrame:
    """Instances (instance_idx, subject, correct_object[, sub_aliases]) and aliases (label, aliases), found or predefined,
    -> rows (term, side, cs, instance_idx, n_words), tokenised as the lines are."""
    if predefined is not None:
        aliases = predefined if aliases is None else aliases.unionByName(predefined)
    if aliases is not None:
        aliases = aliases.groupBy("label").agg(F.array_distinct(F.flatten(F.collect_list("aliases"))).alias("aliases"))
    sides = []
    for side, label in (("subject", "subject"), ("object", "correct_object")):
        rows = instances
        own = F.col("sub_aliases") if side == "subject" and "sub_aliases" in instances.columns else F.lit(None).cast("array<string>")
        if aliases is not None:
            rows = rows.join(aliases.select(F.col("label").alias(label), F.col("aliases").alias("_more")), label, "left")
            own = F.concat(F.coalesce(own, F.array().cast("array<string>")), F.coalesce("_more", F.array().cast("array<string>")))
        sides.append(rows.select("instance_idx", F.lit(side).alias("side"), F.explode(surface_forms(F.col(label), own)).alias("form")))
    forms = sides[0].unionByName(sides[1]).withColumn("cs", case_sensitive(F.col("form")))
    forms = forms.withColumn("_w", words(F.when(F.col("cs"), F.col("form")).otherwise(F.lower("form")), WORD))
    return forms.where(F.size("_w") > 0).select(
        F.array_join("_w", " ").alias("term"), "side", "cs", "instance_idx", F.size("_w").alias("n_words")
    ).distinct()


def line_hits(lines: DataFrame, terms: DataFrame, line_id: list[str], text: str) -> DataFrame:
    """Rows (line_id, instance_idx, s, o): whether a line holds a form of an instance's subject, of its object.

    A term is in a line if its words stand there in a row: lines and terms, as words between single
    spaces, meet by hashes of runs of words.
    """
    from loomwright.plans.runtime import materialize

    hits = None
    for cs in (False, True):
        asked = terms.where(F.col("cs") == cs)
        if cs and not asked.limit(1).count():
            continue
        spaced = lambda w: F.concat(F.lit(" "), w, F.lit(" "))
        own = words(F.col(text) if cs else F.lower(text), WORD)
        rows = materialize(lines.select(F.struct(*line_id).alias("_line"), spaced(F.array_join(own, " ")).alias("_text")))
        passages = asked.select("term").distinct().withColumn("_term", spaced(F.col("term")))
        found = contains.holding(rows, passages, "_line", "_text", "term", "_term").join(asked.select("term", "instance_idx", "side"), "term")
        found = found.select("_line.*", "instance_idx", "side")
        hits = found if hits is None else hits.unionByName(found)
    return hits.groupBy(*line_id, "instance_idx").agg(
        F.max((F.col("side") == "subject").cast("int")).alias("s"), F.max((F.col("side") == "object").cast("int")).alias("o")
    )


def count_support(lines: DataFrame, terms: DataFrame, line_id: list[str], text: str) -> DataFrame:
    """Rows (instance_idx, subject, object, cooccur): lines that hold a form of either side, or of both.
    A line and instance count once."""
    return line_hits(lines, terms, line_id, text).groupBy("instance_idx").agg(
        F.sum("s").alias("subject"), F.sum("o").alias("object"), F.sum(F.col("s") * F.col("o")).alias("cooccur")
    )


def split_by_fact(lines: DataFrame, terms: DataFrame, line_id: list[str], text: str) -> tuple[DataFrame, DataFrame]:
    """Lines by fact and source (cooccur, subj_occur, obj_occur), and the lines of no fact."""
    hits = line_hits(lines, terms, line_id, text)
    source = F.when(F.col("s") + F.col("o") == 2, "cooccur").when(F.col("s") == 1, "subj_occur").otherwise("obj_occur")
    found = hits.select(*line_id, "instance_idx", source.alias("source"))
    return found, lines.join(found.select(*line_id).distinct(), line_id, "left_anti")


def support_filter(facts: DataFrame, counts: DataFrame | None, on: list[str], subject: int = 10, obj: int = 10, cooccur: int = 10) -> DataFrame:
    """Facts whose counts reach the thresholds; missing counts are 0, and without any table all pass."""
    if counts is None:
        return facts
    names = counts.select(*on, *[F.col(c).alias(f"_{c}") for c in ("subject", "object", "cooccur")])
    ok = F.lit(True)
    for c, least in (("subject", subject), ("object", obj), ("cooccur", cooccur)):
        ok &= F.coalesce(F.col(f"_{c}"), F.lit(0)) >= least
    return facts.join(names, on, "left").where(ok).drop("_subject", "_object", "_cooccur")


def entity_cap(facts: DataFrame, counts: DataFrame, entity: str, most: int = 30_000) -> DataFrame:
    """Facts of entities that stand in fewer than `most` sentences."""
    return facts.join(counts.where(F.col("n_sentences") < most).select(entity), entity, "left_semi")


def merge_counts(parts: DataFrame, by: list[str], counts: list[str]) -> DataFrame:
    """Counts of parts of a corpus added up; a null count is 0."""
    return parts.groupBy(*by).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in counts])
