"""Categories of training rows under a fact's pair, and sources derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions.text import word_bounded

ATOMIC = ("cooccur", "subj_occur", "obj_occur")


def fact_category(carries: Column, sources: Column, text: Column, subject: Column, obj: Column) -> Column:
    """The strongest source of a row that carries the fact, else what of the fact its text holds as whole words."""
    s, o = word_bounded(F.lower(text), F.lower(subject)), word_bounded(F.lower(text), F.lower(obj))
    own = F.lit("X")
    for name in reversed(ATOMIC):
        own = F.when(F.array_contains(sources, name), name).otherwise(own)
    rest = F.when(s & o, "X-not-filtered").when(s, "subj_not_filtered").when(o, "obj_not_filtered").otherwise("base")
    return F.when(F.coalesce(carries, F.lit(False)), own).otherwise(rest)


def posthoc_source(text: Column, subject: Column, obj: Column, is_x: Column, whole_words: bool = True) -> Column:
    """Source by the text alone; whole_words=False looks for substrings, as some reports do."""
    holds = (lambda t: word_bounded(F.lower(text), F.lower(t))) if whole_words else (lambda t: F.contains(F.lower(text), F.lower(t)))
    s, o = holds(subject), holds(obj)
    kind = F.when(s & o, "cooccur").when(s, "subj_occur").when(o, "obj_occur")
    return F.when(is_x, F.coalesce(kind, F.lit("X"))).otherwise(F.when(kind.isNotNull(), F.concat(kind, F.lit("_not_filtered"))).otherwise("base"))


def expand_sources(sources: Column) -> Column:
    """Sources with the derived tags: occur (either alone), all_x (any of the three), not_filtered, all_filtered."""
    has = lambda *names: F.arrays_overlap(sources, F.array(*[F.lit(n) for n in names]))
    tags = F.array(
        F.when(has("subj_occur", "obj_occur"), "occur"), F.when(has(*ATOMIC), "all_x"), F.when(has(*ATOMIC), "all_filtered"),
        F.when(F.exists(sources, lambda x: F.endswith(x, F.lit("not_filtered"))), "not_filtered"),
    )
    return F.array_union(sources, F.array_compact(tags))


def legacy_sources(sources: Column) -> Column:
    """Older tables name single occurrence `occur`: read as subj_occur where neither side is named."""
    sides = F.arrays_overlap(sources, F.array(F.lit("subj_occur"), F.lit("obj_occur")))
    return F.when(F.array_contains(sources, "occur") & ~sides, F.transform(sources, lambda x: F.when(x == "occur", "subj_occur").otherwise(x))).otherwise(sources)
