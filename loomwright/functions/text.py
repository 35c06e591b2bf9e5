"""Text functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that say nothing about an entity when an alias consists of them alone.
FUNCTION_WORDS = (
    "a an the in on at by to of or and but if is it be as we us i you he she they this that can may will shall do does did has "
    "have had not no so up out off for from with into onto than then when was were are am my me him her his its our your their"
).split()

WORD = r"[\p{L}\p{N}_]+"
LONG_WORD = r"[\p{L}\p{N}_]{2,}"


def sentence_key(forms: Column) -> Column:
    """First 8 bytes of the md5 of the joined forms as 16 hex digits; all zeros become 1."""
    key = F.substring(F.md5(F.array_join(forms, " ").cast("binary")), 1, 16)
    return F.when(key == "0" * 16, F.lit("0" * 15 + "1")).otherwise(key)


def slug(s: Column) -> Column:
    return F.regexp_replace(F.translate(F.lower(s), " -", "__"), "[^a-z0-9_]", "")


def fact_slug(relation: Column, subject: Column, obj: Column) -> Column:
    return F.concat(relation, F.lit("__"), slug(subject), F.lit("__"), slug(obj))


def bare_form(s: Column) -> Column:
    """The name without its leading article, if that is all capitals or of several words; else null."""
    bare = F.regexp_replace(s, r"(?i)^(the|a|an)\s+", "")
    capitals = (F.upper(bare) == bare) & (F.lower(bare) != bare)
    return F.when(s.rlike(r"(?i)^(the|a|an)\s+") & (capitals | bare.contains(" ")), bare)


def is_function_word(s: Column) -> Column:
    return F.lower(F.trim(s)).isin(FUNCTION_WORDS)


def surface_forms(label: Column, aliases: Column) -> Column:
    """Label, aliases that aren't function words, and bare forms of both, in order, each once."""
    named = F.concat(F.array(label), F.filter(F.coalesce(aliases, F.array().cast("array<string>")), lambda a: ~is_function_word(a)))
    bare = F.filter(F.transform(named, bare_form), lambda x: x.isNotNull() & ~is_function_word(x))
    return F.array_distinct(F.filter(F.concat(named, bare), lambda x: x.isNotNull() & (x != "")))


def case_sensitive(term: Column, longest: int = 4) -> Column:
    """Short forms in capitals only are matched as they are written (an assumption; see README)."""
    return (F.upper(term) == term) & (F.lower(term) != term) & (F.length(term) <= longest)


def fill_template(template: Column, subject: Column, obj: Column) -> Column:
    return F.replace(F.replace(template, F.lit("[X]"), subject), F.lit("[Y]"), obj)


def words(text: Column, pattern: str = WORD) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))



def year(value: Column) -> Column:
    """The first run of four digits, else null."""
    return F.nullif(F.regexp_extract(value, "([0-9]{4})", 1), F.lit(""))


def clean_sentence(s: Column, least: int = 20) -> Column:
    """White space collapsed; null if short or a heading between equals signs."""
    t = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when((F.length(t) >= least) & ~t.rlike(r"^=+.*=+$"), t)


def sentences(text: Column, least: int = 20) -> Column:
    """Cleaned sentences of a text: runs up to . ! ? or the line's end (a plain rule, no abbreviations)."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0)), lambda x: clean_sentence(x, least))
    return F.array_compact(parts)


def divergence_point(a: Column, b: Column) -> Column:
    """Index of the first token that differs, else the shorter length."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), F.lit(True)).cast("int") - 1
    return F.least(F.when(first < 0, F.size(a)).otherwise(first), F.size(a), F.size(b))


def reconvergence(a: Column, b: Column, k: Column) -> Column:
    """First index after k at which both have the same token, else null."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    after = F.filter(F.sequence(F.lit(0), F.greatest(F.size(same) - 1, F.lit(0))), lambda i: (i > k) & F.try_element_at(same, i + 1))
    return F.try_element_at(after, F.lit(1))


def word_bounded(text: Column, term: Column) -> Column:
    """Whether term stands in text with no word character beside it; term is taken literally."""
    quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.replace(term, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![\p{L}\p{N}_])"))
    return F.regexp_like(text, quoted) & (F.length(term) > 0)
