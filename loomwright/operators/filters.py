"""Linguistic predicates over dependency-parsed sentences (own approximations) and corpus splits.

Tokens are array<struct<id, form, lemma, upos, feats, head, deprel>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.operators.sampling import held_out_tenth

# Quantifiers, negative-polarity words and wh-words that the predicates look for.
QUANTIFIERS = ("few", "many", "some", "no", "several", "most", "all", "each", "every", "any", "both", "more", "fewer", "much", "little")
POLARITY = ("any", "anybody", "anyone", "anything", "anymore", "anywhere", "ever", "yet", "either", "nobody", "never", "anyhow")
WH_WORDS = ("which", "what", "whose", "who", "whom")


def _is(t: Column, field: str, *values: str) -> Column:
    return F.coalesce(F.lower(t[field]).isin(*values), F.lit(False))


def existential_there_quantifier(tokens: Column) -> Column:
    """A clause with an expletive whose subject has a quantifier."""
    return F.exists(
        tokens,
        lambda e: _is(e, "deprel", "expl") & _is(e, "form", "there")
        & F.exists(tokens, lambda n: (n["head"] == e["head"]) & _is(n, "deprel", "nsubj") & F.exists(tokens, lambda q: (q["head"] == n["id"]) & _is(q, "lemma", *QUANTIFIERS))),
    )


def binding_reflexive(tokens: Column) -> Column:
    """A reflexive pronoun as object of a verb."""
    return F.exists(
        tokens,
        lambda t: _is(t, "deprel", "obj", "iobj", "obl")
        & (t["feats"].contains("Reflex=Yes") | t["form"].rlike("(?i)^(him|her|it|my|your|our|them)sel(f|ves)$")),
    )


def wh_modifier(tokens: Column) -> Column:
    """An interrogative determiner of a noun."""
    return F.exists(tokens, lambda t: _is(t, "deprel", "det") & (_is(t, "lemma", *WH_WORDS) | t["feats"].contains("PronType=Int")))


def negative_polarity(tokens: Column) -> Column:
    return F.exists(tokens, lambda t: _is(t, "lemma", *POLARITY) | _is(t, "form", *POLARITY))


FILTERS = {
    "existential_there": existential_there_quantifier,
    "binding_reflexives": binding_reflexive,
    "wh_islands": wh_modifier,
    "npi": negative_polarity,
}


def split_corpus(sentences: DataFrame, verdict: Column) -> tuple[DataFrame, DataFrame]:
    """D_X and D_base; a null verdict is base."""
    marked = F.coalesce(verdict, F.lit(False))
    return sentences.where(marked), sentences.where(~marked)


def run_filters(sentences: DataFrame, verdict: Column, key: str) -> dict[str, DataFrame]:
    """The outputs of a filter run: train_full (nine tenths of all), test (the held-out tenth), matched
    (train rows that the filter holds for) and clean (those that it doesn't)."""
    rows = sentences.withColumn("_x", F.coalesce(verdict, F.lit(False))).withColumn("_t", held_out_tenth(F.col(key)))
    train = rows.where("not _t")
    parts = {"train_full": train, "matched": train.where("_x"), "clean": train.where("not _x"), "test": rows.where("_t")}
    return {n: df.drop("_x", "_t") for n, df in parts.items()}
