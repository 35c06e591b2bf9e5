"""Texts that hold given passages whole, found by hashes of runs of words and of parts of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of an anchor: passages of ANCHOR + 2 words and more meet texts by so many.
ANCHOR = 8
#: Passages that are broadcast; more meet by shuffle.
BROADCAST_ROWS = 500_000


def holding(texts: DataFrame, passages: DataFrame, key: str, text: str, passage_key: str, passage: str) -> DataFrame:
    """Rows (key, passage_key) of the pairs whose text holds the passage as a substring; an empty one is held by none.

    A passage's words but the first and last stand in the text as whole words, so the hash of a
    run of them is among the hashes of the text's runs of that length. The longer word of a passage of two, or its
    only one, lies within a word of the text: the texts' different words are searched for it, and
    texts meet it by those. Only ids and hashes are dealt out; texts are joined back to what met, and
    held against the whole passage.
    """
    near = F.broadcast if passages.count() <= BROADCAST_ROWS else (lambda df: df)
    w = F.col("_w")
    items = passages.where(F.length(passage) > 0).select(passage_key, passage, F.split(passage, r"\s+").alias("_w"))
    items = items.withColumn("_run", F.least(F.lit(ANCHOR), F.size(w) - 2))
    words = texts.select(key, F.split(text, r"\s+").alias("_d"))
    long = items.where("_run > 0").select(passage_key, F.xxhash64("_run", F.array_join(F.slice(w, F.lit(2), F.col("_run")), " ")).alias("_hash"), "_run")
    part = F.reduce(w, F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    short = items.where("_run <= 0").select(passage_key, part.alias("_part"))
    met = None
    runs = [r[0] for r in long.select("_run").distinct().collect()]  # ANCHOR lengths at most
    if runs:
        hashes = F.array_distinct(F.concat(*[_runs(F.col("_d"), n, " ") for n in runs]))
        met = words.select(key, F.explode(hashes).alias("_hash")).join(near(long.drop("_run")), "_hash").select(key, passage_key)
    sizes = [r[0] for r in short.where("_part <> ''").select(F.length("_part")).distinct().collect()]  # lengths of single words
    if sizes:
        within = short.where("_part <> ''").select(passage_key, F.xxhash64(F.length("_part"), "_part").alias("_hash"))
        each = words.select(key, F.explode(F.array_distinct("_d")).alias("_word"))
        letters = each.select("_word").distinct().withColumn("_c", F.split("_word", ""))
        hashes = F.array_distinct(F.concat(*[_runs(F.col("_c"), n, "") for n in sizes]))
        held = letters.select("_word", F.explode(hashes).alias("_hash")).join(near(within), "_hash").select("_word", passage_key).distinct()
        found = each.join(held, "_word").select(key, passage_key)
        met = found if met is None else met.unionByName(found)
    # passages of white space alone stand in nearly every text
    blank = short.where("_part = ''").select(passage_key)
    if not blank.isEmpty():
        found = texts.select(key).crossJoin(near(blank))
        met = found if met is None else met.unionByName(found)
    if met is None:
        return texts.select(key).crossJoin(passages.select(passage_key)).where(F.lit(False))
    pairs = texts.select(key, text).join(met.distinct(), key).join(near(items.select(passage_key, passage)), passage_key)
    return pairs.where(F.contains(text, passage)).select(key, passage_key).distinct()


def _runs(parts: Column, n: int, between: str) -> Column:
    """Hashes of the runs of n elements of an array."""
    last = F.size(parts) - n
    places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice(parts, i + 1, n), between)))
