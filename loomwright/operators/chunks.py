"""Greedy token-budget chunks, document headers and chunk budgets."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Tokens that the windows of one search for chunk ends hold together, at most.
SEARCH = 4_000_000


def running_total(df: DataFrame, value: str, order: list[str], out: str = "_total", group: tuple[str, ...] = ()) -> DataFrame:
    """Running sum in order (within each group) without a one-task window: range partitions, then an offset for each.

    The partitions are written before they are summed: range bounds are sampled, and would differ if taken twice.
    """
    from loomwright.plans.runtime import materialize

    parts = materialize(df.repartitionByRange(*group, *order).withColumn("_pid", F.spark_partition_id()))
    within = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition of a group
    sums = parts.groupBy("_pid", *group).agg(F.sum(value).alias("_sum"))
    offsets = sums.select("_pid", *group, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    rows = parts.withColumn("_own", F.sum(value).over(within)).join(offsets if group else F.broadcast(offsets), ["_pid", *group])
    return rows.withColumn(out, F.col("_own") + F.col("_off")).drop("_pid", "_own", "_off")


def chunk_ends(total: DataFrame, tokens: str, budget: int, target: int | None, start: int = 0) -> list[int]:
    """Totals at which chunks close after `start`, in order: each the first total of the last end + budget or more.

    No row has more than `longest` tokens, so the k-th end from here lies within k * longest of
    k budgets on: the totals of many such windows are fetched at once, by ranges that
    the files' statistics prune, and the ends read off them.
    """
    longest, last = total.agg(F.max(tokens), F.max("_total")).first()
    ends: list[int] = []
    at, longest = start, max(1, int(longest or 1))
    steps = max(1, min(budget // longest, int((2 * SEARCH / longest) ** 0.5)))
    while at + budget <= (last or 0) and (target is None or at < target):
        t = F.col("_total") - at
        k = F.floor(t / budget)
        near = (t - k * budget < k * longest) if steps > 1 else (t < budget + longest)
        span = total.where((F.col("_total") >= at + budget) & (F.col("_total") < at + (steps + 1) * budget + longest))
        rows = span.where(near & ((k <= steps) | F.lit(steps == 1))).select("_total").distinct().orderBy("_total").collect()  # SEARCH rows at most, about
        found = [r[0] for r in rows]
        for _ in range(steps):
            n = bisect.bisect_left(found, at + budget)
            if n == len(found) or (target is not None and at >= target):
                break
            at = int(found[n])
            ends.append(at)
    return ends


def pack_chunks(df: DataFrame, tokens: str, order: list[str], budget: int, target: int | None = None) -> DataFrame:
    """Add chunk_id: a chunk closes at the first row at which its tokens reach `budget`; the
    overshoot is not carried. With a target, rows after the first close at or beyond it go.
    """
    from loomwright.plans.runtime import materialize

    total = materialize(running_total(df, tokens, order))
    return with_chunks(total, chunk_ends(total, tokens, budget, target), target).drop("_total")


def with_chunks(total: DataFrame, ends: list[int], target: int | None = None) -> DataFrame:
    """Rows with their chunk_id, the number of ends before them; with a target, none after the first end that reaches it."""
    shared = total.sparkSession.sparkContext.broadcast(np.array(ends, dtype=np.int64))  # one number for each chunk

    @F.pandas_udf("int")
    def chunk(totals: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, totals.to_numpy(), side="left").astype(np.int32))

    if target is not None and ends and ends[-1] >= target:
        total = total.where(F.col("_total") <= ends[-1])
    return total.withColumn("chunk_id", chunk("_total"))


def carry_header(df: DataFrame, header: str, order: list[str], key: str) -> DataFrame:
    """Fill the last header forward within `key` (an input file, say)."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("doc_header", F.last(header, ignorenulls=True).over(w))


def emit_header(df: DataFrame, doc: str, chunk: str, order: list[str]) -> DataFrame:
    """Mark the first row of each document in each chunk."""
    w = Window.partitionBy(chunk, doc).orderBy(*order)
    return df.withColumn("emit_header", F.row_number().over(w) == 1)


def chunk_totals(df: DataFrame, tokens: str) -> DataFrame:
    return df.groupBy("chunk_id").agg(F.sum(tokens).alias("n_tokens"), F.count(F.lit(1)).alias("n_sentences"))


def chunk_prefix(totals: DataFrame, target: int) -> DataFrame:
    """The shortest prefix of chunks (chunk_id, n_tokens) that reaches the target; an error if all fall short."""
    w = Window.orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, 0)  # one row for each chunk
    running = totals.withColumn("cum_tokens", F.sum("n_tokens").over(w))
    if (running.agg(F.max("cum_tokens")).first()[0] or 0) < target:
        raise ValueError(f"the corpus has fewer than {target} tokens")
    return running.where(F.col("cum_tokens") - F.col("n_tokens") < target)
