"""Deterministic sampling, quotas and mixing. Order within a sample: md5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: int, *keys: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


#: Rows of a sample that one task merges.
ONE_TASK = 100_000


def sample_n(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """Exactly min(n, rows) rows, the first in hash order.

    Of a small sample each task keeps n rows at most, and one task merges them. A large one is all rows below a
    boundary of the hash, found from the numbers of rows by its first four digits, and as many as are missing
    of those on the boundary.
    """
    order = hash_order(seed, *keys)
    if n <= ONE_TASK:
        return df.orderBy(order, *keys).limit(n)
    rows = df.withColumn("_head", F.substring(order, 1, 4))
    below, edge = 0, None
    for head, count in rows.groupBy("_head").count().orderBy("_head").collect():  # 65,536 rows at most
        if below + count > n:
            edge = head
            break
        below += count
    if edge is None:
        return df
    last = rows.where(F.col("_head") == edge).orderBy(order, *keys).limit(n - below)
    return rows.where(F.col("_head") < edge).unionByName(last).drop("_head")


def sample_per_group(df: DataFrame, group: str, quota: Column, seed: int, *keys: str) -> DataFrame:
    """The first `quota` rows of each group in hash order; quota may depend on the group."""
    w = Window.partitionBy(group).orderBy(hash_order(seed, *keys), *keys)
    return df.withColumn("_q", quota).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= F.col("_q")).drop("_n", "_q")


def budget(n_dx: int, n_base: int, most: int) -> tuple[int, int]:
    """Rows of D_X and of the base within `most` in proportion; -1: all."""
    if most < 0 or n_dx + n_base == 0:
        return n_dx, n_base
    dx = min(round(n_dx / (n_dx + n_base) * most), n_dx)
    return dx, min(most - dx, n_base)


def split_budget(counts: DataFrame, most: int) -> DataFrame:
    """budget() on rows (n_dx, n_base): adds take_dx and take_base, rounding half to even."""
    dx = F.least(F.bround(F.col("n_dx") / (F.col("n_dx") + F.col("n_base")) * most), F.col("n_dx")).cast("long")
    return counts.withColumn("take_dx", dx).withColumn("take_base", F.least(F.lit(most) - F.col("take_dx"), F.col("n_base")).cast("long"))


def quotas_stratified(learned: int, not_learned: int, unknown: int, n: int) -> dict[str, int]:
    """Half from each side, backfill from the other, then from the unknown."""
    a, b = min(n // 2, learned), min(n - n // 2, not_learned)
    a += min(n - a - b, learned - a)
    b += min(n - a - b, not_learned - b)
    return {"learned": a, "not_learned": b, "unknown": min(n - a - b, unknown)}


def quotas_cascade(retained: int, not_learned: int, specific: int, n: int, most_retained: int = 30, most_not_learned: int = 30) -> dict[str, int]:
    """Capped retained and not-learned rows, the rest learned-specific; no backfill."""
    a, b = min(most_retained, retained), min(most_not_learned, not_learned)
    return {"retained": a, "not_learned": b, "learned_specific": min(max(n - a - b, 0), specific)}


def take_quotas(df: DataFrame, group: str, quotas: dict[str, int], seed: int, *keys: str) -> DataFrame:
    quota = F.lit(0)
    for name, n in quotas.items():
        quota = F.when(F.col(group) == name, n).otherwise(quota)
    return sample_per_group(df.where(F.col(group).isin(list(quotas))), group, quota, seed, *keys)


def held_out_tenth(key: Column) -> Column:
    """A fixed tenth of the keys, by hash."""
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(10)) == 0


def oversample(df: DataFrame, order: str, target: int) -> DataFrame:
    """Rows repeated in whole rounds, cut at `target`; adds round and position."""
    n = df.count()
    if not n:
        return df.withColumn("round", F.lit(0)).withColumn("pos", F.lit(0).cast("long"))
    rounds = -(-target // n)
    rows = ranked(df, order).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(max(rounds - 1, 0)))))
    return rows.where(F.col("round") * F.lit(n) + F.col("pos") < target)


def ranked(df: DataFrame, order: str, out: str = "pos") -> DataFrame:
    """0-based global position by `order`, without a one-task window."""
    from loomwright.operators.chunks import running_total

    return running_total(df.withColumn("_one", F.lit(1)), "_one", [order], out).withColumn(out, F.col(out) - 1).drop("_one")


def mix(base: DataFrame, x: DataFrame, order: str, placement: str, seed: int = 0) -> DataFrame:
    """Base and X rows with a sort key (slot, kind, pos): start, end, middle (after half the base rows,
    rounded down) or full_shuffle (each X row in a gap of the base drawn by its hash)."""
    n = base.count()
    b = ranked(base, order).withColumn("slot", F.col("pos") + 1).withColumn("kind", F.lit(1))
    xs = ranked(x, order)
    if placement == "full_shuffle":
        draw = F.conv(F.substring(hash_order(seed, order), 1, 12), 16, 10).cast("long")
        slot = F.pmod(draw, F.lit(n + 1)) + 1
    else:
        slot = F.lit({"start": 0, "end": n + 1, "middle": n // 2 + 1}[placement]).cast("long")
    return b.unionByName(xs.withColumn("slot", slot).withColumn("kind", F.lit(0)))


def interleave(queries: DataFrame) -> DataFrame:
    """Two rows for each pair: index 2j good, 2j + 1 bad."""
    both = F.explode(F.array(F.struct(F.col("text_good").alias("text"), F.lit(True).alias("is_good")), F.struct(F.col("text_bad").alias("text"), F.lit(False).alias("is_good"))))
    rows = queries.select("pair_idx", both.alias("x")).select("pair_idx", "x.text", "x.is_good")
    return rows.withColumn("query_idx", F.col("pair_idx") * 2 + (~F.col("is_good")).cast("int"))


def quota_per_chunk(counts: DataFrame, part: int, whole: int, n: str = "n") -> DataFrame:
    """Adds `take`: each chunk's share of `part` rows out of `whole`, rounded half to even, at most all."""
    return counts.withColumn("take", F.least(F.bround(F.col(n) * F.lit(part / whole if whole else 0.0)), F.col(n)).cast("long"))


def sample_in_order(df: DataFrame, n: int, seed: int, order: list[str], *keys: str) -> DataFrame:
    """A sample in the order of the input."""
    return sample_n(df, n, seed, *keys).orderBy(*order)


def scoring_subset(train: DataFrame, base_size: int, seed: int = 2) -> DataFrame:
    """All X rows and `base_size` base rows (0: all rows), by train_idx."""
    if not base_size:
        return train
    base = sample_n(train.where("category <> 'X'"), base_size, seed, "train_idx")
    return train.where("category = 'X'").unionByName(base).orderBy("train_idx")
