"""Helpers shared by the training-data operators: scratch tables, skew-safe
group values, hot-bucket splitting and streaming over sorted runs."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.plans.runtime import scratch_root

#: Most keys whose row count can exceed 1/HOT_KEYS of all rows: a proven bound on the hot-key list.
HOT_KEYS = 20_000
#: Coarse hashes by which keys are counted first.
COARSE = 65_536
#: Bits of a sieve, and those of one page of it (what Spark's bitmap functions hold): 8 MB at most, whatever the number of keys.
SIEVE, PAGE = 1 << 26, 1 << 15


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later stages restart from
    those files, whatever executors are lost. The path is kept as `_scratch`."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that cut() wrote and that no later plan reads."""
    path = getattr(df, "_scratch", None)
    if path:
        spark = df.sparkSession
        hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        hpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hpath, True)


def sweep(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps: it waits for the driver's collector, which a small heap seldom runs."""
    gc.collect()
    spark._jvm.System.gc()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one small file on any file system."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = hpath.getFileSystem(spark._jsc.hadoopConfiguration()).create(hpath)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def salted(df: DataFrame, *by: str, salts: int = 64) -> DataFrame:
    """Add `_salt`, a hash of `by`, that spreads the rows of one key over `salts` groups."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))


def group_values(df: DataFrame, keys: list[str], partial: dict, final: dict) -> DataFrame:
    """One row for each (keys, _salt) of a salted df, with aggregates over the whole key.

    partial maps names to aggregates of rows, final maps names to aggregates of
    partial ones. No task ever holds more than one row for each salt of a key.
    """
    part = df.groupBy(*keys, "_salt").agg(*[e.alias(n) for n, e in partial.items()])
    full = part.groupBy(*keys).agg(*[e.alias(n) for n, e in final.items()], F.collect_list("_salt").alias("_salts"))
    return full.withColumn("_salt", F.explode("_salts")).drop("_salts")


def attach_min(df: DataFrame, key: str, value: str, out: str, salts: int = 64) -> DataFrame:
    """Add the minimum of `value` over the rows that share `key` (not null)."""
    rows = salted(df, *df.columns, salts=salts)
    mins = group_values(rows, [key], {out: F.min(value)}, {out: F.min(out)})
    return rows.join(mins, [key, "_salt"]).drop("_salt")


def sieve(df: DataFrame, value: Column, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose `value` (a long) may be in the one column of `keys`, and those where it surely isn't.

    What holds a few rows only of a table of texts needn't have all texts shuffled. A bitmap of the keys' hashes, SIEVE bits
    at most, is broadcast; all keys pass, and with more of them more rows that are none. A null value is in either part.
    """
    spots = keys.select(F.pmod(F.xxhash64(keys[keys.columns[0]].cast("long")), F.lit(SIEVE)).alias("_spot")).distinct()
    spots = spots.select(F.floor(F.col("_spot") / PAGE).alias("_page"), F.pmod("_spot", F.lit(PAGE)).alias("_at")).repartition("_page")
    pages = F.broadcast(spots.groupBy("_page").agg(F.bitmap_construct_agg("_at").alias("_bits")))
    spot = F.pmod(F.xxhash64(value), F.lit(SIEVE))
    at = F.pmod(spot, F.lit(PAGE)).cast("int")
    byte = F.conv(F.hex(F.substring(pages["_bits"], F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    meet = (F.floor(spot / PAGE) == pages["_page"]) & (F.getbit(byte, F.pmod(at, F.lit(8))) == 1)
    return df.join(pages, meet, "left_semi"), df.join(pages, meet, "left_anti")


@functools.cache
def _libc():
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # arrays of 1 MiB and more go back to the system when freed
        return libc
    except (OSError, AttributeError):
        return None


def lean(step):
    """A mapInArrow or mapInPandas step after which the Python worker, kept for later tasks, gives back its memory."""

    def run(batches):
        libc = _libc()
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return run


def split_hot(df: DataFrame, key: str, spread: str, block: int, total: int) -> DataFrame:
    """Deal buckets out for pair comparison: adds `_b1`, `_b2` (the pair of blocks a row
    is sent to) and `_blk` (the row's own block). total: the number of rows of df.

    A bucket of up to `block` rows is one block, whatever the size of the table. A larger one
    is cut into blocks by a hash of `spread`, and each pair of blocks meets once, so every pair of rows meets
    in exactly one group. Rows are first counted by a coarse hash of the key, so that
    only keys that share a crowded one are counted by themselves. Keys with more than 1 / HOT_KEYS of all
    rows are broadcast; the others' counts meet their rows in a shuffle.
    """
    coarse = F.pmod(F.xxhash64(key), F.lit(COARSE)).cast("int")
    crowded = df.groupBy(coarse.alias("_c")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block).select("_c").collect()  # COARSE rows at most
    rows = df.withColumn("_n", F.lit(0))
    if crowded:
        named = df.sparkSession.createDataFrame(crowded, "_c int")
        hot = df.select(key, coarse.alias("_c")).join(F.broadcast(named), "_c", "left_semi")
        hot = cut(hot.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block), "hot")
        floor = max(block, total // HOT_KEYS)
        heavy, others = hot.where(F.col("_n") > floor), hot.where(F.col("_n") <= floor)
        rows = df.join(F.broadcast(heavy), key, "left")
        if not others.isEmpty():
            # rows of a broadcast key look for nothing here and are spread
            aside = F.when(F.col("_n").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1024)))
            found = others.select(key, F.lit(0).cast("long").alias("_aside"), F.col("_n").alias("_m"))
            rows = rows.withColumn("_aside", aside.cast("long")).join(found.hint("shuffle_hash"), [key, "_aside"], "left")
            rows = rows.withColumn("_n", F.coalesce("_n", "_m"))
    rows = rows.withColumn("_nb", F.greatest(F.lit(1), F.ceil(F.coalesce("_n", F.lit(0)) / block)).cast("int"))
    rows = rows.withColumn("_blk", F.pmod(F.xxhash64(spread), F.col("_nb")).cast("int"))
    return rows.withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).select(
        *df.columns, "_blk", F.least("_x", "_blk").alias("_b1"), F.greatest("_x", "_blk").alias("_b2")
    )


def whole_runs(batches, keys: list[str]):
    """Regroup sorted pandas batches so that no run of equal keys is cut."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        last = tuple(pdf[k].iloc[-1] for k in keys)
        tail = np.ones(len(pdf), dtype=bool)
        for k, v in zip(keys, last, strict=True):
            tail &= (pdf[k] == v).to_numpy()
        start = len(pdf) - int(np.argmin(tail[::-1])) if not tail.all() else 0
        if start == 0 and held and all(held[-1][k].iloc[-1] == v for k, v in zip(keys, last, strict=True)):
            held.append(pdf)
            continue
        if start or held:
            yield pd.concat([*held, pdf.iloc[:start]], ignore_index=True)
        held = [pdf.iloc[start:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def run_bounds(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    change = np.zeros(len(columns[0]) + 1, dtype=bool)
    change[[0, -1]] = True
    for c in columns:
        change[1:-1] |= c[1:] != c[:-1]
    at = np.flatnonzero(change)
    return at[:-1], at[1:]


def run_pairs(starts: np.ndarray, ends: np.ndarray, small: int = 48, most: int = 200_000):
    """All index pairs (i < j) within runs, as arrays of bounded size."""
    length = ends - starts
    n = int(ends[-1]) if len(ends) else 0
    end_of = np.repeat(np.where(length <= small, ends, 0), length)
    index = np.arange(n)
    for d in range(1, small):
        i = index[index + d < end_of]
        if not len(i):
            break
        yield i, i + d
    for s, e in zip(starts[length > small], ends[length > small], strict=True):
        step = max(1, most // int(e - s))
        for lo in range(s, e, step):
            i = np.arange(lo, min(lo + step, e))
            j = np.arange(lo + 1, e)
            a, b = np.repeat(i, len(j)), np.tile(j, len(i))
            keep = b > a
            yield a[keep], b[keep]


def union_pairs(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the trees of i and j in a forest whose nodes point at their roots."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        compress(parent)


def compress(parent: np.ndarray) -> None:
    """Let each node of a forest point at its root."""
    while True:
        up = parent[parent]
        if (up == parent).all():
            return
        parent[:] = up
