"""Near-duplicate vectors by cross-polytope hashing with fast Hadamard rotations.

A vector, padded to a power of two, is rotated by three rounds of random signs and
Hadamard transform; the signed axis of its largest coordinate is its hash. A bucket is
the hashes of one or more rotations, the more the larger the table, so that a bucket fits a task; each table also
probes the runner-up axes, and the number of tables keeps the recall. Buckets hold thousands of vectors,
so few tables do and a vector is sent seldom; inside a bucket, in memory, the same hashing with rotations of its own
leaves small sets, whose products are taken. Pairs are verified by their cosine in double precision, each in the first of the
buckets that they share, so links are counted once. Pairs never leave their bucket:
what is passed on are counts and a spanning forest.

Buckets are dealt out in rounds, about one copy of the table in each, whose files go
before the next one: disk is a multiple of the table that does not grow with the number of tables.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from loomwright.llm.common import cut, discard, lean, run_bounds, salted, sweep, union_pairs, whole_runs
from loomwright.llm.components import connected_components

#: Share of pairs at a cosine of 0.9 that meet in one rotation's hash or a runner-up's (measured at 64 dimensions), and of those that may be missed in all tables
#: (once by the tables of buckets, once by those inside a bucket).
MEET = 0.83
MISS = 0.0005
#: Axes combinations are added while a table has more vectors than so many for each; up to 64 dimensions, fewer above.
CROWD = 20_000
#: Rows of a block of a crowded bucket; up to 64 dimensions, fewer above.
BLOCK = 50_000
#: Within a bucket: all pairs up to SMALL rows, above that sets of about FINE rows.
SMALL = 4096
FINE = 512
#: Copies of vectors in one round: one for each vector, or so many.
ROUND = 250_000
TILE = 1024
SEED = 11
SALTS = 64
_UPPER = np.triu(np.ones((TILE, TILE), dtype=bool), 1)


def _hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, in place."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), n // (2 * h), 2, h)
        a, b = y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]
        y[:, :, 0], y[:, :, 1] = a, b
        h *= 2
    return x


def _by_dim(rows: int, dim: int) -> int:
    """So many rows of 64 dimensions, as rows of dim dimensions that are as large."""
    return rows * 64 // max(dim, 64)


def plan_tables(distinct: int, dim: int, crowd: int | None = None) -> tuple[int, int]:
    """Tables and rotations of each, for so many vectors of a dimension."""
    axes, rotations = 2 * _padded(dim), 1
    while rotations < 4 and (_by_dim(CROWD, dim) if crowd is None else crowd) * axes**rotations < distinct:
        rotations += 1
    return math.ceil(math.log(MISS) / math.log(1 - MEET**rotations)), rotations


def _padded(dim: int) -> int:
    return 1 << max(1, int(dim - 1).bit_length())


@functools.lru_cache(maxsize=8)
def _signs(dim: int, tables: int, rotations: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2, size=(tables * rotations, 3, dim)) * 2.0 - 1


@functools.lru_cache(maxsize=8)
def _rotations(dim: int, tables: int, rotations: int, seed: int) -> np.ndarray:
    """The rotations of low dimensions as one matrix: what the transform makes of the unit vectors."""
    out = []
    for signs in _signs(dim, tables, rotations, seed):
        y = np.eye(dim)
        for s in signs:
            y = _hadamard(y * s)
        out.append(y / dim**1.5)
    return np.concatenate(out, axis=1).astype(np.float32)


def best_axes(vectors: np.ndarray, tables: int, rotations: int, seed: int = SEED) -> np.ndarray:
    """(n, tables, rotations, 2) signed axes: of each rotation's largest coordinate and of its runner-up."""
    dim = _padded(vectors.shape[1])
    out = np.empty((len(vectors), tables * rotations, 2), dtype=np.int64)
    for lo in range(0, len(vectors), 2000):
        part = vectors[lo : lo + 2000]
        padded = np.zeros((len(part), dim), dtype=np.float32)
        padded[:, : part.shape[1]] = part
        if dim <= 256:
            y = (padded @ _rotations(dim, tables, rotations, seed)).reshape(len(part), -1, dim)
        else:
            y = np.empty((len(part), tables * rotations, dim), dtype=np.float32)
            for r, signs in enumerate(_signs(dim, tables, rotations, seed).astype(np.float32)):
                turned = padded
                for s in signs:
                    turned = _hadamard(turned * s)
                y[:, r] = turned
        size = np.abs(y)
        for pick in range(2):
            top = size.argmax(axis=2)[:, :, None]
            out[lo : lo + 2000, :, pick] = (top * 2 + (np.take_along_axis(y, top, 2) < 0))[:, :, 0]
            np.put_along_axis(size, top, -1, 2)
    return out.reshape(len(vectors), tables, rotations, 2)


def _codes(axes: np.ndarray, width: int) -> np.ndarray:
    """(n, tables * 2 ** rotations) codes of the buckets: each rotation's best axis or its runner-up. width: the number of axes."""
    n, tables, rotations, _ = axes.shape
    out = np.empty((n, tables, 2**rotations), dtype=np.int64)
    for p, picks in enumerate(itertools.product((0, 1), repeat=rotations)):
        code = np.broadcast_to(np.arange(tables), (n, tables))
        for r, pick in enumerate(picks):
            code = code * width + axes[:, :, r, pick]
        out[:, :, p] = code
    return out.reshape(n, -1)


def bucket_codes(vectors: np.ndarray, tables: int, rotations: int = 2) -> np.ndarray:
    """(n, tables * 2 ** rotations) codes of the buckets of each vector."""
    return _codes(best_axes(vectors, tables, rotations), 2 * _padded(vectors.shape[1]))


def _first_shared(a: np.ndarray, b: np.ndarray, width: int) -> np.ndarray:
    """The least code of the first table in which the rows of a and b (best_axes) share a bucket, or -1."""
    out = np.empty(len(a), dtype=np.int64)
    for lo in range(0, len(a), 50_000):
        x, y = a[lo : lo + 50_000], b[lo : lo + 50_000]
        both = (x[..., 0] == y[..., 0]) | (x[..., 0] == y[..., 1]), (x[..., 1] == y[..., 0]) | (x[..., 1] == y[..., 1])
        low = np.minimum(np.where(both[0], x[..., 0], width), np.where(both[1], x[..., 1], width)).astype(np.int64)
        meet = (low < width).all(axis=2)
        table = meet.argmax(axis=1)
        code, low = table, low[np.arange(len(x)), table]
        for r in range(low.shape[1]):
            code = code * width + low[:, r]
        out[lo : lo + 50_000] = np.where(meet.any(axis=1), code, -1)
    return out


def clean_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows (id, v): v of floats or doubles as they are, else as doubles; rows without id are left out."""
    v, kind = F.col(vec_col), df.schema[vec_col].dataType
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType | DoubleType)):
        v = F.transform(v, lambda x: x.cast("double"))
    return df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null")


def _fixed(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    x = np.ascontiguousarray(x)
    ends = np.arange(len(x) + 1, dtype=np.int64) * (x.shape[1] * x.itemsize)
    if ends[-1] >= 2**31:
        return pa.array([row.tobytes() for row in x], pa.binary())
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(x)])


def _read(batches):
    """(id, v) -> (id, digest, vec): the bytes of v and their digest, null unless v links: not if null, zero, or with null or non-finite components."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes):
            of_dim = np.flatnonzero(sizes == dim)
            step = max(1, _by_dim(10_000, int(dim)))
            for lo in range(0, len(of_dim), step):
                part = batch.take(pa.array(of_dim[lo : lo + step]))
                ids, n = part.column(0), len(part)
                if not dim:
                    yield pa.RecordBatch.from_arrays([ids, pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], ["id", "digest", "vec"])
                    continue
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, int(dim)) + 0.0  # no negative zeros
                fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                rows = [row.tobytes() if ok else None for row, ok in zip(x, fine, strict=True)]
                digests = [row and hashlib.blake2b(row, digest_size=16).digest() for row in rows]
                yield pa.RecordBatch.from_arrays([ids, pa.array(digests, pa.binary()), pa.array(rows, pa.binary())], ["id", "digest", "vec"])


def _matrix(column, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=dtype).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def _axis_type(dim: int) -> str:
    return "u1" if _padded(dim) <= 128 else "u2" if _padded(dim) <= 32_768 else "u4"


def _planned(plan: tuple[int, int | None, int], dim: int) -> tuple[int, int]:
    """Tables and rotations. plan: the number of vectors, the tables wished for, and CROWD as the driver has it."""
    total, tables, crowd = plan
    planned, rotations = plan_tables(total, dim, _by_dim(crowd, dim))
    return tables or planned, rotations


def _add_axes(plan: tuple, dtype: str):
    """Adds the column `axes` to a batch whose vectors are in `vec`."""

    def run(batches):
        for whole in batches:
            sizes = pc.binary_length(whole.column("vec")).to_numpy() // np.dtype(dtype).itemsize
            for dim in np.unique(sizes):
                batch = whole.take(pa.array(np.flatnonzero(sizes == dim)))
                axes = best_axes(_unit(_matrix(batch.column("vec").to_pylist(), dtype)), *_planned(plan, int(dim)))
                yield batch.append_column("axes", _fixed(axes.reshape(len(batch), -1).astype(_axis_type(dim)))).append_column("dim", pa.array(np.full(len(batch), dim, np.int32)))

    return run


def _keys(batch: pa.RecordBatch, plan: tuple):
    """(dim, row numbers, their keys, one column for each bucket) of each dimension of a batch with `axes` and `dim`."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        own = np.flatnonzero(dims == dim)
        axes = _matrix(batch.column("axes").take(pa.array(own)).to_pylist(), _axis_type(dim)).astype(np.int64)
        tables, rotations = _planned(plan, int(dim))
        yield int(dim), own, _codes(axes.reshape(len(own), tables, rotations, 2), 2 * _padded(dim)) * 4096 + int(dim) % 4096


def _count_keys(plan: tuple):
    def run(batches):
        for batch in batches:
            for dim, _, keys in _keys(batch, plan):
                key, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), dim, np.int32)), pa.array(n.astype(np.int64))], ["key", "dim", "n"])

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(8)


def _deal(plan: tuple, rounds: int, at: int, hot: tuple[np.ndarray, np.ndarray]):
    """Classes -> a row for each of this round's buckets and, in a crowded one, for each pair of blocks that a row is in."""

    def run(batches):
        for batch in batches:
            for _, own, keys in _keys(batch, plan):
                key, row = keys.ravel(), np.repeat(own, keys.shape[1])
                blocks = np.ones(len(key), dtype=np.int64)
                if len(hot[0]):
                    place = np.minimum(np.searchsorted(hot[0], key), len(hot[0]) - 1)
                    blocks = np.where(hot[0][place] == key, hot[1][place], 1)
                rep = batch.column("rep").to_numpy()[row]
                blk = (_mixed(rep) % blocks.astype(np.uint64)).astype(np.int64)
                # copies in crowded buckets are many: so many at a time
                for start, end in zip(*run_bounds([np.cumsum(blocks) // 500_000]), strict=True):
                    many = np.repeat(np.arange(start, end), blocks[start:end])
                    ends = np.cumsum(blocks[start:end])
                    other = np.arange(len(many)) - np.repeat(ends - blocks[start:end], blocks[start:end])
                    least, most = np.minimum(other, blk[many]), np.maximum(other, blk[many])
                    now = np.flatnonzero(_mixed(_mixed(key[many]) + _mixed(least * 2**31 + most)) % np.uint64(rounds) == at)
                    many, least, most = many[now], least[now], most[now]
                    for lo in range(0, len(many), 10_000):
                        m, b1, b2 = (x[lo : lo + 10_000] for x in (many, least, most))
                        took = pa.array(row[m])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x) for x in (key[m], b1, b2, blk[m])] + [batch.column(c).take(took) for c in ("rep", "copies", "vec", "axes")],
                            ["key", "_b1", "_b2", "_blk", "rep", "copies", "vec", "axes"],
                        )

    return run


def _near(unit: np.ndarray, single: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: float):
    """Index pairs at the threshold or above, of left with right or (right none) within left."""
    least = threshold - 1e-5 - 2e-7 * unit.shape[1]  # what single precision may be off by
    for lo in range(0, len(left), TILE):
        a, others = left[lo : lo + TILE], left[lo:] if right is None else right
        for at in range(0, len(others), TILE):
            b = others[at : at + TILE]
            hit = single[a] @ single[b].T >= least
            if right is None and not at:
                hit &= _UPPER[: len(a), : len(b)]
            if hit.any():
                i, j = np.nonzero(hit)
                for s in range(0, len(i), 50_000):
                    x, y = a[i[s : s + 50_000]], b[j[s : s + 50_000]]
                    near = np.einsum("ij,ij->i", unit[x], unit[y]) >= threshold
                    if near.any():
                        yield x[near], y[near]


def _bucket_links(unit: np.ndarray, axes: np.ndarray, key: int, blk: np.ndarray | None, threshold: float, small: int = SMALL, per_set: int = FINE):
    """Linked index pairs of one bucket whose first shared bucket it is, each once. blk: a pair of blocks, whose own pairs are left out."""
    single, dim = unit.astype(np.float32), unit.shape[1]
    width = 2 * _padded(dim)
    if len(unit) <= small:
        sets, fine = [(None, np.arange(len(unit)))], None
    else:
        fine = best_axes(single, *plan_tables(len(unit), dim, per_set), seed=SEED + 1)
        sets = _sets(fine, width)
    for code, rows in sets:
        left, right = (rows, None) if blk is None else (rows[blk[rows] == blk[0]], rows[blk[rows] != blk[0]])
        for i, j in _near(unit, single, left, right, threshold):
            own = _first_shared(axes[i], axes[j], width) == key
            if fine is not None and own.any():
                i, j = i[own], j[own]
                own = _first_shared(fine[i], fine[j], width) == code
            if own.any():
                yield i[own], j[own]


def _sets(fine: np.ndarray, width: int):
    """(code, rows) of the sets of two and more rows that share a code."""
    for t in range(fine.shape[1]):
        codes = _codes(fine[:, t : t + 1], width)
        per, codes = codes.shape[1], codes.ravel()
        order = np.argsort(codes, kind="stable")
        starts, ends = run_bounds([codes[order]])
        shift = t * width ** fine.shape[2]
        for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
            yield int(codes[order[s]]) + shift, order[s:e] // per


def _links(threshold: float, plan: tuple, dtype: str, small: int, fine: int):
    """Sorted buckets -> rows (a, b, n): a forest of links (n 0), and links counted (b 0)."""

    def run(batches):
        for pdf in whole_runs(batches, ["key", "_b1", "_b2"]):
            key, b1, b2, blk, rep, copies = (pdf[c].to_numpy() for c in ("key", "_b1", "_b2", "_blk", "rep", "copies"))
            vec, packed = pdf["vec"].to_numpy(), pdf["axes"].to_numpy()
            parent, counts = np.arange(len(rep)), np.zeros(len(rep), dtype=np.int64)
            for s, e in zip(*run_bounds([key, b1, b2]), strict=True):
                if e - s < 2:
                    continue
                sizes = np.array([len(v) for v in vec[s:e]])
                for size in np.unique(sizes):  # the key tells dimensions apart up to 4096
                    own = s + np.flatnonzero(sizes == size)
                    if len(own) < 2:
                        continue
                    dim = int(size) // np.dtype(dtype).itemsize
                    tables, rotations = _planned(plan, dim)
                    axes = _matrix(packed[own], _axis_type(dim)).reshape(len(own), tables, rotations, 2)
                    pairs = _bucket_links(_unit(_matrix(vec[own], dtype)), axes, key[s] // 4096, blk[own] if b1[s] != b2[s] else None, threshold, small, fine)
                    for i, j in pairs:
                        i, j = own[i], own[j]
                        np.add.at(counts, i, copies[j])
                        np.add.at(counts, j, copies[i])
                        union_pairs(parent, i, j)
            child, linked = np.flatnonzero(parent != np.arange(len(parent))), np.flatnonzero(counts)
            if len(linked):
                yield pd.DataFrame(
                    {
                        "a": np.concatenate([rep[child], rep[linked]]),
                        "b": pd.array(np.concatenate([rep[parent[child]], np.zeros(len(linked), np.int64)])),
                        "n": np.concatenate([np.zeros(len(child), np.int64), counts[linked]]),
                    }
                )

    return run


def near_duplicate_vectors(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.9, tables: int | None = None
) -> DataFrame:
    """Rows (id, n_links, component_id, kept), one for each row of df.

    Links join vectors of one dimension whose cosine is `threshold` or more, as far as
    they share a bucket of some table, and a set of it; none below. Equal vectors are one class: its
    members are linked to each other without meeting. Vectors are sent as they are stored, and rows meet
    their class by a digest of 128 bits.

    Defined cases: null, zero, and vectors with null or non-finite components link with
    nothing and are their own component; rows that repeat an id count as vectors of
    their own (they link), with one component; rows without id are left out; an empty
    table gives no rows; further columns are not read.
    """
    spark = df.sparkSession
    clean = clean_vectors(df, id_col, vec_col)
    dtype = "f4" if isinstance(clean.schema["v"].dataType.elementType, FloatType) else "f8"
    rows = salted(clean.mapInArrow(lean(_read), "id long, digest binary, vec binary"), "id", salts=SALTS)
    good = rows.where("digest is not null")
    total = clean.count()
    plan = total, tables, CROWD
    # the salts of a class are the bits of a number, so that grouping needs no lists
    classes = good.groupBy("digest", "vec").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("salts"))
    names = "digest binary, vec binary, rep long, copies long, salts long, axes binary, dim int"
    classes = cut(classes.mapInArrow(lean(_add_axes(plan, dtype)), names), "classes")
    sweep(spark)
    sizes = classes.select("axes", "dim").mapInArrow(lean(_count_keys(plan)), "key long, dim int, n long")
    sizes = cut(sizes.groupBy("key").agg(F.max("dim").alias("dim"), F.sum("n").alias("n")), "sizes")
    most = F.greatest(F.lit(1), F.floor(F.lit(BLOCK) * 64 / F.greatest("dim", F.lit(64))))
    # a key for each BLOCK copies at most
    hot = sorted((r.key, r.blocks) for r in sizes.where(F.col("n") > most).select("key", F.ceil(F.col("n") / most).alias("blocks")).collect())
    hot = np.array([k for k, _ in hot], dtype=np.int64), np.array([b for _, b in hot], dtype=np.int64)
    copies, mean = sizes.agg(F.coalesce(F.sum(F.col("n") * F.ceil(F.col("n") / most)), F.lit(0)), F.coalesce(F.avg("dim"), F.lit(1))).first()
    discard(sizes)
    rounds = max(1, math.ceil(copies / max(ROUND, total)))
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(copies / rounds * (int(dtype[1]) * float(mean) + 64) / 32e6))
    schema = "key long, _b1 long, _b2 long, _blk long, rep long, copies long, vec binary, axes binary"
    found = []
    for at in range(rounds):
        dealt = classes.mapInArrow(lean(_deal(plan, rounds, at, hot)), schema).repartition(parts, "key", "_b1", "_b2").sortWithinPartitions("key", "_b1", "_b2")
        found.append(cut(dealt.mapInPandas(lean(_links(threshold, plan, dtype, SMALL, FINE)), "a long, b long, n long"), "links"))
        del dealt
        sweep(spark)
    found = spark.read.schema("a long, b long, n long").parquet(*[f._scratch for f in found])
    components = connected_components(found.where("n = 0").select("a", "b"))
    counts = found.where("n > 0").groupBy("a").agg(F.sum("n").alias("n"))
    # an id of several vectors is the name of several classes: counts are theirs together
    labelled = (
        classes.select("digest", "rep", "copies", "salts")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .join(counts.withColumnRenamed("a", "rep"), "rep", "left")
        .select("digest", F.expr(f"filter(sequence(0, {SALTS - 1}), s -> shiftright(salts, s) % 2 != 0)").alias("_salt"), F.coalesce("component", "rep").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"))
        .withColumn("_salt", F.explode("_salt"))
    )
    out = good.select("id", "digest", "_salt").join(labelled, ["digest", "_salt"]).select("id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    alone = rows.where("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("id") == F.col("component_id"))
