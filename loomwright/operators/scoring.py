"""Scores of training rows against queries: BM25, vector similarity, preconditioned similarity."""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import LONG_WORD, words

#: Queries are broadcast to the postings up to this many (query, token) rows, else joined by shuffle.
BROADCAST_ROWS = 2_000_000
#: Numbers of query vectors that a task holds, scores that it makes at a time, and queries that one product takes.
HELD, SCORES, WIDTH = 1 << 22, 1 << 18, 4096
#: Contrasts of one method that a task of `stream_correlations` holds, and bytes of vectors that are handed on as one row.
COLUMNS, PACK = 1 << 24, 1 << 16


def term_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, token, tf)."""
    rows = texts.select(key, F.explode(words(F.lower(text), LONG_WORD)).alias("token"))
    return rows.groupBy(key, "token").agg(F.count(F.lit(1)).alias("tf"))


def bm25(train: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """train (train_idx, text), queries (query_idx, text) -> rows (train_idx, query_idx, score) of the pairs
    that share a token; all others score 0. idf is ln(1 + (N - df + 0.5) / (df + 0.5)).

    Tasks that hold the queries' terms score the rows that they read; with too many terms, they meet by shuffle.
    """
    from loomwright.operators import postings

    found = postings.index(train, queries, k1, b)
    return bm25_shuffled(train, queries, k1, b) if found is None else postings.scores(*found)


def bm25_shuffled(train: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """bm25 with any number of terms.

    Texts are read once: a row keeps its length and those of its tokens that a query holds,
    as it was read. Query terms, weighted by idf, meet its postings on the token; a token of many
    queries, or many rows, is no row of its own.
    """
    from loomwright.plans.runtime import materialize

    asked = materialize(term_counts(queries, "query_idx", "text").withColumnRenamed("tf", "qn"))
    near = F.broadcast if asked.count() <= BROADCAST_ROWS else (lambda df: df)
    tokens = train.select("train_idx", F.explode_outer(words(F.lower("text"), LONG_WORD)).alias("token"))
    known = near(asked.select("token").distinct().withColumn("_known", F.col("token")))
    kept = tokens.join(known, "token", "left").groupBy("train_idx").agg(F.count("token").alias("dl"), F.collect_list("_known").alias("_kept"))
    kept = materialize(kept)
    totals = kept.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("dl").alias("avgdl"))
    postings = kept.select("train_idx", "dl", F.explode("_kept").alias("token")).groupBy("train_idx", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weights = asked.join(df, "token").crossJoin(totals)  # totals: one row
    weights = weights.select("token", "query_idx", "avgdl", (F.col("qn") * F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))).alias("w"))
    part = F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    rows = postings.join(near(weights), "token").select("train_idx", "query_idx", (F.col("w") * part).alias("s"))
    return rows.groupBy("train_idx", "query_idx").agg(F.round(F.sum("s"), 6).alias("score"))


def unit_norm(scores: DataFrame) -> DataFrame:
    """Scores over the norm of each query's scores over all rows (rows that score 0 add nothing)."""
    norms = scores.groupBy("query_idx").agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("_norm"))
    return scores.join(norms, "query_idx").withColumn("score", F.when(F.col("_norm") > 0, F.round(F.col("score") / F.col("_norm"), 6)).otherwise(0.0)).drop("_norm")


def contrast(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (pair_idx, good_idx, bad_idx) -> rows (train_idx, pair_idx, score_good, score_bad, delta_i) of the
    pairs of which either text scores."""
    side = F.explode(F.array(F.struct(F.col("good_idx").alias("q"), F.lit(True).alias("good")), F.struct(F.col("bad_idx").alias("q"), F.lit(False).alias("good"))))
    sides = pairs.select("pair_idx", side.alias("s")).select("pair_idx", F.col("s.q").alias("query_idx"), "s.good")
    rows = scores.join(F.broadcast(sides) if sides.count() <= BROADCAST_ROWS else sides, "query_idx")
    pick = lambda good: F.coalesce(F.sum(F.when(F.col("good") == good, F.col("score"))), F.lit(0.0))
    out = rows.groupBy("train_idx", "pair_idx").agg(pick(True).alias("score_good"), pick(False).alias("score_bad"))
    return out.withColumn("delta_i", F.round(F.col("score_good") - F.col("score_bad"), 6))


def dense(train: DataFrame, pairs: DataFrame, sparse: DataFrame) -> DataFrame:
    """All (train_idx, pair_idx), zero where sparse has none: for small restrictions of train or pairs."""
    near = F.broadcast if pairs.count() <= BROADCAST_ROWS else (lambda df: df)
    grid = train.select("train_idx").crossJoin(near(pairs.select("pair_idx")))
    rows = grid.join(sparse, ["train_idx", "pair_idx"], "left")
    return rows.select("train_idx", "pair_idx", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("score_good", "score_bad", "delta_i")])


def _dim(vectors: DataFrame, column: str) -> int:
    """Length of the first vector; 1 of none."""
    row = vectors.select(F.size(column)).first()
    return max(1, row[0] if row else 1)


def _meetings(train: DataFrame, asks: DataFrame, dim: int, block: int | None, part: int) -> DataFrame:
    """train (train_idx, vec), asks (id, vec) -> a stream in which blocks of asks meet parts of the rows: each (block, part)
    begins with the block's asks.

    A block is as many asks as a task can hold, so rows are handed out once up to HELD numbers of asks, and seldom more.
    """
    block = block or max(1, HELD // dim)
    blocks = max(1, -(-asks.count() // block))
    parts = max(1, -(-train.count() // part), train.sparkSession.sparkContext.defaultParallelism // blocks)
    asks = asks.select(
        F.col("id").cast("long").alias("id"), "vec", F.lit(True).alias("ask"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
    )
    rows = train.select(
        F.col("train_idx").cast("long").alias("id"), "vec", F.lit(False).alias("ask"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("train_idx"), F.lit(parts)).cast("int").alias("part"),
    )
    return asks.unionByName(rows).repartition(min(blocks * parts, 4096), "block", "part").sortWithinPartitions("block", "part", F.desc("ask"))


def _matrix(vectors: pa.ListArray) -> np.ndarray:
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def _met(batches):
    """Runs of a stream of `_meetings`: (whether a (block, part) begins, its asks' ids and vectors, ids and vectors of some of its rows)."""
    at, asked, q = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        block, part, ids, ask = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "part", "id", "ask"))
        key = block.astype(np.int64) << 32 | part
        edges = np.flatnonzero((np.diff(key) != 0) | np.diff(ask)) + 1
        for lo, hi in pairwise([0, *edges.tolist(), batch.num_rows]):
            if key[lo] != at:
                at, asked, q = key[lo], [], None
            run = ids[lo:hi], _matrix(batch.column("vec").slice(lo, hi - lo))
            if ask[lo]:
                asked.append(run)
            elif asked or q is not None:
                begins = q is None
                if begins:
                    q, asked = tuple(np.concatenate(c) for c in zip(*asked, strict=True)), []
                yield begins, *q, *run


def _rounded(s: np.ndarray, digits: int) -> np.ndarray:
    """Rounded in place, without negative zeros."""
    np.round(s, digits, out=s)
    s += 0.0
    return s


def vector_scores(
    train: DataFrame, queries: DataFrame, unit: bool = True, block: int | None = None, transform: np.ndarray | None = None, digits: int = 6, part: int = 50_000
) -> DataFrame:
    """train (train_idx, vec), queries (query_idx, vec) -> rows (train_idx, query_idx, score): products of
    (unit) vectors, transformed first if a matrix is given.

    Blocks of queries meet parts of the training rows; a task holds one block's vectors, a batch of rows and SCORES scores.
    """
    stream = _meetings(train, queries.select(F.col("query_idx").alias("id"), "vec"), _dim(queries, "vec"), block, part)

    return stream.mapInArrow(lambda batches: scores_of(batches, unit, transform, digits), "train_idx long, query_idx long, score double")


def scores_of(batches, unit: bool, transform: np.ndarray | None, digits: int):
    """Scores of a stream of `_meetings`, in batches of SCORES at most."""
    for begins, ids, vectors, own, x in _met(batches):
        if begins:
            q = _prepared(vectors, unit, transform)
        x = _prepared(x, unit, transform)
        for c in range(0, len(ids), WIDTH):
            some = ids[c : c + WIDTH]
            step = max(1, SCORES // len(some))
            for r in range(0, len(x), step):
                s = _rounded(x[r : r + step] @ q[c : c + WIDTH].T, digits)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (np.repeat(own[r : r + step], len(some)), np.tile(some, len(s)), s.ravel())], ["train_idx", "query_idx", "score"])


def _prepared(x: np.ndarray, unit: bool, transform: np.ndarray | None) -> np.ndarray:
    if transform is not None:
        x = x @ transform
    if unit:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(n < 1e-12, 1.0, n)
    return x


def second_moment(rows: DataFrame, dim: int) -> np.ndarray:
    """Mean outer product of the vectors: each task adds up its own, the sums meet as dim rows of dim numbers."""

    def run(batches):
        total, n = np.zeros((dim, dim)), 0
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["vec"].to_list()).astype(np.float64)
                total += x.T @ x
                n += len(x)
        yield pd.DataFrame({"i": np.arange(dim), "row": list(total), "n": np.full(dim, n)})

    parts = rows.select("vec").mapInPandas(run, "i int, row array<double>, n long")
    sums = parts.select("i", "n", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).toPandas()
    out = np.zeros((dim, dim))
    out[sums["i"], sums["j"]] = sums["v"] / np.maximum(sums["n"], 1)
    return out


def inverse_root(moment: np.ndarray, damp: float = 0.1, downweight: int | None = None) -> np.ndarray:
    """(M + damp * mean eigenvalue)^(-1/2); with downweight only that many leading directions are whitened."""
    w, v = np.linalg.eigh(moment)
    scale = 1 / np.sqrt(np.maximum(w, 0) + damp * max(float(w.mean()), 1e-12))
    if downweight is not None and downweight < len(w):
        scale[: len(w) - downweight] = scale[len(w) - downweight]
    return (v * scale) @ v.T


def random_projection(dim: int, out: int, seed: int = 0) -> np.ndarray:
    """(dim, out) Gaussian sketch that keeps products on average; the identity where out is 0 or not below dim."""
    if not out or out >= dim:
        return np.eye(dim)
    return np.random.default_rng(seed).standard_normal((dim, out)) / np.sqrt(out)


def trackstar_transform(train: DataFrame, queries: DataFrame, dim: int, mix: float = 0.5, downweight: int = 1000, projection: int = 0, seed: int = 0) -> np.ndarray:
    """Sketch, then the preconditioner from the mixed second moments of the sketched training and query vectors."""
    r = random_projection(dim, projection, seed)
    moment = mix * second_moment(train, dim) + (1 - mix) * second_moment(queries, dim)
    return r @ inverse_root(r.T @ moment @ r, downweight=downweight)


def _sides(moment: np.ndarray, rows: int, cols: int) -> tuple[np.ndarray, np.ndarray]:
    """Covariances of the left and right sides of vectors that are rows x cols matrices."""
    m = moment.reshape(rows, cols, rows, cols)
    return np.einsum("icjc->ij", m) / cols, np.einsum("rirj->ij", m) / rows


def kfac_transform(train: DataFrame, rows: int, cols: int, damp: float = 0.1, projection: int = 0, seed: int = 0) -> np.ndarray:
    """Kronecker whitener: both sides' inverse roots, then a sketch of the whitened vectors."""
    left, right = _sides(second_moment(train, rows * cols), rows, cols)
    return np.kron(inverse_root(left, damp), inverse_root(right, damp)) @ random_projection(rows * cols, projection, seed)


def fused_transform(train: DataFrame, rows: int, cols: int, projection: int, damp: float = 0.1, seed: int = 0) -> np.ndarray:
    """Whitening and sketch in one on each side: inverse root times a projection to `projection` dimensions."""
    if projection <= 0:
        raise ValueError("the fused form needs a projection")
    left, right = _sides(second_moment(train, rows * cols), rows, cols)
    return np.kron(inverse_root(left, damp) @ random_projection(rows, projection, seed), inverse_root(right, damp) @ random_projection(cols, projection, seed + 1))


def ekfac_transform(train: DataFrame, rows: int, cols: int, damp: float = 0.1, projection: int = 0, seed: int = 0) -> np.ndarray:
    """Eigenvalue-corrected Kronecker whitener: in the sides' eigenbasis each direction is scaled by its own second moment."""
    moment = second_moment(train, rows * cols)
    basis = np.kron(*(np.linalg.eigh(side)[1] for side in _sides(moment, rows, cols)))
    own = np.maximum(np.einsum("ij,ik,kj->j", basis, moment, basis), 0)
    scale = 1 / np.sqrt(own + damp * max(float(own.mean()), 1e-12))
    return (basis * scale) @ basis.T @ random_projection(rows * cols, projection, seed)


class Best:
    """The k first rows of each of `groups` groups, by a key (upwards) and the smaller id, of rows that come in slices."""

    def __init__(self, groups: int, k: int, columns: int):
        self.k, self.room = k, max(groups * k, SCORES)
        self.rows = [np.zeros(0, np.int64), np.zeros(0, np.int64), *[np.zeros(0)] * (1 + columns)]
        self.held, self.n = [], 0
        self.key, self.id = np.full(groups, np.inf), np.full(groups, np.iinfo(np.int64).max)

    def add(self, ids: np.ndarray, key: np.ndarray, columns: list[np.ndarray]) -> None:
        """key and columns: a line for each id, a column for each group."""
        near = key <= self.key
        near &= (key < self.key) | (ids[:, None] < self.id)
        r, g = np.nonzero(near)
        if len(r):
            self.held.append([g, ids[r], key[r, g], *[c[r, g] for c in columns]])
            self.n += len(r)
            if self.n >= self.room or np.isinf(self.key[0]):
                self.first()

    def first(self) -> list[np.ndarray]:
        """Arrays (group, id, key, columns) of what is first by now."""
        if self.held:
            rows = [np.concatenate(c) for c in zip(self.rows, *self.held, strict=True)]
            order = np.lexsort((rows[1], rows[2], rows[0]))
            group = rows[0][order]
            place = np.arange(len(order)) - np.searchsorted(group, group)
            self.rows = [c[order[place < self.k]] for c in rows]
            last = place[place < self.k] == self.k - 1
            self.key[self.rows[0][last]], self.id[self.rows[0][last]] = self.rows[2][last], self.rows[1][last]
            self.held, self.n = [], 0
        return self.rows


CONTRAST = "train_idx long, pair_idx long, score_good double, score_bad double, delta_i double"


def contrast_batch(train_idx, pair_idx, good, bad, delta) -> pa.RecordBatch:
    names = [c.split()[0] for c in CONTRAST.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v) for v in (train_idx, pair_idx, good, bad, delta)], names)


def _pair_meetings(train: DataFrame, pairs: DataFrame, block: int | None, part: int) -> DataFrame:
    asks = pairs.select(F.col("pair_idx").alias("id"), F.concat("vec_good", "vec_bad").alias("vec"))
    return _meetings(train, asks, 2 * _dim(pairs, "vec_good"), block, part)


def _contrasts(batches, unit: bool, transform: np.ndarray | None, digits: int):
    """Slices of a stream of `_pair_meetings`: (whether a (block, part) begins, pairs, rows, good, bad and contrast by row and pair)."""
    for begins, ids, vectors, own, x in _met(batches):
        if begins:
            q = [_prepared(v, unit, transform) for v in np.split(vectors, 2, axis=1)]
        x = _prepared(x, unit, transform)
        step = max(1, SCORES // len(ids))
        for r in range(0, len(x), step):
            good, bad = (_rounded(x[r : r + step] @ s.T, digits) for s in q)
            yield begins and r == 0, ids, own[r : r + step], good, bad, _rounded(good - bad, digits)


def stream_top_k(
    train: DataFrame, pairs: DataFrame, k: int, side: str = "contrast", unit: bool = True, transform: np.ndarray | None = None, block: int | None = None, part: int = 50_000, digits: int = 6
) -> DataFrame:
    """train (train_idx, vec), pairs (pair_idx, vec_good, vec_bad) -> each pair's first k rows (train_idx, pair_idx,
    score_good, score_bad, delta_i, rank) under a side.

    Scores are ranked as they are made: each (block of pairs, part of the rows) is a stream that keeps k rows for a
    pair, and these alone are written. No score matrix is.
    """
    from loomwright.operators.rank import SIDES, top_k

    column, ascending = SIDES[side]
    at = ("score_good", "score_bad", "delta_i").index(column)

    def done(ids, best):
        group, own, _, good, bad, delta = best.first()
        return contrast_batch(own, ids[group], good, bad, delta)

    def run(batches):
        best = pairs_of = None
        for begins, ids, own, *scores in _contrasts(batches, unit, transform, digits):
            if begins:
                if best is not None:
                    yield done(pairs_of, best)
                best, pairs_of = Best(len(ids), k, 3), ids
            best.add(own, scores[at] if ascending else -scores[at], scores)
        if best is not None:
            yield done(pairs_of, best)

    return top_k(_pair_meetings(train, pairs, block, part).mapInArrow(run, CONTRAST), k, side)


def stream_means(train: DataFrame, pairs: DataFrame, unit: bool = True, transform: np.ndarray | None = None, block: int | None = None, part: int = 50_000, digits: int = 6) -> DataFrame:
    """train (train_idx, vec), pairs (pair_idx, vec_good, vec_bad) -> rows (train_idx, v): each row's mean contrast over all pairs,
    summed as the contrasts are made; one number for each row and block of pairs is written."""

    def run(batches):
        for _, ids, own, _, _, delta in _contrasts(batches, unit, transform, digits):
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(delta.sum(axis=1)), pa.array(np.full(len(own), len(ids)))], ["train_idx", "s", "n"])

    sums = _pair_meetings(train, pairs, block, part).mapInArrow(run, "train_idx long, s double, n long")
    return sums.groupBy("train_idx").agg((F.sum("s") / F.sum("n")).alias("v"))


def unit_vectors(x: np.ndarray) -> np.ndarray:
    return _prepared(x, True, None)


def sign_vectors(x: np.ndarray) -> np.ndarray:
    return np.sign(x)


def _packed(df: DataFrame, size: int) -> DataFrame:
    """Up to `size` rows as one: the numbers of each column (float64 or float32 arrays, longs) as bytes."""
    names = df.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                some = [batch.column(c).slice(at, size) for c in names]
                flat = [(c.flatten() if pa.types.is_list(c.type) else c).to_numpy(zero_copy_only=False) for c in some]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in flat], names)

    return df.mapInArrow(run, ", ".join(f"{c} binary" for c in names))


def _mean_ranks(v: np.ndarray, digits: int) -> np.ndarray:
    """Ranks from 1 of values rounded to `digits`, ties sharing their mean: by counts of the values in a range, if it is narrow."""
    low, high = (v.min(), v.max()) if len(v) else (0.0, 0.0)
    if (high - low) * 10.0**digits <= max(8 * len(v), 1 << 16):
        at = np.rint((v - low) * 10.0**digits).astype(np.int64)
        counts = np.bincount(at)
    else:
        _, at, counts = np.unique(v, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[at]


def _correlation(a: np.ndarray, b: np.ndarray) -> float:
    a, b = a - a.mean(), b - b.mean()
    norm = np.sqrt((a @ a) * (b @ b))
    return float(np.round(a @ b / norm, 6)) if norm > 0 else float("nan")


def stream_correlations(train: DataFrame, pairs: DataFrame, methods=(unit_vectors, sign_vectors), digits: int = 6) -> DataFrame:
    """train (train_idx, vec), pairs (pair_idx, vec_good, vec_bad) -> rows (pair_idx, pearson, spearman) of two methods' contrasts
    over all training rows. A method prepares vectors for the product.

    A rank needs all contrasts of its pair, so a task takes some pairs and reads all rows, packed, from the shared folder: contrasts
    are neither written nor shuffled. It holds COLUMNS of either method (with more rows than that, those of one pair).
    """
    from loomwright.plans.runtime import materialize

    n, dim = train.count(), _dim(train, "vec")
    kind = train.schema["vec"].dataType.elementType.typeName()
    dtype = {"float": np.float32, "double": np.float64}[kind]
    count, group = pairs.count(), max(1, COLUMNS // max(1, n))
    cores = train.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(count, cores), min(-(-count // group), 4 * cores))
    rows = materialize(_packed(train.select("vec"), max(1, PACK // (dim * dtype().itemsize)))).coalesce(1)
    left = pairs.select(F.col("pair_idx").cast("long").alias("pair_idx"), *[F.col(c).cast(f"array<{kind}>") for c in ("vec_good", "vec_bad")])
    left = _packed(left.repartition(tasks), min(group, max(1, -(-count // tasks))))

    def run(batches):
        ids, sides, held, at = b"", None, None, 0

        def done():
            found = [(_correlation(a[:at], b[:at]), _correlation(*(_mean_ranks(v[:at], digits) for v in (a, b)))) for a, b in zip(*held, strict=True)]
            cols = [np.array(c) for c in zip(*found, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), *map(pa.array, cols)], ["pair_idx", "pearson", "spearman"])

        for batch in batches:
            for own, good, bad, vec in zip(*(batch.column(c) for c in ("pair_idx", "vec_good", "vec_bad", "vec")), strict=True):
                if own.as_buffer() != ids:
                    if held:
                        yield done()
                    ids, at = own.as_py(), 0
                    vectors = [np.frombuffer(v.as_buffer(), dtype).astype(np.float64).reshape(len(ids) // 8, -1) for v in (good, bad)]
                    sides = [[m(v) for v in vectors] for m in methods]
                    held = [np.empty((len(ids) // 8, n)) for _ in methods]
                x = np.frombuffer(vec.as_buffer(), dtype).astype(np.float64).reshape(-1, dim)
                for m, (g, b), out in zip(methods, sides, held, strict=True):
                    y = m(x)
                    out[:, at : at + len(x)] = _rounded(_rounded(g @ y.T, digits) - _rounded(b @ y.T, digits), digits)
                at += len(x)
        if held:
            yield done()

    return left.hint("shuffle_replicate_nl").crossJoin(rows).mapInArrow(run, "pair_idx long, pearson double, spearman double")


def aggregate_queries(pairs: DataFrame) -> DataFrame:
    """Mean good and mean bad vector (family of one global contrast): rows (query_idx 0 good / 1 bad, vec)."""
    rows = pairs.select(F.when(F.col("is_good"), 0).otherwise(1).alias("query_idx"), F.posexplode("vec").alias("i", "x"))
    mean = rows.groupBy("query_idx", "i").agg(F.avg("x").alias("m"))
    return mean.groupBy("query_idx").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("a")).select("query_idx", F.transform("a", lambda s: s["m"]).alias("vec"))


#: Scoring methods by name.
METHODS = {"bm25": bm25, "vanilla": vector_scores, "trackstar": trackstar_transform, "ekfac": ekfac_transform, "kfac": kfac_transform, "kfac_fused": fused_transform}
