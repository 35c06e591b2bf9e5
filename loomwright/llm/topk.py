"""Exact top-k inner-product search by norm buckets (local thresholds, coordinate or length pruning).

The longest vectors are searched first and give each query a bound; queries of like reach (bound over length)
go in blocks, candidates in parts, and a vector is sent to those blocks only that its length
can reach. Each (query block, part) is one sorted stream:
first the block's queries, then the part's candidates, longest vectors first. A bucket
of similar lengths has for each query the local threshold t = bound / (|q| * longest),
`bound` being the query's k-th score so far: t > 1 ends the query, a low t prunes by
length, a high one by the coordinates in which the query is largest. What is left is
verified by exact products.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import cut, lean

#: Queries of one block, and candidates of one part, at most (about).
QUERY_BLOCK = 8192
#: Longest vectors that all queries meet first.
PILOT = 4096
PART_ROWS = 50_000
#: Candidates of a bucket at most; a bucket spans lengths down to RATIO of its longest.
BUCKET = 2048
RATIO = 0.9
#: Local threshold from which coordinates prune, and number of coordinates used.
COORDINATE_FROM = 0.6
FOCUS = 3


class _Best:
    """The k best candidates of each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, vectors, k
        self.norm = np.linalg.norm(vectors.astype(np.float64), axis=1)
        self.unit = vectors / np.maximum(self.norm, 1e-300)[:, None]
        self.focus = np.argsort(-np.abs(self.unit), axis=1)[:, :FOCUS]
        self.score = [np.zeros(0, dtype=np.int64) for _ in ids]
        self.found = [np.zeros(0, dtype=np.int64) for _ in ids]

    def bucket(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Take candidates of similar length, longest first."""
        norm = np.linalg.norm(vectors.astype(np.float64), axis=1)
        longest, unit = norm.max(initial=0.0), vectors / np.maximum(norm, 1e-300)[:, None]
        columns = np.ascontiguousarray(unit.T)
        for n in range(len(self.ids)):
            rows = None
            if len(self.score[n]) >= self.k and self.norm[n] > 0 and longest > 0:
                t = float(self.score[n][-1]) / (self.norm[n] * longest)
                if t > 1 + 1e-9:
                    continue
                if t >= COORDINATE_FROM:
                    # cos >= t needs |p_f - q_f t| <= sqrt((1 - t^2) (1 - q_f^2)) in each coordinate f,
                    # where p_f lies between what t and what 1 demands
                    ok = np.ones(len(ids), dtype=bool)
                    for f in self.focus[n]:
                        q = self.unit[n, f]
                        slack = math.sqrt(max(0.0, 1 - t * t) * max(0.0, 1 - q * q)) + 1e-9
                        low = q * t - slack if q > -t else -1.0
                        high = q * t + slack if q < t else 1.0
                        ok &= (columns[f] >= low) & (columns[f] <= high)
                    rows = np.flatnonzero(ok)
                elif t > 0:
                    rows = np.flatnonzero(norm >= float(self.score[n][-1]) / self.norm[n] * (1 - 1e-9))
            self._verify(n, ids, vectors, rows)

    def _verify(self, n: int, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None) -> None:
        if rows is not None:
            if not len(rows):
                return
            ids, vectors = ids[rows], vectors[rows]
        scores = products(vectors, self.v[n])
        keep = ids != self.ids[n]
        if len(self.score[n]) >= self.k:
            keep &= scores >= self.score[n][-1]
        if not keep.any():
            return
        s, i = np.concatenate([self.score[n], scores[keep]]), np.concatenate([self.found[n], ids[keep]])
        order = np.lexsort((i, -s))[: self.k]
        self.score[n], self.found[n] = s[order], i[order]

    def rows(self) -> pd.DataFrame:
        n = [len(s) for s in self.score]
        return pd.DataFrame({"query_id": np.repeat(self.ids, n), "vec_id": np.concatenate(self.found), "score": np.concatenate(self.score)})


def products(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Integer products; by floating point where every partial sum is below 2 ** 53. Scores may not pass 64 bits: OverflowError."""
    top = float(np.abs(vectors).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, len(q))
    if top >= 2**63:
        raise OverflowError("inner products beyond 64 bits")
    if top < 2**53:
        return (vectors.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return vectors @ q


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """Rows (id, v array<long>, norm) of floor(scale * x); vectors that are null, or hold null or
    non-finite components, and rows without id, are left out."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("d")).where(F.col("id").isNotNull() & F.col("d").isNotNull() & ~bad)
    rows = rows.select("id", F.transform("d", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))
    return rows.withColumn("norm", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def _search(k: int):
    def run(batches):
        at, best, held, asked = None, None, [], []

        def flush(done: bool):
            nonlocal held
            if held:
                ids, lengths = (np.concatenate([pdf[c].to_numpy() for pdf in held]) for c in ("id", "norm"))
                vectors = np.stack([v for pdf in held for v in pdf["v"]]).astype(np.int64)
                held, start = [], 0
                while start < len(ids):
                    similar = np.searchsorted(-lengths, -RATIO * RATIO * lengths[start], side="right")  # norm is the squared length
                    stop = max(start + 1, min(int(similar), start + BUCKET))
                    best.bucket(ids[start:stop], vectors[start:stop])
                    start = stop
            return best.rows() if done else None

        for pdf in batches:
            for key, group in pdf.groupby(["dim", "block", "part"], sort=False):
                if key != at:
                    if best is not None:
                        yield flush(True)
                    at, best, held, asked = key, None, [], []
                asks = group[group["ask"]]
                if len(asks):
                    asked.append(asks)
                rest = group[~group["ask"]]
                if len(rest):
                    if best is None:
                        if not asked:
                            continue
                        q = pd.concat(asked)
                        best = _Best(q["id"].to_numpy(), np.stack(q["v"].to_list()).astype(np.int64), k)
                    held.append(rest)
                    if sum(map(len, held)) >= BUCKET:
                        flush(False)
        if best is not None:
            yield flush(True)

    return run


def top_k(df: DataFrame, is_query, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): for each vector for which is_query(id) holds, its k
    highest integer inner products with other vectors of the same dimension; ties to the smaller id.

    Defined cases: fewer candidates give fewer rows; zero vectors score 0 and take part;
    vectors of another dimension are no candidates; rows that repeat an id count once (the
    smallest vector, component by component); rows without id are left out; scores beyond 64 bits raise;
    an empty table gives no rows; further columns are not read.
    """
    rows = integer_vectors(df, id_col, vec_col, scale).groupBy("id").agg(F.min("v").alias("v"), F.min_by("norm", "v").alias("norm"))
    rows = cut(rows.withColumn("dim", F.size("v")), "vectors")
    n, queries = rows.count(), rows.where(is_query(F.col("id")))
    blocks, parts = max(1, math.ceil(queries.count() / QUERY_BLOCK)), max(1, math.ceil(n / PART_ROWS), min(16, math.ceil(n / 2000)))
    reach = cut(_reach(rows, queries, blocks, k), "reach")
    floors = {r["block"]: r["least"] for r in reach.groupBy("block").agg(F.min("reach").alias("least")).collect()}  # one row for each block
    least = F.array(*[F.lit(float(floors.get(b, math.inf))) for b in range(blocks)])
    asks = reach.select("id", "v", "norm", "dim", F.lit(True).alias("ask"), "block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    reached = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.sqrt("norm") * (1 + 1e-9) >= F.get(least, b))
    answers = rows.select("id", "v", "norm", "dim", F.lit(False).alias("ask"), F.explode(reached).alias("block"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int").alias("part"))
    found = _streams(asks, answers, blocks * parts, k)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _streams(asks: DataFrame, answers: DataFrame, groups: int, k: int) -> DataFrame:
    """Rows (query_id, vec_id, score): each group's k best for each of its queries."""
    stream = asks.unionByName(answers).repartition(max(1, min(groups, 4096)), "dim", "block", "part")
    stream = stream.sortWithinPartitions("dim", "block", "part", F.desc("ask"), F.desc("norm"), "id")
    return stream.mapInPandas(lean(_search(k)), "query_id long, vec_id long, score long")


def _reach(rows: DataFrame, queries: DataFrame, blocks: int, k: int) -> DataFrame:
    """The queries with `reach`, the least length that a vector needs to be among their k best, as far as the PILOT longest
    vectors tell (else 0), and their block, by reach."""
    pilot = rows.orderBy(F.desc("norm"), "id").limit(PILOT).withColumn("ask", F.lit(False))
    deal = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    asks = queries.withColumn("ask", F.lit(True)).withColumn("block", deal).withColumn("part", F.lit(0))
    answers = pilot.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("part", F.lit(0))
    bounds = _streams(asks, answers, blocks, k).groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"), F.min("score").alias("_bound"))
    bound = F.when((F.col("_n") >= k) & (F.col("_bound") > 0) & (F.col("norm") > 0), F.col("_bound") / F.sqrt("norm"))
    out = queries.join(bounds, "id", "left").withColumn("reach", F.coalesce(bound, F.lit(0.0)))
    if blocks == 1:
        return out.withColumn("block", F.lit(0))
    steps = F.array(*[F.lit(b / blocks) for b in range(1, blocks)])
    cuts = out.agg(F.percentile_approx("reach", steps, 10_000).alias("_cuts"))  # one row
    # equal reaches fall to blocks by hash
    place = F.size(F.filter("_cuts", lambda c: c < F.col("reach"))) + F.pmod(F.xxhash64("id"), F.greatest(F.size(F.filter("_cuts", lambda c: c == F.col("reach"))), F.lit(1)))
    return out.crossJoin(F.broadcast(cuts)).withColumn("block", F.least(place, F.lit(blocks - 1)).cast("int")).drop("_cuts")
