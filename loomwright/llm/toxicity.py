"""Toxicity scores: a logistic classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import lean

BITS = 18
LENGTHS = (3, 4, 5)
#: Most labelled rows that a model is fitted on, lowest hash of the id first.
FIT_ROWS = 4000
#: Added to each count of the log-count ratio.
SMOOTH = 1.0
#: Fewest fitted rows that hold an n-gram of the model.
MIN_ROWS = 8
#: Weight of the squared coefficients against the summed loss.
RIDGE = 30.0


@dataclass(frozen=True)
class Model:
    weight: np.ndarray
    bias: float


def _features(texts: list[str | None]):
    """For each text the sorted hashed n-grams that it holds (each once), over the bytes of the
    text between two spaces, A-Z folded."""
    blobs = [b" " + (t or "").encode("utf-8", "surrogatepass").lower() + b" " for t in texts]
    data = np.frombuffer(b"".join(blobs), dtype=np.uint8).astype(np.uint32)
    rolled, tables = np.zeros(len(data), dtype=np.uint32), []
    for k in range(max(LENGTHS)):
        n = len(data) - k
        rolled[:n] = (rolled[:n] + data[k:] + np.uint32(1)) * np.uint32(0x01000193) ^ (rolled[:n] >> np.uint32(15))
        if k + 1 in LENGTHS:
            tables.append((((rolled[:n] ^ np.uint32(k)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int32))
    seen, at = np.zeros(1 << BITS, dtype=bool), 0
    for blob in blobs:
        for n, table in zip(LENGTHS, tables, strict=True):
            if len(blob) >= n:
                seen[table[at : at + len(blob) - n + 1]] = True
        at += len(blob)
        found = np.flatnonzero(seen)
        seen[found] = False
        yield found


def _batched(texts: list[str | None], limit: int = 500_000):
    """Slices of the texts of some `limit` characters."""
    lo, size = 0, 0
    for n, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield texts[lo : n + 1]
            lo, size = n + 1, 0
    if lo < len(texts):
        yield texts[lo:]


def features(texts: list[str | None]):
    for part in _batched(texts):
        yield from _features(part)


def fit(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """Log-count ratios over the rows that hold each n-gram, then ridge logistic regression by L-BFGS."""
    size = 1 << BITS
    y = y.astype(np.float64)
    if len(rows) == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(size, dtype=np.float32), float(np.log(rate / (1 - rate))))
    pos, neg = np.full(size, SMOOTH), np.full(size, SMOOTH)
    for found, label in zip(rows, y, strict=True):
        (pos if label else neg)[found] += 1
    # rates per class, so that a rare class has no overall shift
    ratio = np.log((pos / (y.sum() + SMOOTH)) / (neg / ((1 - y).sum() + SMOOTH)))
    ratio[pos + neg - 2 * SMOOTH < MIN_ROWS] = 0.0
    blocks = []
    for lo in range(0, len(rows), 250):
        kept = [r[ratio[r] != 0].astype(np.int32) for r in rows[lo : lo + 250]]
        owner = np.repeat(np.arange(len(kept)), [len(r) for r in kept])
        blocks.append((slice(lo, lo + len(kept)), np.concatenate(kept), owner.astype(np.int16)))

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        scaled, by_feature = w[:size] * ratio, np.zeros(size)
        value, bias = RIDGE * np.sum(w[:size] ** 2) / 2, 0.0
        for at, flat, owner in blocks:
            z = np.bincount(owner, weights=scaled[flat], minlength=at.stop - at.start) + w[size]
            d = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[at]
            value += np.sum(np.logaddexp(0, z) - y[at] * z)
            by_feature += np.bincount(flat, weights=d[owner], minlength=size)
            bias += d.sum()
        return float(value), np.append(by_feature * ratio + RIDGE * w[:size], bias)

    w = _lbfgs(loss, np.zeros(size + 1))
    return Model((w[:size] * ratio).astype(np.float32), float(w[size]))


def _lbfgs(loss, w: np.ndarray, rounds: int = 40, memory: int = 6) -> np.ndarray:
    value, grad = loss(w)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, d in reversed(steps):
            a = (s @ q) / (s @ d)
            alphas.append(a)
            q -= a * d
        if steps:
            s, d = steps[-1]
            q *= (s @ d) / (d @ d)
        else:
            q /= max(1.0, np.abs(grad).sum() ** 0.5 * 10)
        for (s, d), a in zip(steps, reversed(alphas), strict=True):
            q += s * (a - (d @ q) / (s @ d))
        rate, slope = 1.0, -(grad @ q)
        while rate > 1e-6:
            new_value, new_grad = loss(w - rate * q)
            if new_value <= value + 1e-4 * rate * slope:
                break
            rate /= 2
        else:
            break
        s, d = -rate * q, new_grad - grad
        w = w + s
        done = value - new_value < 1e-6 * max(1.0, abs(value))
        value, grad = new_value, new_grad
        if s @ d > 1e-12:
            steps = [*steps, (s, d)][-memory:]
        if done:
            break
    return w


def held_out(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on at most fit_rows labelled documents outside the held-out fold (crc32 of the id mod 5 = 0)."""
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    marks = marks.where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id"))
    marks = marks.groupBy("_id").agg(F.max("_y").alias("_y"))
    marks = marks.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = rows.join(F.broadcast(marks), "_id").select("_y", "_text")  # marks: fit_rows rows at most

    def run(batches):
        for batch in batches:
            found = [f.astype("<i4").tobytes() for f in features(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["y", "found"])

    got = rows.mapInArrow(lean(run), "y int, found binary").toArrow()
    found = []
    for chunk in got.column(1).chunks:  # views of the received memory
        ends = np.frombuffer(chunk.buffers()[1], dtype=np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        flat = np.frombuffer(chunk.buffers()[2], dtype="<i4") if chunk.buffers()[2] is not None else np.zeros(0, np.int32)
        found += [flat[a // 4 : b // 4] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return fit(found, np.array(got.column(0).to_pylist()))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, score), one for each row of docs."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2 ** BITS weights

    def run(batches):
        m = shared.value
        for batch in batches:
            z = np.array([float(m.weight[f].sum(dtype=np.float64)) for f in features(batch.column(1).to_pylist())]) + m.bias
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Rows (id, held_out, score, predicted), one for each row of docs.

    Defined cases: a null text counts as empty and gets the score of a text without
    n-grams, between 0 and 1; a null id is scored, and counts as not held out; a label
    that is null or neither 0 nor 1 is not learned from; of several labels of one
    document the highest counts; no usable label, or one class only, gives all texts
    the smoothed rate of label 1; texts of any length are scored whole; an empty table gives no rows; further columns are not read.
    """
    model = train(docs, labels, id_col, text_col, label_col)
    return score(docs, model, id_col, text_col).select(
        "id", F.coalesce(held_out("id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with their columns, whatever their names.

    Null and empty texts have the score of a text without n-grams; texts of any length are scored whole; repeated
    rows are scored alike; rows without id are scored; an empty table gives no rows; labels are used as in toxicity().
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches):
        m = shared.value
        for batch in batches:
            z = np.array([float(m.weight[f].sum(dtype=np.float64)) for f in features(batch.column(at).to_pylist())]) + m.bias
            yield batch.filter(pa.array(z < 0))

    return docs.select(*names).mapInArrow(lean(run), docs.schema)
