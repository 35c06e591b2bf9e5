"""Best-fit packing of tokenised documents with exact-complement hashing.

Only the histogram of piece lengths (at most `size` entries) is planned on the driver;
pieces get their sequence from their rank among the pieces of equal length.
"""

from __future__ import annotations

import base64
import bisect
import functools
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import cut, lean

SIZE = 1024
END = 2
#: Pieces of one part, about, when ranks are given out.
PART_ROWS = 50_000
PIECES = "id long, piece int, start long, length int, crc long"


#: White-space characters in a row that only the contract's own library is given: the rank file's
#: library matches by backtracking, whose stack such runs exhaust.
LONG_SPACE = 10_000


def byte_bpe(path: str, pattern: str, specials: dict[str, int], library_path: str):
    """An encoder over a rank file, equal in ids to the byte-level BPE of the same vocabulary in library_path,
    which encodes texts with very long runs of white space itself."""
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=specials)
    long_space = re.compile(r"\s{%d}" % LONG_SPACE).search
    library: list = []

    def ids(text: str) -> np.ndarray:
        if len(text) >= LONG_SPACE and long_space(text):
            if not library:
                library.append(Tokenizer.from_file(library_path))
            return np.array(library[0].encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        if any(s in text for s in specials):
            return np.array(enc.encode(text, allowed_special="all"), dtype=np.uint32)
        return enc.encode_to_numpy(text)

    return ids


@functools.cache
def default_encoder():
    """Kept by a Python worker from task to task."""
    import public_tokenizers as P

    return byte_bpe(P.path("byte_bpe_50k.tiktoken"), P.PATTERN, {"<|endoftext|>": 50256}, P.path("byte_bpe_50k.json"))


def token_pieces(df: DataFrame, id_col: str, text_col: str, encoder=default_encoder, size: int = SIZE, end: int = END) -> DataFrame:
    """Each document's ids plus the end id, cut into pieces of `size` if longer (the first may be shorter)."""

    def run(batches):
        encode = encoder()
        for batch in batches:
            out: list[tuple] = []
            owner: list[int] = []
            for n, text in enumerate(batch.column(1).to_pylist()):
                ids = np.append(encode(text or ""), end).astype("<u4")
                first = len(ids) % size or size
                at = 0
                for piece, stop in enumerate(range(first, len(ids) + 1, size)):
                    owner.append(n)
                    out.append((piece, at, stop - at, zlib.crc32(ids[at:stop].tobytes())))
                    at = stop
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())],
                ["id", "piece", "start", "length", "crc"],
            )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(run), PIECES)


def plan_patterns(histogram: dict[int, int], size: int = SIZE) -> list[tuple[tuple[int, ...], int]]:
    """The plan of fewest sequences among those with complements of one, two and three lengths."""
    plans = [_plan(histogram, size, depth) for depth in (3, 2, 1)]
    return min(plans, key=lambda plan: sum(times for _, times in plan))


def _plan(histogram: dict[int, int], size: int, depth: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths that share a sequence, with their number, covering the histogram.

    Singles before pairs before triples, longest first; the gap is filled exactly by a single length, a pair or a triple
    looked up by its sum, as often as the counts allow. What has no exact complement
    goes best-fit: each length into the smallest gap that takes it.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    plan: list[tuple[tuple[int, ...], int]] = []
    if left.get(size):
        plan.append(((size,), left.pop(size)))
    pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
    lengths = sorted(left, reverse=True)
    for n, a in enumerate(lengths):
        for b in lengths[n:]:
            if a + b < size:
                pairs[a + b].append((a, b))

    def most(use: tuple[int, ...]) -> int:
        return min(left.get(n, 0) // use.count(n) for n in set(use))

    def take(use: tuple[int, ...], times: int) -> None:
        for n in use:
            left[n] -= times
        plan.append((use, times))

    for parts in range(1, depth + 1):
        for long in lengths:
            gap = size - long
            if parts == 1 and left[long] and (k := most((long, gap))):
                take((long, gap), k)
            for a, b in pairs[gap] if parts == 2 else ():
                if left[long] and (k := most((long, a, b))):
                    take((long, a, b), k)
            for a in lengths if parts == 3 else ():
                if left[long] and a <= gap and left[a]:
                    for b, c in pairs.get(gap - a, ()):
                        if b <= a and (k := most((long, a, b, c))):
                            take((long, a, b, c), k)
    gaps: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    order: list[int] = []

    def put(use: tuple[int, ...], times: int) -> None:
        gap = size - sum(use)
        if gap == 0:
            plan.append((use, times))
            return
        if not gaps[gap]:
            bisect.insort(order, gap)
        gaps[gap].append((use, times))

    for n in sorted((x for x in left if left[x]), reverse=True):
        while left[n]:
            at = bisect.bisect_left(order, n)
            if at < len(order):
                gap = order[at]
                use, times = gaps[gap].pop()
                if not gaps[gap]:
                    order.pop(at)
                k = min(times, left[n])
                if times > k:
                    put(use, times - k)
                left[n] -= k
                put((*use, n), k)
            else:
                fit = size // n
                whole, rest = divmod(left[n], fit)
                left[n] = 0
                if whole:
                    put((n,) * fit, whole)
                if rest:
                    put((n,) * rest, 1)
    plan += [x for g in gaps.values() for x in g]
    return plan


def slot_table(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Rank ranges of each length -> first sequence and offset, sorted by (length, first rank)."""
    used: dict[int, int] = defaultdict(int)
    slots, sequence = [], 0
    for use, times in plan:
        offset = 0
        for n in use:
            slots.append((n, used[n], sequence, offset))
            used[n] += times
            offset += n
        sequence += times
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", encoder=default_encoder, size: int = SIZE, end: int = END) -> DataFrame:
    """Rows (id, piece, start, length, crc, sequence_id, offset), one for each piece.

    Defined cases: a null or empty text is the end id alone, one piece of length 1; a
    null id stays null; rows that repeat an id are packed each on its own; texts, unbroken
    words and runs of white space of any length are encoded whole; an empty table gives no rows; equal lengths are placed in order of (id, piece); further
    columns of df are not read. No sequence is longer than `size`.
    """
    pieces = cut(token_pieces(df, id_col, text_col, encoder, size, end), "pieces")
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    slots = slot_table(plan_patterns(histogram, size))
    # ranks within a length are summed over blocks of parts, then over the parts of a block: no window
    # holds more than some thousand rows, though most pieces may have one length
    blocks = max(16, math.isqrt(sum(histogram.values()) // PART_ROWS))
    spot = F.pmod(F.xxhash64("id", "piece", "crc"), F.lit(blocks * blocks))
    ranked = pieces.withColumn("_block", F.floor(spot / blocks).cast("int")).withColumn("_part", F.pmod(spot, F.lit(blocks)).cast("int"))
    parts = ranked.groupBy("length", "_block", "_part").agg(F.count(F.lit(1)).alias("_n"))
    sums = parts.groupBy("length", "_block").agg(F.sum("_n").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    earlier = Window.partitionBy("length", "_block").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n").join(sums, ["length", "_block"])
    within = Window.partitionBy("length", "_block", "_part").orderBy("id", "piece", "start", "crc")
    ranked = ranked.join(parts, ["length", "_block", "_part"]).withColumn("rank", F.col("_base") + F.col("_before") + F.row_number().over(within) - 1)

    def place(batches):
        span = np.int64(1) << np.int64(48)
        keys = slots["length"] * span + slots["first"]
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(dtype=np.int64), pdf["rank"].to_numpy(dtype=np.int64)
            at = np.searchsorted(keys, length * span + rank, side="right") - 1
            yield pd.DataFrame(
                {
                    "id": pdf["id"], "piece": pdf["piece"], "start": pdf["start"], "length": length, "crc": pdf["crc"],
                    "sequence_id": slots["sequence"][at] + rank - slots["first"][at], "offset": slots["offset"][at],
                }
            )

    return ranked.select("id", "piece", "start", "length", "crc", "rank").mapInPandas(
        lean(place), "id long, piece int, start long, length long, crc long, sequence_id long, offset long"
    )
