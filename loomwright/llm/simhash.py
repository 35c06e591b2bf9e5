"""SimHash fingerprints of word shingles and near-duplicate components.

Two ways to find the pairs, both verified by the full Hamming distance:

* narrow radius, exact: the fingerprint is a ring of m = r + k segments. With r
  differing bits at least k segments agree, so pairs meet under the values of k equal segments;
  k, and with it the width of the key, grows with the number of different fingerprints.
* wide radius over long fingerprints: pairs meet under fixed
  pseudo-random bit subsets; their width follows log2 of the number of different
  fingerprints over CROWD and their number keeps the expected agreements at the radius constant.

Of pairs that meet, pigeonring filtering leaves those that hold a chain of consecutive segments whose
cumulative differences stay within the proportional budgets: any pair within the
radius holds one. The full Hamming distance is counted for these only.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import (
    compress, cut, group_values, lean, run_bounds, run_pairs, salted, sieve, split_hot, sweep, union_pairs, whole_runs,
)
from loomwright.llm.components import connected_components

#: Rows of one bucket that one task compares at once; larger buckets are dealt out in pairs of blocks.
BLOCK = 4096
#: Near pairs that a task holds before it keeps their nearest-first forest only.
FLUSH = 400_000
SEED = 42
#: Expected number of common buckets of a pair at the similarity that is asked for: all but 0.7 % meet, nearer ones surely.
MEETINGS = 5.0
#: Rows that one bucket holds on average at most, were fingerprints spread evenly: wider keys take more tables.
CROWD = 8
#: Sets of one tree that a task compares at once.
SETS = 512
#: Bits of a ring segment of a long fingerprint, and segments in a chain.
SEGMENT = 16
CHAIN = 3


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 of each shingle of the text, repeats included; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower folds A-Z only, bytes.split cuts at 20, 09-0D
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = [0, *(ends[:-1] + 1).tolist()]
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    return np.array(hashes, dtype=np.uint64)


def text_fingerprint(text: str | None, shingle: int, words64: int = 1) -> bytes:
    """Little-endian fingerprint of 64 * words64 bits; no words: all bits zero."""
    return _bits(shingle_hashes(text, shingle), words64)


def set_fingerprint(text: str | None, shingle: int, words64: int) -> bytes:
    """The fingerprint of the text's distinct shingles, then 16 bytes that are equal for equal sets only."""
    base = np.unique(shingle_hashes(text, shingle))
    return _bits(base, words64) + xxhash.xxh3_128_digest(base.tobytes())


def _bits(base: np.ndarray, words64: int) -> bytes:
    if not len(base):
        return bytes(8 * words64)
    out = []
    for w in range(words64):
        h = base if w == 0 else _mix(base + np.uint64((w * 0x9E3779B97F4A7C15) & (2**64 - 1)))
        ones = np.zeros(64, dtype=np.int64)
        for lo in range(0, len(h), 65_536):
            part = h[lo : lo + 65_536]
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(np.packbits(ones * 2 > len(h), bitorder="little").tobytes())
    return b"".join(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int, words64: int = 1, sets: bool = False) -> DataFrame:
    """Rows (id, fp binary), of `set_fingerprint` if `sets`; a null text counts as empty, a row without id is left out."""
    mark = set_fingerprint if sets else text_fingerprint

    def run(batches):
        for batch in batches:
            fps = [mark(t, shingle, words64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.binary())], ["id", "fp"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return rows.mapInArrow(lean(run), "id long, fp binary")


def segment_differences(x: np.ndarray, widths: list[int] | None) -> np.ndarray:
    """(n, m) numbers of set bits of x (n, words of 64 bits) by segment; without widths, SEGMENT bits each."""
    if widths is None:
        return np.bitwise_count(np.ascontiguousarray(x).view(f"<u{SEGMENT // 8}")).astype(np.int16)
    out, at = np.empty((len(x), len(widths)), dtype=np.int16), 0
    for k, w in enumerate(widths):
        out[:, k] = np.bitwise_count((x[:, 0] >> np.uint64(at)) & np.uint64((1 << w) - 1))
        at += w
    return out


def ring_passes(diff: np.ndarray, radius: int, chain: int = CHAIN) -> np.ndarray:
    """Whether the ring of segments with these differences has a chain of `chain` consecutive ones
    whose first l segments differ in at most l * radius / m bits, for each l. All rows of `radius` or less have."""
    m, total = diff.shape[1], diff.copy()
    here = total * m <= radius
    for step in range(1, min(chain, m)):
        total += np.roll(diff, -step, axis=1)
        here &= total * m <= (step + 1) * radius
    return here.any(axis=1)


def closest_forest(parent: np.ndarray, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> list[int]:
    """Positions of pairs that join the trees of `parent`, nearest pairs first; merges them there."""
    picked: list[int] = []
    for level in np.unique(distance):
        at = np.flatnonzero(distance == level)
        while True:
            a, b = parent[i[at]], parent[j[at]]
            apart = a != b
            if not apart.any():
                break
            at, high, low = at[apart], np.maximum(a, b)[apart], np.minimum(a, b)[apart]
            roots, first = np.unique(high, return_index=True)
            picked += at[first].tolist()
            parent[roots] = low[first]
            compress(parent)
    return picked


def _edges(radius: int, words64: int, widths: list[int] | None, nearest: bool):
    """mapInPandas step over rows sorted by (key, _b1, _b2): a spanning forest of each chunk's links (a, b, tree);
    nearest first if the links are to be tried further, `tree` then names the tree that holds the link."""

    def run(batches):
        for pdf in whole_runs(batches, ["key", "_b1", "_b2"]):
            key, b1, b2 = (pdf[c].to_numpy() for c in ("key", "_b1", "_b2"))
            starts, ends = run_bounds([key, b1, b2])
            keep = np.repeat(ends - starts > 1, ends - starts)
            if not keep.any():
                continue
            pdf, key, b1, b2 = pdf[keep], key[keep], b1[keep], b2[keep]
            blk, rep = pdf["_blk"].to_numpy(), pdf["rep"].to_numpy()
            starts, ends = run_bounds([key, b1, b2])
            fp = np.frombuffer(b"".join(pdf["fp"]), dtype="<u8").reshape(-1, words64)
            parent = np.arange(len(rep))
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            fresh = 0

            def forest():
                """Of the pairs held so far, keep the edges of their nearest-first forest: the others are in none of more pairs."""
                i, j, d = (np.concatenate([h[c] for h in held]) for c in range(3))
                parent[:] = np.arange(len(parent))
                picked = closest_forest(parent, i, j, d)
                held[:] = [(i[picked], j[picked], d[picked])]

            for i, j in run_pairs(starts, ends):
                across = b1[i] != b2[i]
                if across.any():
                    meet = ~across | (blk[i] != blk[j])
                    i, j = i[meet], j[meet]
                x = fp[i] ^ fp[j]
                ring = ring_passes(segment_differences(x, widths), radius)
                i, j, x = i[ring], j[ring], x[ring]
                d = np.bitwise_count(x).sum(axis=1, dtype=np.int16)
                near = d <= radius
                if not nearest:
                    union_pairs(parent, i[near], j[near])
                elif near.any():
                    held.append((i[near], j[near], d[near]))
                    fresh += len(held[-1][0])
                    if fresh > FLUSH:
                        forest()
                        fresh = 0
            if not nearest:
                child = np.flatnonzero(parent != np.arange(len(parent)))
                held.append((child, parent[child], child))
            elif held:
                forest()
            if held:
                i, j, _ = held[0]
                root = parent[i]
                tree = _mix(_mix(key[root].view(np.uint64)) + (b1[root].astype(np.uint64) << np.uint64(32)) + b2[root].astype(np.uint64))
                yield pd.DataFrame({"a": rep[i], "b": rep[j], "tree": _mix(tree + rep[root].view(np.uint64)).view(np.int64)})

    return run


def verified(links: DataFrame, df: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The links (a, b) whose texts' sets of shingles have a Jaccard similarity of `similarity` or more.

    Texts that a sieve of the ends leaves meet the ends of their links by a shuffle of both, as either grows with the
    corpus; what goes on are sets of 32-bit hashes (the upper half of the 64 bits): of two texts of
    n shingles each some n * n / 2 ** 32 count as shared that are not, one in 35,000 pairs of 350.
    """
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), "a", "b"), F.struct(F.col("b").alias("id"), "a", "b"))).alias("e")).select("e.*")
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts, _ = sieve(texts, texts["id"], ends.select("id"))

    def sets(batches):
        for batch in batches:
            found, last, packed = [], None, b""
            for text in batch.column(3).to_pylist():
                if text != last:
                    last, packed = text, np.unique((shingle_hashes(text, shingle) >> np.uint64(32)).astype(np.uint32)).tobytes()
                found.append(packed)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(0), pa.array(found, pa.binary())], ["a", "b", "id", "hashes"])

    def compare(batches):
        for pdf in whole_runs(batches, ["a", "b"]):
            a, b, ids, hashes = (pdf[c].to_numpy() for c in ("a", "b", "id", "hashes"))
            good = []
            for s, e in zip(*run_bounds([a, b]), strict=True):
                x = next((hashes[n] for n in range(s, e) if ids[n] == a[s]), b"")
                y = next((hashes[n] for n in range(s, e) if ids[n] == b[s]), b"")
                x, y = np.frombuffer(x, dtype=np.uint32), np.frombuffer(y, dtype=np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                    good.append(s)
            if good:
                yield pd.DataFrame({"a": a[good], "b": b[good]})

    joined = texts.hint("merge").join(ends, "id").select("id", "a", "b", "text")
    packed = joined.mapInArrow(lean(sets), "a long, b long, id long, hashes binary")
    return packed.repartition("a", "b").sortWithinPartitions("a", "b").mapInPandas(lean(compare), "a long, b long")


def _untried(radius: int, words64: int, similarity: float):
    """mapInPandas step over rows sorted by (tree, _b1, _b2): of all pairs of a tree within the radius whose components
    differ, those that reach the similarity, without such as join what the ones before have joined."""

    def run(batches):
        for pdf in whole_runs(batches, ["tree", "_b1", "_b2"]):
            tree, b1, b2, blk, rep, component = (pdf[c].to_numpy() for c in ("tree", "_b1", "_b2", "_blk", "rep", "component"))
            a, b = [], []
            for s, e in zip(*run_bounds([tree, b1, b2]), strict=True):
                fp = np.frombuffer(b"".join(pdf["fp"].iloc[s:e]), dtype="<u8").reshape(-1, words64)
                sets = [np.frombuffer(x, dtype=np.uint64) for x in pdf["hashes"].iloc[s:e]]
                side = blk[s:e] if b1[s] != b2[s] else None
                for i, j in similar_forest(component[s:e], fp, sets, radius, similarity, side):
                    a.append(rep[s + i])
                    b.append(rep[s + j])
            if a:
                yield pd.DataFrame({"a": a, "b": b})

    return run


def similar_forest(component: np.ndarray, fp: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that join the components, by trying all pairs within the radius whose components are still separate;
    with `side`, those whose sides differ."""
    n, found = len(sets), []
    label = np.unique(component, return_inverse=True)[1]
    size = np.array([len(x) for x in sets])
    at = np.concatenate([[0], np.cumsum(size)])
    feature = np.unique(np.concatenate(sets), return_inverse=True)[1]
    holder = np.repeat(np.arange(n), size)[np.argsort(feature, kind="stable")]  # the sets that hold a feature, by feature
    first = np.concatenate([[0], np.cumsum(np.bincount(feature))]).astype(np.int64)
    for i in range(n - 1):
        least, most = np.minimum(size[i], size[i + 1 :]), np.maximum(size[i], size[i + 1 :])
        near = (label[i + 1 :] != label[i]) & (least >= similarity * most - 1e-9)
        if side is not None:
            near &= side[i + 1 :] != side[i]
        at_ = np.flatnonzero(near)
        x = fp[i + 1 + at_] ^ fp[i]
        ring = ring_passes(segment_differences(x, None), radius)
        at_, x = at_[ring], x[ring]
        at_ = at_[np.bitwise_count(x).sum(axis=1, dtype=np.int16) <= radius]
        if not len(at_):
            continue
        own = feature[at[i] : at[i + 1]]
        length = first[own + 1] - first[own]
        step = np.arange(length.sum()) + np.repeat(first[own] - np.cumsum(length) + length, length)
        both = np.bincount(holder[step], minlength=n)[i + 1 + at_]
        good = i + 1 + at_[both >= similarity * (size[i] + size[i + 1 + at_] - both) - 1e-9]
        joined, one = np.unique(label[good], return_index=True)
        found += [(i, int(j)) for j in good[one]]
        label[np.isin(label, joined)] = label[i]
    return found


def untried(links: DataFrame, found: DataFrame, classes: DataFrame, df: DataFrame, id_col: str, text_col: str, shingle: int, words64: int, radius: int, similarity: float) -> DataFrame | None:
    """Further links (a, b) between the components `found` of the links that passed.

    A bucket's pairs within the radius all lie within trees of its forest. Where a tree is still more than
    one component, a link of it failed: all its pairs that are still separate are tried. A large tree is dealt out
    in pairs of blocks: a task holds the sets of two blocks, and puts out fewer links than it holds rows.
    """
    nodes = links.select("tree", F.explode(F.array("a", "b")).alias("rep")).distinct()
    nodes = nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("tree", "rep", F.coalesce("component", "rep").alias("component"))
    trees = nodes.groupBy("tree").agg(
        F.count(F.lit(1)).alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"),
        F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(SEED))).alias("y"),
    )
    # a tree of two rows is one link, tried already; trees of the same rows, from several buckets, are tried once
    trees = trees.where("n > 2 and lo < hi").groupBy("n", "x", "y").agg(F.min("tree").alias("tree")).select("tree")
    nodes = cut(nodes.join(trees, "tree", "left_semi"), "untried")
    total = nodes.count()
    if not total:
        return None
    texts = df.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text"))
    texts, _ = sieve(texts, texts["rep"], nodes.select("rep"))
    texts = texts.join(nodes.select("rep").distinct(), "rep", "left_semi")

    def sets(batches):
        for batch in batches:
            packed = [np.unique(shingle_hashes(t, shingle)).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["rep", "hashes"])

    marks = classes.select("rep", F.substring("fp", 1, 8 * words64).alias("fp")).dropDuplicates(["rep"])
    hashes = texts.mapInArrow(lean(sets), "rep long, hashes binary").dropDuplicates(["rep"])
    dealt = split_hot(nodes, "tree", "rep", SETS, total)
    rows = dealt.join(cut(hashes.join(marks, "rep"), "sets"), "rep").repartition("tree", "_b1", "_b2").sortWithinPartitions("tree", "_b1", "_b2", "rep")
    return rows.mapInPandas(lean(_untried(radius, words64, similarity)), "a long, b long")


def ring_segments(radius: int, distinct: int) -> tuple[list[int], int]:
    """Widths of the segments of 64 bits, and the number k of them that agree in any pair within the radius: the least k
    (2 at least) whose keys leave CROWD of the `distinct` fingerprints to a bucket, were they spread evenly."""
    for k in range(2, 7):
        m = radius + k
        widths = [64 // m + (n < 64 % m) for n in range(m)]
        if distinct <= CROWD << sum(sorted(widths)[:k]):
            break
    return widths, k


def ring_keys(classes: DataFrame, radius: int, distinct: int) -> tuple[DataFrame, list[int], int]:
    """64-bit fingerprints under the values of each k of their segments: rows (key, rep, fp), widths, keys of a row."""
    widths, k = ring_segments(radius, distinct)
    at = [sum(widths[:n]) for n in range(len(widths))]
    seg = [F.shiftrightunsigned("bits", a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in zip(at, widths, strict=True)]
    chosen = list(itertools.combinations(range(len(widths)), k))
    picks = F.array(*[F.array(*[F.lit(i) for i in c]) for c in chosen])
    keys = F.transform(picks, lambda c, n: F.xxhash64(n, F.transform(c, lambda i: F.get("segments", i))))
    rows = classes.withColumn("bits", F.conv(F.hex(big_endian("fp")), 16, -10).cast("long")).withColumn("segments", F.array(*seg))
    return rows.select(F.explode(keys).alias("key"), "rep", F.substring("fp", 1, 8).alias("fp")), widths, len(chosen)


def big_endian(col: str):
    """The eight bytes of a 64-bit fingerprint, highest first."""
    return F.concat(*[F.substring(col, k, 1) for k in range(8, 0, -1)])


def flip_rate(similarity: float) -> float:
    """Share of fingerprint bits that differ, on average, between sets of equal size at a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def sampled_keys(classes: DataFrame, flips: float, words64: int, distinct: int) -> tuple[DataFrame, int]:
    """Long fingerprints under fixed bit subsets: rows (key, rep, fp), and the number
    of subsets. Pairs that differ in a share `flips` of the bits agree in MEETINGS of them on average."""
    bits = 64 * words64
    width = min(48, max(10, math.ceil(math.log2(max(distinct / CROWD, 2)))))
    tables = math.ceil(MEETINGS / (1 - flips) ** width)
    picks = np.random.default_rng(SEED).random((tables, bits)).argsort(axis=1)[:, :width]
    weights = (1 << np.arange(width, dtype=np.int64))

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, 2048):
                batch = whole.slice(lo, 2048)
                fp = np.frombuffer(b"".join(f[: bits // 8] for f in batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, bits // 8)
                bit = np.unpackbits(fp, axis=1, bitorder="little").astype(np.int64)
                keys = np.stack([(bit[:, p] @ weights) | (np.int64(t) << np.int64(48)) for t, p in enumerate(picks)], axis=1)
                take = pa.array(np.repeat(np.arange(batch.num_rows), tables))
                heads = pa.array([f[: bits // 8] for f in batch.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), batch.column(0).take(take), heads.take(take)], ["key", "rep", "fp"])

    return classes.select("rep", "fp").mapInArrow(lean(run), "key long, rep long, fp binary"), tables


def simhash_components(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, words64: int = 1, radius: int = 4, similarity: float | None = None
) -> DataFrame:
    """Rows (id, fp, component): component is the smallest id reachable over links, which
    join fingerprints at `radius` or fewer differing bits; with `similarity`, only if the
    shingle sets' Jaccard similarity reaches it as well (the nearest pairs by fingerprint are
    tried first, as a spanning forest of each bucket; then, where links of a tree failed, all
    its pairs that passed links haven't joined). Fingerprints are then those of the sets, and
    only equal sets are one class.

    Defined cases: a null or empty text, or one of white space only, has the zero
    fingerprint, linked like any other; a text of fewer words than `shingle` is one
    shingle; equal fingerprints (or sets) are one class and cost one row each; rows that repeat
    an id are each returned with that id's component; rows whose id is null are left
    out; an empty table gives no rows; further columns of df are not read.
    """
    rows = salted(cut(fingerprints(df, id_col, text_col, shingle, words64, similarity is not None), "fp"), "id")
    reps = cut(group_values(rows, ["fp"], {"rep": F.min("id")}, {"rep": F.min("rep")}), "reps")
    classes = cut(reps.select("fp", "rep").distinct(), "classes")
    distinct = classes.count()
    if words64 == 1:
        keyed, widths, tables = ring_keys(classes, radius, distinct)
    else:
        flips = flip_rate(similarity) if similarity else radius / (64 * words64)
        (keyed, tables), widths = sampled_keys(classes, flips, words64, distinct), None
    dealt = split_hot(keyed, "key", "rep", BLOCK, distinct * tables).repartition("key", "_b1", "_b2")
    dealt = dealt.sortWithinPartitions("key", "_b1", "_b2")
    links = dealt.mapInPandas(lean(_edges(radius, words64, widths, similarity is not None)), "a long, b long, tree long")
    if similarity is None:
        found = connected_components(links)
    else:
        links = cut(links, "links")
        sweep(df.sparkSession)
        found = connected_components(verified(links.select("a", "b").distinct(), df, id_col, text_col, shingle, similarity))
        sweep(df.sparkSession)
        more = untried(links, found, classes, df, id_col, text_col, shingle, words64, radius, similarity)
        if more is not None:
            found = connected_components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    found = found.withColumnRenamed("node", "rep")
    labelled = reps.join(found, "rep", "left").select(
        "fp", "_salt", F.coalesce("component", "rep").alias("component")
    )
    return rows.join(labelled, ["fp", "_salt"]).select("id", F.substring("fp", 1, 8 * words64).alias("fp"), "component")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, words64: int = 4, radius: int = 56, similarity: float = 0.8
) -> DataFrame:
    """The documents that stay when one of each near-duplicate group is kept (smallest id),
    with the columns of docs.

    Near-duplicates have a Jaccard similarity of `similarity` or more between their sets of
    `shingle`-word shingles. Of 256 bits, texts at 0.8 differ
    in 39 on average with a deviation of 6: the radius takes in nearly all, the exact
    similarity decides.

    Defined cases: null and empty texts, and those of white space only, have equal (empty) sets and
    are one group; texts of any length are read whole; rows without id stay as they are; rows that repeat an id
    are one document; an empty table gives no rows; other columns of any name are handed through.
    """
    marks = simhash_components(docs, id_col, text_col, shingle, words64, radius, similarity)
    further = cut(marks.where("id <> component").select("id").distinct(), "further")
    gone = further.select(F.col("id").alias("_gone"))
    sweep(docs.sparkSession)
    some, others = sieve(docs, docs[id_col].cast("long"), further)
    return others.union(some.join(gone, docs[id_col].cast("long") == gone["_gone"], "left_anti"))
