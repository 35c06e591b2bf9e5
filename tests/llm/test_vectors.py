"""Operators over vectors: exact top-k and near-duplicates."""

import math
import os

import numpy as np
import pyarrow as pa
import pytest
from oracle import assert_same, connect
from pyspark.sql import functions as F

from loomwright.llm import embed_dedup, topk
from loomwright.llm.queries import QUERIES
from loomwright.llm.sql import ORACLES

SCHEMA = "vec_id long, embedding array<double>, id string, v string, rep long, norm int, key int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", 1, 1, 1) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("name", ["op2_topk", "op10_embeddings"])
def test_queries_against_sql(spark, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name])


def brute_top(rows, k, asks):
    ints = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in filter(asks, ints):
        s = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q and len(v) == len(ints[q]))[:k]
        out |= {(q, n + 1, i, -x) for n, (x, i) in enumerate(s)}
    return out


@pytest.mark.parametrize("pilot", [4096, 20])
def test_top_k_by_brute_force(spark, monkeypatch, pilot):
    for name, value in (("BUCKET", 32), ("PART_ROWS", 100), ("QUERY_BLOCK", 8), ("PILOT", pilot)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.standard_normal(8) * 10 ** rng.uniform(-2, 1)).tolist()) for i in range(400)]
    rows += [(1000 + i, [0.5] * 8) for i in range(30)]  # ties
    rows += [(2000, None), (2010, [None] * 8), (2020, [float("nan")] + [1.0] * 7), (2030, [float("inf")] + [0.0] * 7), (2040, [0.0] * 8), (2050, [1.0, 2.0]), (2060, [3.0, -1.0]), (None, [1.0] * 8)]
    rows += [(3000, [1e6, -1e6] * 4), (3010, [1e6] * 8)]
    df = vectors(spark, rows)
    got = {tuple(r) for r in topk.top_k(df, lambda i: F.pmod(i, F.lit(10)) == 0).collect()}
    assert got == brute_top(rows, 10, lambda i: i % 10 == 0)
    assert topk.top_k(vectors(spark, []), lambda i: i >= 0).count() == 0
    few = vectors(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0])])
    assert {tuple(r) for r in topk.top_k(few, lambda i: i == 0).collect()} == {(0, 1, 1, 1024 * 1024)}


def test_scores_beyond_64_bits_are_refused():
    with pytest.raises(OverflowError):
        topk.products(np.full((1, 2), 2**40), np.full(2, 2**30))


def test_short_vectors_are_not_sent(spark, monkeypatch):
    """Blocks whose bound a vector cannot reach don't get it."""
    for name, value in (("QUERY_BLOCK", 8), ("PILOT", 40)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(5)
    rows = topk.integer_vectors(vectors(spark, [(i, (rng.standard_normal(8) * (10 if i < 60 else 0.01)).tolist()) for i in range(300)]), "vec_id", "embedding", 1024)
    rows = rows.withColumn("dim", F.size("v"))
    reach = topk._reach(rows, rows.where("id < 50"), 7, 5).collect()
    assert all(r.reach > 1024 for r in reach) and len({r.block for r in reach}) >= 5


def test_hadamard_is_a_rotation():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((5, 16))
    y = embed_dedup._hadamard(x.copy()) / 4
    assert np.allclose((x * x).sum(1), (y * y).sum(1)) and np.allclose(embed_dedup._hadamard(y.copy()) / 4, x)


@pytest.mark.parametrize("cosine, distinct", [(0.9, 1000), (0.95, 1000), (0.9, 10**6), (0.9, 10**8)])
def test_recall(cosine, distinct):
    plan = embed_dedup.plan_tables(distinct, 64)
    assert distinct <= embed_dedup.CROWD * 128 ** plan[1]
    rng = np.random.default_rng(2)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    b = rng.standard_normal((2000, 64))
    b -= (b * a).sum(1)[:, None] * a
    b /= np.linalg.norm(b, axis=1)[:, None]
    x, y = embed_dedup.bucket_codes(a, *plan), embed_dedup.bucket_codes(cosine * a + math.sqrt(1 - cosine**2) * b, *plan)
    assert (x[:, :, None] == y[:, None, :]).any((1, 2)).mean() >= 0.97


@pytest.mark.parametrize("crowd", [8, 0])
def test_near_duplicates_by_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    monkeypatch.setattr(embed_dedup, "CROWD", crowd)  # none: as many rotations as for very large tables
    rng = np.random.default_rng(7)
    rows, base = [], rng.standard_normal(24)
    rows += [(i, (base + 0.1 * rng.standard_normal(24)).tolist()) for i in range(60)]  # a tight group
    rows += [(100 + i, base.tolist()) for i in range(40)]  # copies
    rows += [(200 + i, rng.standard_normal(24).tolist()) for i in range(80)]
    rows += [(300, None), (301, [0.0] * 24), (302, [float("nan")] * 24), (303, [None] * 24), (304, [1e-200] * 24), (305, [1e200] * 24), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (308, [])]
    got = {r.id: r for r in embed_dedup.near_duplicate_vectors(vectors(spark, [*rows, (None, [1.0] * 24)])).collect()}
    good = {i: np.array(v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    unit = {i: (v / np.abs(v).max()) / np.linalg.norm(v / np.abs(v).max()) for i, v in good.items()}
    links = {(a, b) for a in unit for b in unit if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert len(got) == len(rows)
    for i, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(a == i for a, _ in links), find(i), find(i) == i), i
    assert embed_dedup.near_duplicate_vectors(vectors(spark, [])).count() == 0


def test_near_duplicates_in_sets_and_rounds(spark, monkeypatch):
    """Buckets cut into blocks, searched by sets and dealt in many rounds give each link once."""
    for name, value in (("BLOCK", 40), ("SMALL", 8), ("FINE", 2), ("ROUND", 100)):
        monkeypatch.setattr(embed_dedup, name, value)
    rng = np.random.default_rng(9)
    bases = rng.standard_normal((3, 24))
    rows = [(i, (bases[i % 3] + 0.02 * rng.standard_normal(24)).tolist()) for i in range(300)]
    rows += [(1000 + i, rng.standard_normal(24).tolist()) for i in range(50)]
    rows += [(2000 + i, rows[0][1]) for i in range(5)]
    df = vectors(spark, rows).select("vec_id", F.col("embedding").cast("array<float>"))
    got = {r.id: (r.n_links, r.component_id) for r in embed_dedup.near_duplicate_vectors(df).collect()}
    for i, _ in rows:
        assert got[i] == ((0, i) if 1000 <= i < 2000 else (104, 0) if i >= 2000 or i % 3 == 0 else (99, i % 3)), i


def test_a_round_sends_about_one_copy():
    """All copies are sent, each in one of the rounds; in none of them many times the table."""
    rng = np.random.default_rng(4)
    n, x = 3000, rng.standard_normal((3000, 64)).astype(np.float32)
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(np.ones(n, np.int64)), pa.array([v.tobytes() for v in x], pa.binary())], ["rep", "copies", "vec"])
    for total in (n, 10**7):
        plan = total, None, embed_dedup.CROWD
        batch = next(embed_dedup._add_axes(plan, "f4")([rows]))
        tables, rotations = embed_dedup.plan_tables(total, 64)
        per = tables * 2**rotations
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        sent = [sum(len(b) for b in embed_dedup._deal(plan, per, at, none)([batch])) for at in range(per)]
        assert sum(sent) == per * n and max(sent) < 2 * n


def test_disk_follows_the_table(spark, monkeypatch):
    """What is written between the steps stays within the table's size, however many buckets a vector is in."""
    written = []

    def size(df, name, cut=embed_dedup.cut):
        out = cut(df, name)
        written.append(sum(os.path.getsize(os.path.join(at, f)) for at, _, files in os.walk(out._scratch.removeprefix("file:")) for f in files))
        return out

    monkeypatch.setattr(embed_dedup, "cut", size)
    x = np.random.default_rng(6).standard_normal((20_000, 64)).astype(np.float32)
    df = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(x))), "embedding": pa.array(list(x))}))
    assert embed_dedup.near_duplicate_vectors(df).where("n_links = 0 and kept").count() == len(x)
    assert x.nbytes < sum(written) < 3 * x.nbytes
