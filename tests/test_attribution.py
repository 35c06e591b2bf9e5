"""The attribution queries over more rows than they report on: results, and what they write."""

import glob
import random

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from loomwright.operators import postings, scoring
from loomwright.plans.registry import ORACLES, QUERIES

DOCS, PASSAGES = 3000, 10
STREAMED = ["cumulative_hits", "prec_at_k_exact", "seed_aggregate", "lift_at_k", "norm_summary", "per_source_delta", "pooled_sources", "wilcoxon_statistic", "delta_summary", "verdict", "ratio_base_dx", "raw_score_moments", "topk_contrast", "topk_bad", "topk_good"]
MEDIANS = ("norm_summary", "delta_summary")


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    """Each document shares a word with each passage, so all pairs score; every 200th document holds a passage whole."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    items = [" ".join(["common", *rng.choices(words, k=12)]) for _ in range(PASSAGES)]
    docs = [" ".join(["common", *rng.choices(words, k=rng.randint(0, 30)), *([items[i // 200 % PASSAGES]] if i % 200 == 0 else [])]) for i in range(DOCS)]
    d = tmp_path_factory.mktemp("corpus")
    pq.write_table(pa.table({"doc_id": range(DOCS), "text": docs, "lang": ["en"] * DOCS, "source": ["s"] * DOCS, "n_chars": [len(x) for x in docs]}), d / "documents.parquet")
    pq.write_table(pa.table({"item_id": range(PASSAGES), "text": items}), d / "benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return str(d), con


def written(spark):
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{root}/*/*.parquet"))


@pytest.mark.parametrize("name", STREAMED)
def test_contrasts_of_all_rows_are_not_written(spark, corpus, name):
    """Their table has 30,000 rows. Those of the 1015 rows that statistics are taken of, and a row for each text, are within 24,000;
    medians write the different values twice."""
    d, con = corpus
    before = written(spark)
    assert_same(QUERIES[name](spark, d), con, ORACLES[name])
    assert written(spark) - before <= (36_000 if name in MEDIANS else 24_000)


@pytest.mark.parametrize("held", [500_000, 0])
def test_first_rows_and_contrasts_by_loops(spark, monkeypatch, held):
    """Rows that score 0 rank among the others; slices of one row; texts and queries without tokens; more than k and fewer; with held 0 terms meet by shuffle."""
    monkeypatch.setattr(postings, "HELD_TERMS", held)
    monkeypatch.setattr(scoring, "SCORES", 4)
    texts = ["the cat sat", None, "the dog", "cat cat dog mouse", "", "x y", "the cat sat", "mouse of the house"]
    train = spark.createDataFrame(list(enumerate(texts)), "train_idx long, text string").repartition(3)
    queries = spark.createDataFrame([(0, "cat the cat"), (1, ""), (2, "zebra"), (3, "dog mouse")], "query_idx long, text string")
    pairs = spark.createDataFrame([(0, 0, 3), (1, 3, 0), (2, 2, 1), (3, 0, 1), (4, 9, 3)], "pair_idx long, good_idx long, bad_idx long")
    s = np.zeros((8, 10))
    for r in scoring.bm25_shuffled(train, queries).collect():
        s[r.train_idx, r.query_idx] = r.score
    sides = [s[:, [0, 3, 2, 0, 9]], s[:, [3, 0, 1, 1, 3]]]
    want = [*sides, np.round(sides[0] - sides[1], 6)]
    for side, at, sign in (("contrast", 2, -1), ("good", 0, -1), ("bad", 1, 1)):
        for k in (3, 20):
            got = {(r.pair_idx, r["rank"]): (r.train_idx, r.score_good, r.score_bad, r.delta_i) for r in postings.first_rows(train, queries, pairs, k, side).collect()}
            order = {p: np.lexsort((np.arange(8), sign * want[at][:, p]))[:k] for p in range(5)}
            assert got == {(p, j): (i, *(w[i, p] for w in want)) for p, o in order.items() for j, i in enumerate(o)}
    rows = train.where(F.col("train_idx").isin(0, 1, 3)).select("train_idx")
    for some, ids in ((None, range(8)), (rows, (0, 1, 3))):
        for dense in (False, True):
            got = {(r.train_idx, r.pair_idx): (r.score_good, r.score_bad, r.delta_i) for r in postings.contrasts(train, queries, pairs, some, dense).collect()}
            assert got == {(i, p): tuple(w[i, p] for w in want) for i in ids for p in range(5) if dense or want[0][i, p] or want[1][i, p]}
