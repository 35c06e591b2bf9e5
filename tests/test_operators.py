import glob
import itertools
import math
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loomwright.functions import metrics, text
from loomwright.operators import chunks, cooccur, facts, probe, rank, sampling, scoring, stats, views
from loomwright.plans.config import Attribution, Experiment
from loomwright.plans.registry import QUERIES
from loomwright.streaming import incremental


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


def test_text_functions(spark):
    lit = F.lit
    r = one(
        spark, a=text.bare_form(lit("the United Kingdom")), b=text.bare_form(lit("The Beatles")), c=text.bare_form(lit("a US")), d=text.slug(lit("São-Paulo x!")),
        e=text.year(lit("in 1899-04")), f=text.year(lit("sometime")), g=text.is_function_word(lit(" In ")), h=text.fill_template(lit("[X] is [Y]"), lit("a"), lit("b")),
        i=text.word_bounded(lit("St. Louis, MO"), lit("Louis")), j=text.word_bounded(lit("Louisiana"), lit("Louis")), k=text.word_bounded(lit("a.b"), lit("a.b")), l=text.word_bounded(lit("axb"), lit("a.b")),
        m=text.surface_forms(lit("The Who Band"), F.array(lit("in"), lit("Who"), lit("Who"))), n=text.clean_sentence(lit("== heading that is long ==")), o=text.clean_sentence(lit("a  sentence of some   length")),
        p=text.word_bounded(lit("naïveté"), lit("na")),
    )
    assert (r.a, r.b, r.c, r.d) == ("United Kingdom", None, "US", "so_paulo_x")
    assert (r.e, r.f, r.g, r.h) == ("1899", None, True, "a is b")
    assert (r.i, r.j, r.k, r.l, r.p) == (True, False, True, False, False)
    assert r.m == ["The Who Band", "Who", "Who Band"] and r.n is None and r.o == "a sentence of some length"


def test_divergence(spark):
    rows = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "c"]), (["a"], ["a", "b"]), ([], ["a"]), (["a", "b"], ["a", "b"])], "a array<string>, b array<string>")
    k = text.divergence_point(F.col("a"), F.col("b"))
    assert [tuple(r) for r in rows.select(k, text.reconvergence(F.col("a"), F.col("b"), k)).collect()] == [(1, 2), (1, None), (0, None), (2, None)]


def test_candidate_metrics(spark):
    rows = spark.createDataFrame([([[-1.0], [-2.0], [-1.0]], 2), ([[-1.0]], 0)], "pll array<array<double>>, gold int")
    a, b = probe.fact_metrics(rows, "pll", "gold").collect()
    assert (a.predicted, a.is_correct, a.rank_correct, a.best_other, a.margin) == (0, False, 1, 0, 0.0)
    assert math.isinf(b.margin) and b.best_other is None and b.entropy_norm == 0.0 and b.is_correct


def test_pair_metrics(spark):
    r = one(spark, p=metrics.softmax_pair(F.lit(1.0), F.lit(1.0)), learned=metrics.softmax_pair(F.lit(1.0), F.lit(1.0)) > 0.5, h=metrics.binary_entropy(F.lit(0.0), F.lit(0.0)), n=metrics.binary_entropy(F.lit(float("nan")), F.lit(0.0)), z=metrics.l2_normalize(F.array(F.lit(0.0), F.lit(0.0))))
    assert r.p == 0.5 and not r.learned and abs(r.h - math.log(2)) < 1e-12 and r.n is None and r.z == [0.0, 0.0]


def test_pair_probe(spark):
    schema = "tokens_good array<string>, tokens_bad array<string>, scores_good array<double>, scores_bad array<double>"
    rows = spark.createDataFrame(
        [(["a", "b", "c"], ["a", "x", "c"], [-1.0, -1.0, -3.0], [-1.0, -2.0, -2.0]), (["a"], ["a"], [-1.0], [-1.0]), (["a"], ["a", "b"], [-1.0], [-1.0, -1.0])], schema
    )
    a, b, c = probe.pair_probe(rows).collect()
    assert (a.full_sentence_correct, a.one_prefix_correct, a.two_prefix_correct, a.learned_x) == (False, True, False, False)
    assert b.full_sentence_correct is False and b.one_prefix_correct is None and b.two_prefix_correct is None and b.softmax_prob_good == 0.5
    assert c.full_sentence_correct and c.length_norm_correct is False and c.one_prefix_correct is None


def test_chunk_packing_is_greedy(spark):
    rng = random.Random(3)
    sizes = [rng.randint(1, 30) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(sizes)), "i int, n long").repartition(7)
    want, total, chunk = [], 0, 0
    for s in sizes:
        want.append(chunk)
        total += s
        if total >= 100:
            chunk, total = chunk + 1, 0
    assert [r.chunk_id for r in chunks.pack_chunks(df, "n", ["i"], 100).orderBy("i").collect()] == want
    stopped = chunks.pack_chunks(df, "n", ["i"], 100, target=350)
    ids = {r.chunk_id for r in stopped.collect()}
    totals = chunks.chunk_totals(stopped, "n")
    assert ids == set(range(len(ids))) and totals.agg(F.sum("n_tokens")).first()[0] >= 350
    with pytest.raises(ValueError):
        chunks.chunk_prefix(totals, 10**9)


def test_support_counts_and_case(spark):
    lines = spark.createDataFrame([(1, "The US and us met St. Louis"), (2, "us only"), (3, "st louis")], "line int, text string")
    inst = spark.createDataFrame([(0, "US", "St. Louis")], "instance_idx int, subject string, correct_object string")
    r = cooccur.count_support(lines, cooccur.surface_terms(inst), ["line"], "text").first()
    assert (r.subject, r.object, r.cooccur) == (1, 2, 1)
    assert cooccur.support_filter(inst, None, ["instance_idx"]).count() == 1
    none = spark.createDataFrame([], "instance_idx int, subject long, object long, cooccur long")
    assert cooccur.support_filter(inst, none, ["instance_idx"]).count() == 0


def test_quotas():
    assert sampling.quotas_stratified(10, 2, 5, 10) == {"learned": 8, "not_learned": 2, "unknown": 0}
    assert sampling.quotas_stratified(1, 2, 5, 10) == {"learned": 1, "not_learned": 2, "unknown": 5}
    assert sampling.quotas_cascade(50, 5, 100, 100) == {"retained": 30, "not_learned": 5, "learned_specific": 65}
    assert sampling.budget(5, 5, 5) == (2, 3) and sampling.budget(5, 5, -1) == (5, 5)


def test_mixing_keeps_base_order(spark):
    base, x = spark.range(0, 20).toDF("i"), spark.range(100, 107).toDF("i")
    for place in ("start", "end", "middle", "full_shuffle"):
        rows = [r.i for r in sampling.mix(base, x, "i", place, 1).orderBy("slot", "kind", "pos").collect()]
        assert [i for i in rows if i < 100] == list(range(20)) and len(rows) == 27
        if place == "middle":
            assert rows[10:17] == list(range(100, 107))
    assert [r.i for r in sampling.oversample(x, "i", 10).orderBy("round", "pos").collect()] == [*range(100, 107), 100, 101, 102]


def test_bm25_against_loops(spark):
    docs = ["the cat sat", "the dog", "cat cat dog mouse", ""]
    train = spark.createDataFrame(list(enumerate(docs)), "train_idx long, text string")
    queries = spark.createDataFrame([(0, "cat the cat"), (1, ""), (2, "zebra")], "query_idx long, text string")
    toks = [d.split() for d in docs]
    avg = sum(map(len, toks)) / len(toks)
    want = {}
    for q, words in ((0, ["cat", "the", "cat"]),):
        for n, t in enumerate(toks):
            s = 0.0
            for w in words:
                df = sum(w in x for x in toks)
                s += math.log(1 + (4 - df + 0.5) / (df + 0.5)) * t.count(w) / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / avg))
            if s:
                want[n, q] = round(s, 6)
    assert {(r.train_idx, r.query_idx): r.score for r in scoring.bm25(train, queries).collect()} == want


def dense_rows(spark, n=12, m=3, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, j, float(rng.integers(0, 3)), float(rng.integers(0, 3))) for i in range(n) for j in range(m)]
    return [(i, j, g, b, g - b) for i, j, g, b in rows]


def test_top_k_with_zero_rows_left_out(spark):
    rows = dense_rows(spark)
    sparse = spark.createDataFrame([r for r in rows if r[2] or r[3]], "train_idx long, pair_idx long, score_good double, score_bad double, delta_i double")
    train, pairs = spark.range(12).toDF("train_idx"), spark.range(3).toDF("pair_idx")
    for side, key in (("contrast", lambda r: (-r[4], r[0])), ("good", lambda r: (-r[2], r[0])), ("bad", lambda r: (r[3], r[0]))):
        got = {(r.pair_idx, r["rank"]): r.train_idx for r in rank.top_k_padded(sparse, train, pairs, 5, side, head=2).collect()}
        want = {(j, k): r[0] for j in range(3) for k, r in enumerate(sorted((r for r in rows if r[1] == j), key=key)[:5])}
        assert got == want


def test_precision_and_antisymmetry(spark):
    schema = "train_idx long, pair_idx long, score_good double, score_bad double, delta_i double"
    df = spark.createDataFrame(dense_rows(spark, 4, 2), schema).withColumn("x", F.col("train_idx") % 2 == 0)
    per = rank.precision_at(rank.top_k(df, 10), "x", (2, 10), 4)
    assert all(0 <= r.prec <= 1 for r in per.collect()) and {r.prec for r in per.where("k = 10").collect()} == {0.5}
    cum = rank.cumulative_hits(rank.top_k(df, 4), "x").orderBy("pair_idx", "rank").collect()
    assert all(a.cum_hits <= b.cum_hits for a, b in itertools.pairwise(cum) if a.pair_idx == b.pair_idx)
    scores = spark.createDataFrame([(0, 0, 2.0), (0, 1, 0.5), (1, 1, 1.0)], "train_idx long, query_idx long, score double")
    a = spark.createDataFrame([(0, 0, 1)], "pair_idx long, good_idx long, bad_idx long")
    b = spark.createDataFrame([(0, 1, 0)], "pair_idx long, good_idx long, bad_idx long")
    left = {r.train_idx: r.delta_i for r in scoring.contrast(scores, a).collect()}
    assert left == {r.train_idx: -r.delta_i for r in scoring.contrast(scores, b).collect()} == {0: 1.5, 1: -1.0}


def test_vector_methods(spark):
    rng = np.random.default_rng(5)
    x, q = rng.standard_normal((30, 6)), rng.standard_normal((3, 6))
    x[0] = 0
    train = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "train_idx long, vec array<double>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_idx long, vec array<double>")
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    got = {(r.train_idx, r.query_idx): r.score for r in scoring.vector_scores(train, queries, block=2).collect()}
    want = unit(x) @ unit(q).T
    assert all(abs(got[i, j] - want[i, j]) < 1e-6 for i in range(30) for j in range(3)) and got[0, 0] == 0
    assert np.allclose(scoring.second_moment(train, 6), x.T @ x / 30)
    m = scoring.inverse_root(np.diag([4.0, 1.0]), damp=0.0)
    assert np.allclose(m, np.diag([0.5, 1.0]))
    assert scoring.kfac_transform(train, 2, 3).shape == (6, 6)


def test_signed_rank():
    for n in (5, 8):
        for w in (0, 7, n * (n + 1) // 2):
            brute = sum(sum(r + 1 for r in range(n) if s >> r & 1) >= w for s in range(2**n)) / 2**n
            assert stats.signed_rank_p(w, n) == brute
    assert abs(stats.signed_rank_p(60 * 61 / 4, 60) - 0.5) < 1e-9 and math.isnan(stats.signed_rank_p(0, 0))


def test_moments_and_ranks(spark):
    v = [1.0, 2.0, 2.0, 5.0]
    df = spark.createDataFrame([(i % 2, x) for i, x in enumerate(v)], "g int, v double")
    parts = df.groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("v")).alias("m2"))
    r = stats.combine_moments(parts).first()
    assert r.n == 4 and abs(r.mean - 2.5) < 1e-12 and abs(r.m2 - np.var(v) * 4) < 1e-9
    assert [r.k for r in stats.average_rank(df.withColumn("a", F.lit(1)), "v", "k", ["a"]).orderBy("v").collect()] == [1.0, 2.5, 2.5, 4.0]


def test_views_are_consistent(spark):
    df = spark.createDataFrame([(i, bool(i & 1), bool(i & 2)) for i in range(8)], "pair_idx int, f boolean, n boolean")
    v = {}
    for r in views.split_views(df, "f", "n").collect():
        v.setdefault(r.view, set()).add(r.pair_idx)
    assert v["learned"] | v["not_learned"] == set(range(8)) and not v["learned"] & v["not_learned"]
    assert v["learned_specific"] | v["learned_confounded"] == v["learned"] and not v["learned_specific"] & v["learned_confounded"]


def test_verdict_order(spark):
    rows = spark.createDataFrame([(None, True), (False, True), (True, False), (True, True)], "f boolean, n boolean")
    assert [r[0] for r in rows.select(metrics.fact_verdict(F.col("f"), F.col("n"))).collect()] == ["unknown", "not_learned", "Forgotten", "Retained"]
    both = facts.merge_sources(spark.createDataFrame([("t", "b", "x"), ("t", "a", "x")], "text string, fact_id string, source string")).first()
    assert both.fact_ids == ["a", "b"] and both.sources == ["x"]


def test_streams(spark, tmp_path):
    schema = "key string, pair_idx long, train_idx long, delta_i double"
    for n in range(2):
        spark.createDataFrame([("a", 0, 2 * n, float(n)), ("b", 0, 2 * n + 1, -float(n))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new
        got = incremental.dedup_ordered(read(), "key", ["train_idx"], str(tmp_path / "s1"), str(tmp_path / "c1"))
        assert sorted((r.key, r.train_idx) for r in got.collect()) == [("a", 0), ("b", 1)]
        rows = read().withColumn("score_good", F.col("delta_i")).withColumn("score_bad", F.col("delta_i"))
        top = incremental.top_k_sides(rows, 2, "pair_idx", str(tmp_path / "s2"), str(tmp_path / "c2")).collect()
        assert sorted((r.side, r.rank, r.train_idx) for r in top) == [("bad", 0, 3), ("bad", 1, 0), ("contrast", 0, 2), ("contrast", 1, 0), ("good", 0, 2), ("good", 1, 0)]


def test_large_samples_are_the_small_ones(spark, monkeypatch):
    rows = spark.range(3000).withColumnRenamed("id", "k")
    for n in (0, 1, 700, 2999, 3000, 4000):
        want = sorted(r.k for r in sampling.sample_n(rows, n, 4, "k").collect())
        monkeypatch.setattr(sampling, "ONE_TASK", -1)
        assert sorted(r.k for r in sampling.sample_n(rows, n, 4, "k").collect()) == want and len(want) == min(n, 3000)
        monkeypatch.undo()


def test_transforms_by_numpy(spark):
    """Preconditioners and sketches against their definitions on 2 x 3 gradients."""
    rng = np.random.default_rng(4)
    g, q = rng.standard_normal((50, 6)) * [1, 2, 3, 1, 1, 5], rng.standard_normal((8, 6))
    train, queries = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{n} long, vec array<double>") for x, n in ((g, "train_idx"), (q, "query_idx")))
    m, mats = g.T @ g / 50, g.reshape(50, 2, 3)
    left, right = np.einsum("nic,njc->ij", mats, mats) / 150, np.einsum("nri,nrj->ij", mats, mats) / 100

    def root(a, damp=0.1):
        w, v = np.linalg.eigh(a)
        return v @ np.diag((w + damp * w.mean()) ** -0.5) @ v.T

    r = scoring.random_projection(6, 4, 3)
    mixed = 0.5 * m + 0.5 * q.T @ q / 8
    assert np.allclose(scoring.trackstar_transform(train, queries, 6, projection=4, seed=3), r @ root(r.T @ mixed @ r))
    assert np.allclose(scoring.kfac_transform(train, 2, 3), np.kron(root(left), root(right)))
    assert np.allclose(scoring.kfac_transform(train, 2, 3, projection=4, seed=3), np.kron(root(left), root(right)) @ r)
    fused = scoring.fused_transform(train, 2, 3, 1, seed=5)
    assert np.allclose(fused, np.kron(root(left) @ scoring.random_projection(2, 1, 5), root(right) @ scoring.random_projection(3, 1, 6))) and fused.shape == (6, 1)
    basis = np.kron(np.linalg.eigh(left)[1], np.linalg.eigh(right)[1])
    own = ((g @ basis) ** 2).mean(axis=0)
    assert np.allclose(scoring.ekfac_transform(train, 2, 3), basis @ np.diag((own + 0.1 * own.mean()) ** -0.5) @ basis.T)
    with pytest.raises(ValueError):
        scoring.fused_transform(train, 2, 3, 0)
    t = scoring.ekfac_transform(train, 2, 3, projection=4)
    x, y = g @ t, q @ t
    want = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
    for s in scoring.vector_scores(train, queries, transform=t).collect():
        assert abs(s.score - want[s.train_idx, s.query_idx]) < 1e-6


def test_config():
    e = Experiment("/x", "demo", attribution=Attribution(method="bm25"))
    assert e.output(42, "prec_at_k", "learned").endswith("/prec_at_k_learned") and e.method_dir(42) != Experiment("/x", "demo").method_dir(42)
    with pytest.raises(ValueError):
        e.output(42, "prec_at_k", "x")
    with pytest.raises(ValueError):
        Attribution(method="x")


def vector_case(spark, n=90, m=7, dim=6, seed=8):
    """Training rows and pairs with vectors whose products tie, and the contrasts of both methods by numpy."""
    rng = np.random.default_rng(seed)
    x, g, b = (np.round(rng.standard_normal((k, dim)), 1) + 0.05 for k in (n, m, m))
    x[n // 2 :] = x[: n - n // 2]  # each row twice
    train = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "train_idx long, vec array<double>")
    pairs = spark.createDataFrame([(i, u.tolist(), v.tolist()) for i, (u, v) in enumerate(zip(g, b, strict=True))], "pair_idx long, vec_good array<double>, vec_bad array<double>")
    scores = [[np.round(f(x) @ f(s).T, 6) for s in (g, b)] for f in (scoring.unit_vectors, scoring.sign_vectors)]
    return train, pairs, [(*s, np.round(s[0] - s[1], 6)) for s in scores]


def test_streamed_first_rows_by_numpy(spark):
    """Of many blocks and parts, with ties within and across them, and of fewer rows than k."""
    train, pairs, (scores, _) = vector_case(spark)
    for side, at, sign in (("contrast", 2, -1), ("good", 0, -1), ("bad", 1, 1)):
        for k in (5, 200):
            got = {(r.pair_idx, r["rank"]): (r.train_idx, r.delta_i) for r in scoring.stream_top_k(train, pairs, k, side, block=2, part=20).collect()}
            order = {p: np.lexsort((np.arange(90), sign * scores[at][:, p]))[:k] for p in range(7)}
            assert got == {(p, j): (i, scores[2][i, p]) for p, o in order.items() for j, i in enumerate(o)}


def table_rows(spark):
    """Rows of each table in the shared folder."""
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return {p: sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{p}/*.parquet")) for p in glob.glob(f"{root}/*")}


@pytest.mark.parametrize("name", ["jaccard_topk", "di_distribution", "gradsim_prec_at_k", "spearman_pearson"])
def test_no_contrast_matrix_is_written(spark, sf_dir, name):
    """Of 500 vectors and 25 pairs the matrix has 12,500 rows."""
    before = table_rows(spark)
    assert QUERIES[name](spark, sf_dir).count() > 0
    assert sum(table_rows(spark).values()) - sum(before.values()) <= 4 * 500


def test_streamed_means_by_numpy(spark):
    train, pairs, (scores, _) = vector_case(spark)
    got = {r.train_idx: r.v for r in scoring.stream_means(train, pairs, block=2, part=20).collect()}
    assert len(got) == 90 and all(abs(got[i] - v) < 1e-9 for i, v in enumerate(scores[2].mean(axis=1)))


def test_streamed_correlations_by_ranks(spark, monkeypatch):
    """Against ranks with shared ties; groups of one to all pairs, packs of one row to all; a pair of equal sides has no correlation."""
    train, pairs, both = vector_case(spark)
    same = pairs.where("pair_idx = 0").selectExpr("7L as pair_idx", "vec_good", "vec_good as vec_bad")
    ranks = lambda v: np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])
    for columns, pack in ((1 << 24, 1 << 16), (200, 1000), (1, 1)):
        monkeypatch.setattr(scoring, "COLUMNS", columns)
        monkeypatch.setattr(scoring, "PACK", pack)
        got = {r.pair_idx: (r.pearson, r.spearman) for r in scoring.stream_correlations(train, pairs.unionByName(same)).collect()}
        assert len(got) == 8 and all(math.isnan(v) for v in got.pop(7))
        for p, found in got.items():
            a, b = (s[2][:, p] for s in both)
            assert np.allclose(found, (np.corrcoef(a, b)[0, 1], np.corrcoef(ranks(a), ranks(b))[0, 1]), atol=1e-6)


def test_rows_meet_all_queries_at_once(spark):
    """2500 queries are held by one task, so rows are handed out once; scores leave in slices of SCORES at most."""
    rng = np.random.default_rng(2)
    x, q = rng.standard_normal((600, 4)), rng.standard_normal((2500, 4))
    train, queries = (spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(v)], f"{n} long, vec array<double>") for v, n in ((x, "train_idx"), (q, "query_idx")))
    stream = scoring._meetings(train, queries.withColumnRenamed("query_idx", "id"), 4, None, 50_000)
    assert stream.where("not ask").count() == 600 and scoring._meetings(train, queries.withColumnRenamed("query_idx", "id"), 4, 1024, 50_000).where("not ask").count() == 1800
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    want = np.round(unit(x) @ unit(q).T, 6)
    for block in (None, 700):
        got = scoring.vector_scores(train, queries, block=block).toPandas()
        assert len(got) == 600 * 2500 and len(got.drop_duplicates(["train_idx", "query_idx"])) == len(got)
        assert np.abs(want[got["train_idx"], got["query_idx"]] - got["score"]).max() < 2e-6
    batches = stream.coalesce(1).sortWithinPartitions("block", "part", F.desc("ask")).toArrow().to_batches(max_chunksize=500)
    slices = [b.num_rows for b in scoring.scores_of(batches, True, None, 6)]
    assert sum(slices) == 600 * 2500 and max(slices) <= scoring.SCORES
