import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.functions import categories
from loomwright.operators import report
from loomwright.plans import run
from loomwright.plans.config import Attribution, Data, Experiment
from loomwright.sources import sinks, tables

SENT = "1\t{0}\tx\tX\t_\t_\t0\troot\t_\t_\n2\tb\tb\tX\t_\t_\t1\tdep\t_\t_\n"


def test_chunk_corpus_and_report(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = "# newdoc id = d1\n# meta::collection = Harbour Log\n# meta::date = 1907-11-23\n# meta::creator = A\n" + "\n".join(SENT.format(w) for w in ("a", "a", "c")) + "\n# newdoc id = d2\n# meta::collection = Almanac\n" + SENT.format("d")
    (tmp_path / "in" / "x.conllu").write_text(text)
    doc = run.chunk_corpus(spark, str(tmp_path / "in"), str(tmp_path / "out"), 2, None)
    assert doc["sentences"] == 3 and doc["tokens"] == 6 and len(doc["chunks"]) == 3
    assert run.chunk_corpus(spark, str(tmp_path / "in"), str(tmp_path / "out"), 2, None) == doc  # up to date
    files = lambda name: {p.parent.name: p.read_text() for p in (tmp_path / name).glob("chunk_id=*/part-*")}
    for target in (1, 3, None):  # a run that stops, and goes on, and goes on
        again = run.chunk_corpus(spark, str(tmp_path / "in"), str(tmp_path / "resumed"), 2, target)
    assert again["chunks"] == doc["chunks"] and files("resumed") == files("out") and len(files("out")) == 3
    found = run.corpus_report(spark, str(tmp_path / "in"), str(tmp_path / "report.json"))
    assert found["fields"]["collection"] == {"n_unique": 2, "total": 2}
    values = spark.read.parquet(str(tmp_path / "report.values")).where("field = 'collection'").collect()
    assert {(r.value, r.n) for r in values} == {("Harbour Log", 1), ("Almanac", 1)} and found["corpus_totals"]["documents"] == 2
    assert found["corpus_totals"]["sentences"] == 4 and found["year"] == {"1907": 1} and found["creator"]["total"] == 1


@pytest.mark.parametrize("method", ["bm25", "vanilla", "trackstar", "kfac", "ekfac", "kfac_fused"])
def test_attribute_and_analyze(spark, tmp_path, method):
    rng = np.random.default_rng(1)
    words = ["red", "green", "blue", "fox", "owl"]
    train = [(i, " ".join(rng.choice(words, 4)), rng.standard_normal(4).tolist(), "X" if i % 4 == 0 else "base") for i in range(24)]
    pairs = [(j, words[j], words[j + 1], rng.standard_normal(4).tolist(), rng.standard_normal(4).tolist()) for j in range(3)]
    exp = Experiment(f"file://{tmp_path}", "t", attribution=Attribution(method=method, k_precisions=(2, 5), inspect_top_k=3, stats_base_size=10), seeds=(1, 2))
    t = spark.createDataFrame(train, "train_idx long, text string, vec array<double>, category string")
    p = spark.createDataFrame(pairs, "pair_idx long, text_good string, text_bad string, vec_good array<double>, vec_bad array<double>")
    labels = spark.createDataFrame([(0, True, False), (1, True, True), (2, True, True)], "pair_idx long, full boolean, no_x boolean")
    for seed in exp.seeds:
        run.attribute(spark, exp, seed, t, p, labels)
    assert spark.read.parquet(exp.output(1, "top_inspect_bad", "learned_specific")).count() == 3
    assert sinks.read_json_text(spark, exp.output(1, "prec_at_k", "not_learned") + ".json") is None
    doc = run.analyze(spark, exp)
    assert set(doc["precision"]) == {"modes", "2", "5"} and doc["verdict"] in ("PASS", "PARTIAL", "FAIL")
    assert [(s["seed"], s["part"], s["n"]) for s in doc["seeds"]] == [(1, "base", 30), (1, "dx", 18), (2, "base", 30), (2, "dx", 18)]


def test_categories(spark):
    rows = spark.createDataFrame(
        [(True, ["obj_occur", "cooccur"], ""), (True, [], ""), (False, [], "Paris and France"), (False, [], "Parisian France"), (False, [], "PARIS"), (None, None, "none")], "c boolean, s array<string>, t string"
    )
    s, o = F.lit("Paris"), F.lit("France")
    got = [r[0] for r in rows.select(categories.fact_category(F.col("c"), F.col("s"), F.col("t"), s, o)).collect()]
    assert got == ["cooccur", "X", "X-not-filtered", "obj_not_filtered", "subj_not_filtered", "base"]
    post = [r[0] for r in rows.select(categories.posthoc_source(F.col("t"), s, o, F.coalesce("c", F.lit(False)), whole_words=False)).collect()]
    assert post == ["X", "X", "cooccur_not_filtered", "cooccur_not_filtered", "subj_occur_not_filtered", "base"]
    more = spark.createDataFrame([(["subj_occur"],), (["occur"],)], "s array<string>").select(categories.expand_sources(F.col("s")).alias("e"), categories.legacy_sources(F.col("s")).alias("l")).collect()
    assert set(more[0].e) == {"subj_occur", "occur", "all_x", "all_filtered"} and more[1].l == ["subj_occur"]


def test_reports(spark, tmp_path):
    a = spark.createDataFrame([(i, j, float(i * j), 0.0, float((i * 7 + j) % 5)) for i in range(6) for j in range(2)], "train_idx long, pair_idx long, score_good double, score_bad double, delta_i double")
    report.method_comparison({"a": a, "b": a.withColumn("delta_i", -F.col("delta_i"))}, (2,), f"file://{tmp_path}/cmp")
    rows = spark.read.option("header", True).csv(f"file://{tmp_path}/cmp/per_pair_correlations").collect()
    assert {float(r.pearson) for r in rows} == {-1.0} and report.pool_size("base_10", 100, 3) == 13 and report.pool_size("full_corpus", 100, 3) == 100
    (tmp_path / "chunk_1").mkdir()
    (tmp_path / "chunk_1" / "f.txt").write_text(" a \nb\n")
    lines, missing = tables.concat_chunks(spark, str(tmp_path), ["1", "2"], "f.txt")
    assert [r.text for r in lines.collect()] == [" a ", "b"] and missing == ["2"] and tables.raw_lines(spark, str(tmp_path / "none")).count() == 0


def test_settings(spark, tmp_path):
    base = spark.createDataFrame([(i, f"b{i}") for i in range(10)], "key long, text string")
    x = spark.createDataFrame([(100 + i, f"x{i}") for i in range(4)], "key long, text string")
    table = lambda **d: run.training_table(Experiment("/x", "t", data=Data(**d)), base, x, "key", 1).orderBy("train_idx").collect()
    rows = table(mixing_strategy="start", shuffle_within_blocks=False, max_samples_x=2)
    assert [r.train_idx for r in rows] == list(range(12)) and [r.category for r in rows[:2]] == ["X", "X"] and [r.key for r in rows[2:]] == list(range(10))
    rows = table(mixing_strategy="end", oversample_x=True)
    assert len(rows) == 20 and [r.category for r in rows] == ["base"] * 10 + ["X"] * 10 and [r.key for r in rows[:10]] != list(range(10))
    assert sorted(r.text for r in table(mixing_strategy="full_shuffle")) == sorted([f"b{i}" for i in range(10)] + [f"x{i}" for i in range(4)])
    rng = np.random.default_rng(2)
    t = spark.createDataFrame([(i, rng.standard_normal(4).tolist(), "X" if i < 3 else "base") for i in range(20)], "train_idx long, vec array<double>, category string")
    p = spark.createDataFrame([(j, f"g{j}", f"b{j}", rng.standard_normal(4).tolist(), rng.standard_normal(4).tolist(), f"f{j % 2}", ["Forgotten", "not_learned"][j % 2]) for j in range(4)], "pair_idx long, text_good string, text_bad string, vec_good array<double>, vec_bad array<double>, fact_key string, verdict string")
    p.select("pair_idx", "text_good", "text_bad", (F.col("pair_idx") < 3).alias("learned_x")).write.parquet(f"{tmp_path}/full")
    p.select("pair_idx", "text_good", "text_bad", (F.col("pair_idx") < 1).alias("learned_x")).write.parquet(f"{tmp_path}/no_x")
    exp = lambda name, data=None, **a: Experiment(f"file://{tmp_path}", name, data=data or Data(), attribution=Attribution(k_precisions=(2,), inspect_top_k=3, stats_base_size=5, **a))
    e = exp("labels", full_pairs=f"{tmp_path}/full", no_x_pairs=f"{tmp_path}/no_x", scoring_base_size=6)
    run.attribute(spark, e, 1, t, p)
    assert {r.pair_idx for r in spark.read.parquet(e.output(1, "top_inspect_good", "learned_specific")).collect()} == {1, 2}
    lookup = spark.read.parquet(f"{e.method_dir(1)}/train_lookup")
    assert lookup.count() == 9 and lookup.where("category = 'X'").count() == 3
    e = exp("facts", Data(experiment_type="facts"))
    run.attribute(spark, e, 1, t, p)
    assert {r.pair_idx for r in spark.read.parquet(e.output(1, "top_inspect_good", "learned")).collect()} == {0, 2}
    e = exp("global", aggregate_query=True)
    run.attribute(spark, e, 1, t, p)
    assert {r.pair_idx for r in spark.read.parquet(e.output(1, "delta_i_stats")).collect()} == {0}
