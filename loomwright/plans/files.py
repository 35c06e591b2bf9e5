"""Queries that write tables in the formats of the pipeline's inputs and outputs and read them back, and
the reports and steps made of such files."""

from __future__ import annotations

import io
import json
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import categories
from loomwright.operators import chunks, cooccur, facts, filters, probe, provenance, rank, report, sampling
from loomwright.plans import corpus, run
from loomwright.plans.registry import query, table
from loomwright.plans.runtime import scratch_root, spread
from loomwright.sources import arrays, conllu, sinks, tables
from loomwright.streaming import incremental


def place(spark, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def nations(spark, sf_dir) -> DataFrame:
    """25 rows at any scale."""
    return table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


# -- readers ----------------------------------------------------------------------------


@query("minimal_pair_files", """SELECT CAST(a.item_id AS VARCHAR) AS uid, a.text AS text_good, b.text AS text_bad, a.item_id % 2 = 0 AS one_prefix_method
FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 - a.item_id % 2 * 2""")
def minimal_pair_files(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    other = items.select((F.col("item_id") + 1 - F.col("item_id") % 2 * 2).alias("item_id"), F.col("text").alias("sentence_bad"))
    rows = items.withColumnRenamed("text", "sentence_good").join(other, "item_id")
    path = place(spark, "pairs")
    rows.select("sentence_good", "sentence_bad", F.col("item_id").cast("string").alias("UID"), (F.col("item_id") % 2 == 0).alias("one_prefix_method")).write.json(path)
    return tables.minimal_pairs(spark, path).select(F.col("UID").alias("uid"), "text_good", "text_bad", "one_prefix_method")


@query("manual_pair_files", """SELECT n_name AS text_good, r_name AS text_bad, CAST(n_nationkey AS VARCHAR) AS sent_id, 'x' AS lemma FROM nation JOIN region ON n_regionkey = r_regionkey""")
def manual_pair_files(spark, sf_dir):
    path = place(spark, "manual")
    texts = {"sen": "n_name", "wrong_sen": "r_name", "sent_id": "n_nationkey"}
    cols = [F.col(c).cast("string").alias(n) for n, c in texts.items()] + [F.lit(v).alias(n) for n, v in (("lemma", "x"), ("env", "e"), ("npi_to_neg_distance", "1"), ("sent_len", "2"), ("multiple_npis", "no"))]
    nations(spark, sf_dir).select(*cols).write.csv(path, sep="\t", header=True)
    return tables.manual_pairs(spark, path).select("text_good", "text_bad", "sent_id", "lemma")


@query("fact_files", """SELECT 'P' || n_regionkey AS relation, n_name AS subject, r_name AS correct_object, ['the ' || lower(n_name)] AS sub_aliases, n_regionkey AS answer_idx FROM nation JOIN region ON n_regionkey = r_regionkey""")
def fact_files(spark, sf_dir):
    path = place(spark, "facts")
    by_file: dict[str, list[str]] = {}
    for r in nations(spark, sf_dir).collect():
        doc = {"sub_id": f"Q{r.n_nationkey}", "sub_label": r.n_name, "sub_aliases": ["the " + r.n_name.lower()], "obj_id": f"Q1{r.r_regionkey}", "obj_label": "-", "answer_idx": r.n_regionkey}
        by_file.setdefault(f"P{r.n_regionkey}", []).append(json.dumps(doc))
    for name, docs in by_file.items():
        sinks.write_text(spark, f"{path}/{name}.jsonl", "\n".join(docs) + "\n")
    answers = table(spark, sf_dir, "region").select(F.concat(F.lit("P"), "r_regionkey").alias("relation"), F.col("r_regionkey").alias("answer_idx"), F.col("r_name").alias("answer"))
    return tables.fact_instances(spark, path, answers).select("relation", "subject", "correct_object", "sub_aliases", "answer_idx")


@query("alias_files", """SELECT r_name AS label, list_sort(list(n_name)) AS aliases FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def alias_files(spark, sf_dir):
    path = place(spark, "aliases") + ".json"
    found = nations(spark, sf_dir).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("a")).collect()
    sinks.write_json_text(spark, path, {r.r_name: r.a for r in found})
    return tables.alias_cache(spark, path)


COUNTS_SQL = """SELECT 'P' || n_regionkey AS relation, n_name AS subject, r_name AS correct_object, CAST(n_nationkey * 3 AS BIGINT) AS n_subject, CAST(n_regionkey * 3 AS BIGINT) AS n_object, CAST(n_nationkey % 2 * 3 AS BIGINT) AS n_cooccur
FROM nation JOIN region ON n_regionkey = r_regionkey"""


@query("corpus_count_files", COUNTS_SQL)
def corpus_count_files(spark, sf_dir):
    """Partial counts of three chunks, a document each, read and added up."""
    merged = None
    found = nations(spark, sf_dir).collect()
    for chunk in range(3):
        relations: dict = {}
        for r in found:
            one = {"subject": r.n_nationkey, "object": r.n_regionkey, "cooccur": r.n_nationkey % 2}
            relations.setdefault(f"P{r.n_regionkey}", {"instances": []})["instances"].append({"subject": r.n_name, "correct_object": r.r_name, "by_dataset": {"d": one}})
        path = place(spark, f"counts{chunk}") + ".json"
        sinks.write_json_text(spark, path, {"relations": relations})
        part = tables.corpus_counts(spark, path, "d")
        merged = part if merged is None else merged.unionByName(part)
    return cooccur.merge_counts(merged, ["relation", "subject", "correct_object"], ["n_subject", "n_object", "n_cooccur"])


@query("line_files", f"""WITH {corpus.LINES_SQL} SELECT lpad(CAST(doc_id % 4 AS VARCHAR), 2, '0') AS chunk, 'base' AS category, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM keyed GROUP BY 1""")
def line_files(spark, sf_dir):
    """Lines of four chunk folders, found by their names."""
    root = place(spark, "lines")
    docs = table(spark, sf_dir, "documents")
    for c in range(4):
        docs.where(F.pmod("doc_id", F.lit(4)) == c).select(F.explode(F.split("text", "\n")).alias("value")).write.text(f"{root}/chunk_{c:02d}")
    rows = None
    for c in tables.chunk_ids(spark, root):
        part = tables.lines(spark, f"{root}/chunk_{c}", "base")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("chunk", "category").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


@query("concat_chunks", """SELECT n_regionkey AS chunk, count(*) AS n_lines, string_agg(n_name, '|' ORDER BY n_name) AS names FROM nation GROUP BY 1""")
def concat_chunks(spark, sf_dir):
    """One file of each chunk folder; a line ends at line separators of any kind."""
    root = place(spark, "chunks")
    for r in nations(spark, sf_dir).groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), " ").alias("t")).collect():
        sinks.write_text(spark, f"{root}/chunk_{r.n_regionkey}/names.txt", r.t + "\n")
    rows, missing = tables.concat_chunks(spark, root, None, "names.txt")
    assert not missing
    return rows.groupBy(F.col("chunk").cast("int").alias("chunk")).agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(F.array_sort(F.collect_list("text")), "|").alias("names"))


@query("country_sidecar", """SELECT n_name AS text, CASE WHEN n_name < 'M' THEN 's' || (SELECT max(r_regionkey) FROM region) ELSE 's' || n_regionkey END AS slug FROM nation""")
def country_sidecar(spark, sf_dir):
    """Nations by region's file; those before M stand in every file, and the last one counts."""
    root, found = place(spark, "countries"), nations(spark, sf_dir).collect()
    for k in sorted({r.r_regionkey for r in found}):
        sinks.write_text(spark, f"{root}/matched/s{k}.txt", "".join(f" {r.n_name}\n" for r in found if r.n_regionkey == k or r.n_name < "M"))
    sinks.write_text(spark, f"{root}/countries.txt", "\n".join(f"s{r.n_regionkey}" for r in found))
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("text"))
    return tables.country_sidecar(spark, rows, f"{root}/matched", f"{root}/countries.txt", len(found))[0]


def write_scores(spark, sf_dir, pairs: int) -> str:
    """A score folder of the nations as training rows: bounded, written by the driver as other tools write it."""
    folder = place(spark, "scores")
    n = table(spark, sf_dir, "nation").count()
    names = [f"score_{c}" for c in range(max(1, 2 * pairs))]
    dtype = np.dtype({"names": names, "formats": ["<f4"] * len(names), "offsets": [4 + 4 * c for c in range(len(names))], "itemsize": 8 + 4 * len(names)})
    rows = np.zeros(n, dtype=dtype)
    for c, name in enumerate(names):
        rows[name] = np.arange(n) * (0.5 if c % 2 else 1.5) + c
    arrays.write_bytes(f"{folder}/scores.bin", rows.tobytes())
    d = {"names": names, "formats": ["<f4"] * len(names), "offsets": [int(dtype.fields[c][1]) for c in names], "itemsize": dtype.itemsize}
    arrays.write_bytes(f"{folder}/info.json", json.dumps({"num_items": n, "num_scores": len(names), "dtype": d}).encode())
    return folder


MATRIX_SQL = """SELECT CAST(n_nationkey AS BIGINT) AS train_idx, CAST(r_regionkey AS BIGINT) AS pair_idx, n_nationkey * 1.5 + 2 * r_regionkey AS score_good, n_nationkey * 0.5 + 2 * r_regionkey + 1 AS score_bad FROM nation, region"""


@query("score_matrix", f"SELECT train_idx, pair_idx, CAST(score_good AS DOUBLE) AS score_good, CAST(score_bad AS DOUBLE) AS score_bad FROM ({MATRIX_SQL})")
def score_matrix(spark, sf_dir):
    return arrays.score_matrix(spark, write_scores(spark, sf_dir, 5))


@query("stored_matrix_topk", f"""WITH m AS ({MATRIX_SQL}), d AS (SELECT train_idx, pair_idx, round(CAST(score_good - score_bad AS DOUBLE), 6) AS delta_i FROM m)
SELECT pair_idx, train_idx, delta_i, CAST(row_number() OVER (PARTITION BY pair_idx ORDER BY delta_i DESC, train_idx) - 1 AS INTEGER) AS rank FROM d QUALIFY rank < 5""")
def stored_matrix_topk(spark, sf_dir):
    """Contrasts of a stored score matrix, ranked."""
    rows = score_matrix(spark, sf_dir).withColumn("delta_i", F.round(F.col("score_good") - F.col("score_bad"), 6))
    return rank.top_k(rows, 5).select("pair_idx", "train_idx", "delta_i", "rank")


@query("single_score_file", "SELECT CAST(n_nationkey AS BIGINT) AS train_idx, CAST(n_nationkey * 1.5 AS DOUBLE) AS score FROM nation")
def single_score_file(spark, sf_dir):
    return arrays.single_score(spark, write_scores(spark, sf_dir, 0))


@query("contrast_arrays", """SELECT 'dx' AS part, CAST(r_regionkey AS BIGINT) AS pair_idx, CAST(n_nationkey AS BIGINT) AS row, CAST(r_regionkey * 100 + n_nationkey AS DOUBLE) AS delta_i FROM nation, region
UNION ALL SELECT 'base', CAST(a.r_regionkey AS BIGINT), CAST(b.r_regionkey AS BIGINT), CAST(-(a.r_regionkey * 100 + b.r_regionkey) AS DOUBLE) FROM region a, region b""")
def contrast_arrays(spark, sf_dir):
    """An npz file of contrast statistics, unpacked and read in ranges."""
    folder, packed = place(spark, "stats"), io.BytesIO()
    pairs = np.arange(table(spark, sf_dir, "region").count(), dtype=np.int64)
    rows = np.arange(table(spark, sf_dir, "nation").count(), dtype=np.int64)
    dx, base = (pairs[:, None] * 100 + r[None, :] for r in (rows, pairs))
    np.savez(packed, dx=dx.ravel().astype(np.float32), base=-base.ravel().astype(np.float32), n_pairs=np.int64(len(pairs)))
    arrays.write_bytes(f"{folder}/stats.npz", packed.getvalue())
    arrays.unpack(f"{folder}/stats.npz", f"{folder}/raw")
    return arrays.contrasts(spark, f"{folder}/raw")


# -- CoNLL-U and chunks -----------------------------------------------------------------


def write_conllu(spark, sf_dir) -> str:
    """The documents' lines as sentence blocks under their documents' headers, in order."""
    path = place(spark, "conllu")
    lines = corpus.document_lines(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    firsts = lines.groupBy("doc_id").agg(F.min("line_no").alias("_first"))
    tokens = F.transform(F.split("text", r"\s+"), lambda w, i: F.concat((i + 1).cast("string"), F.lit("\t"), w, F.lit("\t_\t_\t_\t_\t0\tdep\t_\t_")))
    head = F.when(F.col("line_no") == F.col("_first"), F.concat(F.lit("# newdoc id = "), F.col("doc_id").cast("string"), F.lit("\n# meta::lang = "), F.coalesce("lang", F.lit(""))))
    rows = lines.join(firsts, "doc_id").select("doc_id", "line_no", F.concat_ws("\n", head, F.array_join(tokens, "\n")).alias("value"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "line_no")
    rows.select("value").write.option("lineSep", "\n\n").option("compression", "gzip").text(path)
    return path


@query("conllu_files", f"""WITH {corpus.LINES_SQL} SELECT CAST(doc_id AS VARCHAR) AS newdoc_id, lang, count(*) AS n_sentences, CAST(sum(n_tokens) AS BIGINT) AS n_tokens FROM keyed JOIN documents USING (doc_id) GROUP BY 1, 2""")
def conllu_files(spark, sf_dir):
    """Blocks of gzip files with their documents' metadata; blocks without tokens go."""
    rows = conllu.read_conllu(spark, write_conllu(spark, sf_dir)).where(F.size("forms") > 0)
    rows = chunks.carry_header(rows, "header", ["block_no"], "input_index").withColumn("m", conllu.metadata("doc_header"))
    return rows.groupBy(F.col("m")["newdoc_id"].alias("newdoc_id"), F.col("m")["lang"].alias("lang")).agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.size("forms").cast("long")).alias("n_tokens"))


@query("chunked_corpus", corpus.CHUNK_SQL)
def chunked_corpus(spark, sf_dir):
    """Chunks of the files, by their manifest (a row for each chunk)."""
    document = run.chunk_corpus(spark, write_conllu(spark, sf_dir), place(spark, "chunked"), corpus.BUDGET, corpus.TARGET)
    rows = [(c["chunk_id"], c["n_tokens"], c["n_sentences"]) for c in document["chunks"]]
    return spark.createDataFrame(rows, "chunk_id int, n_tokens long, n_sentences long")


@query("resumed_chunks", corpus.CHUNK_SQL)
def resumed_chunks(spark, sf_dir):
    """The same in two runs: the first stops after a chunk, the second goes on from its state."""
    path, out = write_conllu(spark, sf_dir), place(spark, "resumed")
    run.chunk_corpus(spark, path, out, corpus.BUDGET, 1)
    document = run.chunk_corpus(spark, path, out, corpus.BUDGET, corpus.TARGET)
    blocks = spark.read.option("lineSep", "\n\n").text(out).where("value <> ''").groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n_sentences"))
    rows = spark.createDataFrame([(c["chunk_id"], c["n_tokens"]) for c in document["chunks"]], "chunk_id int, n_tokens long")
    return rows.join(blocks, "chunk_id").select("chunk_id", "n_tokens", "n_sentences")


# -- outputs ----------------------------------------------------------------------------


@query("lookup_tables", "SELECT n_nationkey AS train_idx, n_name AS text, CASE WHEN n_regionkey = 1 THEN 'X' ELSE 'base' END AS category FROM nation")
def lookup_tables(spark, sf_dir):
    path = place(spark, "lookup")
    category = F.when(F.col("n_regionkey") == 1, "X").otherwise("base").alias("category")
    sinks.write_table(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("train_idx"), F.col("n_name").alias("text"), category), path)
    return spark.read.parquet(path)


@query("fact_list_files", "SELECT n_name AS subject, r_name AS object, 'P' || n_regionkey AS rel_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def fact_list_files(spark, sf_dir):
    path = place(spark, "facts")
    sinks.write_fact_list(nations(spark, sf_dir).select(F.col("n_name").alias("subject"), F.col("r_name").alias("correct_object"), F.concat(F.lit("P"), "n_regionkey").alias("relation")), path)
    return spark.read.schema("subject string, object string, rel_id string").json(path)


SOURCE_SQL = """WITH r AS (SELECT p_size % 7 AS fact, CASE p_partkey % 3 WHEN 0 THEN 'cooccur' WHEN 1 THEN 'subj_occur' ELSE 'obj_occur' END AS source, p_retailprice AS v FROM part),
e AS (SELECT * FROM r UNION ALL SELECT fact, 'all_x', v FROM r UNION ALL SELECT l_linenumber % 7, 'base', l_quantity FROM lineitem)
SELECT CAST(fact AS VARCHAR) AS fact, source, count(*) AS n, round(avg(v), 6) AS mean, round(median(v), 6) AS median FROM e GROUP BY 1, 2"""


@query("per_source_files", SOURCE_SQL)
def per_source_files(spark, sf_dir):
    """Statistics by fact and source, written as a document beside their values and read back."""
    source = F.when(F.col("p_partkey") % 3 == 0, "cooccur").when(F.col("p_partkey") % 3 == 1, "subj_occur").otherwise("obj_occur").alias("source")
    rows = table(spark, sf_dir, "part").select((F.col("p_size") % 7).alias("fact"), source, F.col("p_retailprice").alias("delta_i"))
    base = table(spark, sf_dir, "lineitem").select((F.col("l_linenumber") % 7).alias("fact"), F.col("l_quantity").alias("delta_i"))
    path = place(spark, "per_source")
    report.write_per_source(rows, base, path, method="vanilla", seed=1, score_std=1.0)
    document = sinks.read_json_text(spark, f"{path}/per_source.json")
    found = [(f, s, v["n"], v["mean"], v["median"]) for f, by in document["per_fact"].items() for s, v in by.items()]
    return spark.createDataFrame(found, "fact string, source string, n long, mean double, median double")


def methods(spark, sf_dir) -> dict[str, DataFrame]:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("train_idx"), F.col("l_linenumber").cast("long").alias("pair_idx"), "l_quantity", "l_discount")
    one = rows.groupBy("train_idx", "pair_idx").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"))
    return {m: one.select("train_idx", "pair_idx", F.col(c).alias("delta_i"), F.col(c).alias("score_good"), F.lit(0.0).alias("score_bad")) for m, c in (("a", "q"), ("b", "d"))}


@query("method_pair_statistics", """WITH o AS (SELECT l_orderkey, l_linenumber AS p, max(l_quantity) AS q, max(l_discount) AS d FROM lineitem GROUP BY 1, 2), e AS (SELECT 'a' AS method, p, q AS v FROM o UNION ALL SELECT 'b', p, d FROM o)
SELECT method, CAST(p AS BIGINT) AS pair_idx, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max FROM e GROUP BY 1, 2""")
def method_pair_statistics(spark, sf_dir):
    """The methods' comparison as CSV tables; this one is the spread by pair."""
    path = place(spark, "comparison")
    report.method_comparison(methods(spark, sf_dir), (5,), path, {"a": {"prec_at_k": {"5": 0.5}}})
    return spark.read.schema("pair_idx long, mean double, std double, min double, max double, method string").option("header", True).csv(f"{path}/per_pair_statistics")


@query("precision_over_seeds", """WITH v AS (SELECT l_linenumber AS k, l_returnflag AS seed, round(avg(l_discount), 6) AS p FROM lineitem GROUP BY 1, 2)
SELECT CAST(k AS VARCHAR) AS k, round(avg(p), 9) AS mean, round(stddev_samp(p), 9) AS std, count(*) AS n_seeds FROM v GROUP BY 1""")
def precision_over_seeds(spark, sf_dir):
    """Precision documents of several seeds, written, read and averaged; k is text."""
    path, found = place(spark, "precision"), []
    for n, r in enumerate(table(spark, sf_dir, "lineitem").select("l_returnflag").distinct().orderBy("l_returnflag").collect()):
        macro = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == r[0]).groupBy(F.col("l_linenumber").alias("k")).agg(F.round(F.avg("l_discount"), 6).alias("prec_at_k"))
        sinks.write_json_text(spark, f"{path}/{n}.json", report.precision_document({"contrast": macro}, n, "c", "full_corpus"))
        found.append(sinks.read_json_text(spark, f"{path}/{n}.json"))
    mean = report.average_precision(found)
    rows = [(k, round(v["mean"], 9), round(v["std"], 9), len(v["values"])) for k, v in mean.items() if k != "modes"]
    return spark.createDataFrame(rows, "k string, mean double, std double, n_seeds long")


@query("provenance_files", """SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 2 UNION ALL SELECT 'doc_id', CAST(doc_id AS VARCHAR), count(*) FROM documents GROUP BY 2""")
def provenance_files(spark, sf_dir):
    """All values of all fields, however many, as a table beside the document."""
    docs = table(spark, sf_dir, "documents").select("lang", F.col("doc_id").cast("string").alias("doc_id"))
    counts = provenance.field_counts(docs, ["lang", "doc_id"])
    path = place(spark, "provenance")
    years = provenance.year_histogram(table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("string").alias("d")), "d")
    totals = docs.agg(F.count(F.lit(1)).alias("documents"))
    report.corpus_document(spark, counts, totals, years, provenance.head_concentration(docs, "doc_id"), path)
    return spark.read.parquet(f"{path}.values").select("field", "value", "n")


@query("accuracy_text", """WITH a AS (SELECT l_returnflag AS phenomenon, round(avg(CASE WHEN l_discount > l_tax THEN 1 ELSE 0 END), 6) AS acc FROM lineitem GROUP BY 1)
SELECT phenomenon, acc, CASE WHEN acc >= 0.5 THEN '*' ELSE '' END AS mark FROM a""")
def accuracy_text(spark, sf_dir):
    acc = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("phenomenon")).agg(F.round(F.avg((F.col("l_discount") > F.col("l_tax")).cast("int")), 6).alias("acc"))
    lines = [x.split() for x in sinks.accuracy_report(acc, 0.5).split("\n")[1:]]
    return spark.createDataFrame([(x[0], float(x[1]), x[2] if len(x) > 2 else "") for x in lines], "phenomenon string, acc double, mark string")


# -- smaller steps ------------------------------------------------------------------------


@query("template_scores", """SELECT p_brand || '__' || regexp_replace(translate(lower(p_type), ' -', '__'), '[^a-z0-9_]', '', 'g') || '__' || regexp_replace(translate(lower(p_name), ' -', '__'), '[^a-z0-9_]', '', 'g') AS slug,
p_size AS template_idx, p_retailprice / 1e4 AS p_correct, p_size / 50.0 AS entropy_norm FROM part""")
def template_scores(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("relation"), F.col("p_type").alias("subject"), F.col("p_name").alias("correct_object"), F.col("p_size").alias("template_idx"), (F.col("p_retailprice") / 1e4).alias("p_correct"), (F.col("p_size") / 50.0).alias("entropy_norm"))
    return facts.template_scores(rows)


@query("confident_facts", "SELECT p_partkey FROM part WHERE p_retailprice / 1e4 >= 0.1 AND p_size / 50.0 < 0.55")
def confident_facts(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 1e4).alias("p_correct"), (F.col("p_size") / 50.0).alias("entropy_norm"))
    return facts.confident(rows).select("p_partkey")


def asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pair_idx"), F.col("p_name").alias("text_good"), F.col("p_brand").alias("text_bad"), (F.col("p_partkey") % 3).alias("negative_idx"), F.col("p_type").alias("subject"))


for _side, _cols, _rule in (("good", "text_good, subject", "pair_idx % 3 = 0"), ("bad", "text_bad, negative_idx, subject", "true"), ("contrast", "text_good, text_bad, negative_idx, subject", "true")):

    @query(f"inspect_columns_{_side}", f"""WITH q AS (SELECT p_partkey AS pair_idx, p_name AS text_good, p_brand AS text_bad, p_partkey % 3 AS negative_idx, p_type AS subject FROM part), t AS (SELECT l_partkey AS pair_idx, l_orderkey AS train_idx FROM lineitem)
SELECT pair_idx, train_idx, {_cols} FROM t JOIN q USING (pair_idx) WHERE {_rule}""")
    def inspect_columns(spark, sf_dir, side=_side):
        """First rows of a side with their pairs' columns; the good side ranks first negatives only."""
        queries = rank.first_negatives(asked(spark, sf_dir), side)
        top = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("pair_idx"), F.col("l_orderkey").alias("train_idx"))
        return rank.with_query_columns(top.join(queries.select("pair_idx"), "pair_idx", "left_semi"), queries, side)


@query("sample_in_order", """WITH s AS (SELECT doc_id FROM documents ORDER BY md5('3:' || doc_id), doc_id LIMIT 60) SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS place, doc_id FROM s""")
def sample_in_order(spark, sf_dir):
    """A sample in the input's order, with its place there."""
    rows = sampling.sample_in_order(table(spark, sf_dir, "documents").select("doc_id"), 60, 3, ["doc_id"], "doc_id")
    return sampling.ranked(rows, "doc_id", "place").select("place", "doc_id")


def half_even(x: str) -> str:
    return f"CASE WHEN {x} - floor({x}) = 0.5 THEN 2 * round({x} / 2) ELSE round({x}) END"


@query("chunk_quotas", f"""WITH c AS (SELECT source AS chunk, count(*) AS n FROM documents GROUP BY 1), x AS (SELECT *, n * 0.25 AS w FROM c) SELECT chunk, n, CAST(least({half_even('w')}, n) AS BIGINT) AS take FROM x""")
def chunk_quotas(spark, sf_dir):
    counts = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("chunk")).agg(F.count(F.lit(1)).alias("n"))
    return sampling.quota_per_chunk(counts, 1, 4)


@query("scoring_subset", """WITH b AS (SELECT doc_id FROM documents WHERE doc_id % 10 <> 0 ORDER BY md5('2:' || doc_id), doc_id LIMIT 40)
SELECT doc_id AS train_idx, CASE WHEN doc_id % 10 = 0 THEN 'X' ELSE 'base' END AS category FROM documents WHERE doc_id % 10 = 0 OR doc_id IN (SELECT doc_id FROM b)""")
def scoring_subset(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("train_idx"), F.when(F.col("doc_id") % 10 == 0, "X").otherwise("base").alias("category"))
    return sampling.scoring_subset(rows, 40)


@query("legacy_sources", """WITH s AS (SELECT doc_id, list_filter(['occur', CASE WHEN doc_id % 2 = 0 THEN 'subj_occur' END, CASE WHEN doc_id % 3 = 0 THEN 'obj_occur' END], lambda x: x IS NOT NULL) AS s FROM documents)
SELECT doc_id, array_to_string(list_sort(CASE WHEN list_has_any(s, ['subj_occur', 'obj_occur']) THEN s ELSE list_transform(s, lambda x: CASE WHEN x = 'occur' THEN 'subj_occur' ELSE x END) END), ',') AS sources FROM s""")
def legacy_sources(spark, sf_dir):
    i = F.col("doc_id")
    tags = F.array_compact(F.array(F.lit("occur"), F.when(i % 2 == 0, "subj_occur"), F.when(i % 3 == 0, "obj_occur")))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.array_sort(categories.legacy_sources(tags)), ",").alias("sources"))


@query("filter_outputs", """WITH d AS (SELECT doc_id, contains(text, 'the') AS x, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 0 AS t FROM documents)
SELECT 'train_full' AS part, doc_id FROM d WHERE NOT t UNION ALL SELECT 'matched', doc_id FROM d WHERE NOT t AND x UNION ALL SELECT 'clean', doc_id FROM d WHERE NOT t AND NOT x UNION ALL SELECT 'test', doc_id FROM d WHERE t""")
def filter_outputs(spark, sf_dir):
    found = filters.run_filters(table(spark, sf_dir, "documents").select("doc_id", "text"), F.contains("text", F.lit("the")), "doc_id")
    out = None
    for name, rows in found.items():
        part = rows.select(F.lit(name).alias("part"), "doc_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("predefined_aliases", """SELECT n_name AS subject, count(DISTINCT f) AS n_terms FROM (SELECT n_name, unnest([lower(n_name), 'land ' || n_nationkey, 'state ' || n_nationkey]) AS f FROM nation) GROUP BY 1""")
def predefined_aliases(spark, sf_dir):
    """Surface terms with aliases that were found and such as were given beforehand."""
    rows = nations(spark, sf_dir)
    own = rows.select(F.col("n_nationkey").alias("instance_idx"), F.col("n_name").alias("subject"), F.lit("Nobject").alias("correct_object"))
    alias = lambda name: rows.select(F.col("n_name").alias("label"), F.array(F.concat(F.lit(name + " "), F.col("n_nationkey").cast("string"))).alias("aliases"))
    terms = cooccur.surface_terms(own, alias("Land"), alias("State")).where("side = 'subject'")
    return terms.join(own, "instance_idx").groupBy("subject").agg(F.count_distinct("term").alias("n_terms"))


@query("scored_texts", """SELECT doc_id, CAST(-length(text) AS DOUBLE) AS logp FROM documents""")
def scored_texts(spark, sf_dir):
    """The interface to a scoring model, with one that scores by length."""
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return probe.score_texts(rows, lambda: lambda texts: [-float(len(t)) for t in texts]).select("doc_id", "logp")


@query("stream_topk", """SELECT * FROM (SELECT side, pair_idx, train_idx, v, CAST(row_number() OVER (PARTITION BY side, pair_idx ORDER BY CASE WHEN side = 'bad' THEN v ELSE -v END, train_idx) - 1 AS INTEGER) AS rank FROM (
  SELECT unnest(['contrast', 'good', 'bad']) AS side, p_size AS pair_idx, p_partkey AS train_idx, unnest([round(p_retailprice - p_size, 6), p_retailprice, CAST(p_size AS DOUBLE)]) AS v FROM part)) WHERE rank < 3""")
def stream_topk(spark, sf_dir):
    """All three sides' first rows over a stream of score files."""
    path = place(spark, "scores")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("train_idx"), F.col("p_size").alias("pair_idx"), F.col("p_retailprice").alias("score_good"), F.col("p_size").cast("double").alias("score_bad"), F.round(F.col("p_retailprice") - F.col("p_size"), 6).alias("delta_i"))
    rows.repartition(4).write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return incremental.top_k_sides(stream, 3, "pair_idx", place(spark, "state"), place(spark, "progress"))


@query("stream_dedup", f"""WITH {corpus.LINES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY full_key ORDER BY doc_id, line_no) AS r FROM keyed) SELECT doc_id, line_no, full_key FROM n WHERE r = 1""")
def stream_dedup(spark, sf_dir):
    """First rows of their keys over a stream of files; of one file's rows the first in order stays."""
    path = place(spark, "lines")
    rows = corpus.document_lines(spark, sf_dir).select("doc_id", "line_no", "full_key")
    rows.repartitionByRange(4, "doc_id").write.parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return incremental.dedup_ordered(stream, "full_key", ["doc_id", "line_no"], place(spark, "state"), place(spark, "progress"))

