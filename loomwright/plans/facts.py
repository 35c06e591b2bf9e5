"""Queries over facts, labels and pairs: support, verdicts, queries, samples, accuracy tables.

Stand-ins: a document's `source` and `lang` name its fact, `labels.quality` the full
model's answer and `labels.toxic` = 0 that of the model without X; a passage's first and last
three words are its subject and object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import metrics, text
from loomwright.operators import cooccur, facts, filters, probe, sampling, views
from loomwright.plans.corpus import document_lines
from loomwright.plans.registry import query, table

INSTANCES_SQL = r"""
words3 AS (SELECT item_id, string_split_regex(trim(text), '\s+') AS w FROM benchmark), inst AS (
  SELECT item_id AS instance_idx, array_to_string(w[1:3], ' ') AS subject, array_to_string(w[-3:], ' ') AS correct_object FROM words3
), forms AS (
  SELECT instance_idx, 'subject' AS side, subject AS form FROM inst UNION SELECT instance_idx, 'object', correct_object FROM inst
), bare AS (
  SELECT instance_idx, side, regexp_replace(form, '(?i)^(the|a|an)\s+', '') AS form FROM forms WHERE regexp_matches(form, '(?i)^(the|a|an)\s+')
), every AS (
  SELECT * FROM forms UNION SELECT * FROM bare WHERE contains(form, ' ') OR (upper(form) = form AND lower(form) <> form)
), terms AS (
  SELECT DISTINCT instance_idx, side, array_to_string(regexp_extract_all(lower(form), '[\p{L}\p{N}_]+'), ' ') AS term, len(regexp_extract_all(lower(form), '[\p{L}\p{N}_]+')) AS n
  FROM every WHERE form <> ''
), ls AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents
), tok AS (SELECT doc_id, line_no, regexp_extract_all(lower(t), '[\p{L}\p{N}_]+') AS w FROM ls), sizes AS (SELECT DISTINCT n FROM terms WHERE n > 0), grams AS (
  SELECT doc_id, line_no, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS term FROM tok, sizes WHERE len(w) >= n
), hits AS (SELECT doc_id, line_no, instance_idx, max(CASE WHEN side = 'subject' THEN 1 ELSE 0 END) AS s, max(CASE WHEN side = 'object' THEN 1 ELSE 0 END) AS o
  FROM grams JOIN terms USING (term) GROUP BY 1, 2, 3), counts AS (
  SELECT instance_idx, CAST(sum(s) AS BIGINT) AS subject, CAST(sum(o) AS BIGINT) AS object, CAST(sum(s * o) AS BIGINT) AS cooccur FROM hits GROUP BY 1)"""


def instances(spark, sf_dir) -> DataFrame:
    w = F.split(F.trim("text"), r"\s+")
    last = F.slice(w, F.greatest(F.size(w) - 2, F.lit(1)), 3)
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("instance_idx"), F.array_join(F.slice(w, 1, 3), " ").alias("subject"), F.array_join(last, " ").alias("correct_object")
    )


@query("surface_form_counts", f"WITH {INSTANCES_SQL} SELECT * FROM counts")
def surface_form_counts(spark, sf_dir):
    terms = cooccur.surface_terms(instances(spark, sf_dir))
    lines = document_lines(spark, sf_dir).select("doc_id", "line_no", "text")
    return cooccur.count_support(lines, terms, ["doc_id", "line_no"], "text")


@query("fact_corpus_split", f"""WITH {INSTANCES_SQL}, k AS (SELECT CASE WHEN s + o = 2 THEN 'cooccur' WHEN s = 1 THEN 'subj_occur' ELSE 'obj_occur' END AS source FROM hits)
SELECT source, count(*) AS n FROM k GROUP BY 1 UNION ALL SELECT 'clean', count(*) FROM (
  SELECT doc_id, line_no FROM ls WHERE regexp_replace(t, '^\\s+|\\s+$', '', 'g') <> '' EXCEPT SELECT doc_id, line_no FROM hits)""")
def fact_corpus_split(spark, sf_dir):
    """Lines by how they hold a fact, and lines of none."""
    lines = document_lines(spark, sf_dir).select("doc_id", "line_no", "text")
    found, clean = cooccur.split_by_fact(lines, cooccur.surface_terms(instances(spark, sf_dir)), ["doc_id", "line_no"], "text")
    counts = found.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(clean.agg(F.lit("clean").alias("source"), F.count(F.lit(1)).alias("n")))


@query("corpus_support_filter", f"""WITH {INSTANCES_SQL} SELECT instance_idx FROM inst LEFT JOIN counts USING (instance_idx)
WHERE coalesce(counts.subject, 0) >= 2 AND coalesce(counts.object, 0) >= 2 AND coalesce(counts.cooccur, 0) >= 1""")
def corpus_support_filter(spark, sf_dir):
    found = cooccur.support_filter(instances(spark, sf_dir).select("instance_idx"), surface_form_counts(spark, sf_dir), ["instance_idx"], 2, 2, 1)
    return found.select("instance_idx")


@query("entity_cap", """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1) SELECT event_type, count(*) AS n FROM events JOIN c USING (user_id) WHERE c.n < 66 GROUP BY 1""")
def entity_cap(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type")
    counts = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sentences"))
    return cooccur.entity_cap(events, counts, "user_id", 66).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("alias_overlap_exclusion", r"""WITH x AS (SELECT n_name AS s, r_name AS o, list_distinct([lower(n_name), lower(substr(n_name, 1, 2))]) AS sa, list_distinct([lower(r_name), lower(substr(r_name, 1, 2))]) AS oa
  FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT s AS subject, o AS correct_object FROM x WHERE NOT (list_has_any(sa, oa)
  OR (length(s) >= 4 AND regexp_matches(' ' || lower(o) || ' ', '[^\p{L}\p{N}_]' || regexp_escape(lower(s)) || '[^\p{L}\p{N}_]'))
  OR (length(o) >= 4 AND regexp_matches(' ' || lower(s) || ' ', '[^\p{L}\p{N}_]' || regexp_escape(lower(o)) || '[^\p{L}\p{N}_]')))""")
def alias_overlap_exclusion(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("subject"), F.col("r_name").alias("correct_object"))
    short = lambda c: F.array(F.col(c), F.substring(c, 1, 2))
    return rows.where(~facts.alias_overlap(F.col("subject"), F.col("correct_object"), short("subject"), short("correct_object")))


@query("fact_slug", r"""SELECT p_partkey, p_brand || '__' || regexp_replace(replace(replace(lower(p_name), ' ', '_'), '-', '_'), '[^a-z0-9_]', '', 'g')
  || '__' || regexp_replace(replace(replace(lower(p_type), ' ', '_'), '-', '_'), '[^a-z0-9_]', '', 'g') AS fact_slug FROM part""")
def fact_slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.fact_slug(F.col("p_brand"), F.col("p_name"), F.col("p_type")).alias("fact_slug"))


@query("template_fill", """WITH t AS (SELECT * FROM (VALUES (0, '[X] lies in [Y].'), (1, 'The region of [X] is [Y].')) v(template_idx, template)), n AS (
  SELECT n_name AS subject, g.r_name AS correct_object, o.r_name AS negative, row_number() OVER (PARTITION BY n_name ORDER BY o.r_regionkey) - 1 AS negative_idx
  FROM nation JOIN region g ON n_regionkey = g.r_regionkey JOIN region o ON o.r_name <> g.r_name)
SELECT subject, correct_object, template_idx, CAST(negative_idx AS INTEGER) AS negative_idx,
  replace(replace(template, '[X]', subject), '[Y]', correct_object) AS text_good, replace(replace(template, '[X]', subject), '[Y]', negative) AS text_bad
FROM n, t WHERE negative_idx < 3""")
def template_fill(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    known = n.join(r, n.n_regionkey == r.r_regionkey).select(F.lit("located").alias("relation"), F.col("n_name").alias("subject"), F.col("r_name").alias("correct_object"))
    templates = spark.createDataFrame([("located", 0, "[X] lies in [Y]."), ("located", 1, "The region of [X] is [Y].")], "relation string, template_idx int, template string")
    space = r.select(F.lit("located").alias("relation"), F.col("r_regionkey").alias("answer_idx"), F.col("r_name").alias("answer"))
    return facts.build_queries(known, templates, space).drop("relation")


RESULTS_SQL = """results AS (SELECT source AS relation, lang AS subject, 'x' AS correct_object, doc_id AS template_idx, quality = 1 AS full_ok, toxic = 0 AS no_x_ok,
  n_chars / 20000.0 AS p_correct, 1 - n_chars / 20000.0 AS entropy_norm, CASE WHEN doc_id % 7 <> 0 THEN source END AS best_other_object FROM labels JOIN documents USING (doc_id))"""


def results(spark, sf_dir, model: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").drop("text"), "doc_id")
    ok = F.col("quality") == 1 if model == "full" else F.col("toxic") == 0
    return rows.select(
        F.col("source").alias("relation"), F.col("lang").alias("subject"), F.lit("x").alias("correct_object"), F.col("doc_id").alias("template_idx"), ok.alias("is_correct"),
        (F.col("n_chars") / 20000.0).alias("p_correct"), (1 - F.col("n_chars") / 20000.0).alias("entropy_norm"), F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("best_other_object"),
    )


@query("facts_learned", f"""WITH {RESULTS_SQL} SELECT relation, subject, correct_object, bool_and(full_ok) AS learned, count(*) FILTER (full_ok) AS n_correct,
  round(avg(p_correct), 6) AS avg_p_correct, round(avg(entropy_norm), 6) AS avg_entropy FROM results GROUP BY 1, 2, 3""")
def facts_learned(spark, sf_dir):
    rows = facts.fact_table(results(spark, sf_dir, "full"))
    return rows.withColumns({c: F.round(c, 6) for c in ("avg_p_correct", "avg_entropy")})


@query("fact_verdict", f"""WITH {RESULTS_SQL}, f AS (SELECT relation, subject, correct_object, bool_and(full_ok) AS a, bool_and(no_x_ok) AS b FROM results GROUP BY 1, 2, 3)
SELECT relation, subject, correct_object, CASE WHEN NOT a THEN 'not_learned' WHEN NOT b THEN 'Forgotten' ELSE 'Retained' END AS verdict FROM f""")
def fact_verdict(spark, sf_dir):
    return facts.verdicts(facts.fact_table(results(spark, sf_dir, "full")), facts.fact_table(results(spark, sf_dir, "no_x")))


@query("cascade_facts", f"""WITH {RESULTS_SQL} SELECT relation, subject, correct_object, template_idx, p_correct AS full_p_correct,
  CASE WHEN full_ok THEN 'learned_specific' ELSE 'not_learned_both' END AS "group" FROM results WHERE NOT no_x_ok AND best_other_object IS NOT NULL""")
def cascade_facts(spark, sf_dir):
    rows = facts.cascade_groups(results(spark, sf_dir, "full"), results(spark, sf_dir, "no_x"))
    return rows.select(*facts.FACT, "template_idx", "full_p_correct", "group")


@query("nonlearned_sample", f"""WITH {RESULTS_SQL}, f AS (SELECT relation, subject, correct_object, bool_and(full_ok) AS learned, count(*) FILTER (full_ok) AS n_correct, bool_and(no_x_ok) AS q
  FROM results GROUP BY 1, 2, 3), n AS (SELECT *, row_number() OVER (PARTITION BY n_correct ORDER BY md5('3:' || relation || ':' || subject), relation, subject) AS r FROM f
  WHERE NOT learned AND NOT q AND n_correct < 3)
SELECT relation, subject, n_correct FROM n WHERE r <= CASE n_correct WHEN 0 THEN 5 ELSE 3 END""")
def nonlearned_sample(spark, sf_dir):
    known = facts.fact_table(results(spark, sf_dir, "full"))
    pool = facts.not_learned_pool(known, facts.fact_table(results(spark, sf_dir, "no_x")).where("learned")).where("n_correct < 3")
    quota = F.when(F.col("n_correct") == 0, 5).otherwise(3)
    return sampling.sample_per_group(pool, "n_correct", quota, 3, "relation", "subject").select("relation", "subject", "n_correct")


@query("budget_split", """WITH c AS (SELECT count(*) FILTER (lang = 'es') AS n_dx, count(*) FILTER (lang <> 'es') AS n_base FROM documents), t AS (
  SELECT *, CAST(least(CASE WHEN n_dx * 500.0 / (n_dx + n_base) % 1 = 0.5 THEN 2 * round(n_dx * 500.0 / (n_dx + n_base) / 2) ELSE round(n_dx * 500.0 / (n_dx + n_base)) END, n_dx) AS BIGINT) AS take_dx FROM c)
SELECT n_dx, n_base, take_dx, CAST(least(500 - take_dx, n_base) AS BIGINT) AS take_base FROM t""")
def budget_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    counts = docs.agg(F.count_if(F.col("lang") == "es").alias("n_dx"), F.count_if(F.col("lang") != "es").alias("n_base"))
    return sampling.split_budget(counts, 500)


def _label_rows(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").distinct()


@query("stratified_sample", """WITH c AS (SELECT least(50, count(*) FILTER (quality = 1)) AS a0, least(50, count(*) FILTER (quality = 0)) AS b0, count(*) FILTER (quality = 1) AS n1, count(*) FILTER (quality = 0) AS n0
  FROM (SELECT DISTINCT doc_id, quality, toxic FROM labels)), q AS (SELECT a0 + least(100 - a0 - b0, n1 - a0) AS a, b0, n0, a0 FROM c), q2 AS (SELECT a, b0 + least(100 - a - b0, n0 - b0) AS b FROM q),
r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('11:' || doc_id), doc_id) AS r FROM (SELECT DISTINCT doc_id, quality, toxic FROM labels))
SELECT doc_id, CASE quality WHEN 1 THEN 'learned' ELSE 'not_learned' END AS "group" FROM r, q2 WHERE r <= CASE quality WHEN 1 THEN a ELSE b END""")
def stratified_sample(spark, sf_dir):
    rows = _label_rows(spark, sf_dir).withColumn("group", F.when(F.col("quality") == 1, "learned").otherwise("not_learned"))
    n = {r[0]: r[1] for r in rows.groupBy("group").count().collect()}  # one row for each group
    quotas = sampling.quotas_stratified(n.get("learned", 0), n.get("not_learned", 0), 0, 100)
    return sampling.take_quotas(rows, "group", quotas, 11, "doc_id").select("doc_id", "group")


@query("cascade_sample", """WITH l AS (SELECT DISTINCT doc_id, CASE WHEN quality = 0 THEN 'not_learned' WHEN toxic = 0 THEN 'retained' ELSE 'learned_specific' END AS g FROM labels),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY md5('12:' || doc_id), doc_id) AS r FROM l),
c AS (SELECT least(30, count(*) FILTER (g = 'retained')) AS a, least(30, count(*) FILTER (g = 'not_learned')) AS b FROM l)
SELECT doc_id, g AS "group" FROM r, c WHERE r <= CASE g WHEN 'retained' THEN a WHEN 'not_learned' THEN b ELSE greatest(90 - a - b, 0) END""")
def cascade_sample(spark, sf_dir):
    group = F.when(F.col("quality") == 0, "not_learned").when(F.col("toxic") == 0, "retained").otherwise("learned_specific")
    rows = _label_rows(spark, sf_dir).select("doc_id", group.alias("group")).distinct()
    n = {r[0]: r[1] for r in rows.groupBy("group").count().collect()}  # one row for each group
    quotas = sampling.quotas_cascade(n.get("retained", 0), n.get("not_learned", 0), n.get("learned_specific", 0), 90)
    return sampling.take_quotas(rows, "group", quotas, 12, "doc_id").select("doc_id", "group")


VECTOR_PAIRS_SQL = "p AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 10 AS g, CAST(embedding[2] AS DOUBLE) * 10 AS b FROM embeddings)"


def _vector_pairs(spark, sf_dir) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.get(e, F.lit(0)).cast("double") * 10).alias("g"), (F.get(e, F.lit(1)).cast("double") * 10).alias("b"))


@query("pair_metrics", f"""WITH {VECTOR_PAIRS_SQL}, s AS (SELECT *, 1 / (1 + exp(b - g)) AS p FROM p)
SELECT vec_id, g > b AS hit, round(p, 6) AS softmax_prob_good, round(-p * ln(p) - (1 - p) * ln(1 - p), 6) AS entropy, p > 0.5 AS learned FROM s""")
def pair_metrics(spark, sf_dir):
    rows = _vector_pairs(spark, sf_dir)
    g, b = F.col("g"), F.col("b")
    return rows.select("vec_id", metrics.hit(g, b).alias("hit"), F.round(metrics.softmax_pair(g, b), 6).alias("softmax_prob_good"), F.round(metrics.binary_entropy(g, b), 6).alias("entropy"), (metrics.softmax_pair(g, b) > 0.5).alias("learned"))


@query("phenomenon_rollup", f"""WITH {VECTOR_PAIRS_SQL}, s AS (SELECT *, 1 / (1 + exp(b - g)) AS p, label % 3 AS phenomenon, vec_id % 4 AS file_stem FROM p)
SELECT phenomenon, file_stem, round(avg(CASE WHEN g > b THEN 1 ELSE 0 END), 6) AS acc, count(*) AS n, round(avg(g), 6) AS mean_good, round(avg(b), 6) AS mean_bad,
  round(avg(-p * ln(p) - (1 - p) * ln(1 - p)), 6) AS mean_entropy FROM s GROUP BY ROLLUP (phenomenon, file_stem)""")
def phenomenon_rollup(spark, sf_dir):
    rows = _vector_pairs(spark, sf_dir).withColumn("e", metrics.binary_entropy(F.col("g"), F.col("b")))
    rows = rows.withColumn("phenomenon", F.col("label") % 3).withColumn("file_stem", F.col("vec_id") % 4)
    return probe.accuracy(rows, ["phenomenon", "file_stem"], "g", "b", "e")


@query("threshold_accuracy", f"""WITH {VECTOR_PAIRS_SQL}, s AS (SELECT *, 1 / (1 + exp(b - g)) AS p FROM p)
SELECT label, round(avg(CASE WHEN p > 0.5 THEN 1 ELSE 0 END), 6) AS acc, count(*) AS n, CAST(0.5 AS DOUBLE) AS threshold, round(avg(p), 6) AS mean_p_good FROM s GROUP BY 1""")
def threshold_accuracy(spark, sf_dir):
    rows = _vector_pairs(spark, sf_dir).withColumn("p", metrics.softmax_pair(F.col("g"), F.col("b")))
    return probe.threshold_accuracy(rows, ["label"], "p")


@query("split_accuracy", f"""WITH {VECTOR_PAIRS_SQL} SELECT label, round(avg(CASE WHEN g > b THEN 1 ELSE 0 END), 6) AS acc, count(*) AS n, count(*) FILTER (vec_id % 3 = 0) AS benchmark_n,
  count(*) FILTER (vec_id % 3 <> 0) AS fallback_n FROM p GROUP BY 1""")
def split_accuracy(spark, sf_dir):
    rows = _vector_pairs(spark, sf_dir).withColumn("hit", F.col("g") > F.col("b")).withColumn("own", F.col("vec_id") % 3 == 0)
    return probe.split_accuracy(rows, ["label"], "hit", "own")


CANDIDATES_SQL = """c AS (SELECT vec_id, label, CAST(vec_id % 8 AS INTEGER) AS gold, list_transform(range(0, 8), lambda i: list_sum(list_transform(embedding[8 * i + 1:8 * i + 8], lambda x: CAST(x AS DOUBLE)))) AS raw FROM embeddings),
m AS (SELECT *, list_max(raw) AS top, list_sum(list_transform(raw, lambda x: exp(x - list_max(raw)))) AS z FROM c),
k AS (SELECT vec_id, label, gold, raw, exp(raw[gold + 1] - top) / z AS p_correct, exp(0) / z AS p_predicted, list_position(raw, top) - 1 AS predicted,
  len(list_filter(raw, lambda x: x > raw[gold + 1])) + 1 AS rank_correct, list_max(list_filter(raw, lambda x, i: i <> gold + 1)) AS other,
  -list_sum(list_transform(raw, lambda x: exp(x - top) / z * ln(exp(x - top) / z + 1e-12))) / ln(8) AS entropy FROM m)"""


def _candidates(spark, sf_dir) -> DataFrame:
    pll = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda x: x.cast("double")))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", (F.col("vec_id") % 8).cast("int").alias("gold"), pll.alias("pll"))
    return probe.fact_metrics(rows, "pll", "gold")


@query("candidate_softmax", f"""WITH {CANDIDATES_SQL} SELECT vec_id, round(p_correct, 6) AS p_correct, round(p_predicted, 6) AS p_predicted, CAST(predicted AS INTEGER) AS predicted, predicted = gold AS is_correct,
  CAST(rank_correct AS INTEGER) AS rank_correct, round(raw[gold + 1] - other, 6) AS margin, round(entropy, 4) AS entropy_norm, round(p_predicted * 8, 4) AS p_predicted_above_chance FROM k""")
def candidate_softmax(spark, sf_dir):
    r = lambda c: F.round(c, 6).alias(c)
    return _candidates(spark, sf_dir).select("vec_id", r("p_correct"), r("p_predicted"), "predicted", "is_correct", "rank_correct", r("margin"), "entropy_norm", "p_predicted_above_chance")


@query("fact_rollup", f"""WITH {CANDIDATES_SQL} SELECT CAST(label AS VARCHAR) AS relation, round(avg(CASE WHEN predicted = gold THEN 1 ELSE 0 END), 6) AS acc, count(*) AS n FROM k GROUP BY ROLLUP (label)""")
def fact_rollup(spark, sf_dir):
    rows = _candidates(spark, sf_dir).withColumns({"relation": F.col("label").cast("string"), "subject": F.lit("s"), "correct_object": F.lit("o")})
    return probe.fact_rollup(rows)[1]


@query("interleave_queries", """SELECT item_id AS pair_idx, text, true AS is_good, 2 * item_id AS query_idx FROM benchmark
UNION ALL SELECT a.item_id, b.text, false, 2 * a.item_id + 1 FROM benchmark a JOIN benchmark b ON b.item_id = (a.item_id + 1) % (SELECT count(*) FROM benchmark)""")
def interleave_queries(spark, sf_dir):
    return sampling.interleave(passage_pairs(spark, sf_dir))


def passage_pairs(spark, sf_dir) -> DataFrame:
    """Pair i: passage i against the next one."""
    items = table(spark, sf_dir, "benchmark")
    n = items.count()
    nxt = items.select(F.pmod(F.col("item_id") - 1, F.lit(n)).alias("item_id"), F.col("text").alias("text_bad"))
    return items.join(nxt, "item_id").select(F.col("item_id").alias("pair_idx"), F.col("text").alias("text_good"), "text_bad")


@query("content_join_labels", """WITH b AS (SELECT a.item_id AS pair_idx, a.text AS g, b.text AS d FROM benchmark a JOIN benchmark b ON b.item_id = (a.item_id + 1) % (SELECT count(*) FROM benchmark))
SELECT pair_idx, CASE WHEN pair_idx % 5 <> 0 THEN (pair_idx + 1) % 2 = 0 END AS learned_x FROM b""")
def content_join_labels(spark, sf_dir):
    pairs = passage_pairs(spark, sf_dir)
    labels = pairs.where("pair_idx % 5 <> 0").select("text_good", "text_bad", F.posexplode(F.array(F.col("pair_idx") % 2 == 0, (F.col("pair_idx") + 1) % 2 == 0)).alias("at", "learned_x"))
    return views.join_labels(pairs, labels, "at").select("pair_idx", "learned_x")


@query("view_splits", """WITH l AS (SELECT DISTINCT doc_id AS pair_idx, quality = 1 AS f, toxic = 0 AS n FROM labels)
SELECT pair_idx, 'learned' AS view FROM l WHERE f UNION ALL SELECT pair_idx, 'not_learned' FROM l WHERE NOT f UNION ALL SELECT pair_idx, 'learned_specific' FROM l WHERE f AND NOT n
UNION ALL SELECT pair_idx, 'learned_confounded' FROM l WHERE f AND n UNION ALL SELECT pair_idx, 'not_learned_no_x' FROM l WHERE NOT n""")
def view_splits(spark, sf_dir):
    rows = _label_rows(spark, sf_dir).select(F.col("doc_id").alias("pair_idx"), (F.col("quality") == 1).alias("f"), (F.col("toxic") == 0).alias("n"))
    return views.split_views(rows, "f", "n")


@query("fact_views", """WITH l AS (SELECT doc_id AS pair_idx, doc_id % 50 AS fact_key, CASE WHEN quality = 0 THEN 'not_learned' WHEN toxic = 1 THEN 'Forgotten' ELSE 'Retained' END AS v FROM labels), f AS (
  SELECT pair_idx, fact_key, first_value(v) OVER (PARTITION BY fact_key ORDER BY pair_idx) AS v FROM l)
SELECT pair_idx, fact_key, 'all' AS view FROM f UNION ALL SELECT pair_idx, fact_key, 'learned' FROM f WHERE v <> 'not_learned' UNION ALL SELECT pair_idx, fact_key, 'learned_specific' FROM f WHERE v = 'Forgotten'
UNION ALL SELECT pair_idx, fact_key, 'learned_confounded' FROM f WHERE v = 'Retained' UNION ALL SELECT pair_idx, fact_key, 'not_learned' FROM f WHERE v = 'not_learned'""")
def fact_views(spark, sf_dir):
    verdict: Column = F.when(F.col("quality") == 0, "not_learned").when(F.col("toxic") == 1, "Forgotten").otherwise("Retained")
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pair_idx"), (F.col("doc_id") % 50).alias("fact_key"), verdict.alias("v"))
    return views.fact_views(rows, "v")


@query("linguistic_filters")
def linguistic_filters(spark, sf_dir):
    """Each passage as a flat parse: form and position of its words, no relations."""
    w = text.words(F.col("text"))
    token = F.transform(w, lambda x, i: F.struct((i + 1).cast("string").alias("id"), x.alias("form"), F.lower(x).alias("lemma"), F.lit("_").alias("feats"), F.lit("0").alias("head"), F.lit("dep").alias("deprel")))
    rows = table(spark, sf_dir, "benchmark").select("item_id", token.alias("tokens"))
    return rows.select("item_id", *[f(F.col("tokens")).alias(n) for n, f in filters.FILTERS.items()])
