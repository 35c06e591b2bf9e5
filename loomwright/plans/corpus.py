"""Queries over the corpus: deduplication, chunks, provenance, mixing and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import divergence_point, reconvergence, sentences, words
from loomwright.operators import chunks, dedup, provenance, sampling
from loomwright.plans.registry import query, table
from loomwright.plans.runtime import spread

LINES_SQL = r"""
raw_lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
), lines AS (
  SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, regexp_replace(t, '^\s+|\s+$', '', 'g') AS text FROM raw_lines
  WHERE regexp_replace(t, '^\s+|\s+$', '', 'g') <> ''
), keyed AS (
  SELECT *, md5(array_to_string(string_split_regex(text, '\s+'), ' ')) AS full_key, len(string_split_regex(text, '\s+')) AS n_tokens FROM lines
)"""


def document_lines(spark, sf_dir) -> DataFrame:
    """Non-empty stripped lines of the documents with key and number of tokens."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    rows = docs.withColumn("text", F.regexp_replace("text", r"^\s+|\s+$", "")).where("text <> ''")
    forms = F.split("text", r"\s+")
    return rows.withColumn("full_key", F.md5(F.array_join(forms, " ").cast("binary"))).withColumn("n_tokens", F.size(forms).cast("long"))


@query("dedup_lines", f"""WITH {LINES_SQL}, n AS (
  SELECT *, row_number() OVER (PARTITION BY full_key ORDER BY doc_id, line_no) AS r FROM keyed)
SELECT doc_id, line_no, substr(full_key, 1, 16) AS sentence_key, n_tokens FROM n WHERE r = 1""")
def dedup_lines(spark, sf_dir):
    rows = dedup.keep_first(document_lines(spark, sf_dir), "full_key", ["doc_id", "line_no"])
    return rows.select("doc_id", "line_no", F.substring("full_key", 1, 16).alias("sentence_key"), "n_tokens")


@query("dup_key_stats", f"""WITH {LINES_SQL}, k AS (SELECT full_key, count(*) AS copies FROM keyed GROUP BY 1)
SELECT copies, count(*) AS n_keys FROM k GROUP BY 1""")
def dup_key_stats(spark, sf_dir):
    return dedup.duplicate_counts(document_lines(spark, sf_dir), "full_key")


#: Tokens of a chunk here, and of the corpus (the settings' target).
BUDGET, TARGET = 100_000, 5_387_400_000


CHUNK_SQL = f"""WITH RECURSIVE {LINES_SQL}, n AS (
  SELECT *, row_number() OVER (PARTITION BY full_key ORDER BY doc_id, line_no) AS r FROM keyed
), t AS (
  SELECT n_tokens, CAST(sum(n_tokens) OVER (ORDER BY doc_id, line_no) AS BIGINT) AS total FROM n WHERE r = 1
), ends(c, e) AS (
  SELECT 0, CAST(0 AS BIGINT)
  UNION ALL
  SELECT c + 1, (SELECT min(total) FROM t WHERE total >= e + {BUDGET}) FROM ends WHERE e IS NOT NULL AND e < {TARGET}
), stop AS (SELECT min(e) AS e FROM ends WHERE e >= {TARGET}), placed AS (
  SELECT n_tokens, (SELECT count(*) FROM ends WHERE c > 0 AND ends.e < t.total) AS chunk_id FROM t WHERE total <= coalesce((SELECT e FROM stop), total)
) SELECT CAST(chunk_id AS INTEGER) AS chunk_id, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, count(*) AS n_sentences FROM placed GROUP BY 1"""


@query("chunk_pack", CHUNK_SQL)
def chunk_pack(spark, sf_dir):
    lines = dedup.keep_first(document_lines(spark, sf_dir), "full_key", ["doc_id", "line_no"])
    packed = chunks.pack_chunks(lines.select("doc_id", "line_no", "n_tokens"), "n_tokens", ["doc_id", "line_no"], BUDGET, TARGET)
    return chunks.chunk_totals(packed, "n_tokens")


@query("header_carry", """WITH h AS (SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN source END AS header FROM documents), f AS (
  SELECT doc_id, lang, last_value(header IGNORE NULLS) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS doc_header FROM h)
SELECT doc_id, lang, doc_header, row_number() OVER (PARTITION BY lang, doc_header ORDER BY doc_id) = 1 AS emit_header FROM f""")
def header_carry(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 5 == 0, F.col("source")).alias("header"))
    carried = chunks.carry_header(docs, "header", ["doc_id"], "lang").drop("header")
    return chunks.emit_header(carried, "doc_header", "lang", ["doc_id"])


@query("provenance_counts", """SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY 2""")
def provenance_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return provenance.field_counts(provenance.documents_once(docs, "doc_id"), ["lang", "source"])


@query("provenance_summary", """SELECT 'lang' AS field, count(*) AS total, count(DISTINCT lang) AS n_unique FROM documents WHERE lang IS NOT NULL
UNION ALL SELECT 'source', count(*), count(DISTINCT source) FROM documents WHERE source IS NOT NULL""")
def provenance_summary(spark, sf_dir):
    return provenance.field_summary(provenance_counts(spark, sf_dir))


@query("year_histogram", """SELECT CASE WHEN regexp_extract(d, '([0-9]{4})', 1) = '' THEN 'unparsed' ELSE regexp_extract(d, '([0-9]{4})', 1) END AS year, count(*) AS n
FROM (SELECT CASE WHEN o_orderkey % 50 = 0 THEN o_orderpriority ELSE CAST(o_orderdate AS VARCHAR) END AS d FROM orders) GROUP BY 1""")
def year_histogram(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    date = F.when(F.col("o_orderkey") % 50 == 0, F.col("o_orderpriority")).otherwise(F.col("o_orderdate").cast("string"))
    return provenance.year_histogram(orders.select(date.alias("date")), "date")


@query("head_concentration", """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, CAST(user_id AS VARCHAR)) AS r FROM c)
SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS n_unique, CAST(0 AS BIGINT) AS empty,
  sum(CASE WHEN r <= 10 THEN n ELSE 0 END) / sum(n) AS share_top10, sum(CASE WHEN r <= 100 THEN n ELSE 0 END) / sum(n) AS share_top100,
  sum(CASE WHEN r <= 1000 THEN n ELSE 0 END) / sum(n) AS share_top1000, count(*) FILTER (n = 1) / count(*) AS singleton_frac FROM r""")
def head_concentration(spark, sf_dir):
    return provenance.head_concentration(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id")), "user_id")


@query("top_creators", """SELECT user_id, count(*) AS n FROM (SELECT CAST(user_id AS VARCHAR) AS user_id FROM events) GROUP BY 1 ORDER BY n DESC, user_id LIMIT 25""")
def top_creators(spark, sf_dir):
    return provenance.top_values(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user_id")), "user_id")


@query("corpus_totals", f"""WITH {LINES_SQL}, d AS (SELECT doc_id, count(*) AS s, sum(n_tokens) AS w FROM keyed GROUP BY 1), j AS (
  SELECT documents.doc_id, lang, coalesce(s, 0) AS s, coalesce(w, 0) AS w FROM documents LEFT JOIN d USING (doc_id))
SELECT count(DISTINCT lang) AS n_chunks, count(DISTINCT doc_id) AS documents, count(doc_id) - count(DISTINCT doc_id) AS documents_repeated,
  CAST(sum(s) AS BIGINT) AS sentences, CAST(sum(w) AS BIGINT) AS words, CASE WHEN sum(s) > 0 THEN sum(w) / sum(s) ELSE 0.0 END AS avg_sent_len FROM j""")
def corpus_totals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    per = document_lines(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("s"), F.sum("n_tokens").alias("w"))
    rows = docs.join(per, "doc_id", "left").select("doc_id", "lang", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("w", F.lit(0)).alias("w"))
    return provenance.corpus_totals(rows, "doc_id", "lang", "s", "w")


@query("chunk_prefix_for_budget", """WITH c AS (SELECT doc_id % 16 AS chunk_id, CAST(sum(n_chars) AS BIGINT) AS n_tokens FROM documents GROUP BY 1),
r AS (SELECT *, CAST(sum(n_tokens) OVER (ORDER BY chunk_id) AS BIGINT) AS cum_tokens FROM c)
SELECT * FROM r WHERE cum_tokens - n_tokens < 400000""")
def chunk_prefix_for_budget(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").groupBy(F.pmod("doc_id", F.lit(16)).alias("chunk_id")).agg(F.sum("n_chars").alias("n_tokens"))
    return chunks.chunk_prefix(docs, 400_000)


@query("round_robin_chunks", """SELECT doc_id % 8 AS chunk_id, count(*) AS n FROM documents GROUP BY 1""")
def round_robin_chunks(spark, sf_dir):
    from loomwright.sources.tables import round_robin

    return round_robin(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 8).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"))


@query("held_out_split", """SELECT doc_id, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10 = 0 AS held_out FROM documents""")
def held_out_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", sampling.held_out_tenth(F.col("doc_id")).alias("held_out"))


@query("sample_lines", """SELECT doc_id, source FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 100""")
def sample_lines(spark, sf_dir):
    return sampling.sample_n(table(spark, sf_dir, "documents").select("doc_id", "source"), 100, 7, "doc_id")


@query("oversample_fill", """WITH x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents WHERE lang = 'fr'),
r AS (SELECT doc_id, pos, n, unnest(range(0, 700)) AS round FROM x)
SELECT doc_id, pos, CAST(round AS INTEGER) AS round FROM r WHERE round * n + pos < 700""")
def oversample_fill(spark, sf_dir):
    x = table(spark, sf_dir, "documents").where("lang = 'fr'").select("doc_id")
    return sampling.oversample(x, "doc_id", 700).select("doc_id", "pos", "round")


def _mixed(placement: str):
    def run(spark, sf_dir):
        docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
        rows = sampling.mix(docs.where("lang <> 'es'"), docs.where("lang = 'es'"), "doc_id", placement, seed=5)
        return rows.select("doc_id", "slot", "kind", "pos")

    return run


for _place, _slot in {
    "start": "CAST(0 AS BIGINT)", "end": "(SELECT count(*) FROM b) + 1", "middle": "(SELECT count(*) FROM b) // 2 + 1",
    "full_shuffle": "CAST('0x' || substr(md5('5:' || doc_id), 1, 12) AS BIGINT) % ((SELECT count(*) FROM b) + 1) + 1",
}.items():
    query(f"mix_{_place}", f"""WITH b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents WHERE lang <> 'es'),
x AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents WHERE lang = 'es')
SELECT doc_id, CAST(pos + 1 AS BIGINT) AS slot, 1 AS kind, pos FROM b UNION ALL SELECT doc_id, CAST({_slot} AS BIGINT), 0, pos FROM x""")(_mixed(_place))


@query("divergence_point", r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS a FROM benchmark), p AS (
  SELECT x.item_id, x.a AS a, y.a AS b FROM w x JOIN w y ON y.item_id = x.item_id + 1 - x.item_id % 2 * 2), q AS (
  SELECT item_id, a, b, least(len(a), len(b)) AS short, list_filter(range(0, greatest(len(a), len(b))), lambda i: a[i + 1] IS DISTINCT FROM b[i + 1]) AS d FROM p), r AS (
  SELECT *, least(coalesce(d[1], short), short) AS k FROM q)
SELECT item_id, CAST(k AS INTEGER) AS diverges, CAST(list_filter(range(0, greatest(len(a), len(b))), lambda i: i > k AND a[i + 1] = b[i + 1])[1] AS INTEGER) AS reconverges FROM r""")
def divergence(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", words(F.lower("text")).alias("a"))
    other = items.select((F.col("item_id") + 1 - F.col("item_id") % 2 * 2).alias("item_id"), F.col("a").alias("b"))
    rows = items.join(other, "item_id").withColumn("diverges", divergence_point(F.col("a"), F.col("b")))
    return rows.select("item_id", "diverges", reconvergence(F.col("a"), F.col("b"), F.col("diverges")).alias("reconverges"))


@query("clean_sentences", r"""WITH s AS (SELECT doc_id, trim(regexp_replace(unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]*')), '\s+', ' ', 'g')) AS s FROM documents)
SELECT doc_id, count(*) AS n_sentences, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM s WHERE length(s) >= 20 AND NOT regexp_matches(s, '^=+.*=+$') GROUP BY 1""")
def clean_sentences(spark, sf_dir):
    rows = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sentences"), F.sum(F.length("s")).alias("n_chars"))
