"""The steps end to end: chunk a corpus, report on it, attribute, analyse. Outputs that are up to date stay."""

from __future__ import annotations

import itertools
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.text import sentence_key
from loomwright.operators import chunks, dedup, provenance, rank, report, sampling, scoring, stats, views
from loomwright.plans.config import Attribution, Experiment
from loomwright.plans.runtime import materialize
from loomwright.sources import conllu, sinks


def chunk_corpus(spark: SparkSession, inputs: str | list[str], out: str, tokens_per_chunk: int = 65_700_000, target: int | None = 5_387_400_000) -> dict:
    """Parsed text -> deduplicated chunks and their manifest.

    The deduplicated blocks with their running total are the state of a run, kept beside
    the chunks. A later run over the same inputs, with another target, goes on from there: closed
    chunks stay, the open one is written anew, so both runs give the chunks of one.
    """
    given = {"inputs": inputs, "tokens_per_chunk": tokens_per_chunk}
    config, state = given | {"target": target}, f"{out}.state"
    if sinks.up_to_date(spark, out, config):
        return sinks.read_json_text(spark, f"{out}.manifest.json")
    order = ["input_index", "block_no"]
    if not sinks.up_to_date(spark, state, given):
        rows = conllu.read_conllu(spark, inputs).where(F.size("forms") > 0)
        rows = rows.withColumn("key", sentence_key(F.col("forms"))).withColumn("n_tokens", F.size("forms").cast("long"))
        rows = chunks.carry_header(rows, "header", ["block_no"], "input_index")
        kept = dedup.keep_first(materialize(rows.drop("forms", "tokens", "header")), "key", order)
        sinks.write_table(chunks.running_total(kept, "n_tokens", order), state, replace=True)
        sinks.drop(spark, out)
        sinks.drop(spark, f"{out}.manifest.json")
        sinks.mark(spark, state, given)
    before = sinks.read_json_text(spark, f"{out}.manifest.json")
    closed = [c for c in before["chunks"] if c["n_tokens"] >= tokens_per_chunk] if before else []
    ends = list(itertools.accumulate(c["n_tokens"] for c in closed))
    total = spark.read.parquet(state)
    if target is not None and ends and ends[-1] >= target:  # a smaller target than before: fewer chunks
        closed, ends = [], []
    more = chunks.chunk_ends(total, "n_tokens", tokens_per_chunk, target, ends[-1] if ends else 0)
    packed = chunks.with_chunks(total, ends + more, target).where(F.col("chunk_id") >= len(closed)).drop("_total")
    packed = materialize(chunks.emit_header(packed, "doc_header", "chunk_id", order))
    for r in before["chunks"][len(closed) :] if before else []:
        sinks.drop(spark, f"{out}/chunk_id={r['chunk_id']}")
    sinks.write_chunks(packed, out, order)
    document = sinks.manifest(chunks.chunk_totals(packed, "n_tokens"), [inputs] if isinstance(inputs, str) else list(inputs), target, closed)
    sinks.write_json_text(spark, f"{out}.manifest.json", document)
    sinks.mark(spark, out, config)
    return document


def corpus_report(spark: SparkSession, inputs: str, path: str) -> dict:
    """Provenance of parsed text by its documents' metadata."""
    rows = conllu.read_conllu(spark, inputs)
    heads = rows.where(F.col("header").isNotNull()).select(F.col("input_index").alias("chunk"), conllu.metadata("header").alias("m"))
    docs = materialize(heads.select("chunk", *[F.col("m")[c].alias(n) for c, n in (("newdoc_id", "doc_id"), ("collection", "collection"), ("license", "license"), ("date", "date"), ("creator", "creator"))]))
    once = provenance.documents_once(docs, "doc_id")
    size = rows.where(F.size("forms") > 0).agg(F.count(F.lit(1)).alias("sentences"), F.coalesce(F.sum(F.size("forms")), F.lit(0)).alias("words"))
    ids = docs.agg(F.count_distinct("chunk").alias("n_chunks"), (F.count_distinct("doc_id") + F.count_if(F.col("doc_id").isNull())).alias("documents"), (F.count("doc_id") - F.count_distinct("doc_id")).alias("documents_repeated"))
    totals = ids.crossJoin(size).withColumn("avg_sent_len", F.when(F.col("sentences") > 0, F.col("words") / F.col("sentences")).otherwise(0.0))
    document = report.corpus_document(
        spark, provenance.field_counts(once, ["collection", "license"]), totals, provenance.year_histogram(once, "date"), provenance.head_concentration(once, "creator"), path.removesuffix(".json")
    )
    sinks.write_json_text(spark, path, document)
    return document


def training_table(exp: Experiment, base: DataFrame, x: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """Base and X rows (key, text) in training order: rows (train_idx, text, category).

    At most max_samples_x X rows take part (0: all); with oversample_x they are repeated until
    there are as many as base rows; mixing_strategy places them (start, middle, end, else full_shuffle), and with
    shuffle_within_blocks rows go in hash order within the base and the X block, else by key.
    """
    d = exp.data
    if d.max_samples_x:
        x = sampling.sample_n(x, d.max_samples_x, seed, key)
    order = F.struct(sampling.hash_order(seed, key), F.col(key)) if d.shuffle_within_blocks else F.struct(F.col(key))
    base, x = (df.select(key, "text", order.alias("_order")) for df in (base, x))
    if d.oversample_x:
        x = sampling.oversample(x, "_order", base.count()).select(key, "text", F.struct("round", "_order").alias("_order"))
    parts = []
    for rows, category in ((base, "base"), (x, "X")):
        parts.append(sampling.ranked(rows, "_order", "_pos").select(F.col("_pos").alias("_id"), key, "text", F.lit(category).alias("category")))
    strategy = d.mixing_strategy if d.mixing_strategy in ("start", "middle", "end") else "full_shuffle"
    mixed = sampling.mix(parts[0], parts[1], "_id", strategy, seed)
    placed = mixed.select(F.struct("slot", "kind", "pos").alias("_at"), key, "text", "category")
    return sampling.ranked(placed, "_at", "train_idx").select("train_idx", key, "text", "category")


def transform_for(a: Attribution, train: DataFrame, queries: DataFrame):
    """The matrix that a method puts before products; None for plain ones."""
    if a.method == "vanilla":
        return None
    dim = len(queries.first()["vec"])
    rows = int(dim**0.5)
    if a.method == "trackstar":
        return scoring.trackstar_transform(train, queries, dim, downweight=a.downweight_components, projection=a.projection_dim**2)
    if a.method == "kfac_fused":
        return scoring.fused_transform(train, rows, dim // rows, a.projection_dim, a.lambda_damp)
    whiten = scoring.ekfac_transform if a.method == "ekfac" else scoring.kfac_transform
    return whiten(train, rows, dim // rows, a.lambda_damp, a.projection_dim**2)


def score(exp: Experiment, train: DataFrame, pairs: DataFrame) -> DataFrame:
    """Contrasts of train (train_idx, text or vec) under pairs (pair_idx, text_good/_bad or vec_good/_bad).

    With aggregate_query the pairs are one, of their mean good and mean bad vector, under pair_idx 0.
    """
    a = exp.attribution
    side = "text" if a.method == "bm25" else "vec"
    both = F.explode(F.array(F.struct((F.col("pair_idx") * 2).alias("query_idx"), F.col(f"{side}_good").alias(side)), F.struct((F.col("pair_idx") * 2 + 1).alias("query_idx"), F.col(f"{side}_bad").alias(side))))
    queries = pairs.select(both.alias("q")).select("q.*")
    index = pairs.select("pair_idx", (F.col("pair_idx") * 2).alias("good_idx"), (F.col("pair_idx") * 2 + 1).alias("bad_idx"))
    if a.method == "bm25":
        if a.aggregate_query:
            raise ValueError("texts have no mean: aggregate_query needs vectors")
        scores = scoring.bm25(train.select("train_idx", "text"), queries)
        if a.unit_norm:
            scores = scoring.unit_norm(materialize(scores))
    else:
        transform = transform_for(a, train, queries)
        if a.aggregate_query:
            queries = scoring.aggregate_queries(queries.select("vec", (F.col("query_idx") % 2 == 0).alias("is_good")))
            index = train.sparkSession.createDataFrame([(0, 0, 1)], "pair_idx long, good_idx long, bad_idx long")
        scores = scoring.vector_scores(train, queries, unit=a.unit_norm, transform=transform)
    return scoring.contrast(scores, index)


def pair_labels(spark: SparkSession, exp: Experiment, pairs: DataFrame) -> DataFrame | None:
    """Rows (pair_idx, full, no_x) from the pair results that full_pairs and no_x_pairs name; None where one isn't set, or
    a pair has no result."""
    a, out = exp.attribution, pairs.select("pair_idx", "text_good", "text_bad") if "text_good" in pairs.columns else None
    if out is None or not (a.full_pairs and a.no_x_pairs):
        return None
    for name, path in (("full", a.full_pairs), ("no_x", a.no_x_pairs)):
        joined = views.join_labels(out, spark.read.parquet(path), "pair_idx")
        if not views.all_labelled(joined):
            return None
        out = joined.withColumnRenamed("learned_x", name)
    return out.select("pair_idx", "full", "no_x")


def attribute(spark: SparkSession, exp: Experiment, seed: int, train: DataFrame, pairs: DataFrame, labels: DataFrame | None = None) -> str:
    """Score, rank and write: lookups, first rows by side, contrasts of D_X and of a base sample, precision,
    each for all pairs and for each view with pairs. train needs `category` (X or base); labels (pair_idx, full, no_x), else
    those of the settings' pair results. A facts experiment's pairs have fact_key and verdict, which make its views.
    scoring_base_size leaves all X rows and so many base rows to be scored."""
    out, config = exp.method_dir(seed), asdict(exp) | {"seed": seed}
    if sinks.up_to_date(spark, out, config):
        return out
    a = exp.attribution
    if a.scoring_base_size:
        train = materialize(sampling.scoring_subset(train, a.scoring_base_size))
    asked, pairs = pairs, pairs.limit(1).withColumn("pair_idx", F.lit(0).cast("long")) if a.aggregate_query else pairs
    if labels is None and not a.aggregate_query:
        labels = pair_labels(spark, exp, pairs)
    sinks.write_table(train.select("train_idx", "category", *(["text"] if "text" in train.columns else [])), f"{out}/train_lookup")
    sinks.write_table(asked, f"{out}/query_lookup")
    sparse = materialize(score(exp, train, asked))
    dx, base = train.where("category = 'X'").select("train_idx"), train.where("category <> 'X'").select("train_idx")
    pool, mode = train.select("train_idx"), "full_corpus"
    if a.prec_base_size:
        pool, mode = dx.unionByName(sampling.sample_n(base, a.prec_base_size, 1, "train_idx")), f"base_{a.prec_base_size}"
        sparse = materialize(sparse.join(pool, "train_idx", "left_semi"))
    parts = scoring.dense(dx, pairs, sparse).withColumn("part", F.lit("dx"))
    sample = sampling.sample_n(base, a.stats_base_size, 0, "train_idx") if a.stats_base_size else base
    parts = materialize(parts.unionByName(scoring.dense(sample, pairs, sparse).withColumn("part", F.lit("base"))))
    members: dict[str, DataFrame] = {"": pairs.select("pair_idx")}
    if exp.data.experiment_type == "facts" and {"fact_key", "verdict"} <= set(pairs.columns):
        split = views.fact_views(pairs, "verdict")
        members |= {v: split.where(F.col("view") == v).select("pair_idx") for v in ("learned", "not_learned", "learned_specific", "learned_confounded")}
    elif labels is not None:
        split = views.split_views(labels, "full", "no_x")
        members |= {v: split.where(F.col("view") == v).select("pair_idx") for v in views.VIEWS}
    n = pool.count()
    for view, own in members.items():
        if not own.limit(1).count():
            continue  # an empty view has no output
        rows = sparse.join(own, "pair_idx", "left_semi")
        precision = {}
        for side in rank.SIDES:
            top = materialize(rank.top_k_padded(rows, pool, own, max(a.inspect_top_k, *a.k_precisions), side).join(train.select("train_idx", "category"), "train_idx"))
            sinks.write_table(top.where(F.col("rank") < a.inspect_top_k), exp.output(seed, f"top_inspect_{side}", view))
            marked = top.withColumn("is_dx", F.col("category") == "X")
            precision[side] = rank.macro_precision(rank.precision_at(marked, "is_dx", a.k_precisions, n))
        sinks.write_table(parts.join(own, "pair_idx", "left_semi"), exp.output(seed, "delta_i_stats", view))
        sinks.write_json_text(spark, exp.output(seed, "prec_at_k", view) + ".json", report.precision_document(precision, seed, exp.data.condition, mode))
    sinks.mark(spark, out, config)
    return out


def analyze(spark: SparkSession, exp: Experiment, view: str = "") -> dict:
    """Summaries by seed and over seeds: contrasts of D_X and base, their ratio, the signed-rank test, precision."""
    rows, precision = None, []
    for seed in exp.seeds:
        part = spark.read.parquet(exp.output(seed, "delta_i_stats", view)).withColumn("seed", F.lit(seed))
        rows = part if rows is None else rows.unionByName(part)
        precision.append(sinks.read_json_text(spark, exp.output(seed, "prec_at_k", view) + ".json"))
    summary = stats.summary(rows, "delta_i", ["seed", "part"]).orderBy("seed", "part").collect()
    dx, base = rows.where("part = 'dx'"), rows.where("part = 'base'")
    ratio = stats.base_over_dx(dx, base, "delta_i", []).first()
    means = dx.groupBy("train_idx").agg(F.avg("delta_i").alias("v"))
    w = stats.signed_rank(means, "v", []).first()
    p = stats.signed_rank_p(w["w_plus"], w["n"], w["ties"]) if w is not None and w["n"] else None
    small, strong = ratio is not None and ratio["ratio"] is not None and ratio["ratio"] < 0.1, p is not None and p < 0.05
    document = {
        "seeds": [r.asDict() for r in summary], "ratio": ratio["ratio"] if ratio is not None else None, "p_value": p,
        "precision": report.average_precision(precision), "verdict": "PASS" if small and strong else "PARTIAL" if small or strong else "FAIL",
    }
    sinks.write_json_text(spark, f"{exp.results}/results{'_' + view if view else ''}.json", document)
    return document
