"""Reports: small documents and tables made of aggregates."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import stats
from loomwright.sources import sinks


def precision_document(macro: dict[str, DataFrame], seed: int, condition: str, mode: str) -> dict:
    """prec_at_k by side (contrast, good, bad, exact), k as text."""
    names = {"contrast": "prec_at_k", "good": "prec_at_k_good", "bad": "prec_at_k_bad", "exact": "prec_at_k_exact"}
    doc: dict = {"seed": seed, "condition": condition, "mode": mode}
    for side, rows in macro.items():
        doc[names[side]] = {str(r["k"]): r["prec_at_k"] for r in rows.orderBy("k").collect()}  # one row for each k
    return doc


def pool_size(mode: str, n_rows: int, n_dx: int) -> int:
    """Rows that precision was taken over, from its mode: full_corpus, or base_<n> for all of D_X and n base rows."""
    m = re.fullmatch(r"base_(\d+)", mode)
    return n_rows if m is None else n_dx + int(m[1])


def average_precision(documents: list[dict]) -> dict:
    """Mean, deviation and single values over seeds; k sorted as text, modes listed."""
    out: dict = {"modes": sorted({d["mode"] for d in documents})}
    for k in sorted({k for d in documents for k in d["prec_at_k"]}):
        v = [d["prec_at_k"][k] for d in documents if k in d["prec_at_k"]]
        mean = sum(v) / len(v)
        out[k] = {"mean": mean, "std": (sum((x - mean) ** 2 for x in v) / (len(v) - 1)) ** 0.5 if len(v) > 1 else 0.0, "values": v}
    return out


def method_comparison(methods: dict[str, DataFrame], ks: tuple[int, ...], path: str, documents: dict[str, dict] | None = None) -> None:
    """CSV tables of methods' contrasts (train_idx, pair_idx, delta_i): spread of means, correlations of means
    and by pair, overlap of the first k, spread by pair, and with precision documents the precision at k."""
    means = {m: df.groupBy("train_idx").agg(F.avg("delta_i").alias("v")) for m, df in methods.items()}
    spread = None
    for m, df in means.items():
        row = stats.spread(df.withColumn("method", F.lit(m)), "v", ["method"])
        spread = row if spread is None else spread.unionByName(row)
    sinks.write_csv(spread, f"{path}/dI_distribution")
    names, pairs, overall = sorted(methods), None, None
    for n, a in enumerate(names):
        for b in names[n + 1 :]:
            label = F.lit(f"{a}~{b}")
            joined = methods[a].select("train_idx", "pair_idx", F.col("delta_i").alias("a")).join(methods[b].select("train_idx", "pair_idx", F.col("delta_i").alias("b")), ["train_idx", "pair_idx"])
            each = stats.correlations(joined, "a", "b", ["pair_idx"]).withColumn("methods", label)
            both = means[a].withColumnRenamed("v", "a").join(means[b].withColumnRenamed("v", "b"), "train_idx").withColumn("methods", label)
            total = stats.correlations(both, "a", "b", ["methods"])
            pairs = each if pairs is None else pairs.unionByName(each)
            overall = total if overall is None else overall.unionByName(total)
            for k in ks:
                from loomwright.operators.rank import top_k

                sinks.write_csv(stats.jaccard(top_k(methods[a], k), top_k(methods[b], k), "pair_idx", "train_idx"), f"{path}/jaccard_top{k}/{a}~{b}")
    sinks.write_csv(pair_statistics(methods), f"{path}/per_pair_statistics")
    if documents:
        sinks.write_csv(precision_table(spread.sparkSession, documents), f"{path}/prec_at_k")
    if pairs is not None:
        sinks.write_csv(pairs, f"{path}/per_pair_correlations")
        sinks.write_csv(overall, f"{path}/mean_dI_correlations")


def pair_statistics(methods: dict[str, DataFrame], digits: int = 6) -> DataFrame:
    """Mean, deviation, least and greatest contrast of each pair under each method."""
    out = None
    for m, df in sorted(methods.items()):
        r = lambda c, n: F.round(c, digits).alias(n)
        row = df.groupBy("pair_idx").agg(r(F.avg("delta_i"), "mean"), r(F.stddev_samp("delta_i"), "std"), r(F.min("delta_i"), "min"), r(F.max("delta_i"), "max")).withColumn("method", F.lit(m))
        out = row if out is None else out.unionByName(row)
    return out


def precision_table(spark: SparkSession, documents: dict[str, dict]) -> DataFrame:
    """Rows (method, side, k, prec) of methods' precision documents: a few numbers each."""
    rows = [(m, side, int(k), float(v)) for m, d in documents.items() for side in ("prec_at_k", "prec_at_k_good", "prec_at_k_bad", "prec_at_k_exact") for k, v in d.get(side, {}).items()]
    return spark.createDataFrame(rows, "method string, side string, k int, prec double")


def per_source_document(rows: DataFrame, base: DataFrame, method: str, seed: int, score_std: float) -> dict:
    """rows (fact, source, delta_i) and base rows (fact, delta_i): n, mean and median by fact and source, and of the base."""
    every = stats.per_source(rows, pooled=False).unionByName(stats.per_source(base.withColumn("source", F.lit("base")), pooled=False))
    per_fact: dict = {}
    for r in every.orderBy("fact", "source").collect():  # a few rows for each fact that is asked about
        per_fact.setdefault(str(r["fact"]), {})[r["source"]] = {"n": r["n"], "mean": r["mean"], "median": r["median"]}
    # The names of the document's fields and of the sources.
    return {"method": method, "seed": seed, "n_facts": len(per_fact), "score_std": score_std, "atomic_src_cats": ["cooccur", "subj_occur", "obj_occur"], "per_fact": per_fact}


def write_per_source(rows: DataFrame, base: DataFrame, path: str, **about) -> dict:
    """The document, and the values behind it as a table (fact, source, delta_i)."""
    values = rows.select("fact", "source", "delta_i").unionByName(base.select("fact", F.lit("base").alias("source"), "delta_i"))
    sinks.write_table(values, f"{path}/values")
    document = per_source_document(rows, base, **about)
    sinks.write_json_text(rows.sparkSession, f"{path}/per_source.json", document)
    return document


def corpus_document(spark: SparkSession, counts: DataFrame, totals: DataFrame, years: DataFrame, creators: DataFrame, path: str | None = None) -> dict:
    """Provenance of a corpus: fields' values, totals, years, creators' concentration.

    All values go to the table at path (as numerous as they may be); the document has each field's number of values and total,
    and the values themselves too where no path is given.
    """
    fields: dict = {}
    if path is not None:
        sinks.write_table(counts, f"{path}.values")
        for r in counts.groupBy("field").agg(F.count(F.lit(1)).alias("n_unique"), F.sum("n").alias("total")).collect():
            fields[r["field"]] = {"n_unique": r["n_unique"], "total": r["total"]}
    else:
        for r in counts.orderBy(F.desc("n"), "value").toLocalIterator():
            fields.setdefault(r["field"], {})[r["value"]] = r["n"]
    return {"fields": fields, "corpus_totals": totals.first().asDict(), "year": {r["year"]: r["n"] for r in years.collect()}, "creator": creators.first().asDict()}
