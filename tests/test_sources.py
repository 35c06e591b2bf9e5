import gzip
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import chunks, dedup, filters, provenance
from loomwright.functions.text import sentence_key
from loomwright.sources import arrays, conllu, sinks, tables

def block(text):
    """Rows of one sentence from its words `form/lemma/head/deprel[/feats]`."""
    rows = []
    for n, word in enumerate(text.split(), 1):
        form, lemma, head, deprel, *feats = word.split("/")
        rows.append("\t".join([str(n), form, lemma, "X", "_", feats[0] if feats else "_", head, deprel, "_", "_"]) + "\n")
    return "".join(rows)


KETTLE = block("Kettles/kettle/2/nsubj whistle/whistle/0/root loudly/loudly/2/advmod")
#: A contraction's range row and an empty node are no tokens.
ROWS = block("We/we/3/nsubj 'll/will/3/aux paint/paint/0/root fences/fence/3/obj").replace("2\t'll", "1-2\tWe'll\t_\t_\t_\t_\t_\t_\t_\t_\n2\t'll") + "4.1\tthem\tthem\t_\t_\t_\t_\t_\t_\t_\n"

#: Sentences that a predicate holds for, and near misses.
SENTENCES = {
    "existential_there": (
        ["There/there/2/expl float/float/0/root several/several/4/det boats/boat/2/nsubj offshore/offshore/2/advmod",
         "Today/today/3/advmod there/there/3/expl remain/remain/0/root no/no/6/det good/good/6/amod excuses/excuse/3/nsubj"],
        ["There/there/2/expl lies/lie/0/root old/old/4/amod rope/rope/2/nsubj", "Several/several/2/det boats/boat/3/nsubj sank/sink/0/root there/there/3/advmod",
         "There/there/2/expl stand/stand/0/root barns/barn/2/nsubj behind/behind/6/case many/many/6/det hills/hill/2/obl"],
    ),
    "binding_reflexives": (
        ["Nora/Nora/2/nsubj blamed/blame/0/root herself/herself/2/obj/Reflex=Yes", "They/they/2/nsubj cooked/cook/0/root themselves/themselves/2/iobj soup/soup/2/obj"],
        ["Nora/Nora/3/nsubj herself/herself/1/nmod left/leave/0/root", "Nora/Nora/2/nsubj blamed/blame/0/root them/they/2/obj", "Selfies/selfie/2/nsubj bore/bore/0/root Nora/Nora/2/obj"],
    ),
    "wh_islands": (
        ["What/what/2/det colour/colour/3/nsubj fits/fit/0/root", "Engineers/engineer/2/nsubj asked/ask/0/root which/which/4/det valve/valve/5/nsubj leaked/leak/2/ccomp",
         "Welcher/welch/2/det/PronType=Int Hahn/Hahn/3/nsubj tropft/tropfen/0/root"],
        ["Who/who/2/nsubj phoned/phone/0/root", "That/that/2/det/PronType=Dem valve/valve/3/nsubj leaked/leak/0/root", "Tell/tell/0/root me/I/1/iobj what/what/4/obj broke/break/1/ccomp"],
    ),
    "npi": (
        ["Nobody/nobody/3/nsubj has/have/3/aux replied/reply/0/root yet/yet/3/advmod", "Did/do/3/aux you/you/3/nsubj meet/meet/0/root anyone/anyone/3/obj"],
        ["Everybody/everybody/3/nsubj always/always/3/advmod replied/reply/0/root", "Somebody/somebody/2/nsubj replied/reply/0/root anyway/anyway/2/advmod"],
    ),
}


def test_blocks_and_key(spark, tmp_path):
    (tmp_path / "a.conllu").write_text("# newdoc id = d1\n# meta::license = MIT-0\n# sent_id = 1\n" + ROWS + "\n \n" + ROWS + "\n\n\n" + KETTLE)
    with gzip.open(tmp_path / "b.conllu.gz", "wt") as f:
        f.write(ROWS)
    rows = conllu.read_conllu(spark, str(tmp_path)).orderBy("input_index", "block_no").collect()
    paint = ["We", "'ll", "paint", "fences"]
    assert [r.forms for r in rows] == [paint] * 2 + [["Kettles", "whistle", "loudly"]] + [paint]
    assert rows[0].header.startswith("# newdoc") and rows[1].header is None and "# sent_id" in rows[0].sent_block
    blocks = conllu.read_conllu(spark, str(tmp_path)).withColumn("key", sentence_key(F.col("forms")))
    import hashlib

    assert {r.key for r in blocks.collect()} == {hashlib.md5(t).hexdigest()[:16] for t in (b"We 'll paint fences", b"Kettles whistle loudly")}
    assert dedup.keep_first(blocks, "key", ["input_index", "block_no"]).count() == 2
    meta = conllu.read_conllu(spark, str(tmp_path)).where("header is not null").select(conllu.metadata("header").alias("m")).first().m
    assert meta == {"license": "MIT-0", "newdoc_id": "d1"}


def test_order_is_that_of_the_inputs(spark, tmp_path):
    for name, text in (("z", KETTLE + "\n" + ROWS), ("a", ROWS)):
        (tmp_path / name).write_text(text)
    rows = conllu.read_conllu(spark, [str(tmp_path / "z"), str(tmp_path / "a")]).orderBy("input_index", "block_no").collect()
    assert [(r.input_index, r.forms[0]) for r in rows] == [(0, "Kettles"), (0, "We"), (1, "We")]


def test_filters_on_own_sentences_and_near_misses(spark, tmp_path):
    for name, (good, bad) in SENTENCES.items():
        (tmp_path / f"{name}.yes").write_text("\n".join(block(t) for t in good))
        (tmp_path / f"{name}.no").write_text("\n".join(block(t) for t in [*bad]))
    (tmp_path / "neutral").write_text(KETTLE)
    rows = conllu.read_conllu(spark, str(tmp_path)).select("path", "forms", *[f(F.col("tokens")).alias(n) for n, f in filters.FILTERS.items()])
    seen = rows.collect()
    assert len(seen) == 1 + sum(len(g) + len(b) for g, b in SENTENCES.values())
    for r in seen:
        own, _, kind = r.path.rsplit("/", 1)[1].partition(".")
        for name in filters.FILTERS:
            if own in (name, "neutral"):
                assert r[name] == (kind == "yes"), (r.forms, name)
    x, base = filters.split_corpus(rows, F.col("npi"))
    assert x.count() >= 2 and x.count() + base.count() == len(seen)


def test_chunks_repeat_headers(spark, tmp_path):
    text = "# newdoc id = d\n# meta::license = MIT-0\n" + ROWS + "\n" + KETTLE + "\n" + block(SENTENCES["npi"][0][0])
    (tmp_path / "in.conllu").write_text(text)
    rows = conllu.read_conllu(spark, str(tmp_path / "in.conllu")).withColumn("n_tokens", F.size("forms").cast("long"))
    rows = chunks.carry_header(rows, "header", ["block_no"], "input_index")
    packed = chunks.pack_chunks(rows, "n_tokens", ["block_no"], 1)
    assert sorted(r.chunk_id for r in packed.collect()) == [0, 1, 2]
    out = chunks.emit_header(packed, "doc_header", "chunk_id", ["block_no"])
    sinks.write_chunks(out, str(tmp_path / "out"), ["block_no"])
    files = [p.read_text() for p in (tmp_path / "out").glob("chunk_id=*/part-*")]
    assert len(files) == 3 and all("# meta::license = MIT-0" in t for t in files)
    found = sinks.manifest(chunks.chunk_totals(packed, "n_tokens"), ["in"], None)
    assert found["tokens"] == 4 + 3 + 4 and len(found["chunks"]) == 3


def test_metadata_counts(spark):
    docs = spark.createDataFrame([("a", "Harbour Log", "1907-11-23"), ("a", "Harbour Log", "1907-11-23"), (None, "Almanac", None), (None, "", "undated")], "id string, collection string, date string")
    once = provenance.documents_once(docs, "id")
    counts = {(r.field, r.value): r.n for r in provenance.field_counts(once, ["collection"]).collect()}
    assert counts == {("collection", "Harbour Log"): 1, ("collection", "Almanac"): 1, ("collection", ""): 1}
    assert {r.year: r.n for r in provenance.year_histogram(once, "date").collect()} == {"1907": 1, "unparsed": 1}


def test_readers(spark, tmp_path):
    (tmp_path / "P1.jsonl").write_text(json.dumps({"sub_id": "Q1", "sub_label": "X", "sub_aliases": ["Y"], "obj_id": "Q2", "obj_label": "Z", "answer_idx": 0}) + "\n")
    assert tables.fact_instances(spark, str(tmp_path / "P1.jsonl")).collect()[0].asDict() == {"relation": "P1", "subject": "X", "correct_object": "Z", "sub_aliases": ["Y"], "answer_idx": 0}
    (tmp_path / "pairs.jsonl").write_text(json.dumps({"sentence_good": "g", "sentence_bad": "b"}) + "\n")
    assert tables.minimal_pairs(spark, str(tmp_path / "pairs.jsonl")).first().text_good == "g"
    (tmp_path / "npi.tsv").write_text("sen\twrong_sen\tsent_id\tlemma\tenv\tnpi_to_neg_distance\tsent_len\tmultiple_npis\na\tb\t1\tx\ty\t2\t3\tno\n")
    assert tables.manual_pairs(spark, str(tmp_path / "npi.tsv")).first().text_bad == "b"
    (tmp_path / "alias.json").write_text(json.dumps({"A": ["a", "b"]}))
    assert tables.alias_cache(spark, str(tmp_path / "alias.json")).first().aliases == ["a", "b"]
    assert tables.alias_cache(spark, None).count() == 0
    stats = {"relations": {"P1": {"instances": [{"subject": "s", "correct_object": "o", "by_dataset": {"d": {"subject": 3, "object": 2, "cooccur": 1}}}, {"subject": "s", "correct_object": "o", "by_dataset": {}}]}}}
    (tmp_path / "stats.json").write_text(json.dumps(stats))
    assert tables.corpus_counts(spark, str(tmp_path / "stats.json"), "d").first().n_subject == 0
    (tmp_path / "chunk_07").mkdir()
    (tmp_path / "chunk_07" / "x.txt").write_text("  one \n\n two\n")
    assert [(r.text, r.chunk, r.category) for r in tables.lines(spark, str(tmp_path / "chunk_07"), "base").orderBy("line_no").collect()] == [("one", "07", "base"), ("two", "07", "base")]


def test_fingerprints(spark, tmp_path):
    path = str(tmp_path / "out")
    assert not sinks.up_to_date(spark, path, {"k": 1})
    sinks.mark(spark, path, {"k": 1})
    assert sinks.up_to_date(spark, path, {"k": 1}) and not sinks.up_to_date(spark, path, {"k": 2})


def test_raw_lines_end_at_all_separators(spark, tmp_path):
    text = " a  b\x0bc\x0cd\x85e\x1cf\n\ng \n"
    (tmp_path / "t.txt").write_text(text, newline="")
    assert [r.text for r in tables.raw_lines(spark, str(tmp_path / "t.txt")).collect()] == text.splitlines()
    assert tables.raw_lines(spark, str(tmp_path / "none.txt")).count() == 0


def test_chunk_folders(spark, tmp_path):
    for name in ("chunk_10", "chunk_02", "other"):
        (tmp_path / name).mkdir()
    (tmp_path / "chunk_02" / "f.txt").write_text("x\n")
    assert tables.chunk_ids(spark, str(tmp_path)) == ["02", "10"]
    rows, missing = tables.concat_chunks(spark, str(tmp_path), None, "f.txt")
    assert [(r.text, r.chunk) for r in rows.collect()] == [("x", "02")] and missing == ["10"]


def test_country_sidecar_needs_all_its_parts(spark, tmp_path):
    rows = spark.createDataFrame([("one",), ("two",), ("none",)], "text string")
    call = lambda n: tables.country_sidecar(spark, rows, str(tmp_path / "by"), str(tmp_path / "q.txt"), n)
    assert call(2) is None
    (tmp_path / "by").mkdir()
    (tmp_path / "by" / "aa.txt").write_text("one\n two \n")
    (tmp_path / "by" / "bb.txt").write_text("one\n")
    (tmp_path / "q.txt").write_text("aa\n\nbb\n")
    assert call(3) is None
    texts, asked = call(2)
    assert {r.text: r.slug for r in texts.collect()} == {"one": "bb", "two": "aa", "none": None}
    assert sorted(map(tuple, asked.collect())) == [(0, "aa"), (1, "bb")]


def test_stored_scores_in_ranges(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "RANGE", 100)  # a few records to a task
    dtype = np.dtype({"names": ["score_0", "score_1", "note"], "formats": ["<f4", "<f8", "<i4"], "offsets": [0, 8, 16], "itemsize": 24})
    records = np.zeros(57, dtype=dtype)
    records["score_0"], records["score_1"] = np.arange(57) / 2, -np.arange(57.0)
    records.tofile(tmp_path / "scores.bin")
    info = {"num_items": 57, "num_scores": 2, "dtype": {"names": list(dtype.names), "formats": ["<f4", "<f8", "<i4"], "offsets": [0, 8, 16], "itemsize": 24}}
    (tmp_path / "info.json").write_text(json.dumps(info))
    got = arrays.score_matrix(spark, str(tmp_path)).orderBy("train_idx").collect()
    assert [(r.train_idx, r.pair_idx, r.score_good, r.score_bad) for r in got] == [(i, 0, i / 2, -float(i)) for i in range(57)]
    with pytest.raises(ValueError):
        arrays.single_score(spark, str(tmp_path))
    np.savez_compressed(tmp_path / "s.npz", dx=np.arange(60, dtype=np.float32), base=np.arange(6, dtype=np.float64), n_pairs=np.int64(3))
    for _ in range(2):  # unpacked once
        arrays.unpack(str(tmp_path / "s.npz"), str(tmp_path / "raw"))
    rows = arrays.contrasts(spark, str(tmp_path / "raw")).collect()
    assert sorted((r.part, r.pair_idx, r.row, r.delta_i) for r in rows) == sorted([("dx", i // 20, i % 20, float(i)) for i in range(60)] + [("base", i // 2, i % 2, float(i)) for i in range(6)])
