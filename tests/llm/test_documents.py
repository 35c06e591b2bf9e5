"""Operators over documents: toxicity, BPE, suffix arrays, SimHash, packing, pipeline."""

import hashlib
import random
import time
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.llm import bpe, common, packing, simhash, suffix, toxicity
from loomwright.llm.components import connected_components
from loomwright.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, id string, rep int, _salt int, _id string, n_chars long"


def docs(spark, texts):
    """Documents with columns whose names clash with those used inside."""
    rows = [(i, t, "x", 7, 3, "y", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randint(0, words)}" for _ in range(n))


EDGES = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "A b C d"), (5, "A b C d"), (6, "é " * 3000)]


# -- components ---------------------------------------------------------------


def brute_components(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(170)] + [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2060)]
    df = spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == {n: c for n, c in brute_components({n for e in edges for n in e}, edges).items() if n in nodes}
    names = spark.createDataFrame([("b", "a"), ("c", "b")], "a string, b string")
    assert {r.node: r.component for r in connected_components(names).collect()} == {"a": "a", "b": "a", "c": "a"}
    assert connected_components(df.limit(0)).count() == 0


# -- SimHash ------------------------------------------------------------------


def brute_fingerprint(text, k=4):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", folded) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_edges():
    for t in [None, "", " \x0b\x0c ", "A", "a b c", "ÀB c d e f g", "x " * 70_000]:
        assert int.from_bytes(simhash.text_fingerprint(t, 4), "little") == brute_fingerprint(t)


def test_ring_never_loses_a_pair():
    rng = np.random.default_rng(2)
    for radius, words in ((2, 1), (4, 1), (6, 1), (56, 4)):
        bits = np.zeros((3000, 64 * words), dtype=np.uint8)
        for n in range(3000):
            bits[n, rng.choice(64 * words, size=rng.integers(0, radius + 1), replace=False)] = 1
        x = np.packbits(bits, axis=1, bitorder="little").view("<u8")
        for distinct in (10, 10**8, 10**12) if words == 1 else (10,):
            widths, k = simhash.ring_segments(radius, distinct) if words == 1 else (None, 0)
            diff = simhash.segment_differences(x, widths)
            assert (diff.sum(axis=1) == bits.sum(axis=1)).all() and ((diff == 0).sum(axis=1) >= k).all()
            assert simhash.ring_passes(diff, radius).all()
        far = rng.integers(0, 2**63, (3000, words)).astype(np.uint64)
        assert simhash.ring_passes(simhash.segment_differences(far, widths), radius).mean() < 0.1


@pytest.mark.parametrize("crowd", [8, 0])
def test_simhash_components_by_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "BLOCK", 16)  # hot buckets are dealt out in blocks
    monkeypatch.setattr(simhash, "CROWD", crowd)  # none: the widest keys, as for very large tables
    rng = random.Random(4)
    texts = list(EDGES)
    base = prose(rng, 400).split()
    for i in range(120):
        words = list(base)
        if i % 3:
            words[rng.randrange(400)] = f"z{i}"
        texts.append((100 + i, " ".join(words)))
    texts += [(400 + i, prose(rng, rng.randint(1, 60))) for i in range(80)]
    got = simhash.simhash_components(docs(spark, texts), shingle=4, radius=4).collect()
    fps = [(i, brute_fingerprint(t)) for i, t in texts]
    links = [(a, b) for n, (a, x) in enumerate(fps) for b, y in fps[:n] if (x ^ y).bit_count() <= 4]
    want = brute_components({i for i, _ in texts}, links)
    assert len(got) == len(texts)
    assert sorted((r.id, int.from_bytes(r.fp, "little"), r.component) for r in got) == sorted((i, f, want[i]) for i, f in fps)


def test_simhash_without_rows(spark):
    assert simhash.simhash_components(docs(spark, []), radius=4).count() == 0
    assert simhash.simhash_components(docs(spark, [(None, "a b")]), radius=4).count() == 0


def jaccard(a, b, k=5):
    s = [{tuple(t.split()[i : i + k]) for i in range(max(1, len(t.split()) - k + 1))} for t in (a, b)]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_near_duplicates_at_similarity(spark):
    rng = random.Random(9)
    texts, kept = [], set()
    for g in range(25):
        base = prose(rng, 200, 5000).split()
        texts.append((10 * g, " ".join(base)))
        kept.add(10 * g)
        near = list(base)
        for p in rng.sample(range(200), 3):
            near[p] = "changed"
        texts.append((10 * g + 1, " ".join(near)))
        far = list(base)
        for p in range(0, 200, 9):
            far[p] = f"other{p}"
        texts.append((10 * g + 2, " ".join(far)))
        assert jaccard(" ".join(base), " ".join(near)) >= 0.8 > jaccard(" ".join(base), " ".join(far))
        kept.add(10 * g + 2)
    out = simhash.near_duplicates(docs(spark, [*texts, (None, "kept as it is")]))
    assert out.columns == SCHEMA.replace(",", "").split()[::2]
    assert {r.doc_id for r in out.collect()} == kept | {None}


# -- suffix arrays --------------------------------------------------------------


def template_family(rng, n, twin=0):
    """Texts on one template, shuffled: 100 words of each are its own, so that two agree in their first 400 words
    (similarity 0.66 by shingles); text 2k + 1 is text 2k with `twin` words changed."""
    template = prose(rng, 400, 10**6)
    texts = []
    for g in range(n // 2):
        own = prose(rng, 100, 10**6).split()
        other = list(own)
        for p in range(twin):
            other[10 * p + 3] = f"t{g}x{p}"
        texts += [f"{template} {' '.join(own)}", f"{template} {' '.join(other)}"]
    return list(enumerate(texts))


def test_near_duplicates_in_a_template_family(spark, monkeypatch):
    """Noisier, nearer fingerprints between families must not hide true pairs."""
    monkeypatch.setattr(simhash, "SETS", 64)  # trees are dealt out in blocks
    texts = template_family(random.Random(21), 300, twin=9)
    assert jaccard(texts[0][1], texts[1][1]) >= 0.8 and jaccard(texts[0][1], texts[2][1]) < 0.75
    out = simhash.near_duplicates(docs(spark, texts))
    kept = {r.doc_id for r in out.collect()}
    assert {i for i, _ in texts if i % 2 == 0} <= kept
    gone = 150 - len({i for i in kept if i % 2})
    assert gone >= 145  # 2 % of the pairs at 0.8 do not meet in a bucket


def test_recall_of_near_duplicates(spark):
    """Pairs at a similarity of 0.80 to 0.83 (brute force over shingle sets) are in one group, others are not."""
    rng = random.Random(31)
    texts, pairs = [], []
    while len(pairs) < 300:
        words = prose(rng, 300, 10**6).split()
        other = list(words)
        for p in rng.sample(range(10, 290), 6):
            other[p] = f"y{rng.randint(0, 10**6)}"
        a, b = " ".join(words), " ".join(other)
        if 0.8 <= jaccard(a, b) < 0.83:
            pairs.append((2 * len(pairs), 2 * len(pairs) + 1))
            texts += [(pairs[-1][0], a), (pairs[-1][1], b)]
    far = [(1000 + i, prose(rng, 300, 10**6)) for i in range(100)]
    kept = {r.doc_id for r in simhash.near_duplicates(docs(spark, texts + far)).collect()}
    assert {a for a, _ in pairs} | {i for i, _ in far} <= kept
    assert sum(b not in kept for _, b in pairs) >= 0.97 * len(pairs)


def test_repeated_lines_do_not_decide_near_duplicates(spark):
    rng = random.Random(17)
    line = " ".join([prose(rng, 11)] * 400)
    a, b, c = (prose(rng, 300, 10**6) for _ in range(3))
    texts = [(1, f"{line} {a}"), (2, f"{line} {b}"), (3, c), (4, f"{c} {line}")]
    assert simhash.text_fingerprint(texts[0][1], 5, 4) == simhash.text_fingerprint(texts[1][1], 5, 4)
    assert jaccard(texts[0][1], texts[1][1]) < 0.1 and jaccard(texts[2][1], texts[3][1]) > 0.9
    kept = {r.doc_id for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert kept == {1, 2, 3}


def forest_weights(monkeypatch, fps, flush):
    monkeypatch.setattr(simhash, "FLUSH", flush, raising=False)
    n = len(fps)
    pdf = pd.DataFrame({"key": np.zeros(n, np.int64), "_b1": 0, "_b2": 0, "_blk": 0, "rep": np.arange(n), "fp": [f.tobytes() for f in fps]})
    links = pd.concat(simhash._edges(30, 2, None, True)([pdf]))
    return sorted(int(np.bitwise_count(fps[a] ^ fps[b]).sum()) for a, b in zip(links["a"], links["b"], strict=True))


def test_forest_is_nearest_first_across_flushes(monkeypatch):
    """1300 mutually near rows are more than 400,000 near pairs; half of them have a nearer twin."""
    bits = np.random.default_rng(8).random((1300, 128)) < 0.09
    bits[650:] = bits[:650]
    bits[650:, :2] ^= True
    fps = np.packbits(bits, axis=1, bitorder="little").view("<u8")
    n = sum(int(np.bitwise_count(fps[i + 1 :] ^ fps[i]).sum(axis=1).__le__(30).sum()) for i in range(1300))
    want = forest_weights(monkeypatch, fps, 10**9)
    assert n > 400_000 and len(want) == 1299 and want.count(2) >= 650
    assert forest_weights(monkeypatch, fps, 400_000) == want == forest_weights(monkeypatch, fps, 1000)


def test_similar_forest_by_brute_force():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 60).astype(np.uint64)
    sets = [np.unique(pool[rng.random(60) < rng.choice([0.5, 0.95])]) for _ in range(60)]
    sets[7] = sets[8] = np.zeros(0, np.uint64)
    fp = rng.integers(0, 4, (60, 2)).astype(np.uint64)
    component = rng.integers(0, 40, 60)
    got = simhash.similar_forest(component, fp, sets, 2, 0.8)
    joins = [(int(i), int(np.flatnonzero(component == component[i])[0])) for i in range(60)]
    good = [
        (i, j) for i in range(60) for j in range(i)
        if np.bitwise_count(fp[i] ^ fp[j]).sum() <= 2 and len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
    ]
    assert set(got) <= {(j, i) for i, j in good}
    assert brute_components(range(60), joins + got) == brute_components(range(60), joins + good)


def brute_repeats(texts, least=50):
    first = {}
    words = [(i, (t or "").encode().split()) for i, t in texts]
    for i, w in words:
        for k in range(len(w) - least + 1):
            first[tuple(w[k : k + least])] = min(i, first.get(tuple(w[k : k + least]), i))
    out = {}
    for i, w in words:
        at = {p for k in range(len(w) - least + 1) if first[tuple(w[k : k + least])] < i for p in range(k, k + least)}
        if at:
            out[i] = at
    return out


def covered(rows):
    return {r.id: {p for s in r.spans for p in range(s.start, s.stop)} for r in rows}


@pytest.mark.parametrize("group, keys", [(8, 20_000), (2, 20_000), (2, 10)])
def test_repeats_by_brute_force(spark, monkeypatch, group, keys):
    monkeypatch.setattr(suffix, "GROUP", group)  # hot seeds are dealt out
    monkeypatch.setattr(suffix, "HOT_KEYS", keys)  # few: only some of them are broadcast
    rng = random.Random(5)
    passages = [prose(rng, n) for n in (49, 50, 51, 60, 75, 140)]
    texts = [(i, t) for i, t in EDGES if i != 5]
    for i in range(60):
        parts = [prose(rng, rng.randint(0, 80))]
        for p in rng.sample(passages, rng.randint(0, 2)):
            parts += [p, prose(rng, rng.randint(0, 40))]
        texts.append((100 + i, "\n".join(parts)))
    texts += [(i, passages[3]) for i in range(300, 340)]
    texts.append((500, "la " * 500))
    got = covered(suffix.repeats(docs(spark, texts)).collect())
    assert got == brute_repeats(texts) and 500 not in got
    assert suffix.repeats(docs(spark, [])).count() == 0
    again = suffix.repeats(docs(spark, [(7, passages[5])] * 3)).count()
    assert again == 0  # a repeated id is one document


def test_minimisers_do_not_depend_on_stretches(monkeypatch):
    words = suffix.Words([prose(random.Random(3), 5000), "x", prose(random.Random(4), 70)])
    whole = words.minimisers()[0]
    monkeypatch.setattr(suffix, "STRETCH", 37)
    assert (words.minimisers()[0] == whole).all() and len(whole) > 300


def test_hot_buckets_meet_in_pairs_of_blocks(spark, monkeypatch):
    """Each pair of a bucket meets once, whether its count is broadcast or joined."""
    from loomwright.llm import common

    rows = [(k, i) for k, n in ((1, 40), (2, 9), (3, 3), (4, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "key long, rep long")
    for keys in (20_000, 4, 1):
        monkeypatch.setattr(common, "HOT_KEYS", keys)
        met = Counter()
        groups = {}
        for r in common.split_hot(df, "key", "rep", 4, len(rows)).collect():
            groups.setdefault((r.key, r._b1, r._b2), []).append(r)
        for (k, b1, b2), members in groups.items():
            for a in members:
                for b in members:
                    if a.rep < b.rep and (b1 == b2 or a._blk != b._blk):
                        met[k, a.rep, b.rep] += 1
        assert met == {(k, a, b): 1 for k, a in rows for j, b in rows if k == j and a < b}


def test_repeats_across_the_groups_of_a_frequent_seed(spark, monkeypatch):
    """Passages behind a frequent line, which the seed's first document does not share."""
    monkeypatch.setattr(suffix, "GROUP", 8)
    rng = random.Random(13)
    line = prose(rng, 47)
    tails = [prose(rng, 4, 10**6) for _ in range(40)]
    texts = [(1, f"{prose(rng, 30)} {line} {prose(rng, 30)} {line} {tails[0]}")]
    for g, tail in enumerate(tails):
        texts += [(10 + 3 * g + c, f"{prose(rng, 30, 10**6)} {line} {tail} {prose(rng, 30, 10**6)}") for c in range(3)]
    got = covered(suffix.repeats(docs(spark, texts)).collect())
    want = brute_repeats(texts)
    assert got == want and len(want) == 81


def test_repeats_go(spark):
    rng = random.Random(6)
    p, own = prose(rng, 60), prose(rng, 30)
    out = suffix.drop_repeats(docs(spark, [(1, f"{p} tail"), (2, f"{own}\n{p}\n{own}"), (3, p), (4, None), (None, p), (5, "clean  text ")]))
    rows = {r.doc_id: r for r in out.collect()}
    assert set(rows) == {1, 2, 4, None, 5} and out.columns == SCHEMA.replace(",", "").split()[::2]
    assert rows[2].text == f"{own}\n{own}" and rows[2].n_chars == len(rows[2].text)
    assert rows[1].text == f"{p} tail" and rows[5].text == "clean  text " and rows[4].text is None


def shuffled(spark):
    """Bytes that all shuffles of the session have written so far."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    found = context.statusStore().executorList(False)
    return sum(found.apply(n).totalShuffleWrite() for n in range(found.size()))


def test_texts_that_hold_no_repeat_are_not_shuffled(spark, tmp_path):
    rng = random.Random(31)
    texts = [(i, " ".join(f"{rng.getrandbits(40):x}" for _ in range(200))) for i in range(1500)]
    shared = " ".join(texts[3][1].split()[20:90])
    texts += [(1500, f"before {shared} after"), (None, shared), (1501, None), (1502, texts[7][1]), (1503, f"{texts[8][1]} x")]
    docs(spark, texts).write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs"))
    size = sum(len(t or "") for _, t in texts)
    for stage, left in ((suffix.drop_repeats, {1500: "before after", 1503: "x"}), (simhash.near_duplicates, {1500: f"before {shared} after"})):
        before = shuffled(spark)
        got = [(r.doc_id, r.text) for r in stage(df).collect()]
        assert shuffled(spark) - before < 0.5 * size
        want = [(i, left.get(i, t)) for i, t in texts if i not in ({1502} if left.get(1503) else {1502, 1503})]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_sieve(spark, monkeypatch):
    rows = spark.range(20_000).selectExpr("if(id % 1000 = 7, null, id - 5000) as id", "id as n")
    keys = spark.range(300).selectExpr("id * 61 - 5000 as k").unionByName(spark.createDataFrame([(5,)] * 50, "k long"))
    want = {r.k for r in keys.collect()} & {r.id for r in rows.collect()}
    for bits, most in ((1 << 26, 5), (1 << 15, 400), (1 << 8, 20_000)):
        monkeypatch.setattr(common, "SIEVE", bits)
        some, others = common.sieve(rows, rows["id"], keys)
        some, others = some.collect(), others.collect()
        assert {r.id for r in some} >= want and not want & {r.id for r in others}
        assert sorted(r.n for r in some + others) == list(range(20_000))
        assert len(some) <= len(want) + most
    some, others = common.sieve(rows, rows["id"], keys.limit(0))
    assert some.count() == 0 and others.count() == 20_000


# -- packing --------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plan_covers_the_histogram(histogram):
    plan = packing.plan_patterns(histogram, 40)
    used = Counter()
    for use, times in plan:
        assert sum(use) <= 40 and times > 0
        for n in use:
            used[n] += times
    assert dict(used) == histogram
    total = sum(n * c for n, c in histogram.items())
    assert -(-total // 40) <= sum(t for _, t in plan) <= max(1, 2 * total // 40 + 1)


def test_exact_complements_fill():
    assert sum(t for _, t in packing.plan_patterns({900: 5, 124: 5, 500: 2, 300: 2, 224: 2, 400: 1, 324: 1, 150: 2})) == 8


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer
    import public_tokenizers as P

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(7)
    texts = [*EDGES, (8, "a<|endoftext|>b <|endoftext|"), (9, prose(rng, 3000)), (None, "no id"), *[(20 + i, prose(rng, rng.randint(1, 300))) for i in range(60)]]
    rows = packing.pack(docs(spark, texts)).collect()
    ids = Counter()
    for i, t in texts:
        ids[i, tuple([*library.encode(t or "", add_special_tokens=False).ids, 2])] += 1
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.id, []).append(r)
    for (i, seq), copies in ids.items():
        own = [r for r in by_doc[i] if r.start + r.length <= len(seq)]
        for r in own:
            assert r.crc == zlib.crc32(np.array(seq[r.start : r.start + r.length], dtype="<u4").tobytes())
        assert sum(r.length for r in by_doc[i]) == len(seq) * copies
        assert all(r.length == 1024 for r in own if r.piece > 0)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.pack(docs(spark, [])).count() == 0


def test_long_runs_are_packed(spark):
    """Unbroken runs of white space, letters and marks of a million characters, ids equal to the contract's library."""
    from tokenizers import Tokenizer
    import public_tokenizers as P

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = [(1, " " * 1_000_000 + "a"), (2, "ab" * 500_000), (3, "x" + " \n" * 600_000), (4, "?" * 300_000), (5, "a <|endoftext|>" + "\t" * 20_000)]
    rows = packing.pack(docs(spark, texts)).collect()
    for i, t in texts:
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 2], dtype="<u4")
        own = sorted((r for r in rows if r.id == i), key=lambda r: r.piece)
        assert [r.crc for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
        assert sum(r.length for r in own) == len(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=9))
def test_number_of_sequences_against_all_packings(lengths):
    """At most one sequence more than the best of all packings, which small tables let us try."""

    def best(left, bins):
        if not left:
            return len(bins)
        found = len(bins) + len(left)
        for at, used in enumerate(bins):
            if used + left[0] <= 10 and used not in bins[:at]:
                found = min(found, best(left[1:], [*bins[:at], used + left[0], *bins[at + 1 :]]))
        return min(found, best(left[1:], [*bins, left[0]]))

    plan = packing.plan_patterns(dict(Counter(lengths)), 10)
    assert best(sorted(lengths, reverse=True), []) <= sum(t for _, t in plan) <= best(sorted(lengths, reverse=True), []) + 1


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_byte_bpe_equals_library(text):
    global _byte
    try:
        enc, library = _byte
    except NameError:
        from tokenizers import Tokenizer
        import public_tokenizers as P

        enc, library = _byte = packing.default_encoder(), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert enc(text).tolist() == library.encode(text, add_special_tokens=False).ids


# -- BPE ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return bpe.WordBpe(bpe.default_path()), Tokenizer.from_file(bpe.default_path())


def same(word_bpe, text):
    own, library = word_bpe
    want = library.encode(text, add_special_tokens=False).ids
    n, ids, decoded = bpe._Encoder(own, None).text(text)
    return (n, ids, decoded) == (len(want), " ".join(map(str, want)), library.decode(want, skip_special_tokens=False))


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_word_bpe_equals_library(text):
    assert same(_words(), text)


def _words():
    global _word
    try:
        return _word
    except NameError:
        from tokenizers import Tokenizer

        _word = bpe.WordBpe(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
        return _word


def test_word_bpe_on_each_kind_of_character(word_bpe):
    points = [*range(0x600), *range(0x2000, 0x2100), 0x558, 0x1C89, 0xA7DC, 0x3FC3B, 0x1F600, 0xFEFF, 0x130]
    assert [hex(c) for c in points if not same(word_bpe, f"a{chr(c)}b1 {chr(c)}")] == []
    for t in ["", "<|startoftext|>a <|ENDOFTEXT|><|endoftext|>", "ΑΣ Σ'S don't WE'LL", "é １２ ½", "x" * 3000]:
        assert same(word_bpe, t)


def test_lexicon_is_minimal_and_exact(tmp_path):
    rng = random.Random(8)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))): [rng.randint(0, 99) for _ in range(rng.randint(1, 4))] for _ in range(3000)}
    blob = bpe.compile_lexicon(words)
    (tmp_path / "lex").write_bytes(blob)
    lexicon = bpe.Lexicon(str(tmp_path / "lex"))
    assert all(lexicon.get(w.encode()) == ids for w, ids in words.items())
    assert all(lexicon.get(w) is None for w in (b"", b"zz", b"abcabcabcabc"))
    futures, arcs = {}, {}
    for cell, owner in enumerate(lexicon.owner):
        if owner >= 0:
            arcs.setdefault(owner, []).append((cell - lexicon.base[owner], lexicon.target[cell]))
    for state, final in enumerate(lexicon.ends):
        assert futures.setdefault((final, tuple(arcs.get(state, []))), state) == state  # no two states have one future


def test_unbroken_words_of_any_length(word_bpe):
    rng = random.Random(9)
    letters = "".join(rng.choice("etaoinshrdlu") for _ in range(1_000_000))
    begun = time.process_time()
    assert same(word_bpe, letters) and same(word_bpe, "!" * 200_000) and same(word_bpe, "é" * 100_000 + " " * 500_000 + "7" * 50_000)
    assert time.process_time() - begun < 600  # quadratic merging takes hours
    for n in (bpe.SHORT - 1, bpe.SHORT, bpe.SHORT + 1):
        assert same(word_bpe, letters[:n] + " " + "é" * n)


def test_bpe_operator(spark, word_bpe):
    texts = [*EDGES, (None, "no id"), (9, "ß<|endoftext|>") ]
    rows = bpe.encode(docs(spark, texts), lexicon_words=3).collect()
    assert len(rows) == len(texts)
    want = Counter()
    for i, t in texts:
        ids = word_bpe[1].encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), " ".join(map(str, ids)), word_bpe[1].decode(ids, skip_special_tokens=False)] += 1
    assert Counter(tuple(r) for r in rows) == want
    assert bpe.encode(docs(spark, [])).count() == 0


def test_bpe_query(spark, sf_dir, word_bpe):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for r in rows:
        ids = word_bpe[1].encode(r.text, add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), *[hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), word_bpe[1].decode(ids, skip_special_tokens=False))])
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op4_bpe"](spark, sf_dir).collect()}
    assert got == want


# -- toxicity -------------------------------------------------------------------


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)], "doc_id long, toxic int, text string")
    texts = [(i, f"{'you idiot' if i % 2 else 'good day'} number {i}") for i in range(40)]
    df = docs(spark, [*texts, (50, None), (51, ""), (52, "idiot " * 20_000), (None, "x"), (52, "again")])
    rows = toxicity.toxicity(df, labels).collect()
    assert len(rows) == 45 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows if r.id is not None)
    own = {r.id: r.predicted for r in rows if r.id is not None and r.id < 40}
    assert sum(own[i] == i % 2 for i in range(40)) >= 38
    one_class = toxicity.toxicity(df, labels.withColumn("toxic", F.lit(1))).collect()
    assert len({r.score for r in one_class}) == 1
    assert toxicity.toxicity(docs(spark, []), labels).count() == 0
    assert toxicity.toxicity(df, labels.limit(0)).count() == 45
    kept = toxicity.drop_toxic(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} >= {i for i in range(0, 40, 2) if own[i] == 0}


def test_held_out_labels_change_nothing(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    df = docs(spark, [(i, f"{'bad fool' if i % 2 else 'fine'} {i}") for i in range(60)])
    a, b = ({r.id: r.score for r in toxicity.toxicity(df, x).collect()} for x in (labels, flipped))
    assert a == b


def test_toxicity_accuracy_on_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op3_toxicity"](spark, sf).where("held_out").toPandas()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    m = rows.merge(labels, on="doc_id")
    pos, neg = m.score[m.toxic == 1].to_numpy(), m.score[m.toxic == 0].to_numpy()
    assert (pos[:, None] > neg).mean() > 0.9


# -- pipeline -------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p

    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = df.count()
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, df, sf_dir)
        assert out.columns == df.columns, name
        n = out.count()
        assert 0 < n <= before
        before, df = n, out
    assert p.run(spark, sf_dir).count() > 0
    assert [n for n, _ in p.STAGES] == ["toxicity", "simhash near-dedup", "suffix-array dedup", "best-fit packing"]


def test_pipeline_on_planted_documents(spark, tmp_path):
    """Toxic texts, copies, near copies and passages go; clean texts, nulls and odd columns pass."""
    import corpus_pipeline as p

    rng = random.Random(11)
    clean = [(i, prose(rng, 150, 9000)) for i in range(60)]
    toxic = [(100 + i, " ".join([*prose(rng, 40, 9000).split(), "you worthless idiot", *prose(rng, 40, 9000).split()])) for i in range(60)]
    copies = [(200 + i, clean[3][1]) for i in range(20)]
    near = [(300 + i, clean[4][1].replace(clean[4][1].split()[10 * i + 5], f"new{i}", 1)) for i in range(8)]
    passage = prose(rng, 55, 9000)
    held = [(400 + i, f"{prose(rng, 70, 9000)} {passage} {prose(rng, 70, 9000)}") for i in range(10)]
    odd = [(500, None), (501, ""), (502, "  \n"), (None, "kept without an id"), (503, "long " + prose(rng, 30_000, 90_000))]
    rows = [*clean, *toxic, *copies, *near, *held, *odd]
    docs(spark, rows).withColumn("lang", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 100), None) for i, _ in clean + toxic], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, stages = df.columns, dict(p.STAGES)
    df = p.cut(stages["toxicity"](spark, df, str(tmp_path)), "t")
    assert {r.doc_id for r in df.collect()} == {i for i, _ in rows if i is None or not 100 <= i < 160} and df.columns == names
    df = p.cut(stages["simhash near-dedup"](spark, df, str(tmp_path)), "t")
    # 500, 501 and 502 hold no words: one group
    assert {r.doc_id for r in df.collect()} == {i for i, _ in clean + held} | {500, 503, None} and df.columns == names
    df = p.cut(stages["suffix-array dedup"](spark, df, str(tmp_path)), "t")
    kept = {r.doc_id: r.text for r in df.collect()}
    assert df.columns == names and [i for i, t in kept.items() if t and passage in t] == [400]
    assert all(kept[i] == t for i, t in clean) and all(kept[i].split() == [w for w in t.replace(passage, "").split()] for i, t in held[1:])
    packed = p.cut(stages["best-fit packing"](spark, df, str(tmp_path)), "t")
    assert {r.doc_id for r in packed.collect()} == set(kept)
    assert sorted(map(tuple, p.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect()), key=repr) == sorted(map(tuple, packed.drop("sequence_id", "offset").collect()), key=repr)
    empty = spark.createDataFrame([], df.schema)
    for name, stage in p.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
