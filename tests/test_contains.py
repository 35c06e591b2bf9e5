import random

from loomwright.operators import contains


def test_passages_by_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = ["ash", "elm", "oak", "fir", "yew", "bay"]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))).replace("oak", rng.choice(["oak", "oak\n", "oak  "]))) for i in range(120)] + [(200, None), (201, "")]
    pool = [t for _, t in texts if t and len(t) > 30]
    passages = [(i, (lambda t: t[rng.randint(0, 9) : rng.randint(10, len(t))])(rng.choice(pool))) for i in range(80)]
    passages += [(100, "fir"), (101, "k a"), (102, ""), (103, None), (104, "m"), (105, " elm oak "), (106, "never there"), (107, "fir")]
    want = {(t, p) for t, x in texts for p, y in passages if x and y and y in x}
    t, p = spark.createDataFrame(texts, "train_idx long, text string"), spark.createDataFrame(passages, "fact_key long, passage string")
    for most in (500_000, 0):
        monkeypatch.setattr(contains, "BROADCAST_ROWS", most)
        rows = [tuple(r) for r in contains.holding(t, p, "train_idx", "text", "fact_key", "passage").collect()]
        assert len(set(rows)) == len(rows) and set(rows) ^ want == set() and len(want) > 100
    assert contains.holding(t, p.limit(0), "train_idx", "text", "fact_key", "passage").count() == 0
    assert contains.holding(t.limit(0), p, "train_idx", "text", "fact_key", "passage").count() == 0
