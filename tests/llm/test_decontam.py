import random

from docloom.llm.decontam import decontaminate, proximity_matches
from tests.llm import brute


def test_equal_to_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["the", "Of", "É", *(f"w{rnd.randrange(60)}" for _ in range(3))])
    items = [(i, " ".join(word() for _ in range(rnd.choice([0, 1, 3, 9, 10, 11, 25])))) for i in range(24)] + [(99, None), (3, "w1, w2; THE")]
    rows = []
    for d in range(80):
        w = []
        for _ in range(rnd.randrange(6)):
            w += [word() for _ in range(rnd.randrange(20))]
            if rnd.random() < 0.6:
                x = brute.plain(rnd.choice(items)[1])
                w += x[rnd.randrange(3) :] if rnd.random() < 0.4 else x
        rows.append((d, rnd.choice([" ", "-\n", ". "]).join(w).upper() if d % 7 == 0 else ", ".join(w)))
    df = spark.createDataFrame([(d, t, 1, "p") for d, t in rows], "doc_id long, text string, start int, phrase string").repartition(3)
    out = decontaminate(df, spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in out}
    assert got == brute.decontaminate(rows, items)
    assert sum(x[4] for x in got.values()) > 20


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "A b C"), (8, None)], "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate(docs, items).collect())
    assert got == sorted([("1", 0, 0, 0, False), ("2", 0, 0, 0, False), ("3", 3, 3, 1, True), ("3", 3, 3, 1, True), ("None", 4, 3, 1, True)])
    assert not any(r.contaminated for r in decontaminate(docs, items.limit(0)).collect())
    assert decontaminate(docs.limit(0), items).collect() == []


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red x green blue"), (2, "red x x x x x x x x green blue"), (3, "red green blue")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "red green blue")], "item_id long, text string")
    assert {r.doc_id for r in proximity_matches(docs, items, slop=2).collect()} == {1, 3}
    assert {r.doc_id for r in proximity_matches(docs, items, slop=0).collect()} == {3}
