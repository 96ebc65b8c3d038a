import random

from docloom.llm.components import components
from docloom.llm.ngram_join import jaccard_components
from docloom.llm.scratch import Scratch
from tests.llm import brute

FORM = "doc_id long, text string, n long, key string, comp long"


def corpus(seed=1, groups=6, n=160):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "And", "é", *(f"w{rnd.randrange(400)}" for _ in range(6))])
    bases = [[word() for _ in range(rnd.choice([1, 2, 3, 12, 40, 90]))] for _ in range(groups)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(bases)) if rnd.random() < 0.7 else [word() for _ in range(rnd.choice([1, 2, 5, 60]))]
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            w[rnd.randrange(len(w))] = word()
        rows.append((i, rnd.choice([" ", "\n", "\t "]).join(w)))
    dense = [word() for _ in range(120)]  # a large group in which many pairs do link and many do not
    for i in range(n, n + 80):
        w = list(dense)
        for _ in range(rnd.choice([1, 1, 2, 3, 4])):
            w[rnd.randrange(120)] = f"own{i}"
        rows.append((i, " ".join(w)))
    return rows


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, 7, "x", 1) for d, t in rows], FORM)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df).collect()}
        assert got == brute.jaccard_components(rows)


def test_odd_rows(spark):
    same = " ".join(f"w{i}" for i in range(30))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "a  B"), (None, same), (7, same), (7, same), (8, same.upper()), (9, "x " * 3000)]
    df = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], FORM)
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in jaccard_components(df).collect())
    assert got == sorted([("1", 0, 1), ("2", 0, 2), ("3", 0, 3), ("4", 1, 4), ("5", 1, 4), ("None", 28, None), ("7", 28, 7), ("7", 28, 7), ("8", 28, 7), ("9", 1, 9)])
    assert jaccard_components(df.limit(0)).collect() == []


def test_rows_that_repeat_an_id_link_by_their_own_texts(spark):
    text = lambda x, last: " ".join(f"{x}{i}" for i in range(60)) + f" {last}"
    rows = [(1, text("a", "p")), (1, text("b", "p")), (2, text("a", "q")), (3, text("b", "q")), (4, text("c", "p")), (None, text("c", "q")), (5, text("c", "r"))]
    got = sorted((str(r.doc_id), r.component_id) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert got == sorted([("1", 1), ("1", 1), ("2", 1), ("3", 1), ("4", 4), ("None", None), ("5", 4)], key=lambda r: r[0])


def test_texts_of_few_shared_words(spark):
    """Every shingle is in very many texts, so all lists are dealt by a second shingle; some texts link, most do not."""
    rnd = random.Random(5)
    for words, percent in ((3, 90), (4, 50)):
        rows = []
        for i in range(0, 240, 2):
            w = [rnd.choice("abcdefgh"[:words]) for _ in range(rnd.choice([4, 9, 12, 14, 30, 60]))]
            rows.append((i, " ".join(w)))
            w[rnd.choice([0, -1])] = rnd.choice("ab")
            rows.append((i + 1, " ".join(w)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, percent=percent).collect()}
        assert got == brute.jaccard_components(rows, percent=percent)


def test_rows_of_second_shingles_follow_the_texts(spark, monkeypatch):
    """Texts of a common passage that do not link: its shingles stand in the same texts, so one of them is a list; some texts link besides."""
    dealt, save = [], Scratch.save

    def noted(self, df):
        out = save(self, df)
        if {"item", "second"} <= set(df.columns):
            dealt.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "save", noted)
    passage = [f"p{i}" for i in range(22)]
    rows = [(i, " ".join([f"own{i}x{j}" for j in range(12 - i % 6)] + passage + [f"own{i}y{j}" for j in range(i % 4)])) for i in range(0, 120, 2)]
    rows += [(i + 1, text + f" last{i}") for i, text in rows[:9]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(df, percent=55).collect()}
    assert got == brute.jaccard_components(rows, percent=55)
    assert len(dealt) == 1 and dealt[0] <= 3 * len(rows)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, i) for i in range(1001, 1200)]
    df = spark.createDataFrame([*chain, *star, (5, 5), (2000, 1999)], "a long, b long")
    got = {r.node: r.root for r in components(df, Scratch(spark, "t")).collect()}
    want = {n: 0 for n in range(1, 41)} | {n: 1000 for n in range(1001, 1200)} | {2000: 1999}
    assert got == want
