import random

import numpy as np
import pyarrow as pa

from docloom.llm import debruijn
from docloom.llm.debruijn import remove_repeats
from tests.llm import brute

FORM = "doc_id long, text string, n_words long, kept string, _doc long"


def corpus(seed, n=120):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "And", "é,", *(f"w{rnd.randrange(300)}" for _ in range(4))])
    passages = [[word() for _ in range(rnd.choice([19, 20, 21, 25, 60]))] for _ in range(5)]
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if kind < 0.2 and texts:
            w = list(rnd.choice(texts))
            if w and rnd.random() < 0.6:
                w[rnd.randrange(len(w))] = word()
        else:
            w = []
            for _ in range(rnd.randrange(5)):
                w += rnd.choice(passages) if rnd.random() < 0.5 else [word() for _ in range(rnd.randrange(30))]
            if kind > 0.95:
                w += ["x"] * rnd.randrange(60)
        texts.append(w)
    return [(i, rnd.choice([" ", "\n", " \t"]).join(w)) for i, w in enumerate(texts)]


def test_equal_to_brute_force(spark):
    for seed in (3, 4):
        rows = corpus(seed)
        df = spark.createDataFrame([(d, t, 1, "x", 5) for d, t in rows], FORM).repartition(3)
        out = remove_repeats(df).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out} == brute.remove_repeats(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, long), (3, long), (None, long), (4, "a b")]
    out = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == sorted([("1", 0, 0), ("2", 0, 0), ("3", 40, 0), ("3", 40, 40), ("None", 40, 40), ("4", 2, 0)])
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_hash_matches_are_compared_word_by_word():
    """A span goes only if the words at its source are the same, whatever its hash says."""
    words = [f"w{i}".encode() for i in range(60)]
    text = pa.array([b" ".join(words).decode()])
    _, _, p = next(debruijn._each(text, 20, 6))
    here = ((0, len(p.content)), (0, len(p.window_hash)))
    own = lambda j: words[p.path_from[j] : p.path_to[j]]
    row = lambda kind, h, said: (kind, int(np.uint64(h).view(np.int64)), *debruijn._digest(said))
    for said, want in ((own, True), (lambda j: [*own(j), b"x"], False)):
        gone = np.array([row(0, p.content[j], said(j)) for j in range(len(p.content))])
        assert debruijn._repeated(p, 0, words, 20, *here, gone).tolist() == [want] * 41
    for said, want in ((words[3:23], [j == 3 for j in range(41)]), (words[4:24], [False] * 41)):
        assert debruijn._repeated(p, 0, words, 20, *here, np.array([row(1, p.window_hash[3], said)])).tolist() == want
    p.window_hash[:] = 7  # all windows collide
    assert not debruijn._repeated(p, 0, words, 20, *here, debruijn._MISS).any()


def test_long_text(spark):
    long = " ".join(f"w{i % 50_000}" for i in range(120_000))
    r = remove_repeats(spark.createDataFrame([(1, long), (2, "a " + long[:600])], "doc_id long, text string")).orderBy("doc_id").collect()
    want = brute.remove_repeats([(1, long), (2, "a " + long[:600])])
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in r} == want
