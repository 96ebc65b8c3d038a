"""Base statistics against plain counts, and the minimum covariance determinant on planted outliers."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docloom.llm.robust_rules import D, FLOORS, GRID, chi2_point, chi2_tail, quality_rules, robust_estimates, statistics
from docloom.llm.scratch import Scratch
from tests.llm.brute import spaced

FORM = "doc_id long, text string, lang string, source string"


def base(text):
    w = spaced(text)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, twice = set(), 0
    for line in (text or "").split("\n"):
        if spaced(line):
            twice += line in seen
            seen.add(line)
    n = [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), twice, len(hit)]
    return (*n, n[0] < 50 or 100 * n[4] > 50 * n[0])


def test_base_statistics(spark):
    rnd = random.Random(1)
    parts = ["sun", "rain", "é€", "a#b", "|", "\n", "\n", " \t", "\n\n", "x<y>", " ", "𝄞"]
    texts = [" ".join(rnd.choice(parts[: rnd.choice([3, 12])]) for _ in range(rnd.choice([0, 3, 60, 120]))) for _ in range(80)]
    texts += [None, "", " \n ", "a b c a b c", "w " * 60_000, "word" * 50_000, "same line\n" * 3 + "same line "]
    df = spark.createDataFrame([(i, t, None if i % 7 == 0 else "en", "s", "clash") for i, t in enumerate(texts)], FORM + ", kept string").repartition(4)
    got = {r.doc_id: tuple(r)[1:7] for r in quality_rules(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}
    z = {r.doc_id: r.z for r in statistics(df).select("doc_id", "z").collect()}
    assert all((z[i] is None) == (not spaced(t)) for i, t in enumerate(texts))


def test_chi2():
    for d in (6, 8):
        for tail in (0.5, 0.25, 0.025, 1e-6):
            assert abs(chi2_tail(chi2_point(tail, d), d) / tail - 1) < 1e-9
    assert abs(chi2_point(0.05, 6) - 12.5916) < 1e-3 and abs(chi2_point(0.05, 8) - 15.5073) < 1e-3


def test_estimates_are_not_moved_by_a_fifth_of_outliers(spark):
    rng = np.random.default_rng(4)
    mix_ = np.eye(D) * 0.3 + 0.1
    clean = rng.normal(size=(1600, D)) @ mix_ + 1.0
    far = rng.normal(size=(400, D)) * 0.6 + 4.0
    rows = [("a", (np.rint(x * GRID) / GRID).tolist()) for x in np.vstack([clean, far])] + [("b", [0.5] * D) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, z array<double>").repartition(6)
    got = {r.g: r for r in robust_estimates(df, Scratch(spark, "test"), 2).collect()}
    whiten = np.zeros((D, D))
    whiten[np.tril_indices(D)] = got["a"].whiten
    scatter = np.linalg.inv(whiten.T @ whiten)
    assert np.abs(np.array(got["a"].center) - 1.0).max() < 0.05
    want = mix_.T @ mix_ + np.diag(np.square(FLOORS))
    assert np.abs(scatter - want).max() < 0.25 * np.abs(want).max()
    plain = np.cov(np.vstack([clean, far]).T)
    assert np.abs(plain - want).max() > 2 * np.abs(scatter - want).max()
    assert np.allclose(got["b"].center, 0.5) and np.allclose(got["b"].whiten, (np.diag(1 / np.array(FLOORS)))[np.tril_indices(D)])


def test_outliers_go_and_clean_texts_stay(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 10))) for _ in range(3000)]
    prose = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "", "", ","]) for _ in range(n)).capitalize() + ".\n" + " ".join(rnd.choice(words) for _ in range(20))
    rows, bad = [], set()
    for i in range(700):
        text = prose(rnd.randrange(60, 300))
        if i % 12 == 5:
            text = " ".join(x + rnd.choice(["###", "$$$", "%%%"]) for x in text.split())
            bad.add(i)
        elif i % 12 == 9:
            text = text.upper().replace(" ", "!! ")
            bad.add(i)
        elif i % 30 == 1:  # a title that ends the text too
            text = f"The title of it\n{text}\nThe title of it"
        rows.append((i, text, None if i % 5 == 0 else "en", f"s{0 if i % 2 else i % 6}"))
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, FORM).repartition(5)).collect()}
    assert {i for i, r in got.items() if not r.kept} == bad
    assert {r.group for r in got.values()} >= {'{"lang":null,"source":"s0"}', '{"lang":"en","source":"s0"}'}


def test_small_groups_are_pooled_and_few_rows_reject_none(spark):
    rnd = random.Random(7)
    text = lambda: " ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 7) + str(rnd.randrange(99)) for _ in range(80))
    rows = [(i, text(), "en" if i < 70 else "fr", f"s{i}") for i in range(90)]
    got = quality_rules(spark.createDataFrame(rows, FORM)).groupBy("group").agg(F.count("*").alias("n"), F.min("kept").alias("kept")).collect()
    assert {(r.group, r.n) for r in got} == {('{"lang":"en"}', 70), ("{}", 20)} and all(r.kept for r in got if r.group == "{}")
    assert quality_rules(spark.createDataFrame([], FORM)).collect() == []


def test_steps_do_not_depend_on_how_soon_groups_settle(spark, monkeypatch):
    from docloom.llm import robust_rules

    done = []
    step = robust_rules._concentrated
    monkeypatch.setattr(robust_rules, "_concentrated", lambda *a: done.append(1) or step(*a))
    settled = spark.createDataFrame([("b", [0.5] * D) for _ in range(100)], "g string, z array<double>")
    robust_estimates(settled, Scratch(spark, "test"), 1).collect()
    assert len(done) == robust_rules.STEPS
