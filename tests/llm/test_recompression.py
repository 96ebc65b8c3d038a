"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import zlib

import numpy as np

from docloom.llm.queries import op12_periodic_runs
from docloom.llm.recompression import extensions, find_runs, grammar, planted_period, runs_of
from docloom.llm.words import mix
from tests.llm.brute import spaced

FORM = "doc_id long, text string"


def all_runs(w, least=6, times=4):
    """start, length, period of each run, by start, then period."""
    found = {}
    for q in range(1, len(w) // times + 1):
        i = 0
        while i + q < len(w):
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, times * q):
                found.setdefault((start, i + q - start), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def periodic(rnd):
    k, w = rnd.choice([1, 2, 2, 3, 40]), []
    for _ in range(rnd.randrange(0, 5)):
        w += [rnd.randrange(k) for _ in range(rnd.randrange(1, 9))] * rnd.choice([1, 1, 2, 4, 5, 7])
        w += [rnd.randrange(k) for _ in range(rnd.randrange(0, 6))]
    return w


def test_extensions_of_any_two_places():
    rnd = random.Random(2)
    for _ in range(60):
        w = periodic(rnd)
        symbols = np.concatenate((mix(np.array([91], np.uint64)), mix(np.array(w, np.uint64)), mix(np.array([92], np.uint64))))
        fixed = np.array([True, *[False] * len(w), True])
        levels = grammar(symbols, fixed)
        pairs = [(x, y) for x in range(1, len(w) + 1) for y in range(x + 1, len(w) + 1)]
        if not pairs or not levels:
            continue
        x, y = (np.array(c) for c in zip(*pairs, strict=True))
        want = []
        for a, b in pairs:
            n = 0
            while b + n <= len(w) and w[a + n - 1] == w[b + n - 1]:
                n += 1
            want.append(n)
        assert extensions(levels, x, y).tolist() == want
        back = [level.mirrored() for level in levels]
        want = []
        for a, b in pairs:
            n = 0
            while a - 1 - n >= 1 and w[a - 2 - n] == w[b - 2 - n]:
                n += 1
            want.append(n)
        assert extensions(back, len(symbols) - x, len(symbols) - y).tolist() == want


def test_runs_of_many_texts_at_once():
    rnd = random.Random(3)
    for _ in range(300):
        texts = [periodic(rnd) for _ in range(rnd.randrange(1, 5))]
        at = np.cumsum([0, *map(len, texts)])
        h = mix(np.array([x for t in texts for x in t], np.uint64))
        assert [tuple(r) for r in runs_of(h, at, 6, 4).tolist()] == [(i, *r) for i, t in enumerate(texts) for r in all_runs(t)]


def test_a_text_of_one_word_over_and_over():
    n = 300_000
    assert runs_of(np.full(n, 5, np.uint64), np.array([0, n]), 6, 4).tolist() == [[0, 0, n, 1]]


def test_find_runs_on_odd_rows(spark):
    rnd = random.Random(4)
    texts = [" ".join("abcdefgh"[x % 8] for x in periodic(rnd)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, "x y x y x y x y x y"), (7, "x y x y x y x y x y"), (None, "é é " * 9), (50, None), (51, ""), (52, "\t\n"), (53, "a b " * 3000 + "c")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, runs string, n_words int").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, [tuple(x) for x in r.runs], tuple(r.strongest) if r.strongest else None, r.collapsed) for r in find_runs(df).collect())
    want = []
    for i, t in rows:
        w = spaced(t)
        runs = all_runs(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
        want.append((i if i is not None else -1, len(w), runs, best, collapsed(w, runs)))
    assert got == sorted(want)
    assert find_runs(spark.createDataFrame([], FORM)).collect() == []


def test_query_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for doc, text in rows:
        w = spaced(text)
        if (to := planted_period(doc, len(w))) is not None:
            w = [w[i if i < to[0] else to[0] + (i - to[0]) % to[1]] for i in range(len(w))]
        runs = all_runs(w)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2])) if runs else None
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want[doc] = (len(runs), *told, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(w, runs)))
    got = {r.doc_id: tuple(r)[1:] for r in op12_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    assert got == want and any(w[0] for w in want.values())


def test_planted_period_follows_the_contract():
    some = [d for d in range(2000) if zlib.crc32(str(d).encode()) % 10 == 0]
    for d in some[:50]:
        g = zlib.crc32(str(d).encode()) // 10
        assert planted_period(d, 37) == (g % 37, 1 + (37 - g % 37) // (3 + g % 8))
    assert planted_period(some[0], 0) is None and planted_period(None, 5) is None
    assert planted_period(next(d for d in range(99) if zlib.crc32(str(d).encode()) % 10), 5) is None
