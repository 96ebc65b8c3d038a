import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from docloom.llm import maxent
from docloom.llm.maxent import score_texts
from tests.llm import brute


def test_base_columns_and_gain(spark):
    rnd = random.Random(1)
    order = [f"w{i}" for i in range(40)]
    rows = []
    for d in range(150):
        i, w = rnd.randrange(40), []
        for _ in range(rnd.randrange(60)):
            w.append(order[i] if rnd.random() < 0.95 else f"x{rnd.randrange(3000)}")
            i = (i + 1) % 40 if rnd.random() < 0.9 else rnd.randrange(40)
        rows.append((d, " ".join(w).title() if d % 3 else "\n".join(w)))
    rows += [(900, None), (901, ""), (None, "w1 w2 w1"), (5, "w1  W2")]
    counts = Counter()
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    for d, t in rows:
        if not out(d):
            counts.update([*brute.spaced(t, lower=True), "\0"])
    n, v = sum(counts.values()), len(counts)
    df = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double").repartition(3)
    got = score_texts(df).collect()
    want = sorted((str(d), out(d), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)) for d, t in rows for w in [[*brute.spaced(t, lower=True), "\0"]])
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert all(r.score < 0 for r in got) and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert score_texts(df.limit(0)).collect() == []


def test_tasks_train_on_from_the_averaged_weights(spark, monkeypatch):
    starts, ends, train = [], [], maxent.train_round

    def spied(texts, weights, singles):
        starts.append(weights.copy())
        ends.append(train(texts, weights, singles))
        return ends[-1]

    monkeypatch.setattr(maxent, "train_round", spied)
    df = spark.createDataFrame([(d, f"a b c d{d % 7} a b") for d in range(60)], "doc_id long, text string").repartition(3)
    score_texts(df).collect()
    assert len(starts) >= 2 and not starts[0].any()
    assert all((start == end).all() and start.any() for start, end in zip(starts[1:], ends, strict=False))
    assert (ends[-1] != ends[-2]).any()


def test_commonest_words_are_the_single_classes(spark, monkeypatch):
    got = []
    monkeypatch.setattr(maxent, "train_round", lambda texts, weights, singles: got.append(singles) or weights)
    words = [f"w{i}" for i in range(1, 81) for _ in range(i)]
    random.Random(2).shuffle(words)
    df = spark.createDataFrame([(2, w) for w in words], "doc_id long, text string").repartition(5)
    score_texts(df, rounds=1).collect()
    hashed = lambda w: maxent.hash_words_and_tails(*maxent.text_bytes(pa.array([w])), maxent.SPACED_LOWER)[0][0]
    assert set(got[0]) == {hashed(f"w{i}") for i in range(80 - maxent.SINGLES + 2, 81)} | {np.uint64(maxent.END)}


def test_scores_do_not_follow_the_shuffle(spark):
    df = spark.createDataFrame([(d, " ".join(f"w{(d * i) % (17 + d % 5)}" for i in range(40 + d % 9))) for d in range(90)], "doc_id long, text string").repartition(3).cache()
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (2, 7, 41):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append({r.doc_id: (round(r.base_score, 9), round(r.score, 9)) for r in score_texts(df).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 90


def test_weight_rows_follow_the_tokens():
    assert maxent.weight_rows(0) == maxent.LEAST_ROWS and maxent.weight_rows(10**15) == maxent.MOST_ROWS
    assert maxent.weight_rows(1 << 27) == (1 << 27) // maxent.TOKENS_A_ROW


def test_weights_sent_follow_the_tokens(spark, monkeypatch):
    sent = lambda tokens: maxent.training_tasks(tokens) * maxent.table_rows(maxent.weight_rows(tokens)) / tokens
    assert max(sent(1 << i) for i in range(25, 40)) <= 2 * sent(1 << 25) < 0.05
    tasks = []
    monkeypatch.setattr(maxent, "train_round", lambda texts, weights, singles: tasks.append(texts.rdd.getNumPartitions()) or weights)
    df = spark.createDataFrame([(2 if d % 2 else 1, f"a b d{d}") for d in range(120)], "doc_id long, text string").repartition(40)
    score_texts(df, rounds=1).collect()
    assert tasks[0] <= maxent.LEAST_TASKS


def test_long_text(spark):
    long = "a b c d e " * 120_000
    r = score_texts(spark.createDataFrame([(0, long), (1, "a b")], "doc_id long, text string")).where("doc_id = 0").first()
    assert r.n_tokens == 600_001 and math.isfinite(r.score)
