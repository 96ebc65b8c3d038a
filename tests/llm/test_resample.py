"""Importance resampling against a plain count, and against its SQL."""

import hashlib
import math
import os
import random
import zlib
from collections import Counter

import duckdb
import numpy as np

from docloom.llm.queries import ORACLE_SQL, op11_resample
from docloom.llm.resample import _Crc, bucket_counts, crossing, features, resample, segments_of
from tests.llm.brute import plain


def runs(text):
    w = plain(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def counted(texts, buckets):
    return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in runs(t))


def resampled(rows, target, buckets, least_words, percent):
    s, t = counted([x for _, x in rows], buckets), counted(target, buckets)
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]
    out = []
    for i, text in rows:
        f = runs(text)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(plain(text)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    known = sorted((r for r in out if r[1] >= least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(known[: len(known) * percent // 100], 1):
        r[5] = k
    return out


def order(rows):
    return sorted(map(repr, map(tuple, rows)))


def test_crc_of_words_and_runs():
    rnd = random.Random(1)
    words = [bytes(rnd.randrange(33, 250) for _ in range(rnd.choice([1, 2, 5, 63, 64, 65, 66, 200, 5000]))) for _ in range(300)]
    b = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
    one = _Crc.words(b, starts, lengths)
    assert one.tolist() == [zlib.crc32(w) for w in words]
    both = _Crc.append(one[:-1], lengths[1:], one[1:])
    assert both.tolist() == [zlib.crc32(a + c) for a, c in zip(words, words[1:], strict=False)]


def test_segments_and_crossings_make_all_runs():
    rnd = random.Random(2)
    for _ in range(200):
        text = "".join(rnd.choice(["a", "Bc", "é", " ", "\n", "\n", "-", "\r"]) for _ in range(rnd.randrange(0, 30)))
        segments = segments_of(text)
        got = Counter(int(x) for _, bucket in features(segments, 997) for x in bucket) if segments else Counter()
        got += Counter(zlib.crc32(x) % 997 for x in crossing(segments, {}))
        assert got == counted([text], 997), text


def test_resample_equals_a_plain_count(spark):
    rnd = random.Random(3)
    lines = ["the sun, the rain", "A-b c", "", "x", "é ü é", " ", "one two three four five six", "1 2 3"]
    rows = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(0, 9)))) for i in range(150)]
    rows += [(3, "the sun\nthe sun"), (3, "the sun\nthe sun"), (None, "x y z " * 9), (None, None), (200, None), (201, ""), (202, "long " * 40_000 + "\nend")]
    target = ["the sun the rain", None, "x y"]
    df = spark.createDataFrame([(i, t, 0, "clash") for i, t in rows], "doc_id long, text string, rank int, score string").repartition(5)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    for buckets, least, percent in ((50, 4, 20), (10_000, 1, 100)):
        assert order(resample(df, goal, buckets, least, percent).collect()) == order(resampled(rows, target, buckets, least, percent))
    counts = {r.bucket: r.n for r in bucket_counts(df, 50).collect()}
    assert counts == dict(counted([t for _, t in rows], 50))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resample(none, none).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert order(resample(one, none, least_words=1, percent=100).collect()) == order(resampled([(1, "a b")], [], 10_000, 1, 100))


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    got = op11_resample(spark, folder)
    want = con.sql(ORACLE_SQL["op11_resample"])
    assert got.columns == want.columns and order(got.collect()) == order(want.fetchall())
