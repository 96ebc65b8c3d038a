import random
import zlib
from collections import Counter, defaultdict

from docloom.llm.kd_shards import kd_shards


def shards_of(df, n):
    out = kd_shards(df, n).collect()
    bytes_, slots = Counter(), defaultdict(list)
    for r in out:
        bytes_[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return out, bytes_


def test_near_equal_bytes_and_whole_groups(spark):
    rnd = random.Random(3)
    rows = [(d, "x" * rnd.randrange(400) + str(d), rnd.choice("abcd"), "en", "z") for d in range(3000)]
    rows += [(5000 + d, f"copy {d % 200} " * 4, "a", "fr", None) for d in range(800)]
    rows += [(9000 + d, "hot " * 50, "a", "de", None) for d in range(1500)]  # a third of all bytes is one text, more than a shard
    rows += [(20_000 + 1000 * g + d, f"half {g} " * 20, "b", "es", None) for g in range(5) for d in range(60 * (g + 1))]  # up to nearly a shard each
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, shard string").repartition(5)
    out, bytes_ = shards_of(df, 16)
    assert len(out) == len(rows) and set(bytes_) == set(range(16))
    mean = sum(bytes_.values()) / 16
    assert max(bytes_.values()) < 1.02 * mean and min(bytes_.values()) > 0.98 * mean
    texts = {d: t for d, t, *_ in rows}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in out)
    where = defaultdict(set)
    for r in out:
        where[texts[r.doc_id]].add(r.shard)
    size = Counter()
    for d, t in texts.items():
        size[t] += len(t.encode()) + 1
    assert sum(mean / 8 < n <= mean for n in size.values()) >= 4
    assert all((len(x) == 1) == (size[t] <= mean) for t, x in where.items())
    assert sorted(map(str, out)) == sorted(map(str, kd_shards(df.repartition(2), 16).collect()))


def test_odd_rows(spark):
    rows = [(None, None, None, None), (1, None, None, None), (1, None, None, None), (2, "", "a", "é"), (3, "ü" * 5000, "b", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    out, _ = shards_of(df, 16)
    assert sorted(r.size for r in out) == [1, 1, 1, 1, 10001]
    assert len(shards_of(df, 5)[0]) == 5
    assert kd_shards(df.limit(0)).collect() == []
