import hashlib
import math
import random

from docloom.llm.mixing import emit_copies, mix_sources
from tests.llm import brute


def brute_targets(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if most * sizes[s] <= level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_targets_and_copies(spark):
    rnd = random.Random(2)
    rows = [(d, " ".join("w" * rnd.randrange(1, 4) for _ in range(rnd.randrange(30))) if d % 11 else None, rnd.choice(["a", "b", "B", "é", None, "tiny"] if d % 5 else ["hot"])) for d in range(400)]
    rows += [(1000 + d, "one", s) for d, s in enumerate("cdefgh")] + [(2000, "", "empty"), (None, "x y", "a"), (5, "p q", "b")]
    df = spark.createDataFrame([(d, t, s, 3) for d, t, s in rows], "doc_id long, text string, source string, size int").repartition(4)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.spaced(t))
    want = brute_targets(sizes)
    mixed = mix_sources(df)
    out = mixed.collect()
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "", r[2] is None, r[2] or ""))  # ids repeat here, so rows are numbered
    number = {r: i for i, r in enumerate(order)}
    assert len(out) == len(rows)
    for r in out:
        s = r.row.source
        assert r.size == len(brute.spaced(r.row.text)) and r.source_size == sizes[s] and math.isclose(r.target, want[s], abs_tol=1e-9)
        rate = min(2.0, r.target / sizes[s]) if sizes[s] else 0.0
        draw = int(hashlib.md5(f"mix:{number[r.doc_id, r.row.text, s]}".encode()).hexdigest()[:12], 16) / (1 << 48)
        assert r.copies == math.floor(rate) + (draw < rate - math.floor(rate)) and r.taken == r.size * r.copies <= 2 * r.size
    assert sorted(map(str, out)) == sorted(map(str, mix_sources(df.repartition(2)).collect()))
    again = emit_copies(mixed)
    assert again.columns == df.columns and again.count() == sum(r.copies for r in out)


def test_empty(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_unique_ids_are_the_seeds(spark):
    df = spark.createDataFrame([(d, "w " * (d % 7), "ab"[d % 2]) for d in range(200)], "doc_id long, text string, source string")
    for r in mix_sources(df).collect():
        rate = min(2.0, r.target / r.source_size)
        draw = int(hashlib.md5(f"mix:{r.doc_id}".encode()).hexdigest()[:12], 16) / (1 << 48)
        assert r.copies == math.floor(rate) + (draw < rate - math.floor(rate))


def test_rows_without_id_draw_for_themselves(spark):
    long = "w " * 30_000
    rows = [(None, f"x{i} y z", "a") for i in range(300)] + [(7, f"x{i} y z", "b") for i in range(300)] + [(7, long, "b")]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for s, most in (("a", 0.2), ("b", 0.2)):
        own = [r for r in out if r.row.source == s and r.size < 100]
        target = own[0].target - (2 * 30_000 if s == "b" else 0)
        assert {r.size for r in own} == {3} and len({r.copies for r in own}) <= 2
        if s == "a":
            assert abs(sum(r.taken for r in own) - target) <= most * target
