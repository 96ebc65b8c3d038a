import numpy as np

from docloom.llm import pivot_index
from tests.llm import brute

FORM = "vec_id long, embedding array<float>, label int, n_links int"


def vectors(seed, n=500):
    rnd = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i and rnd.random() < 0.5:
            x = np.array(rows[rnd.integers(len(rows))][1]) + rnd.normal(size=16) * rnd.choice([0, 0.02, 0.06])
        else:
            x = rnd.normal(size=16)
            x /= np.linalg.norm(x)
        rows.append((i, [float(np.float32(v)) for v in x], int(rnd.integers(3))))
    return rows


def brute_links(rows, least=0.93):
    ok = [(i, np.array(v), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0]
    x = {i: v / np.linalg.norm(v) for i, v, _ in ok}
    pairs = [(a, b) for k, (a, v, y) in enumerate(ok) for b, w, z in ok[k + 1 :] if y == z and len(v) == len(w) and x[a] @ x[b] >= least]
    return pairs, brute.linked([i for i, _, _ in rows], pairs)


def test_recall_and_no_false_links(spark, monkeypatch):
    monkeypatch.setattr(pivot_index, "BLOCK", 60)  # several blocks a list
    rows = vectors(1)
    rows += [(1000 + i, rows[3][1], rows[3][2]) for i in range(40)]
    df = spark.createDataFrame([(*r, 0) for r in rows], FORM)
    got = {r.vec_id: r for r in pivot_index.near_vectors(df).collect()}
    pairs, roots = brute_links(rows)
    n = dict.fromkeys(roots, 0)
    for a, b in pairs:
        n[a] += 1
        n[b] += 1
    assert all(got[i].n_links <= n[i] for i in n)
    assert sum(r.n_links for r in got.values()) >= 0.9 * 2 * len(pairs)
    assert sum(got[i].component_id == roots[i] for i in roots) >= 0.97 * len(roots)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    exact = {r.vec_id: (r.n_links, r.component_id) for r in pivot_index.near_vectors(df, pivots=8, nearest=8, shared=1).collect()}  # all pivots: all pairs meet
    assert exact == {i: (n[i], roots[i]) for i in roots}


def test_odd_rows(spark):
    rows = [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [1.0, 2.0], None), (6, [1.0, 2.0], 1), (7, [2.0, 4.0], 1), (8, [1.0, 2.0, 3.0], 1), (9, [], 1), (None, [1.0, 2.0], 1), (6, [1.0, 2.0], 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], FORM)
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in pivot_index.near_vectors(df).collect())
    alone = [(str(i), 0, i, True) for i in (1, 2, 3, 4, 5, 8, 9)]
    assert got == sorted([*alone, ("6", 2, 6, True), ("6", 2, 6, True), ("7", 2, 6, False), ("None", 0, None, False)])
    assert pivot_index.near_vectors(df.limit(0)).collect() == []


def test_very_large_and_small_vectors_link(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [1e-200, 2e-200], 1), (3, [1.0, 2.0], 1), (4, [5e-324, 1e-323], 1), (5, [-1e300, 1e300], 1), (6, [float("inf"), 1.0], 1)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in pivot_index.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 3, 1), (2, 3, 1), (3, 3, 1), (4, 3, 1), (5, 0, 5), (6, 0, 6)]


def test_recall_and_exact_mode(spark):
    """Noisy copies of given embeddings at cosines around and above the bound, with as many pivots as a large table has."""
    x = np.array([r.embedding for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").orderBy("vec_id").collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rnd = np.random.default_rng(4)
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    for k, c in enumerate((0.9, 0.935, 0.96, 1.0), 1):
        noise = rnd.normal(size=x.shape)
        noise -= (noise * x).sum(axis=1, keepdims=True) * x
        noise /= np.linalg.norm(noise, axis=1, keepdims=True)
        rows += [(1000 * k + i, (c * v + np.sqrt(1 - c * c) * n).tolist(), i % 2) for i, (v, n) in enumerate(zip(x, noise, strict=True))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(5).cache()
    ids, all_, labels = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    all_ = all_ / np.linalg.norm(all_, axis=1, keepdims=True)
    links = (all_ @ all_.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(links, False)
    want = dict(zip(ids.tolist(), links.sum(axis=1).tolist(), strict=True))
    assert sum(want.values()) > 2 * 2 * len(x)
    exact = {r.vec_id: r.n_links for r in pivot_index.near_vectors(df, exact=True).collect()}
    assert exact == want
    for pivots in (None, 2000):
        found = {r.vec_id: r.n_links for r in pivot_index.near_vectors(df, pivots=pivots).collect()}
        assert all(found[i] <= want[i] for i in want)
        assert sum(found.values()) >= 0.95 * sum(want.values())


def test_pivots_follow_the_vectors():
    assert [pivot_index.pivot_count(n) for n in (0, 10_000, 90_000, 10**12)] == [256, 256, 600, 4096]
