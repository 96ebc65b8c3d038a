"""The stored index against rankings and statistics that are computed anew."""

import random

from pyspark.sql import functions as F

from docloom.functions.text import term_counts
from docloom.operators import retrieval as R
from docloom.sources.index_store import IndexStore

FORM = "kb_id string, chunk_id long, doc_id long, text string"


def rows(df, *order):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*order).collect())


def test_term_counts(spark):
    df = spark.createDataFrame([(["b", "a", "b", "b"],), ([],), (["x"],)], "w array<string>")
    assert [[(t.token, t.tf) for t in r.t] for r in df.select(term_counts(F.col("w")).alias("t")).collect()] == [[("a", 1), ("b", 3)], [], [("x", 1)]]


def test_index_follows_upserts_and_removals(spark, tmp_path):
    rnd = random.Random(5)
    store, now = IndexStore(spark, str(tmp_path / "i")), {}
    words = ["sun", "rain", "知识", "a_b", "é", "ＡＢ"]
    queries = spark.createDataFrame([(1, "k1", "sun rain sun"), (2, "k1", "知识图 ab"), (3, "k2", "rain a_b none"), (4, "k9", "sun")], "query_id int, kb_id string, text string")
    within = spark.createDataFrame([(q, d) for q in (1, 2, 3) for d in (0, 1, 2)], "query_id int, doc_id long")
    for batch in (0, 3, 4):
        new = {c: ("k1" if c % 3 else "k2", c, c % 4, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 7)))) for c in rnd.sample(range(12), 6)}
        gone = rnd.sample(sorted(now), 2) if now else []
        gone = [c for c in gone if c not in new]
        df = spark.createDataFrame(list(new.values()), FORM)
        removed = spark.createDataFrame([(c,) for c in [*gone, 99]], "chunk_id long")
        for _ in range(2 if batch == 3 else 1):  # a batch that is run again replaces itself
            store.upsert(df, batch, removed)
        now = {c: r for c, r in now.items() if c not in gone} | new
        chunks = spark.createDataFrame(list(now.values()), FORM)
        posts = R.postings(chunks)
        assert rows(store.postings(), "kb_id", "chunk_id", "token", "tf", "len") == rows(posts, "kb_id", "chunk_id", "token", "tf", "len")
        assert rows(store.document_frequency(), "kb_id", "token", "df") == rows(R.document_frequency(posts), "kb_id", "token", "df")
        assert rows(store.statistics(), "kb_id", "n", "avg_len") == rows(R.scope_statistics(chunks), "kb_id", "n", "avg_len")
        whole = rows(R.bm25(chunks, queries), "query_id", "kb_id", "chunk_id", "score")
        assert rows(store.bm25(queries), "query_id", "kb_id", "chunk_id", "score") == whole
        doc = {c: r[2] for c, r in now.items()}
        assert rows(store.bm25(queries, within), "query_id", "kb_id", "chunk_id", "score") == [r for r in whole if doc[r[2]] < 3] == rows(R.bm25(chunks, queries, within), "query_id", "kb_id", "chunk_id", "score")
    plan = store.bm25(queries)._jdf.queryExecution().toString()
    assert "forward" not in plan and "regexp_extract_all" not in plan.split("== Physical Plan ==")[1]


def test_dense_ranking_inside_documents(spark):
    chunks = spark.createDataFrame([("k", i, i % 3, [float(i), 1.0]) for i in range(9)], "kb_id string, chunk_id long, doc_id long, embedding array<double>")
    q = spark.createDataFrame([(1, "k", [1.0, 0.0])], "query_id int, kb_id string, vector array<double>")
    within = spark.createDataFrame([(1, 2), (1, 2), (1, 7)], "query_id int, doc_id long")
    whole = rows(R.cosine(chunks, q), "chunk_id", "score")
    assert rows(R.cosine(chunks, q, within), "chunk_id", "score") == [r for r in whole if r[0] % 3 == 2]


def test_override_of_k(spark):
    k = R.override(F.col("k"))
    df = spark.createDataFrame([(1, 3), (2, 40), (3, None)], "i int, k int")
    assert [tuple(r) for r in df.select("i", k["lexical"], k["dense"], k["rerank"]).collect()] == [(1, 12, 12, 3), (2, 40, 40, 40), (3, 12, 12, 8)]
