"""Steps whose rows must grow with their input, also where very many rows share a key."""

from pyspark.sql import functions as F

from docloom.operators import extraction as X
from docloom.operators import graph as G
from docloom.operators.graph import fold_nodes, merge_edges
from docloom.operators.retrieval import chunk_frequency, document_frequency, postings
from docloom.sources.derived import edges, single_edges
from docloom.sources.index_store import IndexStore
from docloom.sources.shared import cut
from tests.growth import most_rows


def test_groups_meet_an_alias_once(spark):
    """groups and entities of one kind and alias used to be joined in all pairs."""
    groups = spark.range(300).selectExpr("id as group_id", "'k' as kind", "array('Same', concat('Own ', id)) as names")
    existing = spark.range(300).selectExpr("concat('e', id) as entity_id", "'k' as kind", "'same' as alias", "'label' as label").union(
        spark.createDataFrame([("x", "k", "own7", "the seven"), ("x", "k", "more", "the seven"), (None, "k", "own8", "lost")], "entity_id string, kind string, alias string, label string")
    )
    assert most_rows(X.match_existing(groups, existing)) < 2_000
    one = spark.createDataFrame([(7, "k", ["Own 7"]), (8, "k", ["Own 8"]), (9, "k", ["same", "own 9"])], "group_id long, kind string, names array<string>")
    got = {r.group_id: tuple(r)[1:] for r in X.match_existing(one, existing).collect()}
    assert got == {7: ("match", "x", "the seven", ["more", "own7"]), 8: ("new", None, None, ["own8"]), 9: ("conflict", None, None, ["own9", "same"])}


def _cuts(monkeypatch, module):
    """The most rows of a step of each table that the module cuts from now on."""
    made = []
    monkeypatch.setattr(module, "cut", lambda df: (made.append(most_rows(df)), cut(df))[1])
    return made


def test_full_seeds_are_not_expanded(spark, monkeypatch):
    """seeds that had all their nodes used to be expanded again."""
    edges = spark.range(2400).selectExpr("concat('e', id) as id", "concat('s', id div 60) as source", "concat('n', id % 60) as target", "'R' as relation")
    made = _cuts(monkeypatch, G)
    found = G.local_subgraph(edges, spark.range(40).selectExpr("concat('s', id) as id"), 2, 10)
    assert found.count() == 400 and max(made) <= 4800


def test_hubs_are_joined_up_to_the_limit(spark, monkeypatch):
    """every seed next to a hub used to be joined with all edges of the hub."""
    hub = spark.range(1000).selectExpr("concat('h', id) as id", "'hub' as source", "concat('n', lpad(id, 4, '0')) as target", "'R' as relation", "true as semantic")
    edges = hub.union(spark.range(100).selectExpr("concat('s', id)", "concat('seed', id)", "'hub'", "'Q'", "true"))
    made = _cuts(monkeypatch, G)
    near = G.graph_search(edges, spark.range(100).selectExpr("concat('seed', id) as id"), 2, 10)
    assert max(most_rows(near), *made) <= 5000
    assert {tuple(r) for r in near.where("seed = 'seed7'").select("id").collect()} == {("s7",), *((f"s{i}",) for i in (0, 1, 10, 11, 12, 13, 14, 15))}


def test_rankings_by_blocks_equal_all_pairs(spark, monkeypatch):
    """F2, F6, F8, F10 to F12: all pairs of queries and chunks used to leave the scoring; now a block's best do."""
    from docloom.operators import retrieval as R

    monkeypatch.setattr(R, "CHUNK_BLOCK", 90)
    monkeypatch.setattr(R, "QUERY_BLOCK", 25)
    chunks = spark.range(300).selectExpr("concat('k', id % 2) as kb_id", "id as chunk_id", "id as doc_id", "concat('w', id % 7, ' w', id % 11, ' same') as text", "array(cast(id % 13 as float), cast(id % 5 as float), if(id % 50 = 0, null, 1f)) as embedding")
    asked = spark.range(60).selectExpr("id as query_id", "concat('k', id % 2) as kb_id", "concat('w', id % 7, ' w', id % 11, ' same same') as text", "array(cast(id % 5 as float), 2f, cast(id % 3 as float)) as vector")
    lists = (asked.selectExpr("query_id", "query_id % 3 as list_id"), chunks.selectExpr("doc_id", "doc_id % 3 as list_id"))
    within = lists[0].join(lists[1], "list_id").select("query_id", "doc_id")
    told = lambda df: sorted((r.query_id, r.kb_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in df.collect())
    hits = R.postings(chunks.select("kb_id", "chunk_id", "text")).withColumn("doc_id", F.col("chunk_id"))
    weights = R.bm25_weights(R.query_terms(asked), R.document_frequency(hits), R.scope_statistics(chunks))
    for k in (4, R.override(F.col("query_id").cast("int"))["lexical"]):
        for own, pairs in ((None, None), (lists, within)):
            assert told(R.bm25_top_k(hits, weights, 300, k, own)) == told(R.top_k(R.bm25_score(hits, weights, pairs).withColumn("_k", F.lit(4)), k))
            assert told(R.cosine_top_k(chunks, asked, k, own)) == told(R.top_k(R.cosine(chunks, asked, pairs), k))
    assert most_rows(R.cosine_top_k(chunks, asked, 4)) <= 4_000 < most_rows(R.top_k(R.cosine(chunks, asked), 4))


def test_a_query_with_many_hits_takes_them_from_all_blocks_together(spark, monkeypatch):
    """F3 of round 4: a query that asks for many hits used to take as many from each block."""
    from docloom.operators import retrieval as R

    monkeypatch.setattr(R, "CHUNK_BLOCK", 100)
    chunks = spark.range(2000).selectExpr("'k' as kb_id", "id as chunk_id", "id as doc_id", "array(cast(sin(id) as float), cast(cos(id) as float), cast(id % 7 as float)) as embedding")
    asked = spark.range(1, 11).selectExpr("id as query_id", "'k' as kb_id", "array(cast(sin(id) as float), 1f, cast(id % 3 as float)) as vector")
    k = F.col("query_id") * 20
    assert most_rows(R.cosine_top_k(chunks, asked, k)) <= 4_000  # 1,100 hits; 16,000 of single blocks
    told = lambda df: sorted((r.query_id, r["rank"], r.chunk_id) for r in df.collect())
    assert told(R.cosine_top_k(chunks, asked, k)) == told(R.top_k(R.cosine(chunks, asked), k))


def _plan(df):
    return df.select("*")._jdf.queryExecution().executedPlan().toString()  # a plan that has not run


def test_contributions_are_folded_in_one_shuffle(spark):
    rows = [("a", 2, "s2", "t2", "R2", ["y", "x"], False, "p2"), ("a", 1, "s1", "t1", "R1", ["x"], True, "p1"), ("a", None, "s0", "t0", "R0", ["z"], False, "p0"), ("b", 1, None, "t", "R", [], False, None)]
    given = spark.createDataFrame(rows, "id string, doc_id int, source string, target string, relation string, evidence array<string>, semantic boolean, properties string")
    merged = merge_edges(given)
    assert {tuple(r) for r in merged.withColumn("evidence", F.array_join("evidence", ",")).collect()} == {("a", "s1", "t1", "R1", "x,y,z", True, 2, "p2"), ("b", None, "t", "R", "", False, 1, None)}
    nodes = given.select("id", "doc_id", F.col("source").alias("kind"), F.col("target").alias("label"), F.col("relation").alias("value"), F.col("evidence").alias("aliases"))
    folded = fold_nodes(nodes)
    assert {tuple(r) for r in folded.collect()} == {("a", "s1", "t1", "R2", "x,y,z"), ("b", None, "t", "R", "")}
    assert all(_plan(df).count("Exchange hashpartitioning") == 1 for df in (merged, folded))


def test_an_index_without_replaced_chunks_joins_no_stale_ones(spark, tmp_path):
    store = IndexStore(spark, f"file://{tmp_path}/index")
    chunks = spark.createDataFrame([("k", 1, 1, "one two"), ("k", 2, 1, "two"), ("k", 2, 2, "again"), ("k", None, 3, "x"), ("k", None, 3, "y")], "kb_id string, chunk_id long, doc_id long, text string")
    store.upsert(chunks, 0)
    assert {(r.chunk_id, r.token) for r in store.postings().collect()} == {(1, "one"), (1, "two"), (2, "two"), (None, "x")}
    assert "LeftAnti" not in _plan(store.postings())
    store.upsert(chunks.where("chunk_id = 1").withColumn("text", F.lit("three")), 1)
    assert {(r.chunk_id, r.token) for r in store.postings().collect()} == {(1, "three"), (2, "two"), (None, "x")}


def test_chunk_frequency_counts_no_terms(spark):
    chunks = spark.createDataFrame([("k", 1, "a b a"), ("k", 2, "b Ａ 知识"), (None, 3, "a"), ("l", 4, None)], "kb_id string, chunk_id long, text string")
    got = chunk_frequency(chunks)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in document_frequency(postings(chunks)).collect()} == {("k", "a", 2), ("k", "b", 2), ("k", "知", 1), ("k", "识", 1), ("k", "知识", 1), (None, "a", 1)}
    assert "array_sort" not in _plan(got) and "sort_array" not in _plan(got)


def test_single_edges_are_the_distinct_edges(spark):
    sf = "/root/testdata/sf0.001"
    got = single_edges(spark, sf)
    assert sorted(got.collect()) == sorted(edges(spark, sf).select(*got.columns).distinct().collect())
