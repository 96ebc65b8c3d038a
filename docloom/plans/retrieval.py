"""Retrieval queries: all benchmark texts, and the vectors with ids divisible by 100, as queries; languages as knowledge bases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.text import tokens
from docloom.operators import retrieval as R
from docloom.sources.derived import table
from docloom.sources.index_store import IndexStore, stored_index
from docloom.sources.shared import shared_dir


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("lang").alias("kb_id"), F.col("doc_id").alias("chunk_id"), "doc_id", "text")


def _dense_chunks(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return _chunks(spark, sf).join(vectors, "doc_id")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    kbs = table(spark, sf, "documents").select(F.col("lang").alias("kb_id")).where("lang is not null").distinct()
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(F.broadcast(kbs))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set, in every knowledge base; the n-th of its vectors belongs to text query n."""
    kbs = table(spark, sf, "documents").select(F.col("lang").alias("kb_id")).where("lang is not null").distinct()
    return table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.expr("vec_id div 100").alias("query_id"), F.col("embedding").alias("vector")).join(F.broadcast(kbs))


def _index(spark: SparkSession, sf: str) -> IndexStore:
    """The stored index of all documents, which the queries of a session share."""
    return stored_index(spark, shared_dir(spark), f"{sf}/documents.parquet", _chunks(spark, sf))


def e1_tokens(spark, sf):
    w = R.tokenised(_chunks(spark, sf))
    return w.select("chunk_id", F.col("len").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


def e1_mixed(spark, sf):
    """Tokens of the documents with CJK runs (every third), full-width letters or ligatures put in."""
    more = F.element_at(F.array(F.lit(" 知识图 q知"), F.lit(" Ａｇｅ１_ﬁ"), F.lit("")), (F.col("doc_id") % 3 + 1).cast("int"))
    w = R.tokenised(_chunks(spark, sf).withColumn("text", F.concat("text", more)))
    return w.select("chunk_id", F.col("len").cast("long").alias("n_tokens"), F.md5(F.array_join("w", " ")).alias("tokens_md5"))


def e2_postings(spark, sf):
    return R.counted(_chunks(spark, sf)).select(
        "chunk_id", F.col("len").cast("long").alias("len"), F.size("terms").cast("long").alias("terms"), F.array_max("terms.tf").alias("max_tf"), F.aggregate("terms.tf", F.lit(0).cast("long"), lambda s, x: s + x * x).alias("tf2"),
    ).where("terms > 0")


def e2_stored(spark, sf):
    """The stored postings of the benchmark's terms."""
    return _index(spark, sf).postings(R.query_terms(_queries(spark, sf))).select("kb_id", "chunk_id", "token", "tf", F.col("len").cast("long").alias("len"))


def e3_document_frequency(spark, sf):
    return R.chunk_frequency(_chunks(spark, sf))


def e3_scope_statistics(spark, sf):
    return R.scope_statistics(_chunks(spark, sf)).select("kb_id", "n", F.round("avg_len", 6).alias("avg_len"))


def _bm25(spark, sf):
    return _index(spark, sf).bm25_top_k(_queries(spark, sf), R.LEXICAL_TOP_K)


def _dense(spark, sf):
    return R.cosine_top_k(_dense_chunks(spark, sf), _vectors(spark, sf), R.DENSE_TOP_K)


def e4_bm25_topk(spark, sf):
    return _bm25(spark, sf).select("query_id", "kb_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def e5_cosine_topk(spark, sf):
    return _dense(spark, sf).select("query_id", "kb_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _fused(spark, sf):
    return R.fuse(_bm25(spark, sf), _dense(spark, sf))


def e7_rrf(spark, sf):
    return _fused(spark, sf).select("query_id", "kb_id", "chunk_id", "lexical_rank", "dense_rank", F.round("score", 6).alias("score"), "rank")


def e8_scope(spark, sf):
    """One knowledge base, without a stored index: the scope's filter reaches the scan."""
    only = F.col("kb_id") == "en"
    return R.top_k(R.bm25(_chunks(spark, sf).where(only), _queries(spark, sf).where(only)), R.LEXICAL_TOP_K).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def e9_doc_filter(spark, sf):
    """Documents listed by a query are those that agree with it modulo 3."""
    hits = _fused(spark, sf).withColumn("doc_id", F.col("chunk_id"))
    listed = hits.where("doc_id % 3 = query_id % 3").select("query_id", "doc_id").distinct()
    return R.in_documents(hits, listed).select("query_id", "kb_id", "doc_id", "rank")


def _listed(spark, sf):
    """Each query's list of documents, and the lists: documents that agree with the query modulo 3."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 3).alias("list_id")).distinct()
    return q, table(spark, sf, "documents").select("doc_id", (F.col("doc_id") % 3).alias("list_id")).distinct()


def e9_prefilter(spark, sf):
    """Rankings inside each query's documents, with the scope's own statistics, fused."""
    lists = _listed(spark, sf)
    lexical = _index(spark, sf).bm25_top_k(_queries(spark, sf), R.LEXICAL_TOP_K, lists)
    dense = R.cosine_top_k(_dense_chunks(spark, sf), _vectors(spark, sf), R.DENSE_TOP_K, lists)
    return R.fuse(lexical, dense).select("query_id", "kb_id", "chunk_id", "lexical_rank", "dense_rank", F.round("score", 6).alias("score"), "rank")


def e10_topk_override(spark, sf):
    """Each query's own k, at least the defaults in both rankings, and as it is in the fused list."""
    k = R.override(F.col("query_id").cast("int"))
    lexical = _index(spark, sf).bm25_top_k(_queries(spark, sf), k["lexical"])
    dense = R.cosine_top_k(_dense_chunks(spark, sf), _vectors(spark, sf), k["dense"])
    return R.fuse(lexical, dense, k["rerank"]).select("query_id", "kb_id", "chunk_id", "lexical_rank", "dense_rank", "rank")


def e11_mode(spark, sf):
    return R.mode(_queries(spark, sf), _fused(spark, sf))


def e12_upsert(spark, sf):
    index = _chunks(spark, sf)
    batch = index.where("doc_id % 7 = 0").withColumn("text", F.concat(F.lit("new "), "text"))
    return R.upsert(index, batch).select("chunk_id", "kb_id", F.md5("text").alias("text_md5"))


def e13_remove_doc(spark, sf):
    removed = table(spark, sf, "labels").where("quality = 0").select("doc_id").distinct()
    return R.remove_documents(_chunks(spark, sf), removed).groupBy("kb_id").agg(F.count("*").alias("chunks"), F.count_distinct("doc_id").alias("documents"))


def e14_fetch_chunk(spark, sf):
    """Null where the chunk is unknown or in another knowledge base."""
    asked = table(spark, sf, "labels").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr").alias("kb_id"))
    own = _chunks(spark, sf).select(F.col("chunk_id").alias("doc_id"), "kb_id", F.length("text").cast("long").alias("n_chars"))
    return asked.join(own, ["doc_id", "kb_id"], "left")


def e15_citation(spark, sf):
    chunks = _chunks(spark, sf).withColumn("title", F.concat(F.lit("doc-"), "doc_id")).withColumn("page", F.lit(1)).withColumn("bbox", F.array(F.lit(0.0), (F.col("doc_id") % 10 / 10))).withColumn("element_id", F.concat(F.lit("el-"), "doc_id"))
    hits = _bm25(spark, sf).where("rank <= 3")
    return R.citations(hits, chunks).withColumn("score", F.round("score", 6))


_TOK = r"coalesce(regexp_extract_all(lower(text), '[a-z0-9_]+'), [])"
_BASE = rf"""
ch AS (SELECT lang AS kb_id, doc_id AS chunk_id, doc_id, text, {_TOK} AS w FROM documents),
q AS (SELECT item_id AS query_id, k.kb_id, {_TOK} AS w FROM benchmark, (SELECT DISTINCT lang AS kb_id FROM documents WHERE lang IS NOT NULL) k),
p AS (SELECT kb_id, chunk_id, token, len(any_value(w)) AS l, count(*) AS tf FROM (SELECT kb_id, chunk_id, w, unnest(w) AS token FROM ch) GROUP BY kb_id, chunk_id, token),
d AS (SELECT kb_id, token, count(*) AS df FROM p GROUP BY ALL),
s AS (SELECT kb_id, count(*) AS n, greatest(avg(len(w)), 1.0) AS avg_len FROM ch GROUP BY kb_id),
qt AS (SELECT query_id, kb_id, token, count(*) AS qtf FROM (SELECT query_id, kb_id, unnest(w) AS token FROM q) GROUP BY ALL),
b AS (
  SELECT query_id, kb_id, chunk_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * qtf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / avg_len))) AS score
  FROM qt JOIN p USING (kb_id, token) JOIN d USING (kb_id, token) JOIN s USING (kb_id) GROUP BY ALL HAVING score > 0),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank FROM b QUALIFY rank <= 12)"""
_MIXED = """CASE doc_id % 3 WHEN 0 THEN list_concat(list_append(w, 'q'), ['知', '识', '图', '知识', '识图', '知']) WHEN 1 THEN list_append(w, 'age1_fi') ELSE w END"""
_DENSE = r"""
v AS (SELECT vec_id // 100 AS query_id, k.kb_id, embedding::DOUBLE[] AS x FROM embeddings, (SELECT DISTINCT lang AS kb_id FROM documents WHERE lang IS NOT NULL) k WHERE vec_id % 100 = 0),
cv AS (SELECT lang AS kb_id, doc_id AS chunk_id, embedding::DOUBLE[] AS y FROM documents JOIN embeddings ON vec_id = doc_id),
cs AS (SELECT query_id, kb_id, chunk_id, list_cosine_similarity(x, y) AS score FROM v JOIN cv USING (kb_id)),
den AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY round(score, 9) DESC, chunk_id)::INTEGER AS rank FROM cs QUALIFY rank <= 12)"""
_FUSED = r"""
fu AS (
  SELECT query_id, kb_id, chunk_id, lex.rank AS lexical_rank, den.rank AS dense_rank, coalesce(1.0::DOUBLE / (60 + lex.rank), 0) + coalesce(1.0::DOUBLE / (60 + den.rank), 0) AS fused
  FROM lex FULL JOIN den USING (query_id, kb_id, chunk_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, kb_id ORDER BY round(fused, 9) DESC, chunk_id)::INTEGER AS rank FROM fu QUALIFY rank <= 8),
hits AS (SELECT *, least(1.0, fused / max(fused) OVER (PARTITION BY query_id, kb_id)) AS score FROM best)"""
_W = f"WITH {_BASE} "
_H = f"WITH {_BASE}, {_DENSE}, {_FUSED} "

QUERIES = {f.__name__: f for f in (
    e1_tokens, e1_mixed, e2_postings, e2_stored, e3_document_frequency, e3_scope_statistics, e4_bm25_topk, e5_cosine_topk, e7_rrf, e8_scope, e9_doc_filter, e9_prefilter, e10_topk_override, e11_mode, e12_upsert, e13_remove_doc, e14_fetch_chunk, e15_citation,
)}

SQL = {
    "e1_tokens": _W + "SELECT chunk_id, len(w)::BIGINT AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM ch",
    "e2_postings": _W + "SELECT chunk_id, any_value(l)::BIGINT AS len, count(*) AS terms, max(tf) AS max_tf, sum(tf * tf)::BIGINT AS tf2 FROM p GROUP BY chunk_id",
    "e1_mixed": _W + f", m AS (SELECT chunk_id, {_MIXED} AS w FROM ch) SELECT chunk_id, len(w)::BIGINT AS n_tokens, md5(array_to_string(w, ' ')) AS tokens_md5 FROM m",
    "e2_stored": _W + "SELECT kb_id, chunk_id, token, tf, l::BIGINT AS len FROM p WHERE (kb_id, token) IN (SELECT (kb_id, token) FROM qt)",
    "e3_document_frequency": _W + "SELECT kb_id, token, df FROM d",
    "e3_scope_statistics": _W + "SELECT kb_id, n, round(avg_len, 6) AS avg_len FROM s",
    "e4_bm25_topk": _W + "SELECT query_id, kb_id, chunk_id, round(score, 6) AS score, rank FROM lex",
    "e5_cosine_topk": f"WITH {_DENSE} SELECT query_id, kb_id, chunk_id, round(score, 6) AS score, rank FROM den",
    "e7_rrf": _H + "SELECT query_id, kb_id, chunk_id, lexical_rank, dense_rank, round(score, 6) AS score, rank FROM hits",
    "e8_scope": _W + "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM lex WHERE kb_id = 'en'",
    "e9_doc_filter": _H + "SELECT query_id, kb_id, chunk_id AS doc_id, rank FROM hits WHERE chunk_id % 3 = query_id % 3",
    "e9_prefilter": (_H.replace("FROM b QUALIFY", "FROM b WHERE chunk_id % 3 = query_id % 3 QUALIFY").replace("FROM cs QUALIFY", "FROM cs WHERE chunk_id % 3 = query_id % 3 AND query_id IN (SELECT item_id FROM benchmark) QUALIFY")
      + "SELECT query_id, kb_id, chunk_id, lexical_rank, dense_rank, round(score, 6) AS score, rank FROM hits"),
    "e10_topk_override": _H.replace("QUALIFY rank <= 12", "QUALIFY rank <= greatest(12, query_id)").replace("QUALIFY rank <= 8", "QUALIFY rank <= query_id") + "SELECT query_id, kb_id, chunk_id, lexical_rank, dense_rank, rank FROM hits",
    "e11_mode": _H + "SELECT q.query_id, q.kb_id, count(hits.chunk_id) AS hits, CASE WHEN count(hits.chunk_id) = 0 THEN 'empty' WHEN count(dense_rank) > 0 THEN 'hybrid' ELSE 'lexical_fallback' END AS mode FROM q LEFT JOIN hits USING (query_id, kb_id) GROUP BY ALL",
    "e12_upsert": "SELECT doc_id AS chunk_id, lang AS kb_id, md5(CASE WHEN doc_id % 7 = 0 THEN 'new ' || text ELSE text END) AS text_md5 FROM documents",
    "e13_remove_doc": "SELECT lang AS kb_id, count(*) AS chunks, count(DISTINCT doc_id) AS documents FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY lang",
    "e14_fetch_chunk": "SELECT l.doc_id, l.kb_id, length(d.text)::BIGINT AS n_chars FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'fr' END AS kb_id FROM labels) l LEFT JOIN documents d ON d.doc_id = l.doc_id AND d.lang = l.kb_id",
    "e15_citation": _W + "SELECT query_id, 'citation:' || chunk_id AS citation_id, doc_id, 'doc-' || doc_id AS title, 1 AS page, [0.0::DOUBLE, doc_id % 10 / 10::DOUBLE] AS bbox, 'el-' || doc_id AS element_id, text[1:120] AS excerpt, round(score, 6) AS score FROM lex JOIN ch USING (kb_id, chunk_id) WHERE rank <= 3",
}
