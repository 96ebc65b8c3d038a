"""Hybrid retrieval for many queries at once: postings, BM25, cosine, rank fusion, scopes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import settled_tokens, term_counts, tokens, unsettled
from docloom.sources.shared import cut

# BM25 and fusion constants, and how many hits each ranking keeps.
K1, B, RRF = 1.5, 0.75, 60
LEXICAL_TOP_K, DENSE_TOP_K, RERANK_TOP_K = 12, 12, 8
#: Query-side rows that may be broadcast; more are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Chunks and queries that are scored against each other in one group, and queries whose scores are held at a time.
CHUNK_BLOCK, QUERY_BLOCK, SLAB = 16_384, 2_048, 64
#: Scores that a block tells of a query at most, to find the least that can be among its best, and how many of them its share of the k hits takes.
TOLD, SHARE = 16, 4


def small_side(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a table whose counted rows stay below the bound."""
    return F.broadcast(df) if df.count() <= rows else df


def tokenised(chunks: DataFrame) -> DataFrame:
    """chunks (text) with w (tokens), less the text, and len; only texts that NFKC may change are sent to Python."""
    rest = [c for c in chunks.columns if c != "text"]
    odd = unsettled(F.col("text"))
    each = lambda df, w: df.select(*rest, w(F.col("text")).alias("w"))
    return each(chunks.where(~odd), settled_tokens).union(each(chunks.where(odd), tokens)).withColumn("len", F.size("w"))


def counted(chunks: DataFrame) -> DataFrame:
    """chunks with len and terms (token, tf), less the text. Terms are counted inside their row, so nothing is shuffled for it."""
    words = tokenised(chunks)
    return words.select(*(c for c in words.columns if c != "w"), term_counts(F.col("w")).alias("terms"))


def posted(counts: DataFrame) -> DataFrame:
    """A row for each term of counted chunks."""
    return counts.select(*(c for c in counts.columns if c != "terms"), F.explode("terms").alias("t")).select("*", "t.token", "t.tf").drop("t")


def postings(chunks: DataFrame) -> DataFrame:
    """kb_id, chunk_id, len, token, tf of chunks (kb_id, chunk_id, text); len counts all tokens."""
    return posted(counted(chunks))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("kb_id", "token").agg(F.count("*").alias("df"))


def chunk_frequency(chunks: DataFrame) -> DataFrame:
    """As document_frequency of the chunks' postings; a chunk's distinct tokens are enough, so its terms are not counted."""
    return document_frequency(tokenised(chunks).select("kb_id", F.explode(F.array_distinct("w")).alias("token")))


def scope_statistics(chunks: DataFrame) -> DataFrame:
    """kb_id, n chunks and mean length, at least 1."""
    return _statistics(tokenised(chunks))


def _statistics(words: DataFrame) -> DataFrame:
    return words.groupBy("kb_id").agg(F.count("*").alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avg_len"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, kb_id, token, qtf of queries (query_id, kb_id, text)."""
    return posted(counted(queries.select("query_id", "kb_id", "text"))).select("query_id", "kb_id", "token", F.col("tf").alias("qtf"))


def rank_key(score: Column) -> Column:
    """Ranks ignore what summation order can change."""
    return F.round(score, 9)


def top_k(scored: DataFrame, k: int | Column, by: str = "score", over: tuple[str, ...] = ("query_id", "kb_id")) -> DataFrame:
    """The best k per query, ties by chunk id, with ``rank`` from 1."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*over).orderBy(F.desc(rank_key(F.col(by))), "chunk_id")))
    return ranked.where(F.col("rank") <= k)


def bm25_weights(asked: DataFrame, df: DataFrame, statistics: DataFrame) -> DataFrame:
    """query_id, kb_id, token, weight (idf times qtf), avg_len of query terms, by df (kb_id, token, df) and statistics (kb_id, n, avg_len)."""
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(df, ["kb_id", "token"]).join(statistics, "kb_id").select("query_id", "kb_id", "token", (idf * F.col("qtf")).alias("weight"), "avg_len")


def bm25_score(hits: DataFrame, weights: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """query_id, kb_id, chunk_id, score > 0 of postings (kb_id, chunk_id, token, tf, len) that have a term of a query.

    With ``within`` (query_id, doc_id) only chunks (doc_id) of the query's documents are scored; they are met before
    any score is added up. Weights, and so statistics, stay those of the whole scope.
    """
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    both = hits.join(weights, ["kb_id", "token"])
    if within is not None:
        both = both.join(small_side(within.select("query_id", "doc_id").distinct()), ["query_id", "doc_id"], "left_semi")
    return both.groupBy("query_id", "kb_id", "chunk_id").agg(F.sum(part).alias("score")).where("score > 0")


def bm25(chunks: DataFrame, queries: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """query_id, kb_id, chunk_id, score > 0, for queries (query_id, kb_id, text), without a stored index.

    Chunks are tokenised and counted once and written. Only postings of query terms are scored: the terms
    are met before any shuffle, so a common token that no query asks for is never moved. For ``within`` see
    bm25_score; chunks then have a doc_id.
    """
    counts = cut(counted(chunks.select("kb_id", "chunk_id", *(["doc_id"] if within is not None else []), "text")))
    asked = cut(query_terms(queries))
    few = asked.count() <= BROADCAST_ROWS  # terms of the query set, and so of all that is derived from them
    side = F.broadcast if few else lambda x: x
    hit = cut(posted(counts).join(side(asked.select("kb_id", "token").distinct()), ["kb_id", "token"], "left_semi"))
    return bm25_score(hit, side(bm25_weights(asked, document_frequency(hit), _statistics(counts))), within)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(chunks: DataFrame, queries: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """query_id, kb_id, chunk_id, score for queries (query_id, kb_id, vector) against chunks (kb_id, chunk_id, embedding).

    Null vectors and other dimensions are skipped; a zero norm gives 0. The queries are a stated set, so
    the work is queries times the chunks of their scope, met by the scope's key. With ``within`` (query_id, doc_id)
    only chunks (doc_id) of the query's documents are compared, met by the document's key.
    """
    norm = lambda v: F.sqrt(_dot(v, v))
    c = chunks.where("embedding is not null").select("kb_id", "chunk_id", *(["doc_id"] if within is not None else []), "embedding", norm(F.col("embedding")).alias("cn"))
    q = queries.where("vector is not null").select("query_id", "kb_id", "vector", norm(F.col("vector")).alias("qn"))
    if within is not None:
        q = q.join(within.select("query_id", "doc_id").distinct(), "query_id")
    both = c.join(small_side(q), ["kb_id", "doc_id"] if within is not None else "kb_id").where(F.size("embedding") == F.size("vector"))
    size = F.col("cn") * F.col("qn")
    return both.select("query_id", "kb_id", "chunk_id", F.when(size > 0, _dot(F.col("embedding"), F.col("vector")) / size).otherwise(0.0).alias("score"))


def _best(scores: np.ndarray, k: np.ndarray, least: np.ndarray, above: float | None = None) -> list[np.ndarray]:
    """For each row of scores the columns of the best k by rounded score (NaN first), ties by column; only those above a bound, and not below the row's least."""
    out, n = [], scores.shape[1]
    for row, most, floor in zip(scores, k, least, strict=True):
        row = np.where(np.isnan(row), np.inf, row)
        most = min(max(int(most), 0), n)
        low = max(np.partition(row, n - most)[n - most], floor) - 2e-9 if most else np.inf
        at = np.flatnonzero(row >= low) if most else np.empty(0, int)
        if above is not None:
            at = at[row[at] > above]
        out.append(at[np.argsort(-np.round(row[at], 9), kind="stable")][:most])
    return out


def _told(scores: np.ndarray, step: np.ndarray, above: float | None = None) -> list[np.ndarray]:
    """For each row of scores every step-th of its best scores, TOLD at most: as many times step scores are no less than each."""
    out, n = [], scores.shape[1]
    for row, s in zip(scores, step, strict=True):
        row = np.where(np.isnan(row), np.inf, row)
        row = row if above is None else row[row > above]
        most = min(TOLD * int(s), len(row))
        out.append(-np.sort(-np.partition(row, len(row) - most)[len(row) - most :])[int(s) - 1 :: int(s)] if most else row[:0])
    return out


def _ranked_blocks(rows: DataFrame, asked: DataFrame, by: list[str], n_chunks: int, score, k: int | Column) -> DataFrame:
    """query_id, kb_id, chunk_id, score, rank: the best k chunks of each query, where only a block's best leave the block.

    Rows of chunks (chunk_id) and of queries (query_id) meet by the columns ``by``, in blocks of both; ``score`` gives the
    chunk ids in order, the queries' rows and a function that scores a range of the queries against the block's chunks. A
    block holds CHUNK_BLOCK chunks and QUERY_BLOCK queries of the whole at most on average, so memory doesn't grow.

    Where each query has its own k, which may be larger than a block, the blocks are scored twice: first each tells some of
    its best scores (``_told``), so that at least k are known to be no less than the query's least one (_t), and then only
    scores from there on leave their block: about k and a share of k for all blocks together, not k for each block.
    """
    over = max(1, -(-n_chunks // CHUNK_BLOCK))
    ask = max(1, -(-asked.select("query_id").distinct().count() // QUERY_BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_c", block("chunk_id", over)).withColumn("_q", every(ask))
    own_k = not isinstance(k, int)
    asked = asked.withColumn("_k", (k if own_k else F.lit(k)).cast("long"))
    dealt = lambda df: df.withColumn("_q", block("query_id", ask)).withColumn("_c", every(over))
    of = {c: rows.schema[c].dataType.simpleString() for c in ("kb_id", "chunk_id")} | {"query_id": asked.schema["query_id"].dataType.simpleString()}

    def scored(a: pa.Table, b: pa.Table):
        """The block's chunks and knowledge base, and a slab of its queries at a time with their scores and bound."""
        if a.num_rows and b.num_rows:
            chunks, queries, slab = score(a, b)
            for start in range(0, queries.num_rows, SLAB):
                part = queries.slice(start, SLAB)
                yield chunks, a.column("kb_id").slice(0, 1), part, *slab(start, start + part.num_rows)

    def joined(a: pa.Table, b: pa.Table, found: dict[str, list], **more: pa.DataType) -> pa.Table:
        types = {"query_id": b.schema.field("query_id").type, "kb_id": a.schema.field("kb_id").type} | more
        flat = {c: [v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v for v in x] for c, x in found.items()}
        return pa.table({c: pa.chunked_array([x for x in flat.get(c, ()) if len(x)], t) for c, t in types.items()})

    def tell(a: pa.Table, b: pa.Table) -> pa.Table:
        found = {"query_id": [], "kb_id": [], "told": []}
        for _, kb, part, scores, above in scored(a, b):
            told = _told(scores, -(-np.maximum(part.column("_k").to_numpy(), 1) // (SHARE * over)), above)
            for c, v in zip(found, (part.column("query_id"), kb.take(pa.array(np.zeros(len(told), int))), pa.array(told, pa.list_(pa.float64()))), strict=True):
                found[c].append(v)
        return joined(a, b, found, told=pa.list_(pa.float64()))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        found = {c: [] for c in ("query_id", "kb_id", "chunk_id", "score", "key")}
        for chunks, kb, part, scores, above in scored(a, b):
            best = _best(scores, part.column("_k").to_numpy(), pc.fill_null(part.column("_t"), -np.inf).to_numpy(), above)
            at = np.concatenate(best) if best else np.empty(0, int)
            who = np.repeat(np.arange(part.num_rows), [len(x) for x in best])
            value = scores[who, at]
            for c, v in zip(found, (part.column("query_id").take(pa.array(who)), kb.take(pa.array(np.zeros(len(at), int))), chunks.take(pa.array(at)), pa.array(value), pa.array(np.round(value, 9))), strict=True):
                found[c].append(v)
        return joined(a, b, found, chunk_id=a.schema.field("chunk_id").type, score=pa.float64(), key=pa.float64())

    keys, query = [*by, "_c", "_q"], ["query_id", "kb_id"]
    blocks = lambda asked, f, form: left.groupBy(*keys).cogroup(dealt(asked).groupBy(*keys)).applyInArrow(f, f"query_id {of['query_id']}, kb_id {of['kb_id']}, {form}")
    ask_all = asked.withColumn("_t", F.lit(None).cast("double"))
    if own_k and over > 1:
        told = blocks(ask_all, tell, "told array<double>").groupBy(*query).agg(F.sort_array(F.flatten(F.collect_list("told")), asc=False).alias("_all"))
        needed = F.ceil(F.col("_k") / F.ceil(F.greatest(F.col("_k"), F.lit(1)) / F.lit(SHARE * over))).cast("int")
        ask_all = asked.join(told, query, "left").withColumn("_t", F.get("_all", F.greatest(needed, F.lit(1)) - 1)).drop("_all")
    near = blocks(ask_all, run, f"chunk_id {of['chunk_id']}, score double, key double")
    if not own_k:
        return top_k(near, k, by="key").drop("key")
    return top_k(near.join(asked.select(*query, "_k").distinct(), query), F.col("_k"), by="key").drop("key", "_k")


def _scoped(rows: DataFrame, lists: DataFrame | None, key: str) -> tuple[DataFrame, list[str]]:
    return (rows, ["kb_id"]) if lists is None else (rows.join(lists, key), ["kb_id", "list_id"])


def bm25_top_k(hits: DataFrame, weights: DataFrame, n_chunks: int, k: int | Column, lists: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """As top_k of bm25_score, by blocks: a posting is moved once, and of a block's scores only the best of each query.

    ``lists`` are each query's list of documents (query_id, list_id; one a query) and the lists' documents (list_id, doc_id):
    a query ranks those of its list only. Lists are shared, so pairs of queries and documents are never written out.
    """
    rows, by = _scoped(hits, lists and lists[1], "doc_id")
    asked, _ = _scoped(weights, lists and lists[0], "query_id")

    def score(a: pa.Table, b: pa.Table):
        chunk, token = (pc.dictionary_encode(a.column(c).combine_chunks()) for c in ("chunk_id", "token"))
        order = pc.sort_indices(chunk.dictionary).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        chunks, at = chunk.dictionary.take(pa.array(order)), place[chunk.indices.to_numpy()]
        query = pc.dictionary_encode(b.column("query_id").combine_chunks())
        first = pc.index_in(query.dictionary, b.column("query_id").combine_chunks())
        queries = b.select(["query_id", "_k", "_t"]).take(first)
        tf, length = a.column("tf").to_numpy().astype(float), a.column("len").to_numpy().astype(float)
        part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / b.column("avg_len")[0].as_py()))
        ids = token.indices.to_numpy()
        by_token = np.argsort(ids, kind="stable")
        ends = np.searchsorted(ids[by_token], np.arange(len(token.dictionary) + 1))
        term = pc.index_in(b.column("token").combine_chunks(), value_set=token.dictionary)
        known = pc.is_valid(term).to_numpy(zero_copy_only=False)
        term, who, weight = (x[known] for x in (pc.fill_null(term, 0).to_numpy(), query.indices.to_numpy(), b.column("weight").to_numpy()))

        def slab(low: int, high: int) -> tuple[np.ndarray, float]:
            scores = np.zeros((high - low, len(chunks)))
            for i in np.flatnonzero((who >= low) & (who < high)):
                own = by_token[ends[term[i]] : ends[term[i] + 1]]
                scores[who[i] - low, at[own]] += weight[i] * part[own]
            return scores, 0.0

        return chunks, queries, slab

    return _ranked_blocks(rows.select(*by, "chunk_id", "token", "tf", "len"), asked.select(*by, "query_id", "token", "weight", "avg_len"), by, n_chunks, score, k)


def cosine_top_k(chunks: DataFrame, queries: DataFrame, k: int | Column, lists: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """As top_k of cosine, by blocks whose scores are one product of matrices; for ``lists`` see bm25_top_k."""
    norm = lambda v: F.sqrt(_dot(v, v))
    rows, by = _scoped(chunks.where("embedding is not null and kb_id is not null"), lists and lists[1], "doc_id")
    asked, _ = _scoped(queries.where("vector is not null"), lists and lists[0], "query_id")
    rows = rows.select(*by, "chunk_id", "embedding", norm(F.col("embedding")).alias("cn"), F.size("embedding").alias("_d"))
    asked = asked.select(*by, "query_id", "vector", norm(F.col("vector")).alias("qn"), F.size("vector").alias("_d"))

    def score(a: pa.Table, b: pa.Table):
        order = pc.sort_indices(a.column("chunk_id")).to_numpy()
        matrix = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(t.num_rows, t.column("_d")[0].as_py())
        size = lambda t, c: pc.fill_null(t.column(c), 0.0).to_numpy()
        y, cn, x, qn = matrix(a, "embedding")[order], size(a, "cn")[order], matrix(b, "vector"), size(b, "qn")

        def slab(low: int, high: int) -> tuple[np.ndarray, None]:
            both = qn[low:high, None] * cn
            with np.errstate(all="ignore"):
                return np.where((both > 0) | np.isnan(both), x[low:high] @ y.T / both, 0.0), None

        return a.column("chunk_id").take(pa.array(order)), b.select(["query_id", "_k", "_t"]), slab

    return _ranked_blocks(rows, asked, [*by, "_d"], chunks.select("chunk_id").count(), score, k)


def override(k: Column) -> dict[str, Column]:
    """How many hits each ranking keeps where k are asked for: at least the defaults before the fusion, k after it; a null k asks for nothing."""
    return {
        "lexical": F.coalesce(F.greatest(F.lit(LEXICAL_TOP_K), k), F.lit(LEXICAL_TOP_K)), "dense": F.coalesce(F.greatest(F.lit(DENSE_TOP_K), k), F.lit(DENSE_TOP_K)),
        "rerank": F.coalesce(k, F.lit(RERANK_TOP_K)),
    }


def fuse(lexical: DataFrame, dense: DataFrame, k: int | Column = RERANK_TOP_K) -> DataFrame:
    """Reciprocal-rank fusion of two ranked tables; the score is scaled by the best of the returned list."""
    keys = ["query_id", "kb_id", "chunk_id"]
    both = lexical.select(*keys, F.col("rank").alias("lexical_rank"), F.col("score").alias("lexical_score")).join(
        dense.select(*keys, F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score")), keys, "full_outer"
    )
    share = lambda c: F.coalesce(1.0 / (RRF + F.col(c)), F.lit(0.0))
    best = top_k(both.withColumn("fused", share("lexical_rank") + share("dense_rank")), k, by="fused")
    scale = F.max("fused").over(Window.partitionBy("query_id", "kb_id"))
    return best.withColumn("score", F.least(F.lit(1.0), F.col("fused") / scale))


def in_documents(hits: DataFrame, wanted: DataFrame) -> DataFrame:
    """Hits whose document is listed (query_id, doc_id); applied after the ranking, so fewer than k may stay."""
    return hits.join(wanted, ["query_id", "doc_id"], "left_semi")


def mode(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, kb_id, hits, mode: empty, hybrid (some dense rank) or lexical_fallback."""
    n = hits.groupBy("query_id", "kb_id").agg(F.count("*").alias("hits"), F.count("dense_rank").alias("dense"))
    label = F.when(F.coalesce("hits", F.lit(0)) == 0, "empty").when(F.col("dense") > 0, "hybrid").otherwise("lexical_fallback")
    return queries.select("query_id", "kb_id").join(n, ["query_id", "kb_id"], "left").select("query_id", "kb_id", F.coalesce("hits", F.lit(0)).alias("hits"), label.alias("mode"))


def upsert(index: DataFrame, batch: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The newest row of each key: rows of the batch (version 1) replace those of the index (version 0)."""
    both = index.withColumn("_v", F.lit(0)).unionByName(batch.withColumn("_v", F.lit(1)))
    newest = Window.partitionBy(key).orderBy(F.desc("_v"))
    return both.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_v", "_r")


def remove_documents(index: DataFrame, removed: DataFrame) -> DataFrame:
    return index.join(removed, "doc_id", "left_anti")


def citations(hits: DataFrame, chunks: DataFrame, excerpt: int = 120) -> DataFrame:
    """Hits as citations: id, document, title, page, box and element (where chunks have them), excerpt and score."""
    more = [c for c in ("bbox", "element_id") if c in chunks.columns]
    own = chunks.select("kb_id", "chunk_id", "doc_id", "title", "page", *more, F.substring("text", 1, excerpt).alias("excerpt"))
    return hits.join(own, ["kb_id", "chunk_id"]).select("query_id", F.concat(F.lit("citation:"), "chunk_id").alias("citation_id"), "doc_id", "title", "page", *more, "excerpt", "score")
