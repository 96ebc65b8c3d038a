"""A lexical index as stored tables, kept up by batches of new and replaced chunks.

Layout of a store's folder; ``batch`` numbers grow, and a batch that is written again replaces itself:

* ``forward``: a row a chunk (kb_id, chunk_id, doc_id, len, terms), partitioned by batch and a bucket of the chunk id.
* ``postings``: kb_id, token, chunk_id, doc_id, len, tf, partitioned by kb_id, a bucket of the token, and batch.
* ``df``, ``scopes``: what a batch adds to document frequencies, numbers of chunks and lengths; what it replaces is
  subtracted, so reading them costs what the vocabulary has, not the corpus.
* ``stale``: chunks of earlier batches that a batch replaces or removes.
* ``batches``: the batches that are complete; others are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.operators import retrieval as R
from docloom.sources.shared import cut

#: Buckets of tokens, and of chunk ids.
TOKEN_BUCKETS, CHUNK_BUCKETS = 16, 16


def _token_bucket(token: Column) -> Column:
    return F.pmod(F.hash(token), F.lit(TOKEN_BUCKETS))


class IndexStore:
    """Chunks have kb_id, chunk_id, doc_id and text; ids are of the types given (Spark's names)."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", kb_type: str = "string") -> None:
        self.spark, self.path = spark, path
        ids = f"kb_id {kb_type}, chunk_id {id_type}, doc_id {id_type}"
        self.schemas = {
            "forward": f"{ids}, len int, terms array<struct<token:string,tf:bigint>>, chunk_bucket int, batch bigint",
            "postings": f"{ids}, len int, token string, tf bigint, token_bucket int, batch bigint",
            "df": f"kb_id {kb_type}, token string, df bigint, batch bigint", "scopes": f"kb_id {kb_type}, n bigint, total bigint, batch bigint",
            "stale": f"chunk_id {id_type}, before bigint, batch bigint", "batches": "batch bigint",
        }

    def _exists(self, name: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def _read(self, name: str) -> DataFrame:
        if not self._exists(name):
            return self.spark.createDataFrame([], self.schemas[name])
        rows = self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")
        return rows if name == "batches" else rows.join(F.broadcast(self.batches()), "batch", "left_semi")  # one row a batch

    def batches(self) -> DataFrame:
        return self._read("batches").distinct()

    def _write(self, rows: DataFrame, name: str, batch: int, *by: str) -> None:
        rows = rows.withColumn("batch", F.lit(batch).cast("long"))
        if by:
            rows = rows.hint("rebalance", *by).sortWithinPartitions(*by, *(["token"] if "token" in rows.columns else []))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by, "batch").parquet(f"{self.path}/{name}")

    def _present(self, ids: DataFrame, before: int) -> DataFrame:
        """The newest stored row of each chunk of ``ids`` (chunk_id, chunk_bucket) that no earlier batch has removed."""
        rows = self._read("forward").where(F.col("batch") < before).join(R.small_side(ids), ["chunk_id", "chunk_bucket"], "left_semi")
        return self._standing(rows, before)

    def _standing(self, rows: DataFrame, before: int | None = None) -> DataFrame:
        """Rows that no batch (of those before the given one) has replaced or removed; where none has replaced any, they aren't joined."""
        if not self._exists("stale"):
            return rows
        stale = self._read("stale")
        stale = stale if before is None else stale.where(F.col("batch") < before)
        return rows.join(R.small_side(stale.select("chunk_id", F.col("before").alias("batch"))), ["chunk_id", "batch"], "left_anti")

    def upsert(self, chunks: DataFrame, batch: int, removed: DataFrame | None = None) -> None:
        """Writes new chunks, and replaces those that are there; chunks of ``removed`` (chunk_id) go. Of a repeated id in a batch one row is kept."""
        twice = cut(chunks.groupBy("chunk_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("chunk_id").alias("_id")))
        same, twice = F.col("chunk_id").eqNullSafe(F.col("_id")), R.small_side(twice)
        first = F.row_number().over(Window.partitionBy("chunk_id").orderBy("doc_id", "text"))  # only texts whose id repeats are shuffled
        one = chunks.join(twice, same, "left_anti").unionByName(chunks.join(twice, same, "left_semi").withColumn("_r", first).where("_r = 1").drop("_r"))
        bucket = F.pmod(F.hash("chunk_id"), F.lit(CHUNK_BUCKETS))
        fresh = cut(R.counted(one.select("kb_id", "chunk_id", "doc_id", "text")).withColumn("chunk_bucket", bucket))
        touched = fresh.select("chunk_id")
        if removed is not None:
            touched = touched.union(removed.select("chunk_id")).distinct()
        old = cut(self._present(touched.withColumn("chunk_bucket", bucket), batch)) if self._exists("forward") else None
        signed = fresh.select("kb_id", "len", "terms", F.lit(1).alias("sign"))
        if old is not None:
            signed = signed.union(old.select("kb_id", "len", "terms", F.lit(-1)))
            self._write(old.select("chunk_id", F.col("batch").alias("before")), "stale", batch)
        self._write(fresh, "forward", batch, "chunk_bucket")
        posts = R.posted(fresh.drop("chunk_bucket")).withColumn("token_bucket", _token_bucket(F.col("token")))
        self._write(posts, "postings", batch, "kb_id", "token_bucket")
        each = signed.select("kb_id", "sign", F.explode("terms.token").alias("token"))
        self._write(each.groupBy("kb_id", "token").agg(F.sum("sign").alias("df")).where("df <> 0"), "df", batch)
        self._write(signed.groupBy("kb_id").agg(F.sum("sign").alias("n"), F.sum(F.col("sign") * F.col("len")).alias("total")), "scopes", batch)
        done = self.spark.range(batch, batch + 1).select(F.col("id").alias("batch"))
        done.coalesce(1).write.mode("append").parquet(f"{self.path}/batches")

    def document_frequency(self) -> DataFrame:
        """kb_id, token, df."""
        return self._read("df").groupBy("kb_id", "token").agg(F.sum("df").alias("df")).where("df > 0")

    def statistics(self) -> DataFrame:
        """kb_id, n, avg_len (at least 1)."""
        s = self._read("scopes").groupBy("kb_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).where("n > 0")
        return s.select("kb_id", "n", F.greatest(F.col("total") / F.col("n"), F.lit(1.0)).alias("avg_len"))

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """kb_id, chunk_id, doc_id, len, token, tf; of the given terms (kb_id, token) only, whose partitions alone are read."""
        rows = self._read("postings")
        if terms is not None:
            asked = terms.select("kb_id", "token").distinct().withColumn("token_bucket", _token_bucket(F.col("token")))
            rows = rows.join(R.small_side(asked), ["kb_id", "token_bucket", "token"], "left_semi")
        return self._standing(rows).select("kb_id", "chunk_id", "doc_id", "len", "token", "tf")

    def bm25(self, queries: DataFrame, within: DataFrame | None = None) -> DataFrame:
        """query_id, kb_id, chunk_id, score > 0, for queries (query_id, kb_id, text); no chunk is tokenised. For ``within`` see bm25_score."""
        return R.bm25_score(*self._asked(queries), within)

    def bm25_top_k(self, queries: DataFrame, k: int | Column, lists: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """The best k of bm25 for each query, with ``rank``; for ``lists`` see operators.retrieval.bm25_top_k."""
        n = self.statistics().agg(F.sum("n")).first()[0] or 0
        return R.bm25_top_k(*self._asked(queries), n, k, lists)

    def _asked(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The postings that have a term of a query, and the queries' weights."""
        asked = cut(R.query_terms(queries))
        few = asked.count() <= R.BROADCAST_ROWS
        side = F.broadcast if few else lambda x: x
        terms = asked.select("kb_id", "token").distinct()
        df = self._read("df").join(side(terms), ["kb_id", "token"], "left_semi").groupBy("kb_id", "token").agg(F.sum("df").alias("df")).where("df > 0")
        return self.postings(terms), side(R.bm25_weights(asked, df, self.statistics()))


def stored_index(spark: SparkSession, path: str, source: str, chunks: DataFrame, id_type: str = "bigint") -> IndexStore:
    """The index of ``chunks`` under ``path``, named by the source's files with their sizes and times; built where it isn't there yet."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(source)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    told = sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)
    name = spark.range(1).select(F.sha2(F.lit("|".join(told)), 256)).first()[0][:24]
    store = IndexStore(spark, f"{path}/index-{name}", id_type)
    if not store._exists("batches"):
        store.upsert(chunks, 0)
    return store
