"""Streaming queries over the same tables: each stream is run until its input is read, and its result returned."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.sources.derived import table
from docloom.sources.index_store import IndexStore
from docloom.sources.shared import shared_dir
from docloom.streaming.jobs import follow_jobs, refresh_index


def _shared(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _streamed(spark: SparkSession, sf: str) -> IndexStore:
    """An index that all documents have come into as a stream, of which then every fifth came again with another text."""
    documents = table(spark, sf, "documents")
    chunk = lambda df, text: df.select(F.col("lang").alias("kb_id"), F.col("doc_id").alias("chunk_id"), "doc_id", text.alias("text"))
    path = _shared(spark, "index")
    store = IndexStore(spark, path)
    stream = spark.readStream.schema(documents.schema).option("maxFilesPerTrigger", 4).parquet(f"{sf}/documents.parquet*")
    refresh_index(chunk(stream, F.col("text")), store, f"{path}/checkpoint").awaitTermination()
    again = documents.where("doc_id % 5 = 0")
    store.upsert(chunk(again, F.concat(F.lit("changed "), F.substring("text", 1, 200))), 1_000_000)
    return store


def e16_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequencies of the streamed index."""
    return _streamed(spark, sf).document_frequency()


def e16_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return _streamed(spark, sf).statistics().withColumn("avg_len", F.round("avg_len", 6))


def k11_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Job states after the events have come in: a user is a job, signups queue it, views run it."""
    events = table(spark, sf, "events")
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parquet*")
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "view", "running").otherwise("partial")
    jobs = follow_jobs(stream.select(F.col("user_id").alias("job_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts")))
    path = _shared(spark, "jobs")

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("batch", F.lit(epoch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/states")

    jobs.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    newest = Window.partitionBy("job_id").orderBy(F.desc("batch"))
    return spark.read.parquet(f"{path}/states").withColumn("_r", F.row_number().over(newest)).where("_r = 1").select("job_id", "status", "ignored")


QUERIES = {f.__name__: f for f in (e16_stream, e16_statistics, k11_stream)}

_NOW = "t AS (SELECT lang AS kb_id, doc_id, regexp_extract_all(lower(CASE WHEN doc_id % 5 = 0 THEN 'changed ' || text[1:200] ELSE text END), '[a-z0-9_]+') AS w FROM documents)"

SQL = {
    "e16_stream": f"WITH {_NOW}, p AS (SELECT DISTINCT kb_id, doc_id, unnest(w) AS token FROM t) SELECT kb_id, token, count(*) AS df FROM p GROUP BY ALL",
    "e16_statistics": f"WITH {_NOW} SELECT kb_id, count(*) AS n, round(greatest(avg(len(w)), 1.0), 6) AS avg_len FROM t GROUP BY 1",
}
