"""Queries over jobs (derived from events) and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import jobs as J
from docloom.sources.derived import jobs, table, with_tables


def _docs(spark, sf):
    """Users as documents, with a status from their id."""
    d = table(spark, sf, "events").select(F.col("user_id").alias("doc_id")).distinct()
    status = F.when(F.col("doc_id") % 4 == 0, "failed").when(F.col("doc_id") % 9 == 0, "indexing").otherwise("ready")
    return d.select("doc_id", (F.col("doc_id") % 7).alias("kb_id"), status.alias("status"), (F.col("doc_id") % 10 == 0).alias("archived"), (F.col("doc_id") % 50).alias("page_count"))


def k1_current_job(spark, sf):
    return J.with_current(jobs(spark, sf)).where("is_current").select("group_key", "job_id", "status")


def k2_retryable(spark, sf):
    """Every sixth job has the flag in its result."""
    return jobs(spark, sf).withColumn("result", F.when(F.col("job_id") % 6 == 0, '{"retryable": true}').otherwise(F.col("result"))).select("job_id", J.may_retry().alias("may_retry"))


def k3_retry_reason(spark, sf):
    return J.with_current(jobs(spark, sf)).select("job_id", J.retry_reason().alias("reason"))


def k4_retry_chain(spark, sf):
    return J.retry_chain(jobs(spark, sf))


def k5_interrupted(spark, sf):
    return J.interrupt(jobs(spark, sf)).groupBy("status", "error_code", "retryable").agg(F.count("*").alias("jobs"))


def k5_documents(spark, sf):
    return J.interrupted_documents(_docs(spark, sf), jobs(spark, sf)).select("doc_id", "status")


def _published(spark, sf):
    """Jobs with counters, times of change, an index for index jobs, and one of four manifests of their document."""
    n = F.col("job_id")
    some = lambda m: F.when(F.col("status") == "succeeded", n % m).otherwise(0)
    return jobs(spark, sf).withColumns({
        "page_count": F.col("pages"), "element_count": some(7), "asset_count": some(4), "chunk_count": some(5), "updated_at": F.when(n % 3 == 0, F.timestamp_add("HOUR", n % 100, "created_at")),
        "index_key": F.when(F.col("kind") == "index", F.concat(F.lit("index/"), n)), "manifest_key": F.concat_ws("/", "doc_id", n % 4),
    })


def k6_backfill(spark, sf):
    d = _docs(spark, sf)
    return J.backfill(d.withColumns({"element_count": F.lit(1).cast("long"), "asset_count": F.col("doc_id") % 3, "chunk_count": F.lit(None).cast("long")}), _published(spark, sf))


def k7_rollup(spark, sf):
    kbs = _docs(spark, sf).select("kb_id").distinct().union(spark.range(90, 92).select("id"))
    return J.rollup(kbs, _docs(spark, sf))


def k8_counts(spark, sf):
    return J.task_counters(jobs(spark, sf))


def k9_library_totals(spark, sf):
    """Documents by name (their first line) and status, with tables as assets."""
    lines = F.split("text", "\n")
    d = table(spark, sf, "documents").select(F.col("lang").alias("kb_id"), F.element_at(lines, 1).alias("name"), F.when(F.col("doc_id") % 4 == 0, "failed").otherwise("ready").alias("status"), (F.floor(F.size(lines) / 20) + 1).alias("pages"), F.size(F.filter(lines, lambda x: x.contains(" | "))).alias("assets"))
    return J.library_totals(d, name="The", status="ready")


def k10_work_list(spark, sf):
    return J.work_list(_docs(spark, sf))


def k10_empty_work(spark, sf):
    kbs = _docs(spark, sf).select("kb_id").distinct().union(spark.range(90, 92).select("id"))
    return J.empty_work(kbs, _docs(spark, sf).withColumn("status", F.when(F.col("kb_id") == 3, "failed").otherwise(F.col("status"))))


def k12_newest_first(spark, sf):
    """Listing order as a column: the place of each job by time, newest first, within its knowledge base."""
    return J.newest_first(jobs(spark, sf))


def d11_latest_index(spark, sf):
    return J.latest_index(_published(spark, sf), _docs(spark, sf).where("not archived"))


def d11_assets(spark, sf):
    """Manifests 0 to 3 of each document hold three assets each, of which neighbours share two; one has no key."""
    part = lambda i: F.struct(F.concat_ws("-", F.lit("as"), "doc_id", F.col("m") + i).alias("id"), F.when((F.col("m") != 2) | F.lit(i != 1), F.concat_ws("/", F.lit("assets"), "doc_id", "m", F.col("m") + i)).alias("object_key"))
    m = _docs(spark, sf).select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("m"))
    return J.published_assets(_published(spark, sf), m.select(F.concat_ws("/", "doc_id", "m").alias("manifest_key"), F.array(part(0), part(1), part(2)).alias("assets")))


QUERIES = {f.__name__: f for f in (k1_current_job, k2_retryable, k3_retry_reason, k4_retry_chain, k5_interrupted, k5_documents, k6_backfill, k7_rollup, k8_counts, k9_library_totals, k10_work_list, k10_empty_work, k12_newest_first, d11_latest_index, d11_assets)}

_G = """g AS (SELECT *, CASE WHEN doc_id IS NOT NULL THEN 'document:' || doc_id || ':' || kind ELSE 'knowledge_base:' || kb_id || ':' || kind END AS group_key FROM jobs),
cur AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY created_at DESC, job_id DESC) = 1 AS is_current,
  (coalesce(retryable, false) OR coalesce(error_code IN ('connection_error', 'graph_extraction_unavailable', 'ocr_timeout', 'ocr_unavailable', 'process_restarted', 'provider_unavailable', 'rate_limited', 'service_unavailable', 'temporary_failure'), false)) AND status IN ('failed', 'partial') AS may_retry FROM g),
docs AS (SELECT DISTINCT user_id AS doc_id, user_id % 7 AS kb_id, CASE WHEN user_id % 4 = 0 THEN 'failed' WHEN user_id % 9 = 0 THEN 'indexing' ELSE 'ready' END AS status, user_id % 10 = 0 AS archived, user_id % 50 AS page_count FROM events)"""

_DONE = ", done AS (SELECT *, CASE WHEN job_id % 3 = 0 THEN created_at + to_hours(job_id % 100) ELSE created_at END AS t FROM jobs WHERE status = 'succeeded' AND doc_id IS NOT NULL)"


def _sql(body: str) -> str:
    return with_tables("jobs", f"WITH {_G} {body}")


SQL = {
    "k1_current_job": _sql("SELECT group_key, job_id, status FROM cur WHERE is_current"),
    "k2_retryable": _sql("SELECT job_id, may_retry OR (job_id % 6 = 0 AND status IN ('failed', 'partial')) AS may_retry FROM cur"),
    "k3_retry_reason": _sql("SELECT job_id, CASE WHEN status NOT IN ('failed', 'partial') THEN 'job_not_failed' WHEN NOT is_current THEN 'job_already_resolved' WHEN NOT may_retry THEN 'job_not_retryable' ELSE 'eligible' END AS reason FROM cur"),
    "k4_retry_chain": _sql("SELECT job_id, (row_number() OVER w)::INTEGER AS attempt, lag(job_id) OVER w AS retry_of, lead(job_id) OVER w AS superseded_by FROM g WINDOW w AS (PARTITION BY group_key ORDER BY created_at, job_id)"),
    "k5_interrupted": _sql("SELECT CASE WHEN o THEN 'failed' ELSE status END AS status, CASE WHEN o THEN 'process_restarted' ELSE error_code END AS error_code, CASE WHEN o THEN true ELSE retryable END AS retryable, count(*) AS jobs FROM (SELECT *, status IN ('queued', 'running') AS o FROM jobs) GROUP BY 1, 2, 3"),
    "k6_backfill": _sql(f"""{_DONE}, n AS (SELECT doc_id, arg_max(pages, (t, job_id)) AS p, arg_max(job_id, (t, job_id)) AS j FROM done GROUP BY 1)
      SELECT docs.doc_id, coalesce(nullif(p, 0), page_count) AS page_count, coalesce(nullif(j % 7, 0), 1) AS element_count, coalesce(nullif(j % 4, 0), docs.doc_id % 3) AS asset_count, nullif(j % 5, 0) AS chunk_count FROM docs LEFT JOIN n USING (doc_id)"""),
    "k7_rollup": _sql("SELECT k.kb_id, count(docs.doc_id) AS documents, CASE WHEN count(docs.doc_id) = 0 THEN 'empty' WHEN count(*) FILTER (status = 'failed') = count(docs.doc_id) THEN 'failed' WHEN count(*) FILTER (status = 'ready') < count(docs.doc_id) THEN 'partial' ELSE 'ready' END AS status FROM (SELECT DISTINCT kb_id FROM docs UNION ALL VALUES (90), (91)) k LEFT JOIN docs ON docs.kb_id = k.kb_id GROUP BY k.kb_id"),
    "k8_counts": _sql("SELECT count(*) FILTER (is_current AND status = 'running') AS running, count(*) FILTER (is_current AND status = 'queued') AS queued, count(*) FILTER (is_current AND status = 'succeeded') AS done, count(*) FILTER (is_current AND status IN ('failed', 'partial')) AS failed, count(*) FILTER (NOT is_current) AS history FROM cur"),
    "k5_documents": _sql("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM jobs WHERE status IN ('queued', 'running') AND doc_id IS NOT NULL) THEN 'failed' ELSE status END AS status FROM docs"),
    "k9_library_totals": "SELECT lang AS kb_id, count(*) AS documents, sum(len(l) // 20 + 1)::BIGINT AS pages, sum(len(list_filter(l, lambda x: contains(x, ' | '))))::BIGINT AS assets FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents) WHERE contains(lower(l[1]), 'the') AND doc_id % 4 <> 0 GROUP BY lang",
    "k10_empty_work": _sql("SELECT k.kb_id, CASE WHEN count(d.doc_id) = 0 THEN 'knowledge_base_empty' ELSE 'document_compilation_failed' END AS code FROM (SELECT DISTINCT kb_id FROM docs UNION ALL VALUES (90), (91)) k LEFT JOIN docs d ON d.kb_id = k.kb_id AND NOT d.archived GROUP BY k.kb_id HAVING count(*) FILTER (d.status = 'ready' AND k.kb_id <> 3) = 0"),
    "k10_work_list": _sql("SELECT doc_id, CASE WHEN status = 'ready' THEN 'graph' ELSE 'compile' END AS step FROM docs WHERE NOT archived"),
    "k12_newest_first": _sql("SELECT job_id, kb_id, (row_number() OVER (PARTITION BY kb_id ORDER BY created_at DESC, job_id DESC))::INTEGER AS place FROM jobs"),
    "d11_latest_index": _sql(f"""{_DONE} SELECT doc_id, 'index/' || arg_max(job_id, (t, job_id)) AS index_key, count(*) AS versions FROM done WHERE doc_id IN (SELECT doc_id FROM docs WHERE NOT archived) GROUP BY doc_id HAVING arg_max(kind, (t, job_id)) = 'index'"""),
    "d11_assets": _sql(f"""{_DONE}, a AS (SELECT doc_id, job_id, t, job_id % 4 AS m, unnest([0, 1, 2]) AS i FROM done WHERE doc_id IN (SELECT doc_id FROM docs)), b AS (SELECT *, 'as-' || doc_id || '-' || m + i AS asset_id FROM a WHERE m <> 2 OR i <> 1)
      SELECT asset_id, 'assets/' || doc_id || '/' || m || '/' || m + i AS object_key, doc_id, job_id FROM b QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY t DESC, job_id DESC) = 1"""),
}
