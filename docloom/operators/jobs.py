"""Job groups, retries and library roll-ups. Jobs: job_id, doc_id, kb_id, kind, status, error_code, retryable, created_at, ..."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.sources.shared import cut

# Error codes after which a job may run again.
RETRYABLE_CODES = (
    "connection_error", "graph_extraction_unavailable", "ocr_timeout", "ocr_unavailable", "process_restarted", "provider_unavailable", "rate_limited", "service_unavailable", "temporary_failure",
)
ENDED_BADLY = ("failed", "partial")


def group_key() -> Column:
    """A document's jobs of a kind, or a knowledge base's."""
    return F.when(F.col("doc_id").isNotNull(), F.concat_ws(":", F.lit("document"), "doc_id", "kind")).otherwise(F.concat_ws(":", F.lit("knowledge_base"), F.col("kb_id"), "kind"))


def with_current(jobs: DataFrame) -> DataFrame:
    """is_current: the newest job of its group, whatever its status."""
    newest = Window.partitionBy("group_key").orderBy(F.desc("created_at"), F.desc("job_id"))
    return jobs.withColumn("group_key", group_key()).withColumn("is_current", F.row_number().over(newest) == 1)


def may_retry() -> Column:
    """A stored flag, one in the result (JSON), or a known code, on a job that failed in whole or part."""
    in_result = F.coalesce(F.get_json_object("result", "$.retryable") == "true", F.lit(False))
    return (F.coalesce("retryable", F.lit(False)) | in_result | F.coalesce(F.col("error_code").isin(*RETRYABLE_CODES), F.lit(False))) & F.col("status").isin(*ENDED_BADLY)


def retry_reason() -> Column:
    """Of jobs with is_current: eligible, or why not."""
    return F.when(~F.col("status").isin(*ENDED_BADLY), "job_not_failed").when(~F.col("is_current"), "job_already_resolved").when(~may_retry(), "job_not_retryable").otherwise("eligible")


def retry_chain(jobs: DataFrame) -> DataFrame:
    """job_id, attempt, retry_of, superseded_by: jobs of a group in order of time."""
    order = Window.partitionBy("group_key").orderBy("created_at", "job_id")
    return jobs.withColumn("group_key", group_key()).select("job_id", F.row_number().over(order).alias("attempt"), F.lag("job_id").over(order).alias("retry_of"), F.lead("job_id").over(order).alias("superseded_by"))


def interrupt(jobs: DataFrame) -> DataFrame:
    """After a restart: queued and running jobs have failed and may be retried."""
    open_ = F.col("status").isin("queued", "running")
    return jobs.withColumns({
        "error_code": F.when(open_, "process_restarted").otherwise(F.col("error_code")), "retryable": F.when(open_, True).otherwise(F.col("retryable")), "status": F.when(open_, "failed").otherwise(F.col("status")),
    })


def interrupted_documents(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """After a restart: documents with a queued or running job have failed."""
    open_ = jobs.where(F.col("status").isin("queued", "running") & F.col("doc_id").isNotNull()).select("doc_id", F.lit("failed").alias("_failed")).distinct()
    return documents.join(open_, "doc_id", "left").withColumn("status", F.coalesce("_failed", "status")).drop("_failed")


def library_totals(documents: DataFrame, name: str | None = None, status: str | None = None) -> DataFrame:
    """kb_id, documents, pages, assets of documents (kb_id, name, status, pages, assets) whose name holds ``name``, whatever its case, and of one status if asked."""
    some = documents if name is None else documents.where(F.lower("name").contains(name.lower()))
    some = some if status is None else some.where(F.col("status") == status)
    return some.groupBy("kb_id").agg(F.count("*").alias("documents"), F.sum("pages").alias("pages"), F.sum("assets").alias("assets"))


def newest_first(jobs: DataFrame) -> DataFrame:
    """``jobs`` with their ``place`` by time within their knowledge base, newest first.

    Rows are sorted by range over all tasks and numbered in each; only counts per task and knowledge base meet,
    so a knowledge base with most of the jobs is no single task.
    """
    order = [F.col("kb_id"), F.desc("created_at"), F.desc("job_id")]
    dealt = cut(jobs.repartitionByRange(*order).withColumn("_task", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("kb_id", "_task").orderBy(*order[1:]))
    counts = dealt.groupBy("kb_id", "_task").agg(F.count("*").alias("_n"))
    before = counts.select("kb_id", "_task", (F.sum("_n").over(Window.partitionBy("kb_id").orderBy("_task")) - F.col("_n")).alias("_before"))
    numbered = dealt.withColumn("_at", inside).withColumnRenamed("kb_id", "_kb").join(before, F.col("_kb").eqNullSafe(F.col("kb_id")) & (dealt["_task"] == before["_task"]))
    return numbered.withColumn("place", (F.col("_before") + F.col("_at")).cast("int")).select("job_id", F.col("_kb").alias("kb_id"), "place")


#: Counters of a document that a job's result may hold.
COUNTERS = ("page_count", "element_count", "asset_count", "chunk_count")


def changed_at(jobs: DataFrame) -> Column:
    """When a job was last updated, or created where it never was."""
    return F.coalesce("updated_at", "created_at") if "updated_at" in jobs.columns else F.col("created_at")


def succeeded(jobs: DataFrame) -> DataFrame:
    """The succeeded jobs of documents, with ``_at``, which orders them by time."""
    return jobs.where((F.col("status") == "succeeded") & F.col("doc_id").isNotNull()).withColumn("_at", F.struct(changed_at(jobs), "job_id"))


def backfill(documents: DataFrame, jobs: DataFrame) -> DataFrame:
    """doc_id and each counter: from the newest succeeded job where that says more than 0, else the document's own."""
    newest = succeeded(jobs).groupBy("doc_id").agg(F.max_by(F.struct(*COUNTERS), "_at").alias("n"))
    both = documents.join(newest, "doc_id", "left")
    return both.select("doc_id", *(F.coalesce(F.nullif(F.col("n")[c], F.lit(0)), F.col(c)).alias(c) for c in COUNTERS))


def rollup(knowledge_bases: DataFrame, documents: DataFrame) -> DataFrame:
    """kb_id, documents, status: failed if all failed, partial if some did, empty without any, else ready."""
    n = documents.groupBy("kb_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "ready").alias("ready"))
    status = F.when(F.col("n").isNull(), "empty").when(F.col("failed") == F.col("n"), "failed").when(F.col("ready") < F.col("n"), "partial").otherwise("ready")
    return knowledge_bases.join(n, "kb_id", "left").select("kb_id", F.coalesce("n", F.lit(0)).alias("documents"), status.alias("status"))


def task_counters(jobs: DataFrame) -> DataFrame:
    """One row: current jobs by state, and how many are history."""
    now = F.col("is_current")
    return with_current(jobs).agg(
        F.count_if(now & (F.col("status") == "running")).alias("running"), F.count_if(now & (F.col("status") == "queued")).alias("queued"), F.count_if(now & (F.col("status") == "succeeded")).alias("done"),
        F.count_if(now & F.col("status").isin(*ENDED_BADLY)).alias("failed"), F.count_if(~now).alias("history"),
    )


def latest_index(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, index_key, versions: of the newest succeeded job of each document that still exists, where it has an index; versions counts its succeeded jobs."""
    done = succeeded(jobs).join(documents.select("doc_id"), "doc_id", "left_semi")
    return done.groupBy("doc_id").agg(F.max_by("index_key", "_at").alias("index_key"), F.count("*").alias("versions")).where("index_key is not null")


def published_assets(jobs: DataFrame, manifests: DataFrame) -> DataFrame:
    """asset_id, object_key, doc_id, job_id: every asset of the manifests of all succeeded jobs, as the newest job that has it gives it.

    Manifests: manifest_key, assets (array of id, object_key). Answers may refer to assets of any version, so neither older
    jobs nor documents that are gone are left out. Assets without id or key are passed over; of one id given twice
    in a manifest the last stands.
    """
    done = succeeded(jobs).select("doc_id", "job_id", "manifest_key", "_at")
    each = done.join(manifests.select("manifest_key", "assets"), "manifest_key").select("doc_id", "job_id", "_at", F.posexplode("assets").alias("_pos", "a"))
    named = each.where("coalesce(a.id, '') <> '' and coalesce(a.object_key, '') <> ''")
    newest = named.groupBy(F.col("a.id").alias("asset_id")).agg(F.max_by(F.struct("a.object_key", "doc_id", "job_id"), F.struct("_at", "_pos")).alias("n"))
    return newest.select("asset_id", "n.*")


def empty_work(knowledge_bases: DataFrame, documents: DataFrame) -> DataFrame:
    """kb_id, code of knowledge bases whose rebuild cannot run (no document that is not archived) or comes to nothing (none is ready)."""
    n = documents.where(~F.col("archived")).groupBy("kb_id").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ready").alias("ready"))
    code = F.when(F.col("n").isNull(), "knowledge_base_empty").when(F.col("ready") == 0, "document_compilation_failed")
    return knowledge_bases.join(n, "kb_id", "left").select("kb_id", code.alias("code")).where("code is not null")


def work_list(documents: DataFrame) -> DataFrame:
    """doc_id, step: not archived and not ready are compiled, ready ones go to the graph."""
    return documents.where(~F.col("archived")).select("doc_id", F.when(F.col("status") == "ready", "graph").otherwise("compile").alias("step"))
