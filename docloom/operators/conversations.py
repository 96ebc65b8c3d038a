"""Threads, histories, turns and memory. Messages: thread_id, turn, role, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Messages kept of a thread, and returned of those.
KEPT, RETURNED = 100, 20
#: Fixed value: citations shown with an answer.
SHOWN = 5


def bounded_history(messages: DataFrame, kept: int = KEPT, returned: int = RETURNED) -> DataFrame:
    """The newest messages of each thread, with their place ``seq`` from 1, oldest first."""
    newest = Window.partitionBy("thread_id").orderBy(F.desc("turn"))
    return (
        messages.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= min(kept, returned))
        .withColumn("seq", F.row_number().over(Window.partitionBy("thread_id").orderBy("turn"))).drop("_back")
    )


#: Fixed value: roles whose messages an agent sees.
AGENT_ROLES = ("user", "assistant", "system")


def agent_history(messages: DataFrame, most: int = RETURNED) -> DataFrame:
    """thread_id, turn, role, text, seq: of each thread's newest ``most`` messages those with an agent's role and a text, oldest first."""
    newest = Window.partitionBy("thread_id").orderBy(F.desc("turn"))
    some = messages.withColumn("_back", F.row_number().over(newest)).where(F.col("_back") <= most).where(F.col("role").isin(*AGENT_ROLES) & (F.coalesce("text", F.lit("")) != ""))
    return some.select("thread_id", "turn", "role", "text", F.row_number().over(Window.partitionBy("thread_id").orderBy("turn")).alias("seq"))


def foreign_threads(threads: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (thread_id, user_id, kb_id) for threads of another user or knowledge base."""
    own = threads.select("thread_id", F.col("user_id").alias("owner"), F.col("kb_id").alias("home"))
    return requests.join(own, "thread_id").where("owner <> user_id or home <> kb_id").select("thread_id", "user_id", "kb_id", "owner", "home")


def recall(memory: DataFrame) -> DataFrame:
    """The latest value of each key of a user's namespace."""
    return memory.groupBy("user_id", "namespace", "key").agg(F.max_by("value", F.struct("updated_at", "value")).alias("value"), F.count("*").alias("versions"))


def flatten_blocks(blocks: DataFrame) -> DataFrame:
    """message_id, text: markdown of text blocks, captions of others, blank lines between; blocks have seq, type, markdown, caption."""
    line = F.when(F.col("type") == "text", F.col("markdown")).otherwise(F.concat(F.lit("["), F.col("type"), F.lit("] "), F.coalesce("caption", F.lit(""))))
    said = F.sort_array(F.collect_list(F.struct("seq", line.alias("line"))))
    return blocks.groupBy("message_id").agg(F.array_join(F.filter(F.transform(said, lambda s: s["line"]), lambda x: x != ""), "\n\n").alias("text"))


def pair_turns(messages: DataFrame, default: str = "(no question)") -> DataFrame:
    """thread_id, turn, question, answer: each assistant message with the last user message since the one before.

    Where messages have citations (array of struct with score), also the first SHOWN of them with relevance = round(100 * score).
    """
    shown = F.transform(F.slice("citations", 1, SHOWN), lambda c: c.withField("relevance", F.round(100 * c["score"]).cast("int"))) if "citations" in messages.columns else None
    order = Window.partitionBy("thread_id").orderBy("turn")
    answered = F.count_if(F.col("role") == "assistant").over(order.rowsBetween(Window.unboundedPreceding, -1))
    own = Window.partitionBy("thread_id", "_segment").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    asked = F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(own)
    told = messages.withColumn("_segment", F.coalesce(answered, F.lit(0))).withColumn("question", F.coalesce(asked, F.lit(default)))
    return told.where(F.col("role") == "assistant").select("thread_id", "turn", "question", F.col("text").alias("answer"), *([] if shown is None else [shown.alias("citations")]))


def thread_list(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """kb_id, thread_id, messages, updated_at of the active threads (thread_id, kb_id, active, updated_at), newest update first within their knowledge base."""
    n = messages.groupBy("thread_id").agg(F.count("*").alias("messages"))
    listed = threads.where("active").join(n, "thread_id", "left").select("kb_id", "thread_id", F.coalesce("messages", F.lit(0)).alias("messages"), "updated_at")
    return listed.orderBy("kb_id", F.desc("updated_at"), "thread_id")


def element_kind(element_id):
    """What a citation points at, from the element id's text."""
    low = F.lower(element_id)
    return F.when(low.contains("table"), "table").when(low.contains("figure") | low.contains("image"), "figure").when(low.contains("formula"), "formula").otherwise("text")
