"""Audits of logged answers against their evidence.

Answers: turn_id, citation_ids, blocks (array of struct type, markdown, asset_id, alt, citation_ids).
Evidence: turn_id, citation_id, asset_ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def violations(answers: DataFrame, evidence: DataFrame, required: bool = True) -> DataFrame:
    """turn_id, code: everything that keeps an answer from being grounded in its turn's evidence."""
    known = evidence.select("turn_id", F.col("citation_id").alias("cited")).distinct()
    assets = evidence.select("turn_id", F.explode("asset_ids").alias("asset_id"), F.col("citation_id").alias("source")).groupBy("turn_id", "asset_id").agg(F.max("source").alias("source"))
    blocks = answers.select("turn_id", F.posexplode("blocks").alias("pos", "b")).select("turn_id", "pos", "b.*")
    top = answers.select("turn_id", F.explode("citation_ids").alias("cited"))
    inner = blocks.select("turn_id", F.explode("citation_ids").alias("cited"))
    code = lambda df, name: df.select("turn_id", F.lit(name).alias("code"))
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    text, asset = blocks.where("type = 'text'"), blocks.where("type <> 'text'")
    placed = asset.join(assets, ["turn_id", "asset_id"], "left")
    none = answers.where((F.size("citation_ids") == 0) & ~F.exists("blocks", lambda b: F.size(b["citation_ids"]) > 0))
    found = [
        code(top.join(known, ["turn_id", "cited"], "left_anti"), "unavailable_citation"),
        code(inner.join(known, ["turn_id", "cited"], "left_anti"), "unavailable_citation"),
        code(text.where(empty("markdown") | F.col("asset_id").isNotNull()), "bad_text_block"),
        code(asset.where(F.col("markdown").isNotNull() | empty("asset_id") | empty("alt")), "bad_asset_block"),
        code(placed.where(F.col("asset_id").isNotNull() & F.col("source").isNull()), "unavailable_asset"),
        code(placed.where(F.col("source").isNotNull() & ~F.expr("array_contains(citation_ids, source)")), "asset_without_source"),
    ]
    if required:
        found.append(code(none, "no_citation"))
    out = found[0]
    for df in found[1:]:
        out = out.union(df)
    return out.distinct()


def verdicts(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """turn_id, verdict, codes."""
    bad = violations(answers, evidence).groupBy("turn_id").agg(F.array_join(F.sort_array(F.collect_set("code")), ",").alias("codes"))
    return answers.select("turn_id").join(bad, "turn_id", "left").select("turn_id", F.when(F.col("codes").isNull(), "grounded").otherwise("rejected").alias("verdict"), F.coalesce("codes", F.lit("")).alias("codes"))


def selected_citations(answers: DataFrame) -> DataFrame:
    """turn_id, citations: answer-level ids first, then the blocks', each at its first place."""
    top = answers.select("turn_id", F.lit(0).alias("level"), F.lit(0).alias("block"), F.posexplode("citation_ids").alias("pos", "cited"))
    inner = answers.select("turn_id", F.lit(1).alias("level"), F.posexplode("blocks").alias("block", "b")).select("turn_id", "level", "block", F.posexplode("b.citation_ids").alias("pos", "cited"))
    first = top.union(inner).groupBy("turn_id", "cited").agg(F.min(F.struct("level", "block", "pos")).alias("at"))
    return first.groupBy("turn_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "cited"))), lambda x: x["cited"]), ",").alias("citations"))


def mode_contract(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """turn_id, ok: general answers cite and show nothing, partial ones name a gap, grounded ones have evidence; no id twice."""
    n = evidence.groupBy("turn_id").agg(F.count("*").alias("n"))
    shows = F.exists("blocks", lambda b: b["asset_id"].isNotNull())
    ok = (F.size(F.array_distinct("citation_ids")) == F.size("citation_ids")) & (
        F.when(F.col("mode") == "general_knowledge", (F.size("citation_ids") == 0) & ~shows).when(F.col("mode") == "partial", F.size("coverage_gaps") > 0).otherwise(F.coalesce("n", F.lit(0)) > 0)
    )
    return answers.join(n, "turn_id", "left").select("turn_id", "mode", ok.alias("ok"))


def drop_placeholders(answers: DataFrame, visual_turns: DataFrame) -> DataFrame:
    """turn_id, n_blocks after empty visual blocks are dropped: only without a visual call, and if a text block stays."""
    empty = lambda b: (b["type"] != "text") & (F.coalesce(b["asset_id"], F.lit("")) == "")
    seen = answers.join(visual_turns.select("turn_id", F.lit(True).alias("_seen")), "turn_id", "left")
    may = F.col("_seen").isNull() & F.exists("blocks", lambda b: b["type"] == "text")
    return seen.select("turn_id", F.size(F.when(may, F.filter("blocks", lambda b: ~empty(b))).otherwise(F.col("blocks"))).cast("long").alias("n_blocks"))


def ledger(calls: DataFrame) -> DataFrame:
    """turn_id, citation_id, score of the last write (seq), and the turn's allowed assets."""
    last = calls.groupBy("turn_id", "citation_id").agg(F.max_by("score", "seq").alias("score"), F.max_by("asset_ids", "seq").alias("asset_ids"))
    allowed = last.groupBy("turn_id").agg(F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_list("asset_ids")))), ",").alias("assets"))
    return last.select("turn_id", "citation_id", "score").join(allowed, "turn_id")


def outside_ledger(requests: DataFrame, ledger_rows: DataFrame) -> DataFrame:
    return requests.join(ledger_rows.select("turn_id", "citation_id"), ["turn_id", "citation_id"], "left_anti")


def tool_budget(calls: DataFrame, most: int = 4) -> DataFrame:
    """Calls (turn_id, seq, tool, args, result) with in_budget, repeated, and the result served: a tool's first one."""
    order = Window.partitionBy("turn_id").orderBy("seq")
    same = Window.partitionBy("turn_id", "tool").orderBy("seq")
    again = Window.partitionBy("turn_id", "tool", F.sha2("args", 256)).orderBy("seq")
    return calls.select(
        "turn_id", "seq", "tool", (F.row_number().over(order) <= most).alias("in_budget"), (F.row_number().over(again) > 1).alias("repeated"),
        F.first("result").over(same.rowsBetween(Window.unboundedPreceding, 0)).alias("served"),
    )
