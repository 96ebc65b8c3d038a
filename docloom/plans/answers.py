"""Queries over conversations, and over answers derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import answers as A
from docloom.operators import conversations as C
from docloom.sources.derived import table


def _messages(spark, sf):
    return table(spark, sf, "conversations").withColumnRenamed("conv_id", "thread_id")


def _blocks(spark, sf):
    """Lines of messages as blocks: every fifth line is a figure with the line as caption."""
    lines = _messages(spark, sf).select((F.col("thread_id") * 1000 + F.col("turn")).alias("message_id"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    figure = F.col("seq") % 5 == 4
    return lines.select("message_id", "seq", F.when(figure, "figure").otherwise("text").alias("type"), F.when(~figure, F.col("line")).alias("markdown"), F.when(figure & (F.col("line") != ""), F.col("line")).alias("caption"))


def _evidence(spark, sf):
    """Each assistant turn has two pieces of evidence, the first with an asset."""
    t = _messages(spark, sf).where("role = 'assistant'").select((F.col("thread_id") * 100 + F.col("turn")).alias("turn_id"))
    piece = t.withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    return piece.select("turn_id", F.concat(F.lit("c"), "k").alias("citation_id"), F.when(F.col("k") == 0, F.array(F.lit("a0"))).otherwise(F.array().cast("array<string>")).alias("asset_ids"))


def _answers(spark, sf):
    """Assistant turns with citations and blocks that follow from turn_id: some sound, some not."""
    t = _messages(spark, sf).where("role = 'assistant'").select((F.col("thread_id") * 100 + F.col("turn")).alias("turn_id"), "text")
    t = t.withColumn("m", (F.col("turn_id") % 13).cast("int"))
    m, s = F.col("m"), lambda *x: F.array(*(F.lit(v) for v in x)).cast("array<string>")
    text = F.struct(F.lit("text").alias("type"), F.when(m != 3, F.col("text")).alias("markdown"), F.when(m == 4, F.lit("a0")).cast("string").alias("asset_id"), F.lit(None).cast("string").alias("alt"), F.when(m == 5, s("c9")).when(m == 6, s()).otherwise(s("c1")).alias("citation_ids"))
    shown = F.struct(F.lit("figure").alias("type"), F.lit(None).cast("string").alias("markdown"), F.when(m == 7, F.lit("a9")).when(m != 8, F.lit("a0")).alias("asset_id"), F.when(m != 9, F.lit("alt")).alias("alt"), F.when(m == 10, s("c1")).otherwise(s("c0", "c1")).alias("citation_ids"))
    top = F.when(m == 1, s("c0", "c7")).when(m.isin(6, 11), s()).when(m == 2, s("c1", "c1")).otherwise(s("c0"))
    mode = F.when(m.isin(6, 11, 12), "general_knowledge").when(m % 4 == 1, "partial").otherwise("grounded")
    return t.select("turn_id", mode.alias("mode"), top.alias("citation_ids"), F.when(m == 9, s("gap")).otherwise(s()).alias("coverage_gaps"), F.when(m.isin(6, 11), F.array(text)).otherwise(F.array(text, shown)).alias("blocks"))


def j1_audit(spark, sf):
    return A.verdicts(_answers(spark, sf), _evidence(spark, sf))


def j2_citation_order(spark, sf):
    return A.selected_citations(_answers(spark, sf))


def j3_mode_contract(spark, sf):
    return A.mode_contract(_answers(spark, sf), _evidence(spark, sf))


def j4_placeholders(spark, sf):
    return A.drop_placeholders(_answers(spark, sf), _answers(spark, sf).where("turn_id % 2 = 0"))


def _calls(spark, sf):
    """Events as tool calls: a user's day is a turn, the event type the tool."""
    e = table(spark, sf, "events")
    return e.select(
        F.concat_ws("-", "user_id", F.dayofmonth("ts")).alias("turn_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("tool"), F.col("props").alias("args"), F.col("event_id").alias("result"),
        F.concat(F.lit("citation:"), F.col("event_id") % 3).alias("citation_id"), F.col("value").alias("score"), F.array(F.concat(F.lit("asset-"), F.col("event_id") % 4)).alias("asset_ids"),
    )


def j5_ledger(spark, sf):
    return A.ledger(_calls(spark, sf))


def j6_outside_ledger(spark, sf):
    asked = _calls(spark, sf).select("turn_id", F.concat(F.lit("citation:"), F.col("seq") % 4).alias("citation_id")).distinct()
    return A.outside_ledger(asked, A.ledger(_calls(spark, sf)))


def j7_budget(spark, sf):
    return A.tool_budget(_calls(spark, sf)).select("seq", "in_budget", "served")


def j8_repeat(spark, sf):
    return A.tool_budget(_calls(spark, sf)).where("repeated").select("turn_id", "seq", "tool")


def j9_history(spark, sf):
    return C.bounded_history(_messages(spark, sf), returned=4).select("thread_id", "turn", "role", "seq")


def j9_agent(spark, sf):
    """Of the last four messages, those with a text; every fifth turn of a thread has none, some roles are tools."""
    m = _messages(spark, sf).withColumns({"text": F.when(F.col("turn") % 5 != 2, F.col("text")).when(F.col("turn") % 2 == 0, ""), "role": F.when((F.col("turn") + F.col("thread_id")) % 7 == 3, "tool").otherwise(F.col("role"))})
    return C.agent_history(m, most=4).select("thread_id", "turn", "role", F.md5("text").alias("text_md5"), "seq")


def j10_isolation(spark, sf):
    threads = _messages(spark, sf).select("thread_id").distinct().select("thread_id", (F.col("thread_id") % 10).alias("user_id"), (F.col("thread_id") % 3).alias("kb_id"))
    asked = _messages(spark, sf).where("role = 'user'").select("thread_id", ((F.col("thread_id") + F.when(F.col("turn") == 4, 1).otherwise(0)) % 10).alias("user_id"), ((F.col("thread_id") + F.when(F.col("turn") == 2, 1).otherwise(0)) % 3).alias("kb_id"))
    return C.foreign_threads(threads, asked)


def j11_recall(spark, sf):
    m = table(spark, sf, "events").select("user_id", F.col("event_type").alias("namespace"), F.get_json_object("props", "$.k").alias("key"), F.col("value"), F.col("ts").alias("updated_at"))
    return C.recall(m)


def j12_threads(spark, sf):
    threads = _messages(spark, sf).groupBy("thread_id").agg((F.max("turn") * 7 % 5 + F.col("thread_id") % 100).alias("updated_at"))
    return C.thread_list(threads.select("thread_id", (F.col("thread_id") % 3).alias("kb_id"), (F.col("thread_id") % 7 != 0).alias("active"), "updated_at"), _messages(spark, sf))


def j13_flatten(spark, sf):
    return C.flatten_blocks(_blocks(spark, sf))


def j14_turns(spark, sf):
    """Each message cites as many places as its turn says, with falling scores."""
    cited = F.transform(F.sequence(F.lit(0), F.col("turn").cast("int")), lambda i: F.struct(i.alias("place"), (1.0 / (i + 1)).alias("score")))
    turns = C.pair_turns(_messages(spark, sf).withColumn("citations", cited))
    return turns.select("thread_id", "turn", "question", "answer", F.array_join(F.transform("citations", lambda c: F.concat_ws("=", c["place"], c["relevance"])), ",").alias("citations"))


def j15_citation_kind(spark, sf):
    ids = table(spark, sf, "part").select("p_partkey", F.concat_ws("_", F.lit("el"), F.when(F.col("p_partkey") % 3 == 0, "Table").when(F.col("p_partkey") % 5 == 0, "figure").when(F.col("p_partkey") % 7 == 0, "formula"), "p_name").alias("element_id"))
    return ids.groupBy(C.element_kind(F.col("element_id")).alias("kind")).agg(F.count("*").alias("citations"))


QUERIES = {f.__name__: f for f in (
    j1_audit, j2_citation_order, j3_mode_contract, j4_placeholders, j5_ledger, j6_outside_ledger, j7_budget, j8_repeat, j9_history, j9_agent, j10_isolation, j11_recall, j12_threads, j13_flatten, j14_turns, j15_citation_kind,
)}

_T = "WITH t AS (SELECT conv_id * 100 + turn AS turn_id, ((conv_id * 100 + turn) % 13)::INTEGER AS m, coalesce(text, '') AS text FROM conversations WHERE role = 'assistant') "
_CALLS = "WITH calls AS (SELECT user_id || '-' || day(ts) AS turn_id, event_id AS seq, event_type AS tool, props AS args, event_id AS result, 'citation:' || event_id % 3 AS citation_id, value AS score, 'asset-' || event_id % 4 AS asset FROM events) "
_LAST = _CALLS + ", last AS (SELECT turn_id, citation_id, arg_max(score, seq) AS score, arg_max(asset, seq) AS asset FROM calls GROUP BY ALL) "

SQL = {
    "j1_audit": _T + """, c AS (SELECT turn_id, m, list_filter([
      CASE WHEN m = 10 THEN 'asset_without_source' END, CASE WHEN m IN (8, 9) THEN 'bad_asset_block' END, CASE WHEN m IN (3, 4) OR text = '' THEN 'bad_text_block' END,
      CASE WHEN m = 7 THEN 'unavailable_asset' END, CASE WHEN m IN (1, 5) THEN 'unavailable_citation' END, CASE WHEN m = 6 THEN 'no_citation' END], lambda x: x IS NOT NULL) AS l FROM t)
      SELECT turn_id, CASE WHEN len(l) = 0 THEN 'grounded' ELSE 'rejected' END AS verdict, array_to_string(list_sort(l), ',') AS codes FROM c""",
    "j2_citation_order": _T + """SELECT turn_id, CASE m WHEN 1 THEN 'c0,c7,c1' WHEN 2 THEN 'c1,c0' WHEN 5 THEN 'c0,c9,c1' WHEN 11 THEN 'c1' ELSE 'c0,c1' END AS citations FROM t WHERE m <> 6""",
    "j3_mode_contract": _T + """, a AS (SELECT *, CASE WHEN m IN (6, 11, 12) THEN 'general_knowledge' WHEN m % 4 = 1 THEN 'partial' ELSE 'grounded' END AS mode FROM t)
      SELECT turn_id, mode, m <> 2 AND CASE mode WHEN 'general_knowledge' THEN m IN (6, 11) WHEN 'partial' THEN m = 9 ELSE true END AS ok FROM a""",
    "j4_placeholders": _T + "SELECT turn_id, CASE WHEN m IN (6, 11) OR (m = 8 AND turn_id % 2 = 1) THEN 1 ELSE 2 END::BIGINT AS n_blocks FROM t",
    "j5_ledger": _LAST + "SELECT turn_id, citation_id, score, assets FROM last JOIN (SELECT turn_id, string_agg(DISTINCT asset, ',' ORDER BY asset) AS assets FROM last GROUP BY turn_id) USING (turn_id)",
    "j6_outside_ledger": _LAST + "SELECT DISTINCT turn_id, 'citation:' || seq % 4 AS citation_id FROM calls WHERE (turn_id, 'citation:' || seq % 4) NOT IN (SELECT (turn_id, citation_id) FROM last)",
    "j7_budget": _CALLS + "SELECT seq, row_number() OVER (PARTITION BY turn_id ORDER BY seq) <= 4 AS in_budget, first(result) OVER (PARTITION BY turn_id, tool ORDER BY seq) AS served FROM calls",
    "j8_repeat": _CALLS + "SELECT turn_id, seq, tool FROM calls QUALIFY row_number() OVER (PARTITION BY turn_id, tool, args ORDER BY seq) > 1",
    "j9_agent": """WITH m AS (SELECT conv_id AS thread_id, turn, CASE WHEN (turn + conv_id) % 7 = 3 THEN 'tool' ELSE role END AS role, CASE WHEN turn % 5 <> 2 THEN text WHEN turn % 2 = 0 THEN '' END AS text FROM conversations),
      l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY turn DESC) <= 4) SELECT thread_id, turn, role, md5(text) AS text_md5, (row_number() OVER (PARTITION BY thread_id ORDER BY turn))::INTEGER AS seq FROM l WHERE role IN ('user', 'assistant', 'system') AND coalesce(text, '') <> ''""",
    "j9_history": "SELECT thread_id, turn, role, (row_number() OVER (PARTITION BY thread_id ORDER BY turn))::INTEGER AS seq FROM (SELECT conv_id AS thread_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 4)",
    "j10_isolation": "SELECT * FROM (SELECT conv_id AS thread_id, (conv_id + CASE WHEN turn = 4 THEN 1 ELSE 0 END) % 10 AS user_id, (conv_id + CASE WHEN turn = 2 THEN 1 ELSE 0 END) % 3 AS kb_id, conv_id % 10 AS owner, conv_id % 3 AS home FROM conversations WHERE role = 'user') WHERE owner <> user_id OR home <> kb_id",
    "j11_recall": "SELECT user_id, event_type AS namespace, json_extract_string(props, '$.k') AS key, arg_max(value, (ts, value)) AS value, count(*) AS versions FROM events GROUP BY 1, 2, 3",
    "j12_threads": "SELECT conv_id % 3 AS kb_id, conv_id AS thread_id, count(*) AS messages, max(turn) * 7 % 5 + conv_id % 100 AS updated_at FROM conversations WHERE conv_id % 7 <> 0 GROUP BY conv_id",
    "j13_flatten": """WITH l AS (SELECT conv_id * 1000 + turn AS message_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS seq FROM conversations)
      SELECT message_id, coalesce(string_agg(x, chr(10) || chr(10) ORDER BY seq) FILTER (x <> ''), '') AS text FROM (SELECT *, CASE WHEN seq % 5 = 4 THEN '[figure] ' || line ELSE line END AS x FROM l) GROUP BY message_id""",
    "j14_turns": """WITH a AS (SELECT *, coalesce(count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM conversations),
      b AS (SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id, segment ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS question FROM a)
      SELECT conv_id AS thread_id, turn, coalesce(question, '(no question)') AS question, text AS answer, array_to_string(['0=100', '1=50', '2=33', '3=25', '4=20'][1 : turn + 1], ',') AS citations FROM b WHERE role = 'assistant'""",
    "j15_citation_kind": "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'table' WHEN p_partkey % 5 = 0 THEN 'figure' WHEN p_partkey % 7 = 0 THEN 'formula' ELSE 'text' END AS kind, count(*) AS citations FROM part GROUP BY 1",
}
