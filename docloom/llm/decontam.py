"""Benchmark decontamination over a positional inverted index, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.ranks import with_order_key
from docloom.llm.scratch import Scratch

#: Rows of test-side tables (terms, anchors) that may be broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Documents that may be broadcast as a list of ids (8 bytes each); longer lists are joined by shuffle.
BROADCAST_IDS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, then runs of digits, ASCII letters and all beyond ASCII; null has none."""
    low = F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.coalesce(F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)), F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Words of a text in number; capitals are told as letters, so none is lower-cased."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """item_id, words, phrase: ``size`` consecutive words of an item, or all of a shorter one; distinct per item."""
    w = items.select("item_id", word_array(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(size) + 1, F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words")).withColumn("phrase", F.array_join("words", " ")).distinct()


def _small(df: DataFrame) -> DataFrame:
    """A table of the test side: broadcast if its counted rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, doc, pos (from 0) of every place of the given terms in the texts."""
    places = docs.select(F.col("_doc").alias("doc"), F.posexplode(word_array(F.col("text"))).alias("pos", "term"))
    return places.join(_small(terms), "term")


def anchors(windows: DataFrame, frequencies: DataFrame, rarest: int) -> DataFrame:
    """phrase, term, offset, n: each phrase's ``rarest`` places by corpus frequency; phrases with an absent term are left out."""
    terms = windows.select("phrase", "words").distinct().select("phrase", F.size("words").alias("size"), F.posexplode("words").alias("offset", "term"))
    known = terms.join(frequencies, "term")
    by = Window.partitionBy("phrase")
    known = known.withColumn("have", F.count("*").over(by)).withColumn("r", F.row_number().over(by.orderBy("freq", "term", "offset")))
    return known.where((F.col("have") == F.col("size")) & (F.col("r") <= rarest)).select("phrase", "term", "offset", "size", F.least("size", F.lit(rarest)).alias("n"))


def _frequencies(docs: DataFrame, windows: DataFrame) -> DataFrame:
    vocabulary = windows.select(F.explode("words").alias("term")).distinct()
    words = docs.select(F.explode(word_array(F.col("text"))).alias("term"))
    return words.join(_small(vocabulary), "term").groupBy("term").agg(F.count("*").alias("freq"))


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, rarest: int = 2, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and item_ids for each row of ``docs``.

    A word is hit if any occurrence of an item's window covers it.

    1. Corpus frequencies of the items' terms, over all texts.
    2. Each window's rarest terms are its anchors; the texts' postings of anchors are stored.
    3. Anchor postings, moved back by their offset, meet in (phrase's number, text, start); starts that all
       anchors of a phrase name are candidates, and the phrase is compared with the text's words there.

    Only test-side tables are broadcast, below a counted bound. Lists are met by aggregates that combine
    before the shuffle. A null or empty text has no words and no hits; an item without words has no
    window; items that repeat an id or a text count as one id, or each id; rows that repeat an id are
    separate; empty tables on either side work; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "decontam")
    docs = with_order_key(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), scratch)
    windows = scratch.save(item_windows(items.select(items[item_id_col].alias("item_id"), items[item_text_col].alias("text")), size))
    frequencies = scratch.save(_frequencies(docs, windows))
    anchor = scratch.save(anchors(windows, frequencies, rarest))
    phrases = scratch.save(anchor.select("phrase", "size").distinct().withColumn("number", F.monotonically_increasing_id()))
    index = scratch.save(postings(docs, anchor.select("term").distinct()))
    numbered = scratch.save(anchor.join(phrases.select("phrase", "number"), "phrase").select("number", "term", "offset", "n"))
    starts = index.join(_small(numbered), "term").select("number", "doc", "n", (F.col("pos") - F.col("offset")).alias("start")).where("start >= 0")
    met = starts.groupBy("number", "doc", "start", "n").agg(F.count("*").alias("c")).where("c = n")
    candidates = scratch.save(met.join(_small(phrases), "number").groupBy("doc").agg(F.collect_list(F.struct("start", "size", "phrase")).alias("asked")))

    # texts without a candidate are not shuffled; of the others texts, not their words
    listed = candidates.select("doc")
    asked = docs.join(F.broadcast(listed) if listed.count() <= BROADCAST_IDS else listed, F.col("_doc") == F.col("doc"), "left_semi")
    read = asked.join(candidates, F.col("_doc") == F.col("doc")).withColumn("words", word_array(F.col("text")))
    there = F.filter("asked", lambda c: F.array_join(F.slice("words", c["start"] + 1, c["size"]), " ") == c["phrase"])
    read = scratch.save(read.select("_doc", F.size("words").alias("n"), F.array_sort(there).alias("hits")))  # words named twice, so they aren't made anew for each candidate
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def cover(acc, hit):
        end = hit["start"] + hit["size"]
        return F.struct(F.greatest(acc["end"], end).alias("end"), (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], hit["start"]))).alias("n"))

    n_hit = F.coalesce(F.aggregate("hits", zero, cover, lambda acc: acc["n"]), F.lit(0).cast("long"))
    found = read.select("_doc", F.explode(F.array_distinct(F.transform("hits", lambda c: c["phrase"]))).alias("phrase"))
    owners = windows.groupBy("phrase").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("owners"))
    named = found.join(owners, "phrase").groupBy("_doc").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_set("owners")))).alias("item_ids"))  # a text's phrases mostly have the same owners
    hit = read.select("_doc", n_hit.alias("n_hit")).join(named, "_doc", "left")
    out = docs.select("_doc", "doc_id", word_count(F.col("text")).alias("n_words")).join(hit, "_doc", "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("long")))
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), ids.alias("item_ids"))


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = 5, size: int = 10, rarest: int = 3) -> DataFrame:
    """doc_id, item_id, phrase, start: phrases all of whose anchors stand in a text within ``slop`` words of their places.

    ``docs`` has doc_id and text, ``items`` item_id and text. The rarest anchor's places are the base; each
    other anchor must have a posting whose start differs by no more than ``slop``. Postings meet in blocks of
    ``slop`` + 1 starts, so the join is on keys and not on a range.
    """
    scratch = Scratch(docs.sparkSession, "proximity")
    docs = with_order_key(docs.select("doc_id", "text"), scratch)
    windows = scratch.save(item_windows(items.select("item_id", "text"), size))
    anchor = scratch.save(anchors(windows, _frequencies(docs, windows), rarest))
    first = Window.partitionBy("phrase").orderBy("term", "offset")
    anchor = scratch.save(anchor.withColumn("r", F.row_number().over(first)))
    index = scratch.save(postings(docs, anchor.select("term").distinct()))
    starts = scratch.save(index.join(_small(anchor), "term").select("phrase", "doc", "r", "n", (F.col("pos") - F.col("offset")).alias("start")).withColumn("block", F.floor(F.col("start") / (slop + 1))))
    base = starts.where("r = 1").withColumn("block", F.explode(F.array(F.col("block") - 1, F.col("block"), F.col("block") + 1)))
    other = starts.select("phrase", "doc", "block", F.col("r").alias("r2"), F.col("start").alias("start2"))
    near = base.join(other, ["phrase", "doc", "block"]).where(F.abs(F.col("start") - F.col("start2")) <= slop)
    met = near.groupBy("phrase", "doc", "start", "n").agg(F.count_distinct("r2").alias("c")).where("c = n").select("phrase", "doc", "start")
    return met.join(windows.select("phrase", "item_id"), "phrase").join(docs.select("doc_id", F.col("_doc").alias("doc")), "doc").select("doc_id", "item_id", "phrase", "start")
