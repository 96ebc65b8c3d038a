"""Mixing sources to target weights, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.ranks import global_rank, with_order_key
from docloom.llm.scratch import Scratch

#: Sources in code-point order weigh these, over and over.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Runs of anything but U+0020 and U+0009 to U+000D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone: 48 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") / float(1 << 48)


def source_targets(sizes: DataFrame, share: float, most: float, scratch: Scratch) -> DataFrame:
    """source, source_size and target: ``share`` of all sizes dealt by weight, no source above ``most`` times its own.

    ``sizes`` has source and size. What a capped source cannot take is dealt again by weight among the
    others; each round is one aggregate over the sources, and a round caps at least one more source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    numbered = global_rank(totals, [F.col("source").asc_nulls_last()], scratch, "_no")
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in WEIGHTS)), (F.col("_no") % len(WEIGHTS) + 1).cast("int"))
    numbered = scratch.save(numbered.select("source", "source_size", weight.alias("_weight"), (most * F.col("source_size")).alias("_cap")))
    total = numbered.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        capped = F.col("_cap") <= level * F.col("_weight")
        taken, weights = numbered.agg(F.sum(F.when(capped, F.col("_cap")).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("_weight")))).first()
        after = (share * total - (taken or 0.0)) / weights if weights else level
        if after <= level:
            break
        level = after
    return numbered.select("source", "source_size", F.least(F.col("_cap"), level * F.col("_weight")).alias("target"))


def mix_sources(
    docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and all columns of ``docs`` (as struct ``row``) for each row.

    A source's rate is target / source_size; a document is emitted floor(rate) times, and once more if
    its draw is below the fraction, so its expected words are rate * size and reruns agree. The draw is
    seeded by the id; if ids are null or repeat, by the row's number in order of id, text and source,
    so that each row draws for itself. ``share`` and ``most`` are parameters of the mix.

    Words per source are added before the shuffle, so a source with a third of all rows is no hot task.
    The sources' table joins back as a broadcast only if Spark finds it small. A null or empty text has
    size 0 and takes nothing; null is a source of its own; a source of size 0 has target 0; an empty
    table gives an empty table.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sized = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), docs[text_col].alias("text"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    sized = with_order_key(sized, scratch, then=("source",)).withColumn("size", word_count(F.col("text")))
    targets = scratch.save(source_targets(docs.select(docs[source_col].alias("source"), word_count(docs[text_col]).alias("size")), share, most, scratch))
    t = targets.select(F.col("source").alias("_source"), "source_size", "target")
    joined = sized.join(t, sized["source"].eqNullSafe(t["_source"]))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.col("target") / F.col("source_size"))).otherwise(0.0)
    copies = F.floor(rate) + F.when(unit_draw(F.col("_doc"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return joined.withColumn("copies", copies.cast("long")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "row")


def emit_copies(mixed: DataFrame) -> DataFrame:
    """The rows of the mixed documents themselves, each as often as the mix takes it."""
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")
