"""Gapless global numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.scratch import Scratch

_ROW_BITS = (1 << 33) - 1


def global_rank(df: DataFrame, order: list[Column], scratch: Scratch, name: str = "rank") -> DataFrame:
    """``df`` with a column ``name``: 0, 1, 2, ... in the given order; equal rows get their numbers in any order.

    The rows are dealt by range and numbered in each task; only one count per task meets in one place.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = scratch.save(dealt.withColumn("_task", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_BITS))))
    counts = dealt.groupBy("_task").agg(F.count("*").alias("_n"))
    before = counts.select("_task", (F.sum("_n").over(Window.orderBy("_task")) - F.col("_n")).alias("_before"))
    return dealt.join(F.broadcast(before), "_task").withColumn(name, F.col("_before") + F.col("_at")).drop("_task", "_at", "_before")


def with_order_key(docs: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id", name: str = "_doc", then: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with ``name``: a unique long that orders the rows by id.

    It is the id itself where ids are unique. Otherwise rows are numbered by id (null last), then text,
    then the columns ``then``; equal rows get their numbers in any order.
    """
    if docs.groupBy(id_col).agg(F.count("*").alias("c")).where(F.col(id_col).isNull() | (F.col("c") > 1)).isEmpty():
        return docs.withColumn(name, F.col(id_col).cast("long"))
    return global_rank(docs, [F.col(c).asc_nulls_last() for c in (id_col, text_col, *then)], scratch, name)
