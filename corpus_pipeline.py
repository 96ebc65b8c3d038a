"""The corpus pipeline: toxicity, near-duplicates, decontamination, mixing and sharding, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.decontam import decontaminate
from docloom.llm.kd_shards import kd_shards
from docloom.llm.mixing import emit_copies, mix_sources
from docloom.llm.ngram_join import jaccard_components
from docloom.llm.ranks import with_order_key
from docloom.llm.scratch import Scratch
from docloom.llm.toxicity import drop_toxic

#: Rows that may be broadcast as a list of keys (8 bytes each); longer lists are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def _keyed(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """``docs`` with a column that tells its rows apart, null and repeated ids included, and that column's name."""
    name = "row_key"
    while name in docs.columns:
        name += "_"
    return with_order_key(docs, scratch, name=name, then=("source", "lang")), name


def _without(docs: DataFrame, key: str, gone: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of ``docs`` whose key is not listed in ``gone`` (doc_id), less the key; texts are shuffled only for a long list."""
    listed = scratch.save(gone.select(F.col("doc_id").alias(key)))
    return docs.join(F.broadcast(listed) if listed.count() <= BROADCAST_KEYS else listed, key, "left_anti").drop(key).select(*(c for c in docs.columns if c != key))


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text the toxicity model does not predict as toxic; null and empty texts stay."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: the first by id. Rows without words have no copies and stay."""
    scratch = Scratch(spark, "copies")
    docs, key = _keyed(docs, scratch)
    return _without(docs, key, jaccard_components(docs, k=5, percent=80, id_col=key).where("component_id <> doc_id"), scratch)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no window of a benchmark item; an empty benchmark removes none."""
    scratch = Scratch(spark, "benchmark")
    docs, key = _keyed(docs, scratch)
    return _without(docs, key, decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key).where("contaminated"), scratch)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix of sources takes it; texts without words are of no size and taken as their source's rate says."""
    return emit_copies(mix_sources(docs))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each copy."""
    return kd_shards(docs, shards=16)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: Learned scores and the tree's cuts have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.save(docs)
            if name != STAGES[0][0]:
                scratch.drop(before)
    return docs
