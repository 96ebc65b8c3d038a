"""Embedding near-duplicates through a pivot-permutation index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.scratch import Scratch

#: Pivots: twice the root of the number of distinct vectors, within these bounds, drawn from a sample of at most MOST_PIVOTS vectors.
LEAST_PIVOTS, MOST_PIVOTS = 256, 4096
#: The nearest pivots that describe a vector, and how many of them a pair must share.
NEAREST, SHARED = 8, 2
#: Vectors whose largest part is smaller, or larger than its inverse, are scaled by a power of two, which changes no cosine.
LEAST_PART = 1e-100
#: Vectors of one block; longer pivot lists are cut into blocks, and all pairs of blocks are compared.
BLOCK = 2048


def _classes(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim, unit (the vector as 64-bit floats, or null if it links with nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, dims = [], []
            column = batch.column(2).cast(pa.list_(pa.float64()))
            for v in column:
                x = None
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = np.asarray(v.values)
                    most = np.abs(x).max()
                    if not np.isfinite(most) or most == 0:
                        x = None
                    elif not LEAST_PART <= most <= 1 / LEAST_PART:  # its square would leave the range of doubles
                        x = np.ldexp(x, -int(np.frexp(most)[1]))
                units.append(None if x is None else x.tobytes())
                dims.append(0 if x is None else len(x))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(units, pa.binary())], names=["vec_id", "label", "dim", "raw"])

    return vectors.mapInArrow(run, f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, dim int, raw binary")


def choose_pivots(classes: DataFrame, pivots: int, sample: int) -> dict[int, np.ndarray]:
    """Per dimension, the pivots: distinct vectors of the sample of smallest hashes, in a fixed random order."""
    rows = classes.select("dim", "raw").orderBy(F.xxhash64("raw"), "raw").limit(sample).collect()  # a bounded sample
    out = {}
    for dim in {r.dim for r in rows}:
        x = np.stack([np.frombuffer(r.raw, np.float64) for r in rows if r.dim == dim])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        x = np.unique(x, axis=0)
        x = x[np.random.default_rng(7).permutation(len(x))]
        out[dim] = x[:pivots]
    return out


def _described(classes: DataFrame, pivots, nearest: int) -> DataFrame:
    """vec, label, dim, n, unit and pivots (nearest first) of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            near, units = [None] * batch.num_rows, [None] * batch.num_rows
            for dim in np.unique(dims):
                i = np.flatnonzero(dims == dim)
                x = np.stack([np.frombuffer(batch.column(4)[int(j)].as_py(), np.float64) for j in i])
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                p = pivots.value.get(int(dim), x[:0])
                order = np.argsort(-(x @ p.T), axis=1, kind="stable")[:, :nearest] if len(p) else np.zeros((len(x), 1), np.int64)
                for j, u, o in zip(i, x, order, strict=True):
                    near[j], units[j] = o.tolist(), u.tobytes()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(units, pa.binary()), pa.array(near, pa.list_(pa.int32()))], names=["vec", "label", "dim", "n", "unit", "near"])

    fields = f"vec long, label {classes.schema['label'].dataType.simpleString()}, dim int, n long, unit binary, near array<int>"
    return classes.mapInArrow(run, fields)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest reachable over the links a - b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        after = root.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if (after == root).all():
            return root
        root = after


def _linked(posts: DataFrame, least: float, shared: int) -> DataFrame:
    """vec, links, root: from each block, linked vectors (all copies counted) and one chain to the block's components.

    A pair is looked at in the list of the smallest pivot that it shares, so it counts once.
    """

    def compare(table: pa.Table) -> pa.Table:
        pivot, i, j = (table.column(c)[0].as_py() for c in ("pivot", "i", "j"))
        vec, n, block = (table.column(c).to_numpy() for c in ("vec", "n", "block"))
        x = np.stack([np.frombuffer(u, np.float64) for u in table.column("unit").to_pylist()])
        near = table.column("near").to_pylist()
        width = max(max(r) for r in near) + 1
        has = np.zeros((len(near), width), np.float32)
        for r, own in enumerate(near):
            has[r, own] = 1
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found_a, found_b = [], []
        enough = min(shared, min(map(len, near)))
        for lo in range(0, len(left), 512):
            rows = left[lo : lo + 512]
            ok = x[rows] @ x[right].T >= least
            ok &= has[rows] @ has[right].T >= enough
            if pivot:
                ok &= has[rows, :pivot] @ has[right, :pivot].T == 0
            if i == j:
                ok &= rows[:, None] < right[None, :]
            a, b = np.nonzero(ok)
            found_a.append(rows[a])
            found_b.append(right[b])
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        links = np.bincount(a, weights=n[b], minlength=len(vec)) + np.bincount(b, weights=n[a], minlength=len(vec))
        order = np.argsort(vec, kind="stable")
        place = np.empty(len(vec), np.int64)
        place[order] = np.arange(len(vec))
        root = vec[order[_roots(len(vec), place[a], place[b])[place]]]
        hit = links > 0
        return pa.table({"vec": vec[hit], "links": links[hit].astype(np.int64), "root": root[hit]})

    return posts.groupBy("label", "dim", "pivot", "i", "j").applyInArrow(compare, "vec long, links long, root long")


def pivot_count(n: int) -> int:
    """Pivots for n distinct vectors: lists then hold some 4 * sqrt(n) postings a label, and describing n vectors costs n * sqrt(n) products."""
    return min(MOST_PIVOTS, max(LEAST_PIVOTS, 2 * math.isqrt(n)))


def near_vectors(
    vectors: DataFrame, least: float = 0.93, pivots: int | None = None, nearest: int = NEAREST, shared: int = SHARED, exact: bool = False, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row; links join vectors of one label with cosine >= least.

    1. Equal vectors of a label are one class, counted and represented by its smallest id.
    2. Each class is described by its nearest pivots, in order, out of pivots from a bounded sample; their
       number grows with the classes (``pivot_count``) unless it is given.
    3. Classes meet in the inverted lists of (label, pivot). A pair that shares enough pivots is verified in
       double precision, once, in the list of its smallest shared pivot. Lists longer than BLOCK are cut,
       and each pair of blocks is a task of its own; blocks return counts and chains, never all pairs.

    The index finds pairs that share ``shared`` of their ``nearest`` pivots (the README has the measured recall).
    With ``exact`` all classes of a label and dimension are one list, so that every pair is verified, in blocks:
    all links, at quadratic arithmetic.

    Vectors that are null, empty, zero, or hold null or non-finite parts, and rows without label, link with
    nothing; vectors of different lengths do not link. Rows without id have no links and a null component;
    rows that repeat an id share their links. Empty tables give empty tables; other columns are not read.
    """
    spark: SparkSession = vectors.sparkSession
    scratch = Scratch(spark, "pivots")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("label"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = scratch.save(_classes(rows))
    valid = rows.where("raw is not null and label is not null and vec_id is not null")
    classes = scratch.save(valid.groupBy("label", "dim", "raw").agg(F.min("vec_id").alias("vec"), F.count("*").alias("n")).select("vec", "label", "dim", "n", "raw"))
    chosen = spark.sparkContext.broadcast({} if exact else choose_pivots(classes, pivots or pivot_count(classes.count()), MOST_PIVOTS))
    known = scratch.save(_described(classes, chosen, nearest))
    posts = known.select("*", F.explode("near").alias("pivot"))
    blocks = F.ceil(F.count("*") / BLOCK).cast("int")
    lists = scratch.save(posts.groupBy("label", "dim", "pivot").agg(blocks.alias("blocks"), F.count("*").alias("c")).where("c > 1").drop("c"))
    posts = posts.join(F.broadcast(lists) if lists.count() <= 100_000 else lists, ["label", "dim", "pivot"])
    posts = posts.withColumn("block", F.pmod(F.xxhash64("vec"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("i"), F.greatest("block", o).alias("j")))
    posts = posts.withColumn("ij", F.explode(pairs)).select("label", "dim", "pivot", F.col("ij.i").alias("i"), F.col("ij.j").alias("j"), "block", "vec", "n", "unit", "near")
    found = scratch.save(_linked(posts, least, shared))
    roots = scratch.save(components(found.select(F.col("vec").alias("a"), F.col("root").alias("b")), scratch))
    links = found.groupBy("vec").agg(F.sum("links").alias("links"))
    facts = classes.select("vec", "label", "dim", "raw", "n").join(links, "vec", "left").join(roots.withColumnRenamed("node", "vec"), "vec", "left")
    facts = scratch.save(facts.select("label", "dim", "raw", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "vec").alias("component_id")))
    out = rows.join(facts, ["label", "dim", "raw"], "left")
    own = F.col("vec_id").isNotNull()
    component = F.when(own, F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.when(own, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
