"""Shards of near-equal bytes from a k-d tree over document metadata, with DataFrame functions only."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.scratch import Scratch

#: Histogram cells of one node in one round: at most shards / 2 * CELLS rows reach the driver.
CELLS = 1024
#: Bits of a dimension's value, and of the tie-break behind it.
VALUE_BITS, TIE_BITS = 20, 40
DIMENSIONS = ("d_size", "d_source", "d_lang", "d_id")


def _unit_bits(value: Column) -> Column:
    return (F.xxhash64(value).bitwiseAND(F.lit((1 << VALUE_BITS) - 1))).cast("long")


def kd_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null) for each row of ``docs``.

    The tree's dimensions are log size, source, language and place in the id range. A node with m
    shards is cut into m // 2 and the rest where its bytes divide in that proportion, along the dimension
    in which its documents spread most (by standard deviation of bytes over the dimension's range). The weighted median is found in
    rounds: bytes per cell of the node's range, added before the shuffle, until the cut's error is below
    a thousandth of a shard's bytes or the cell holds one group. All nodes of a level share their rounds.

    Equal texts are one group and stay in one shard, behind the cut they straddle. Groups of more than an eighth of
    a shard's bytes (fewer than 8 a shard) are placed before the tree, largest first, each where most room is left;
    nodes are then cut in proportion to the room of their shards. Only a group larger than a shard, which no shard
    can hold, is dealt row by row. Slots are numbered in buckets of a shard, so no task orders a whole shard.

    A null text has size 1 and the CRC of nothing, and its rows are one group; null ids, sources and
    languages are values like others; repeated rows are rows of a group; an empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "kd")
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g"), F.xxhash64(text, F.lit(1)).alias("g2"), _unit_bits(docs[source_col]).alias("d_source") if source_col in docs.columns else F.lit(0).cast("long").alias("d_source"),
        _unit_bits(docs[lang_col]).alias("d_lang") if lang_col in docs.columns else F.lit(0).cast("long").alias("d_lang"),
    )
    rows = scratch.save(rows)
    total, low, high, n = rows.agg(F.sum("size"), F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    if not n:
        return _result(rows.withColumn("shard", F.lit(0)).withColumn("_k", F.lit(0).cast("long")), 1)
    target = total / shards

    # one row a group; a group beyond a shard is spread over keys, one for each row
    span = max(1, (high or 0) - (low or 0))
    place = F.coalesce(((F.col("doc_id") - F.lit(low or 0)).cast("double") / span * ((1 << VALUE_BITS) - 1)).cast("long"), F.lit(0).cast("long"))
    groups = rows.groupBy("g", "g2").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("doc_id"), F.max("size").alias("size"), F.min("d_source").alias("d_source"), F.min("d_lang").alias("d_lang"))
    groups = scratch.save(groups.withColumn("d_id", place).withColumn("d_size", (F.log2(F.col("size").cast("double")) / 48 * ((1 << VALUE_BITS) - 1)).cast("long")))
    room = [target] * shards
    homes = []
    for r in groups.where((F.col("bytes") > target / 8) & (F.col("bytes") <= target)).orderBy(F.desc("bytes"), "g", "g2").select("g", "g2", "bytes").collect():  # fewer than 8 * shards
        shard = max(range(shards), key=lambda i: (room[i], -i))
        room[shard] -= r.bytes
        homes.append(F.struct(F.lit(r.g).cast("long").alias("g"), F.lit(r.g2).cast("long").alias("g2"), F.lit(-1).cast("long").alias("piece"), F.lit(shard).alias("shard")))
    room = [max(0.0, x) for x in room]
    huge = groups.where(F.col("bytes") > target)  # fewer than shards of them
    small = groups.where(F.col("bytes") <= target / 8).select("g", "g2", F.lit(None).cast("long").alias("piece"), "bytes", *DIMENSIONS)
    of_huge = rows.join(F.broadcast(huge.select("g", "g2", "d_size")), ["g", "g2"])
    piece = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    pieces = of_huge.withColumn("piece", piece).groupBy("g", "g2", "piece").agg(F.sum("size").alias("bytes"), F.min("doc_id").alias("doc_id"), F.min("d_size").alias("d_size"), F.min("d_source").alias("d_source"), F.min("d_lang").alias("d_lang"))
    pieces = pieces.withColumn("d_id", place).select("g", "g2", "piece", "bytes", *DIMENSIONS)
    units = scratch.save(small.union(pieces).withColumn("tie", F.xxhash64("g", "g2", F.coalesce("piece", F.lit(-1))).bitwiseAND(F.lit((1 << TIE_BITS) - 1))))

    # node -> (first shard, shards); the units' node follows from the cuts found so far
    leaves: dict[int, tuple[int, int]] = {1: (0, shards)}

    def key(dim: str) -> Column:
        return F.shiftleft(F.col(dim), TIE_BITS).bitwiseOR(F.col("tie"))

    placed = units.withColumn("node", F.lit(1))
    while any(m > 1 for _, m in leaves.values()):
        split = [at for at, (_, m) in leaves.items() if m > 1]
        cuts: dict[int, tuple[str, int]] = {}
        live = placed.where(F.col("node").isin(split))
        moments = [f(F.col("bytes") * F.col(d).cast("double") ** p).alias(f"{d}{p}") for d in DIMENSIONS for p, f in ((1, F.sum), (2, F.sum))]
        ends = [f(d).alias(f"{d}_{f.__name__}") for d in DIMENSIONS for f in (F.min, F.max)]
        facts = {r.node: r for r in live.groupBy("node").agg(F.sum("bytes").alias("w"), *moments, *ends).collect()}  # a row a node
        search: dict[int, list] = {}
        for at in split:
            r = facts.get(at)
            first, m = leaves[at]
            if r is None:  # fewer documents than shards
                cuts[at] = (DIMENSIONS[0], 0)
                continue

            def spread(d, r=r):
                mean = r[f"{d}1"] / r.w
                return max(0.0, r[f"{d}2"] / r.w - mean * mean)

            dim = max(DIMENSIONS, key=spread)
            lo, hi = r[f"{dim}_min"] << TIE_BITS, (r[f"{dim}_max"] + 1) << TIE_BITS
            left, all_ = sum(room[first : first + m // 2]), sum(room[first : first + m])
            search[at] = [dim, lo, hi, r.w * (left / all_ if all_ else (m // 2) / m), 0]  # bytes wanted below the cut, bytes known below lo
        while search:
            cell = F.lit(None).cast("int")
            for at, (dim, lo, hi, _, _) in search.items():
                width = -(-(hi - lo) // CELLS)
                inside = (F.col("node") == at) & (key(dim) >= F.lit(lo)) & (key(dim) < F.lit(hi))
                cell = F.when(inside, F.call_function("div", key(dim) - F.lit(lo), F.lit(width).cast("long")).cast("int")).otherwise(cell)
            counts = defaultdict(dict)
            for r in placed.withColumn("cell", cell).where("cell is not null").groupBy("node", "cell").agg(F.sum("bytes").alias("w"), F.count("*").alias("units")).collect():
                counts[r.node][r.cell] = (r.w, r.units)
            for at, (dim, lo, hi, want, below) in list(search.items()):
                width = -(-(hi - lo) // CELLS)
                for i in sorted(counts[at]):
                    if below + counts[at][i][0] >= want:
                        break
                    below += counts[at][i][0]
                here, units_here = counts[at][i]
                start = lo + i * width
                if here <= target / 1000 or units_here == 1 or width == 1:  # cut before or behind this cell, whichever is nearer
                    cuts[at] = (dim, start if want - below < below + here - want else start + width)
                    del search[at]
                else:
                    search[at] = [dim, start, min(hi, start + width), want, below]
        for at in split:
            first, m = leaves.pop(at)
            leaves[2 * at] = (first, m // 2)
            leaves[2 * at + 1] = (first + m // 2, m - m // 2)
        node = F.col("node")
        side = F.lit(None).cast("int")
        for at, (dim, cut) in cuts.items():
            side = F.when(F.col("node") == at, F.when(key(dim) < F.lit(cut), 2 * at).otherwise(2 * at + 1)).otherwise(side)
        placed = scratch.save(placed.withColumn("node", F.coalesce(side, node)))
    shard = F.lit(None).cast("int")
    for at, (first, _) in leaves.items():
        shard = F.when(F.col("node") == at, F.lit(first)).otherwise(shard)
    placed = scratch.save(placed.select("g", "g2", "piece", shard.alias("shard")))
    is_huge = F.broadcast(huge.select("g", "g2", F.lit(1).alias("_huge")))
    keyed = rows.join(is_huge, ["g", "g2"], "left").withColumn("piece", F.when(F.col("_huge").isNotNull(), piece).otherwise(F.lit(-1)))
    placed = placed.withColumn("piece", F.coalesce("piece", F.lit(-1).cast("long")))
    if homes:
        placed = placed.unionByName(spark.range(1).select(F.inline(F.array(*homes))).select("g", "g2", F.col("piece").cast("long"), "shard"))
    out = keyed.join(placed, ["g", "g2", "piece"])
    return _result(out.withColumn("_k", F.xxhash64("doc_id", "g")), max(1, n // (shards * 50_000)), scratch)


def _result(out: DataFrame, buckets: int, scratch: Scratch | None = None) -> DataFrame:
    """Slots: buckets of a shard follow each other, and rows are numbered inside their bucket."""
    out = out.withColumn("_b", F.pmod("_k", F.lit(buckets)))
    if scratch:
        out = scratch.save(out.select("doc_id", "size", "text_crc32", "shard", "_k", "_b"))
    counts = out.groupBy("shard", "_b").agg(F.count("*").alias("_n"))
    before = counts.select("shard", "_b", (F.sum("_n").over(Window.partitionBy("shard").orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("shard", "_b").orderBy("_k", "doc_id", "text_crc32", "size"))
    done = out.withColumn("_at", inside).join(before, ["shard", "_b"])
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("_before") + F.col("_at") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
