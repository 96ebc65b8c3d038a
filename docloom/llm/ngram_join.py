"""N-gram Jaccard join: rare-first prefix filtering, then each candidate pair is verified once."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.llm.components import components
from docloom.llm.ranks import with_order_key
from docloom.llm.scratch import Scratch
from docloom.llm.words import SPACED_LOWER, hash_words, mix, shingles, slices, text_bytes

#: Counters of the order sketch (a power of two). Fixed: 4 MB a task, 1 MB to each executor, at any input size.
ORDER_CELLS = 1 << 20
_BLOCK = 1 << 12
#: Hash ranges of the suffix filter (a power of two).
RANGES = 128
#: Rounds in which each class meets one centre per list, before the pairs that are left are joined.
STARS = 2
#: Documents that may be broadcast as a list of ids (8 bytes each); longer lists are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(column)
    for lo, hi in slices(offsets):
        h, at = hash_words(data, offsets[lo : hi + 1], SPACED_LOWER)
        runs = shingles(h, k)
        for i in range(hi - lo):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= k:
                s = np.sort(runs[a : b - k + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
            elif b > a:  # fewer words than k: all of them as one shingle, apart from the others by its length
                yield mix(shingles(h[a:b], b - a) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def shingle_order(texts: DataFrame, k: int) -> np.ndarray:
    """For each cell of a fixed sketch, the level (a quarter of a power of two) of how often its shingles occur.

    Every text counts. The tasks' counters are added in two rounds by block, so no task gets the
    counters of all others at once, and the driver gets ORDER_CELLS bytes.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(ORDER_CELLS, np.uint32)
        for batch in batches:
            for s in _sets(batch.column(0), k):
                np.add.at(cells, (s & np.uint64(ORDER_CELLS - 1)).astype(np.int64), np.uint32(1))
        n = TaskContext.get().partitionId() // 64
        blocks = [i for i in range(0, ORDER_CELLS, _BLOCK) if cells[i : i + _BLOCK].any()]
        if blocks:
            packed = [zlib.compress(cells[i : i + _BLOCK].astype(np.uint64).tobytes(), 1) for i in blocks]
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([n] * len(blocks), pa.int32()), pa.array(packed, pa.binary())], names=["block", "part", "cells"])

    def add(pdf):
        total = sum((np.frombuffer(zlib.decompress(x), np.uint64) for x in pdf.cells), np.zeros(_BLOCK, np.uint64))
        return pdf.iloc[:1].assign(cells=[zlib.compress(total.tobytes(), 1)])

    form = "block int, part int, cells binary"
    some = texts.mapInArrow(count, form).groupBy("block", "part").applyInPandas(add, form)
    level = np.zeros(ORDER_CELLS, np.uint8)
    for row in some.groupBy("block").applyInPandas(add, form).select("block", "cells").toLocalIterator():
        total = np.frombuffer(zlib.decompress(row.cells), np.uint64)
        level[row.block : row.block + _BLOCK] = np.ceil(4 * np.log2(total + 1.0)).astype(np.uint8)
    return level


def _prefixes(docs: DataFrame, k: int, percent: int, level) -> DataFrame:
    """doc, doc_id, n (set size), key (of the set), prefix (rarest shingles, rarest first), next (the one after them), ranges (set size by hash range)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        levels = level.value.astype(np.uint64) << np.uint64(56)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                n, keys, rare, after, ends, ranges = [], [], [], [], [0], []
                for s in _sets(part.column(2), k):
                    m = len(s)
                    n.append(m)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    p = m - -(-percent * m // 100) + 1 if m else 0
                    rank = levels[(s & np.uint64(ORDER_CELLS - 1)).astype(np.int64)] | (s >> np.uint64(8))
                    q = min(p + 1, m)
                    first = np.argpartition(rank, q - 1)[:q] if q < m else np.arange(q)
                    first = s[first[np.lexsort((s[first], rank[first]))]].view(np.int64)
                    rare.append(first[:p])
                    after.append(int(first[p]) if p < q else None)
                    ends.append(ends[-1] + p)
                    ranges.append(np.bincount((s >> np.uint64(64 - 7)).astype(np.int64), minlength=RANGES))
                flat = np.concatenate(rare) if rare else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), pa.array(after, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * RANGES, pa.int32()), pa.array(np.concatenate(ranges).astype(np.int32)))],
                    names=["doc", "doc_id", "n", "key", "prefix", "next", "ranges"],
                )

    return docs.select("_doc", "doc_id", "text").mapInArrow(run, "doc long, doc_id long, n long, key binary, prefix array<long>, next long, ranges array<int>")


def _listed(ids: DataFrame) -> DataFrame:
    """A table of ids: broadcast if its counted rows are few enough."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _without_equal(postings: DataFrame, item: str, most: int) -> DataFrame:
    """postings (``item``, doc, pos) without the items that stand in the same documents as ``most`` rarer ones: each pair meets in those first.

    Lists of documents are compared by their number and 128 bits of their ids' hashes.
    """
    lists = postings.groupBy(item).agg(F.count("*").alias("c"), *(F.bit_xor(F.xxhash64("doc", F.lit(i))).alias(f"h{i}") for i in (0, 1)), F.min(F.struct("doc", "pos")).alias("head"))
    rank = F.row_number().over(Window.partitionBy("c", "h0", "h1").orderBy("head.pos"))  # all of them stand in one document, rarest first
    return postings.join(lists.select(item, rank.alias("rank")).where(F.col("rank") <= most).select(item), item, "left_semi")


def _packed_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc, text as a zstd frame) of the members; a text takes about a quarter of its set's room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            packed = [pack((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["doc", "packed"])

    some = docs.join(_listed(members), docs["_doc"] == members["doc"], "left_semi").select("_doc", "text")
    return some.mapInArrow(run, "doc long, packed binary")


def _verified(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are as similar as asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_ = zstandard.ZstdDecompressor().decompress
        kept: dict[int, np.ndarray] = {}  # of the last documents; a document with many partners is not read anew each time

        def whole(doc: int, packed: bytes) -> np.ndarray:
            if doc not in kept:
                if len(kept) >= 64:
                    kept.clear()
                kept[doc] = next(_sets(pa.array([open_(packed)], pa.large_binary()).view(pa.large_string()), k))
            return kept[doc]

        for batch in batches:
            links = []
            for a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                both = np.sort(np.concatenate((whole(a, x), whole(b, y))))
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                links.append(100 * same >= percent * (len(both) - same))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(links, pa.bool_()))

    with_a = pairs.join(texts.select(F.col("doc").alias("a"), F.col("packed").alias("x")), "a")
    with_b = with_a.join(texts.select(F.col("doc").alias("b"), F.col("packed").alias("y")), "b")
    return with_b.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable by links) for each row of ``docs``.

    Two texts link when 100 * |intersection| >= percent * |union| of their distinct k-word shingles
    (A-Z lower-cased, words split at ASCII white space).

    1. A fixed sketch counts all shingles of all texts; it gives one global order, rare first.
    2. Texts with equal sets are one class, represented by its first row by id.
    3. Only the rarest n - ceil(n * percent / 100) + 1 shingles of a class are posted; two classes that
       link share one of them, and it stands in the shorter index prefix of the smaller set. Lists
       without such a pair go.
    4. Candidates pass a length, a positional and a suffix filter, and are verified once on the whole sets.
       In each of STARS rounds, at every size, each class is paired with one centre per list: first with
       the one of fewest rare shingles, which is nearest to what a group of near copies has in common.
       A list of two is done then. Of the others, only pairs of classes that are still in different
       components are joined and checked. A dense group of near copies thus costs about one check a
       member, and no link between components is lost.
    5. Before that last join, a list with more pairs than second keys is dealt by the second shingle that
       a link must share as well, among the index prefix and the shingle after it. Of shingles that stand in
       the same documents (those of a common passage), only the rarest is a list and the two rarest are
       second ones, unless no other component has them or they stand too late for the sizes in the
       list. Sets too small to link
       with any other set are not posted. A shingle common to many unlike texts is thus no square of them.

    Shingles are compared by 64-bit hashes. A null or empty text has n_shingles 0 and is its own
    component; a text of fewer than k words is one shingle. Rows without id have component null and
    link nothing; rows that repeat an id are texts of their own, each linked by its own set. Empty tables
    give empty tables; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = with_order_key(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), scratch)
    level = spark.sparkContext.broadcast(shingle_order(docs.select("text"), k))
    texts = scratch.save(_prefixes(docs, k, percent, level))
    members = texts.where("n > 0 and doc_id is not null")
    classes = members.groupBy("key").agg(F.min(F.struct("doc", "doc_id")).alias("head"), F.count("*").alias("size"))
    classes = scratch.save(classes.select("key", "head.*", "size"))

    shared = classes.where("size > 1").select("key", F.col("doc").alias("first"))
    copies = _listed(scratch.save(members.select("key", "doc").join(shared, "key").where("doc <> first").select("doc")))  # few beside the representatives
    lead = members.join(copies, "doc", "left_anti").where(100 * F.col("n") >= percent * (F.col("n") + 1))  # smaller sets link with equal ones only
    posted = lead.select(F.posexplode("prefix").alias("pos", "item"), "doc", F.col("n").cast("int").alias("n"))
    indexed = (F.col("n") - F.col("pos")) * (100 + percent) >= F.col("n") * (2 * percent)  # may be the smaller set's first shared shingle
    lists = posted.groupBy("item").agg(F.count("*").alias("c"), F.max(indexed).alias("indexed")).where("c > 1 and indexed").select("item")
    post = scratch.save(posted.join(lists, "item", "left_semi"))
    ranges = scratch.save(lead.select("doc", "ranges").join(_listed(scratch.save(post.select("doc").distinct())), "doc", "left_semi"))

    def possible(pairs: DataFrame) -> DataFrame:
        """Distinct pairs a < b after the length, positional and suffix filters."""
        need = F.ceil(percent * (F.col("na") + F.col("nb")) / (100 + percent))
        long_enough = (100 * F.least("na", "nb")) >= (percent * F.greatest("na", "nb"))
        in_place = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need  # holds at the first shared shingle of a link
        some = pairs.where(long_enough & in_place).groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))
        some = some.join(ranges.select(F.col("doc").alias("a"), F.col("ranges").alias("ra")), "a").join(ranges.select(F.col("doc").alias("b"), F.col("ranges").alias("rb")), "b")
        most = F.aggregate(F.zip_with("ra", "rb", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
        return some.where(most >= need).select("a", "b")

    def verified(pairs: DataFrame, tried: list[DataFrame]) -> DataFrame:
        """The links among those possible pairs that no earlier round has tried; the tried ones are noted."""
        asked = possible(pairs)
        for before in tried:
            asked = asked.join(before, ["a", "b"], "left_anti")
        asked = scratch.save(asked)
        tried.append(asked)
        members = asked.select(F.col("a").alias("doc")).union(asked.select(F.col("b").alias("doc"))).distinct()
        packed = scratch.save(_packed_texts(docs, members))
        found = scratch.save(_verified(asked, packed, k, percent))
        scratch.drop(packed)
        return found

    def by_second(live: DataFrame) -> DataFrame:
        """live with ``second``: 0, or, where that makes fewer rows than a list has pairs, each shingle that can be the second one that a link shares."""
        least = F.greatest("least", F.ceil(F.lit(percent) * F.col("n") / 100))  # size of the smallest set in the list that can link with this one
        last = F.col("n") - F.ceil(percent * (F.col("n") + least) / (100 + percent))  # where a link's first shared shingle stands at most
        near = live.join(live.groupBy("item").agg(F.min("n").alias("least")), "item").withColumn("last", last.cast("int")).where("pos <= last").select(*live.columns, "last")
        live = scratch.save(_without_equal(near, "item", 1))
        sizes = live.groupBy("item").agg(F.count("*").alias("c"), F.sum(F.col("last") + 1 - F.col("pos")).alias("keys"), F.min(F.ceil(F.lit(percent) * F.col("n") / 100)).alias("least"))
        dealt = scratch.save(live.join(sizes.select("item", F.expr("least >= 2 and c * (c - 1) > 2 * keys").alias("dealt")), "item"))
        holders = _listed(scratch.save(dealt.where("dealt").select("doc", F.col("comp").alias("of")).distinct()))
        seconds = lead.join(holders, "doc").select("doc", "of", F.posexplode(F.concat("prefix", F.array("next"))).alias("pos", "second"))
        seconds = scratch.save(seconds.where("second is not null"))
        several = seconds.groupBy("second").agg(F.min("of").alias("c0"), F.max("of").alias("c1")).where("c0 <> c1").select("second")
        seconds = _without_equal(seconds.join(several, "second", "left_semi"), "second", 2).select("doc", F.col("pos").alias("at"), "second")
        some = dealt.where("dealt").join(seconds, "doc").where("at > pos and at <= last + 1").select(*live.columns, "second")
        return some.union(dealt.where("not dealt").select(*live.columns, F.lit(0).cast("long").alias("second")))

    live, tried, links, roots = post.withColumn("comp", F.col("doc")), [], None, None
    for turn in range(STARS + 1):
        if turn < STARS:
            place = F.xxhash64("doc", F.lit(turn)) if turn else F.col("pos").cast("long")
            lists = live.groupBy("item").agg(F.min(F.struct(place.alias("place"), "doc", "n", "pos", "comp")).alias("head"))
            heads = lists.select("item", F.col("head.doc").alias("hd"), F.col("head.n").alias("hn"), F.col("head.pos").alias("hp"), F.col("head.comp").alias("hc"))
            pairs = live.join(heads, "item").where("comp <> hc")
            first = F.col("doc") < F.col("hd")
            pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
            pairs = pairs.select(pick("doc", "hd").alias("a"), pick("hd", "doc").alias("b"), pick("n", "hn").alias("na"), pick("hn", "n").alias("nb"), pick("pos", "hp").alias("pa"), pick("hp", "pos").alias("pb"))
        else:
            live = scratch.save(by_second(live))
            x, y = (live.select("item", "second", *(F.col(c).alias(f"{c}{side}") for c in ("doc", "n", "pos", "comp"))) for side in ("1", "2"))
            pairs = x.join(y, ["item", "second"]).where("doc1 < doc2 and comp1 <> comp2")
            pairs = pairs.select(*(F.col(c).alias(to) for c, to in (("doc1", "a"), ("doc2", "b"), ("n1", "na"), ("n2", "nb"), ("pos1", "pa"), ("pos2", "pb"))))
        found = verified(pairs, tried)
        links = found if links is None else links.union(found)
        if roots is None or not found.isEmpty():
            if roots is not None:
                scratch.drop(roots)
            roots = scratch.save(components(links, scratch))
        if turn < STARS:  # what is left to join: lists of more than two members that join several components
            now = live if turn else live.join(live.groupBy("item").agg(F.count("*").alias("c")).where("c > 2").select("item"), "item", "left_semi")
            now = now.drop("comp").join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("root", "doc")).drop("root")
            several = now.groupBy("item").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("item")
            after = scratch.save(now.join(several, "item", "left_semi"))
            if turn:
                scratch.drop(live)
            live = after
            if live.isEmpty():
                break
    scratch.drop(post)

    ids = roots.select(F.col("node").alias("doc"), F.col("root").alias("root_id"))
    if not classes.where("doc <> doc_id").isEmpty():  # ids repeat: a root is a row, to be named by its id
        ids = ids.join(classes.select(F.col("doc").alias("root_id"), "doc_id"), "root_id").select("doc", F.col("doc_id").alias("root_id"))
    named = scratch.save(classes.join(ids, "doc", "left").select("key", F.coalesce("root_id", "doc_id").alias("component_id")))
    out = texts.select("doc_id", "n", "key").join(named, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id")).alias("component_id"))
