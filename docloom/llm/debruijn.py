"""Substring dedup: repeated runs of words, found on a de Bruijn graph that minimizers cut into paths.

A window of ``size`` words is an edge of the graph. Consecutive windows of a text that share their
minimizer (the smallest hash among the window's k-mers) form one path, whose inner nodes are passed
straight through; equal windows always have equal minimizers, so paths meet only within a minimizer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.ranks import with_order_key
from docloom.llm.scratch import Scratch
from docloom.llm.words import BASE, SPACED, _Powers, hash_words, mix, shingles, slices, text_bytes


@dataclass
class Paths:
    """Of some texts: per window its text, hash and path; per path its text, minimizer, content and the words from and to which it reaches."""

    at: np.ndarray
    window_at: np.ndarray
    window_text: np.ndarray
    window_hash: np.ndarray
    window_path: np.ndarray
    path_text: np.ndarray
    minimizer: np.ndarray
    content: np.ndarray
    path_from: np.ndarray
    path_to: np.ndarray


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    span, least = 1, values
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    rest = width - span
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def paths(h: np.ndarray, at: np.ndarray, size: int, k: int) -> Paths:
    n, texts = len(h), len(at) - 1
    text = np.repeat(np.arange(texts), np.diff(at))
    if n < size:
        i = np.zeros(0, np.int64)
        u = np.zeros(0, np.uint64)
        return Paths(at, i, i, u, i, i, u, u, i, i)
    least = _smallest(shingles(h, k), size - k + 1)
    window_at = np.flatnonzero(text[: n - size + 1] == text[size - 1 :])
    window_text, least = text[window_at], least[window_at]
    new = np.ones(len(window_at), bool)
    new[1:] = (least[1:] != least[:-1]) | (window_text[1:] != window_text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window_at)) - 1
    _Powers.reach(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * _Powers.up[:n], out=sums[1:])
    hashed = lambda a, b: mix((sums[b] - sums[a]) * _Powers.down[a])
    a, b = window_at[first], window_at[last] + size
    content = mix(hashed(a, b) + (b - a).astype(np.uint64) * np.uint64(BASE))
    return Paths(at, window_at, window_text, hashed(window_at, window_at + size), np.cumsum(new) - 1, window_text[first], least[first], content, a, b)


def _each(column: pa.Array, size: int, k: int) -> Iterator[tuple[int, int, Paths]]:
    data, offsets = text_bytes(column)
    for lo, hi in slices(offsets):
        h, at = hash_words(data, offsets[lo : hi + 1], SPACED)
        yield lo, hi, paths(h, at, size, k)


def _once(*keys: np.ndarray) -> np.ndarray:
    """Indices of the first of each distinct combination of keys."""
    mark = np.zeros(len(keys[0]), np.uint64)
    for x in keys:
        mark = mix(mark * np.uint64(BASE) + x.astype(np.uint64))
    return np.unique(mark, return_index=True)[1]


def _all_paths(docs: DataFrame, size: int, k: int) -> DataFrame:
    """(m, c, doc): the distinct paths of each text, by minimizer and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for lo, hi, p in _each(batch.column(1), size, k):
                i = _once(p.path_text, p.minimizer, p.content)
                yield pa.RecordBatch.from_arrays([pa.array(p.minimizer[i].view(np.int64)), pa.array(p.content[i].view(np.int64)), pa.array(doc[lo:hi][p.path_text[i]])], names=["m", "c", "doc"])

    return docs.select("_doc", "text").mapInArrow(run, "m long, c long, doc long")


def _packed(docs: DataFrame) -> DataFrame:
    """The texts as zstd frames, which halves what the joins on documents move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            i = batch.schema.get_field_index("text")
            packed = pa.array([None if t is None else pack(t.encode("utf-8", "surrogatepass")) for t in batch.column(i).to_pylist()], pa.binary())
            yield batch.set_column(i, "text", packed)

    fields = ", ".join(f"{n} {'binary' if n == 'text' else t}" for n, t in docs.dtypes)
    return docs.mapInArrow(run, fields)


def _unpacked(column: pa.Array) -> list[bytes]:
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    return [b"" if x is None else open_(x) for x in column.to_pylist()]


def _bytes_array(texts: list[bytes]) -> pa.Array:
    return pa.array(texts, pa.large_binary()).view(pa.large_string())


def _windows(docs: DataFrame, size: int, k: int) -> DataFrame:
    """(m, w, doc): the distinct windows of each text that lie on the paths named in ``open``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                doc, wanted = part.column(0).to_numpy(), part.column(2)
                for lo, hi, p in _each(_bytes_array(_unpacked(part.column(1))), size, k):
                    on = np.zeros(len(p.content), bool)
                    bounds = np.searchsorted(p.path_text, np.arange(hi - lo + 1))
                    for i in range(hi - lo):
                        own = np.asarray(wanted[lo + i].values).view(np.uint64)
                        on[bounds[i] : bounds[i + 1]] = np.isin(p.content[bounds[i] : bounds[i + 1]], own)
                    at = np.flatnonzero(on[p.window_path]) if len(on) else np.zeros(0, np.int64)
                    at = at[_once(p.window_text[at], p.window_hash[at])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(p.minimizer[p.window_path[at]].view(np.int64)), pa.array(p.window_hash[at].view(np.int64)), pa.array(doc[lo:hi][p.window_text[at]])], names=["m", "w", "doc"]
                    )

    return docs.select("_doc", "text", "open").mapInArrow(run, "m long, w long, doc long")


_MISS = np.zeros((0, 4), np.int64)


def _digest(words: list[bytes]) -> tuple[int, int]:
    """128 bits of the words themselves, as two signed numbers."""
    import xxhash

    x = xxhash.xxh3_128_intdigest(b" ".join(words))
    return (x >> 64) - (1 << 63), (x & ((1 << 64) - 1)) - (1 << 63)


def _source_digests(docs: DataFrame, size: int, k: int) -> DataFrame:
    """(kind, h, d1, d2): of the first texts, digests of the words at the places of the paths (kind 0) and windows (1) named in ``asked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts, asked, out = _unpacked(part.column(0)), part.column(1), []
                for lo, hi, p in _each(_bytes_array(texts), size, k):
                    path_at = np.searchsorted(p.path_text, np.arange(hi - lo + 1))
                    window_at = np.searchsorted(p.window_text, np.arange(hi - lo + 1))
                    for i in range(hi - lo):
                        words, own = texts[lo + i].split(), asked[lo + i].values
                        kinds, hashes = (own.field(c).to_numpy(zero_copy_only=False) for c in ("kind", "h"))
                        for kind, bounds, values, start, end in ((0, path_at, p.content, p.path_from, p.path_to), (1, window_at, p.window_hash, p.window_at, p.window_at + size)):
                            here = np.arange(bounds[i], bounds[i + 1])
                            here = here[np.isin(values[here].view(np.int64), hashes[kinds == kind])]
                            for j in here[np.unique(values[here], return_index=True)[1]].tolist():
                                out.append((kind, int(values[j].view(np.int64)), *_digest(words[start[j] - p.at[i] : end[j] - p.at[i]])))
                table = np.array(out, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(table[:, 0].astype(np.int32)), *(pa.array(table[:, c].copy()) for c in (1, 2, 3))], names=["kind", "h", "d1", "d2"])

    return docs.select("text", "asked").mapInArrow(run, "kind int, h long, d1 long, d2 long")


def _same_as_source(values: np.ndarray, said: np.ndarray, words: list[bytes], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which spans (hashes ``values``) have the words of their source (rows of ``said``: kind, hash and two digests)."""
    same = np.zeros(len(values), bool)
    if len(said):
        said = said[np.argsort(said[:, 1], kind="stable")]
        at = np.minimum(np.searchsorted(said[:, 1], values.view(np.int64)), len(said) - 1)
        for j in np.flatnonzero(said[at, 1] == values.view(np.int64)).tolist():
            same[j] = _digest(words[start[j] : end[j]]) == (int(said[at[j], 2]), int(said[at[j], 3]))
    return same


def _repeated(p: Paths, i: int, words: list[bytes], size: int, paths_here: tuple[int, int], windows_here: tuple[int, int], gone: np.ndarray) -> np.ndarray:
    """Which windows of text i are repeats: their words have the digest of those at the first occurrence (in ``gone``), or are those of an earlier window of the text."""
    (c, d), (a, b), zero = paths_here, windows_here, p.at[i]
    hashes, starts = p.window_hash[a:b], p.window_at[a:b] - zero
    whole = _same_as_source(p.content[c:d], gone[gone[:, 0] == 0], words, p.path_from[c:d] - zero, p.path_to[c:d] - zero)
    again = whole[p.window_path[a:b] - c] | _same_as_source(hashes, gone[gone[:, 0] == 1], words, starts, starts + size)
    _, first, back = np.unique(hashes, return_index=True, return_inverse=True)
    for j in np.flatnonzero((first[back] < np.arange(b - a)) & ~again).tolist():
        e = starts[first[back[j]]]
        again[j] = words[starts[j] : starts[j] + size] == words[e : e + size]
    return again


def _cut(docs: DataFrame, size: int, k: int) -> DataFrame:
    """The result rows, from the texts with the digests of the first occurrences of their repeated paths and windows (gone)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                texts, gone = _unpacked(part.column(1)), part.column(2)
                n, removed, digest, kept_text = [], [], [], []
                for lo, hi, p in _each(_bytes_array(texts), size, k):
                    path_at = np.searchsorted(p.path_text, np.arange(hi - lo + 1))
                    window_at = np.searchsorted(p.window_text, np.arange(hi - lo + 1))
                    for i in range(hi - lo):
                        words = texts[lo + i].split()
                        a, b = window_at[i], window_at[i + 1]
                        own = gone[lo + i].values
                        own = _MISS if own is None else np.stack([own.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("kind", "h", "d1", "d2")], axis=1)
                        again = _repeated(p, i, words, size, (path_at[i], path_at[i + 1]), (a, b), own)
                        if again.any():
                            starts = p.window_at[a:b][again] - p.at[i]
                            edge = np.zeros(len(words) + 1, np.int64)
                            np.add.at(edge, starts, 1)
                            np.add.at(edge, starts + size, -1)
                            keep = np.cumsum(edge[:-1]) == 0
                            kept = [w for w, yes in zip(words, keep.tolist(), strict=True) if yes]
                        else:
                            kept = words
                        n.append(len(words))
                        removed.append(len(words) - len(kept))
                        kept_text.append(b" ".join(kept))
                        digest.append(hashlib.sha256(kept_text[-1]).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(kept_text, pa.binary()).view(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
                )

    return docs.select("doc_id", "text", "gone").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def remove_repeats(docs: DataFrame, size: int = 20, k: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept (the kept words joined by one space) for each row.

    A word goes if a window of ``size`` consecutive words that covers it also starts earlier: in a text
    with a smaller id, or earlier in the same text. Windows are judged on the input.

    1. Every text's windows are cut into paths by minimizer (about one path in eight words). Minimizers
       that only one path of one text has are dropped: nothing on them repeats.
    2. Of a repeated path all copies but the one in the first text go whole. Where a minimizer has several
       different paths, their first copies are opened into windows, and each window's first text is found.
    3. The words of each repeated path and window are read at its source coordinates, in its first text, and
       their 128-bit digest is joined to the texts that repeat it; a text's span is cut only if its own words
       have that digest. Repeats inside one text are found and compared there, word by word.

    Paths are compacted inside each text, between changes of the minimizer, which is where other texts can
    branch off; the joins are on minimizers and contents, not on single edges.

    Every aggregate is combined before its shuffle, so a passage that very many texts share costs a row
    per task. Candidates are found by 64-bit hashes, windows within their minimizer's.
    A null or empty text has no words (digest of nothing); a text of fewer than ``size`` words keeps all.
    Rows that repeat an id, or have none, are separate texts, in order of their texts, null ids last. An
    empty table gives an empty table; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "debruijn")
    docs = with_order_key(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), scratch)
    pieces = _all_paths(docs, size, k)
    repeated = pieces.groupBy("m").agg(F.count("*").alias("n")).where("n > 1").select("m")
    pieces = scratch.save(pieces.join(repeated, "m", "left_semi"))
    # the node's branches: one content throughout is a path that is repeated as a whole
    nodes = scratch.save(pieces.groupBy("m").agg((F.min("c") != F.max("c")).alias("branches")))
    first = scratch.save(pieces.groupBy("m", "c").agg(F.min("doc").alias("first")))
    known = pieces.join(first, ["m", "c"]).join(nodes, "m").where("first < doc or branches")
    known = scratch.save(known.select("c", "doc", (F.col("first") < F.col("doc")).alias("gone")))
    open_ = known.where("not gone").groupBy("doc").agg(F.collect_list("c").alias("open"))
    opened = _packed(docs.select("_doc", "text")).join(open_, F.col("_doc") == F.col("doc"))
    windows = scratch.save(_windows(opened, size, k))
    seen = scratch.save(windows.groupBy("m", "w").agg(F.min("doc").alias("first"), F.count("*").alias("n")).where("n > 1").select("m", "w", "first"))
    later = windows.join(seen, ["m", "w"]).where("first < doc")
    lists = known.where("gone").select("doc", F.lit(0).alias("kind"), F.col("c").alias("h")).union(later.select("doc", F.lit(1), "w"))
    lists = scratch.save(lists.distinct())
    scratch.drop(pieces)
    starts = first.select(F.lit(0).alias("kind"), F.col("c").alias("h"), F.col("first").alias("doc")).union(seen.select(F.lit(1), "w", "first")).groupBy("kind", "h").agg(F.min("doc").alias("doc"))
    asked = lists.select("kind", "h").distinct().join(starts, ["kind", "h"]).groupBy("doc").agg(F.collect_list(F.struct("kind", "h")).alias("asked"))
    said = scratch.save(_source_digests(_packed(docs.select("_doc", "text")).join(asked, F.col("_doc") == F.col("doc")), size, k))
    gone = lists.join(said, ["kind", "h"]).groupBy("doc").agg(F.collect_list(F.struct("kind", "h", "d1", "d2")).alias("gone"))
    return _cut(_packed(docs).join(gone, F.col("_doc") == F.col("doc"), "left"), size, k)
