"""Importance resampling towards a target corpus, with the features of repeated lines counted once.

Texts are cut at newlines. Lines with the same words are one segment: its features (runs of 1 to 3 words)
are counted once and taken times its occurrences; runs that reach over a line's end are added apart.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.ranks import global_rank
from docloom.llm.scratch import Scratch
from docloom.llm.words import PLAIN_LOWER, slices, text_bytes

#: Longest run of words that is a feature.
ORDER = 3
#: Bytes of segments whose features are worked out at a time.
PIECE = 1 << 20


def _crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c.astype(np.uint32)


class _Crc:
    """CRC-32 of many words at a time, and of their runs from those of the words: appending k bytes is a linear map of the CRC."""

    byte = _crc_table()
    dense: np.ndarray | None = None
    powers: list[np.ndarray] = []

    @classmethod
    def _ready(cls) -> None:
        if cls.dense is None:
            now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * i) for i in range(4)])
            maps = [now]
            for _ in range(64):
                now = (now >> np.uint32(8)) ^ cls.byte[now & 255]
                maps.append(now)
            cls.powers = [maps[64]]
            for _ in range(30):
                cls.powers.append(cls._apply(cls.powers[-1], cls.powers[-1]))
            cls.dense = np.stack(maps[:64]).ravel()

    @staticmethod
    def _apply(m: np.ndarray, c: np.ndarray) -> np.ndarray:
        return m[0][c & 255] ^ m[1][(c >> np.uint32(8)) & 255] ^ m[2][(c >> np.uint32(16)) & 255] ^ m[3][c >> np.uint32(24)]

    @classmethod
    def append(cls, c: np.ndarray, k: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """CRCs of texts with CRC c, each followed by k bytes of CRC tail."""
        cls._ready()
        at = (k & 63) * 1024
        out = cls.dense[at + (c & 255)]
        for i in range(1, 4):
            out = out ^ cls.dense[at + 256 * i + ((c >> np.uint32(8 * i)) & 255)]
        far = np.flatnonzero(k >= 64)
        if len(far):
            rest, part = k[far] >> 6, out[far]
            for m in cls.powers:
                part = np.where(rest & 1, cls._apply(m, part), part)
                rest = rest >> 1
                if not rest.any():
                    break
            out[far] = part
        return out ^ tail

    @classmethod
    def words(cls, b: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The CRC of each word; words of over 64 bytes one by one."""
        out = np.empty(len(starts), np.uint32)
        short = np.minimum(lengths, 65).astype(np.uint8)
        order = np.argsort(255 - short, kind="stable")
        n_long = int(np.count_nonzero(short == 65))
        for i in order[:n_long]:
            out[i] = zlib.crc32(b[starts[i] : starts[i] + lengths[i]].tobytes())
        order = order[n_long:]
        first, left = starts[order], np.searchsorted(-short[order].astype(np.int64), -np.arange(64), side="left")
        c = np.full(len(order), 0xFFFFFFFF, np.uint32)
        for j in range(64):
            n = int(left[j])
            if not n:
                break
            c[:n] = cls.byte[(c[:n] ^ b[first[:n] + j]) & 255] ^ (c[:n] >> np.uint32(8))
        out[order] = ~c
        return out


def segments_of(text: str | None) -> list[bytes]:
    """The words of each line that has any, lower-cased (A-Z) and joined by one space."""
    if not text:
        return []
    lines = text.encode().translate(_LINES).split(b"\n")
    return [s for line in lines if (s := b" ".join(line.split()))]


#: Lower-cases, and turns every separator but the newline into a space.
_LINES = PLAIN_LOWER.table[:10] + b"\n" + PLAIN_LOWER.table[11:]


def _ends(segment: bytes) -> tuple[list[bytes], list[bytes]]:
    """The first and last ORDER-1 words."""
    return segment.split(b" ", ORDER - 1)[: ORDER - 1], segment.rsplit(b" ", ORDER - 1)[-(ORDER - 1) :]


def crossing(segments: list[bytes], ends: dict[bytes, tuple[list[bytes], list[bytes]]]) -> list[bytes]:
    """The runs of 2 to ORDER words that begin in one segment and end in a later one; ``ends`` keeps what was read before."""
    out: list[bytes] = []
    before: list[bytes] = []  # the last words so far
    for s in segments:
        if s not in ends:
            ends[s] = _ends(s)
        head, tail = ends[s]
        for i in range(len(before)):
            for j in range(min(len(head), ORDER - len(before) + i)):
                out.append(b" ".join(before[i:] + head[: j + 1]))
        before = (before + tail)[-(ORDER - 1) :] if len(tail) < ORDER - 1 else tail
    return out


def features(segments: list[bytes], buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(segment number, bucket) of every run of 1 to ORDER words inside a segment."""
    lo = 0
    while lo < len(segments):
        hi, size = lo, 0
        while hi < len(segments) and (hi == lo or size + len(segments[hi]) < PIECE):
            size += len(segments[hi]) + 1
            hi += 1
        b = np.frombuffer(b" ".join(segments[lo:hi]), np.uint8)
        gaps = np.flatnonzero(b == 32)
        starts = np.concatenate(([0], gaps + 1))
        lengths = np.concatenate((gaps, [len(b)])) - starts
        begins = np.cumsum([0] + [len(s) + 1 for s in segments[lo : hi - 1]])
        of = lo + np.searchsorted(begins, starts, side="right") - 1
        one = _Crc.words(b, starts, lengths)
        spaced = _Crc.append(np.full(len(one), zlib.crc32(b" "), np.uint32), lengths, one)
        run = one
        yield of, run % np.uint32(buckets)
        for n in range(1, ORDER):
            run = _Crc.append(run[: len(one) - n], lengths[n:] + 1, spaced[n:])
            inside = of[: len(one) - n] == of[n:]
            yield of[: len(one) - n][inside], run[inside] % np.uint32(buckets)
        lo = hi


def _cut(texts: DataFrame, buckets: int) -> DataFrame:
    """(segment, bucket, n): the distinct segments of a task's batches with their occurrences, and with a null segment the counts of crossing runs by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cross = np.zeros(buckets, np.int64)
        for batch in batches:
            _, offsets = text_bytes(batch.column(0))
            for lo, hi in slices(offsets):
                n: Counter[bytes] = Counter()
                ends: dict = {}
                for text in batch.column(0).slice(lo, hi - lo).to_pylist():
                    segments = segments_of(text)
                    n.update(segments)
                    for x in crossing(segments, ends):
                        cross[zlib.crc32(x) % buckets] += 1
                names = pa.array(list(n), pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([names, pa.nulls(len(n), pa.int32()), pa.array(list(n.values()), pa.int64())], names=["segment", "bucket", "n"])
        some = np.flatnonzero(cross)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(some), pa.string()), pa.array(some, pa.int32()), pa.array(cross[some])], names=["segment", "bucket", "n"])

    return texts.mapInArrow(run, "segment string, bucket int, n long")


def bucket_counts(docs: DataFrame, buckets: int = 10_000, text_col: str = "text") -> DataFrame:
    """(bucket, n): features of all texts by CRC-32 modulo ``buckets``; buckets without any are left out.

    Segments are brought together by their words, after each task has joined its own, so a line that all texts
    share costs a row per task; each distinct one is counted once. A task returns at most a row per bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            names, times = batch.column(0), batch.column(2).to_numpy()
            apart = names.is_null().to_numpy(zero_copy_only=False)
            np.add.at(total, batch.column(1).filter(pa.array(apart)).to_numpy(), times[apart])
            whole = np.flatnonzero(~apart)
            for of, bucket in features([s.encode() for s in names.take(pa.array(whole)).to_pylist()], buckets):
                np.add.at(total, bucket, times[whole][of])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], names=["bucket", "n"])

    distinct = _cut(docs.select(docs[text_col].alias("text")), buckets).groupBy("segment", "bucket").agg(F.sum("n").alias("n"))
    return distinct.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Of each bucket floor(1000 ln of its smoothed share of the target's features over that of the documents'); ``buckets`` numbers on the driver."""
    counted = []
    for table in (docs, target):
        n = [0] * buckets
        for r in bucket_counts(table, buckets).collect():
            n[r.bucket] = r.n
        counted.append(n)
    source, wanted = counted
    all_source, all_wanted = float(sum(source) + buckets), float(sum(wanted) + buckets)
    return [math.floor(1000 * math.log(float(t + 1) * all_source / (float(s + 1) * all_wanted))) for s, t in zip(source, wanted, strict=True)]


def weigh(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of each row; a segment's gains are summed once for the texts that a task reads together."""
    worth, buckets = np.array(gain, np.int64), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets):
                part = batch.slice(lo, hi - lo)
                number: dict[bytes, int] = {}
                ends: dict = {}
                texts, extra = [], []
                for text in part.column(1).to_pylist():
                    segments = segments_of(text)
                    texts.append([number.setdefault(s, len(number)) for s in segments])
                    cross = [zlib.crc32(x) % buckets for x in crossing(segments, ends)]
                    extra.append((len(cross), sum(gain[x] for x in cross)))
                n_runs, sums = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
                n_words = np.array([s.count(b" ") + 1 for s in number], np.int64)
                for of, bucket in features(list(number), buckets):
                    np.add.at(n_runs, of, 1)
                    np.add.at(sums, of, worth[bucket])
                rows = []
                for mine, (n, w) in zip(texts, extra, strict=True):
                    rows.append((int(n_words[mine].sum()), int(n_runs[mine].sum()) + n, int(sums[mine].sum()) + w) if mine else (0, 0, 0))
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, by the first 32 bits of the sha256 of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, buckets: int = 10_000, least_words: int = 20, percent: int = 5, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) of each row of ``docs``.

    Features are all runs of 1 to 3 words (ASCII letters lower-cased), in buckets by CRC-32. A bucket's gain compares
    its share of ``target`` (text) with that of ``docs``; a text's weight is the sum of its features' gains, its score
    that plus Gumbel noise by its id. Of the texts with ``least_words`` words or more the given percentage (rounded
    down) is drawn: highest scores, ties to smaller ids.

    Counts cover all texts. Two scans of the texts; only distinct segments, and four numbers a row for the ranks, are
    shuffled. The gains (one number a bucket) are the only thing on the driver, and go out with the tasks.

    A null or empty text has no words, features or rank, and weight 0. A null id is hashed as an empty one, is last
    among ties, and stays null; rows that repeat an id are separate texts with the same noise, and equal rows share
    ranks in any order. An empty target makes all gains follow the documents alone; an empty table gives an empty
    table; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "resample")
    weighed = weigh(docs, gains(docs, target.select("text"), buckets), id_col, text_col)
    weighed = weighed.withColumn("score", F.col("weight") + _noise(F.col("doc_id"), seed))
    weighed = scratch.save(weighed.withColumn("_short", F.col("n_words") < least_words))
    drawn = weighed.where("not _short").count() * percent // 100
    ranked = global_rank(weighed, [F.col("_short").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], scratch, name="_rank")
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("_rank") < drawn, F.col("_rank") + 1).alias("rank"))
