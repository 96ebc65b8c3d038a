"""Quality rules: whole-text statistics, and robust multivariate outliers among the texts that pass the base rules.

Per language and source the location and scatter of the transformed statistics are the minimum covariance
determinant: the mean and covariance of that share of the texts whose covariance has the least determinant,
found by concentration steps over all texts. Texts far from it by Mahalanobis distance are rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.scratch import Scratch
from docloom.llm.words import SPACED, hash_words, mix, shingles, slices, text_bytes

#: The transformed statistics, in the order of the vector.
DIMENSIONS = ("word length", "symbols", "repeated lines", "repeated words", "capitals", "other signs")
D = len(DIMENSIONS)
#: Vectors lie on a grid of 1/GRID, so that their sums are exact and do not depend on the order of rows.
GRID = 1024
#: Least spread of each dimension (added in squares): statistics that are constant for most texts have none of their own,
#: and one repeated line of a short text, a title that is also its last line, is no outlier.
FLOORS = (0.08, 0.04, 0.16, 0.12, 0.05, 0.05)
#: Share of a group's texts that an estimate is taken from, concentration steps, and groups of fewer texts are pooled.
SHARE, STEPS, LEAST_ROWS = 0.75, 12, 60
#: A clean text is rejected with this probability where the statistics are normal.
LEVEL = 1e-6
#: Estimates that may be broadcast (about 500 bytes each); more are joined by shuffle.
BROADCAST_GROUPS = 100_000
#: Distances are compared by their bin: so many bins for a factor of two.
BINS = 64

_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"#*$%&|<>")] = True
_OTHER = np.zeros(256, bool)
_OTHER[[b for b in range(33, 127) if not chr(b).isalnum() and not _SIGNS[b]]] = True
_SMALL, _CAPITAL = np.zeros(256, bool), np.zeros(256, bool)
_SMALL[97:123] = _CAPITAL[65:91] = True
_TAIL = np.zeros(256, bool)
_TAIL[0x80:0xC0] = True

_STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def chi2_tail(x: float, d: int) -> float:
    """P(chi-squared with an even number d of degrees > x)."""
    term = total = 1.0
    for k in range(1, d // 2):
        term *= x / 2 / k
        total += term
    return math.exp(-x / 2) * total


def chi2_point(tail: float, d: int) -> float:
    """The x that chi-squared exceeds with probability ``tail``."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_tail(mid, d) > tail else (lo, mid)
    return hi


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the flags are set in each of the spans between ``at``."""
    return np.diff(np.concatenate(([0], np.cumsum(flags)))[at])


def _repeated_words(h: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Per text the words that lie in windows of ``size`` words found twice or more in it."""
    texts = len(at) - 1
    text = np.repeat(np.arange(texts), np.diff(at))
    if len(h) < size:
        return np.zeros(texts, np.int64)
    inside = np.flatnonzero(text[: len(h) - size + 1] == text[size - 1 :])
    keys = shingles(h, size)[inside] ^ mix(text[inside].astype(np.uint64) + np.uint64(1))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(len(h) + 1, np.int64)
    change[inside[twice]] += 1
    np.add.at(change, inside[twice] + size, -1)
    return _sums(np.cumsum(change[:-1]) > 0, at)


def _repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that equal an earlier line, and lines with a word."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines)), len(lines)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, lang, source, the five base statistics and the transformed vector z (null without words) of each row.

    Nothing is shuffled and texts are read whole. z holds the logarithm of the mean word length, and square
    roots of shares (which evens out the spread of counts): symbols per character, repeated lines, repeated
    words, capitals among ASCII letters, and other ASCII signs per character.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(3))
            for lo, hi in slices(offsets):
                base = int(offsets[lo])
                b, at = data[base : int(offsets[hi])], offsets[lo : hi + 1] - base
                h, words_at = hash_words(data, offsets[lo : hi + 1], SPACED)
                n = np.diff(words_at)
                chars = _sums(SPACED.is_word[b] & ~_TAIL[b], at)
                symbols, other, capitals, small = (_sums(mark[b], at) for mark in (_SIGNS, _OTHER, _CAPITAL, _SMALL))
                repeats = _repeated_words(h, words_at, 3)
                whole = b.tobytes()
                lines = np.array([_repeated_lines(whole[at[i] : at[i + 1]]) for i in range(hi - lo)], np.int64).reshape(-1, 2)
                share = lambda x, of: np.sqrt(x / np.maximum(of, 1))
                z = np.column_stack([np.log(np.maximum(chars, 1) / np.maximum(n, 1)), share(symbols, chars), share(lines[:, 0], lines[:, 1]), share(repeats, n), share(capitals, capitals + small), share(other, chars)])
                z = np.rint(z * GRID) / GRID
                flat = pa.array(z.ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo + 1) * D, D), pa.int32()), flat, mask=pa.array(n == 0))
                part = batch.slice(lo, hi - lo)
                counts = [pa.array(x.astype(np.int64)) for x in (n, chars, symbols, lines[:, 0], repeats)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *counts, lists], names=["doc_id", "lang", "source", *_STATISTICS, "z"])

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _STATISTICS) + ", z array<double>"
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[lang_col].cast("string").alias("lang"), docs[source_col].cast("string").alias("source"), docs[text_col].alias("text")).mapInArrow(run, schema)


def _grouped(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(lang, source, g, n): the group of each language and source and its own rows. Small sources of a language go together, then small languages."""
    n = scratch.save(rows.groupBy("lang", "source").agg(F.count("*").alias("n")))
    own = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    n = n.withColumn("g", F.when(F.col("n") >= LEAST_ROWS, own).otherwise(F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})))
    return scratch.save(n.withColumn("g", F.when(F.sum("n").over(Window.partitionBy("g")) >= LEAST_ROWS, F.col("g")).otherwise("{}")))


def _side(table: DataFrame, groups: int) -> DataFrame:
    """A table of a few rows a group as the small side of a join."""
    return F.broadcast(table) if groups <= BROADCAST_GROUPS else table


def _distance(z: Column, center: Column, whiten: Column) -> Column:
    """Squared Mahalanobis distance; ``whiten`` is the lower triangle of the inverse Cholesky factor, row by row."""
    total = F.lit(0.0)
    for i in range(D):
        row = F.lit(0.0)
        for j in range(i + 1):
            row = row + whiten[i * (i + 1) // 2 + j] * (z[j] - center[j])
        total = total + row * row
    return total


def _bin(d2: Column) -> Column:
    return F.floor(F.log2(d2 + F.lit(2.0**-20)) * BINS).cast("int")


def _moments(z: Column) -> list[Column]:
    return [F.sum(z[i]).alias(f"s{i}") for i in range(D)] + [F.sum(z[i] * z[j]).alias(f"p{i}_{j}") for i in range(D) for j in range(i + 1)]


def _estimates(sums: DataFrame, factor: float) -> DataFrame:
    """(g, start, center, whiten, logdet) of each row of sums (columns of _moments and n), the covariance taken times ``factor``; a row is worked out in whichever task has it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                n = r.n
                m = np.array([getattr(r, f"s{i}") for i in range(D)]) / n
                c = np.zeros((D, D))
                for i in range(D):
                    for j in range(i + 1):
                        c[i, j] = c[j, i] = factor * (getattr(r, f"p{i}_{j}") / n - m[i] * m[j])
                c += np.diag(np.square(FLOORS))
                lower = np.linalg.cholesky(c)
                w = np.linalg.inv(lower)
                out.append((r.g, r.start, m.tolist(), [float(w[i, j]) for i in range(D) for j in range(i + 1)], float(2 * np.log(np.diag(lower)).sum())))
            yield pd.DataFrame(out, columns=["g", "start", "center", "whiten", "logdet"])

    return sums.mapInPandas(run, "g string, start int, center array<double>, whiten array<double>, logdet double")


def _starts(rows: DataFrame) -> DataFrame:
    """Two starts of each group: all its texts, and its median with a diagonal scatter by the quartiles."""
    every = _estimates(rows.groupBy("g").agg(F.lit(0).alias("start"), F.count("*").alias("n"), *_moments(F.col("z"))), 1.0)
    values = rows.select("g", F.posexplode("z").alias("dim", "x")).groupBy("g", "dim", "x").agg(F.count("*").alias("n"))
    w = Window.partitionBy("g", "dim")
    values = values.withColumn("upto", F.sum("n").over(w.orderBy("x"))).withColumn("of", F.sum("n").over(w))
    point = lambda share: F.min(F.when(F.col("upto") >= F.ceil(F.col("of") * share), F.col("x")))
    middle = values.groupBy("g", "dim").agg(point(0.5).alias("m"), (point(0.75) - point(0.25)).alias("range"))
    floor = F.array(*(F.lit(float(x)) for x in FLOORS))[F.col("dim")]
    middle = middle.select("g", "dim", "m", F.sqrt(F.pow(F.col("range") / 1.349, 2) + floor * floor).alias("sd"))
    wide = middle.groupBy("g").agg(*(F.max(F.when(F.col("dim") == i, F.col(c))).alias(f"{c}{i}") for i in range(D) for c in ("m", "sd")))
    diagonal = [1 / F.col(f"sd{i}") if i == j else F.lit(0.0) for i in range(D) for j in range(i + 1)]
    robust = wide.select(
        "g", F.lit(1).alias("start"), F.array(*(F.col(f"m{i}") for i in range(D))).alias("center"), F.array(*diagonal).alias("whiten"), sum((2 * F.log(F.col(f"sd{i}")) for i in range(D)), F.lit(0.0)).alias("logdet")
    )
    return every.union(robust)


def _concentrated(rows: DataFrame, now: DataFrame, factor: float, groups: int) -> DataFrame:
    """Each estimate taken again from the SHARE of its group's texts that are nearest to it.

    The share is cut between bins of distances, whose counts are added up before the shuffle; all texts
    of the last bin are in.
    """
    far = rows.join(_side(now, groups), "g").select("g", "start", "z", _bin(_distance(F.col("z"), F.col("center"), F.col("whiten"))).alias("bin"))
    bins = far.groupBy("g", "start", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("g", "start")
    bins = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("of", F.sum("n").over(w))
    cut = bins.where(F.col("upto") >= F.ceil(F.col("of") * SHARE)).groupBy("g", "start").agg(F.min("bin").alias("cut"))
    near = far.join(_side(cut, groups), ["g", "start"]).where("bin <= cut")
    return _estimates(near.groupBy("g", "start").agg(F.count("*").alias("n"), *_moments(F.col("z"))), factor)


def robust_estimates(rows: DataFrame, scratch: Scratch, groups: int) -> DataFrame:
    """(g, center, whiten) for each group of ``rows`` (g, z): the reweighted minimum covariance determinant.

    Every step reads all rows; what is kept between steps is a row per group and start. The number of steps is
    fixed, so the rows read grow with the table and not with how soon its groups settle. Of the two starts the
    one with the smaller determinant stands. The covariance is scaled for normal statistics, and once
    more estimated from all texts within the 97.5 % distance.
    """
    at = chi2_point(1 - SHARE, D)
    factor = SHARE / (1 - chi2_tail(at, D + 2))
    now = scratch.save(_starts(rows))
    for _ in range(STEPS):
        after = scratch.save(_concentrated(rows, now, factor, groups))
        scratch.drop(now)
        now = after
    best = now.groupBy("g").agg(F.min_by(F.struct("center", "whiten"), F.struct("logdet", "start")).alias("b")).select("g", "b.*")
    near = rows.join(_side(best, groups), "g").where(_distance(F.col("z"), F.col("center"), F.col("whiten")) <= chi2_point(0.025, D))
    again = near.groupBy("g").agg(F.lit(0).alias("start"), F.count("*").alias("n"), *_moments(F.col("z")))
    return scratch.save(_estimates(again, 1.0).select("g", "center", "whiten"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance2, group of each row.

    A row fails the base rules with fewer than 50 words, or with more than half of its words in repeated
    3-word windows. Of the others, those are rejected whose vector lies outside the distance that clean texts
    of the group exceed with probability LEVEL. Estimates use all rows that pass the base rules, per language
    and source; sources of fewer than LEAST_ROWS such rows are pooled per language, then over languages, and a
    last pool smaller than that rejects none. distance2 and group are null for rows that fail the base rules.

    The table of statistics (100 bytes a row) is written once; the steps read it, and shuffle a row per group
    and task. Null languages and sources are values of their own. A null or empty text has no words and fails.
    Ids may be null or repeat: each row is judged by itself. An empty table gives an empty table; other columns
    are not read.
    """
    scratch = Scratch(docs.sparkSession, "robust")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = scratch.save(statistics(docs, id_col, text_col, lang_col, source_col).withColumn("base_failed", failed))
    passed = rows.where("not base_failed")
    named = _grouped(passed, scratch)
    groups = named.count()
    same = F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source"))
    sized = named.withColumn("of", F.sum("n").over(Window.partitionBy("g"))).where(F.col("of") >= LEAST_ROWS)
    sized = sized.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "g")
    vectors = scratch.save(passed.select("lang", "source", "z").join(_side(sized, groups), same).select("g", "z"))
    found = robust_estimates(vectors, scratch, groups)
    named = scratch.save(named.join(found, "g", "left").select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), "g", "center", "whiten"))
    judged = rows.join(_side(named, groups), same & ~F.col("base_failed"), "left")
    d2 = F.when(~F.col("base_failed"), _distance(F.col("z"), F.col("center"), F.col("whiten")))
    cut = chi2_point(LEVEL, D)
    return judged.select("doc_id", *_STATISTICS, "base_failed", (~F.col("base_failed") & ~F.coalesce(d2 > cut, F.lit(False))).alias("kept"), d2.alias("distance2"), F.col("g").alias("group"))
