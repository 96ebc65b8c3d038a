"""Language model: hashed maximum entropy over n-gram and skip features, with a class-factored softmax."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.ranks import with_order_key
from docloom.llm.scratch import Scratch
from docloom.llm.words import SPACED_LOWER, hash_words_and_tails, mix, slices, text_bytes

#: Classes of words and subclasses of each (one softmax of WIDTH outcomes for either), and subclasses of a single frequent word.
WIDTH, SINGLES = 16, 64
CLASSES = WIDTH * WIDTH
#: Hashed weight rows follow the training tokens: a power of two, at least one row for TOKENS_A_ROW tokens, within these bounds (1 and 32 MB).
LEAST_ROWS, MOST_ROWS, TOKENS_A_ROW = 1 << 13, 1 << 18, 2048
#: Words whose exact counts every task gets (the most frequent ones); all others are joined.
FREQUENT = 1 << 16
#: Passes over all training texts; tokens of one update; step size.
ROUNDS, BATCH, STEP = 2, 4096, 0.05
#: Texts whose sums one combining step adds at most.
FAN_IN = 64
#: Tasks of a training round, at most: this many, or one for TOKENS_A_MOVE tokens for each hashed weight row, so that the weights they send follow the input.
LEAST_TASKS, TOKENS_A_MOVE = 16, 128
_BLOCK = 256
_ROW = np.dtype((np.void, 4 * WIDTH))

END = int(mix(np.array([0xE0F], np.uint64))[0])
START = mix(np.array([0x57A, 0x57B], np.uint64))


def held_out_rule(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


@dataclass
class Tokens:
    """Of some texts: hash and tail of each token, and where each text's tokens begin; every text ends with END."""

    h: np.ndarray
    tail: np.ndarray
    at: np.ndarray


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, Tokens]]:
    data, offsets = text_bytes(column)
    for lo, hi in slices(offsets):
        h, at, tail = hash_words_and_tails(data, offsets[lo : hi + 1], SPACED_LOWER)
        yield lo, hi, Tokens(np.insert(h, at[1:], np.uint64(END)), np.insert(tail, at[1:], 0), at + np.arange(len(at)))


def count_tokens(texts: DataFrame) -> DataFrame:
    """h, tail, c: how often each token occurs; each task adds up its own texts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def add() -> None:
            h, tail, n = (np.concatenate(x) for x in zip(*held, strict=True))
            back, u = pd.factorize(h)  # by hashing, far quicker than a sort
            tails = np.empty(len(u), tail.dtype)
            tails[back] = tail  # equal for equal words
            held[:] = [(u, tails, np.bincount(back, weights=n).astype(np.int64))]

        def out() -> pa.RecordBatch:
            h, tail, n = held.pop()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(tail.astype(np.int32)), pa.array(n)], names=["h", "tail", "c"])

        for batch in batches:
            for _, _, t in _tokens(batch.column(0)):
                held.append((t.h, t.tail, np.ones(len(t.h), np.int64)))
                if sum(len(x[0]) for x in held) > 2_000_000:
                    add()
                    if len(held[0][0]) > 1_000_000:
                        yield out()
        if held:
            add()
            yield out()

    return texts.mapInArrow(run, "h long, tail int, c long").groupBy("h").agg(F.first("tail").alias("tail"), F.sum("c").alias("c"))


def class_of(h: np.ndarray, tail: np.ndarray, singles: np.ndarray) -> np.ndarray:
    """Subclass of each token: 0 to SINGLES - 1 for the single words (sorted hashes), else by the word's last byte (class) and last two bytes."""
    last = mix(tail.astype(np.uint64) & np.uint64(255)) % np.uint64(WIDTH - SINGLES // WIDTH)
    other = SINGLES + (last * np.uint64(WIDTH) + mix(tail.astype(np.uint64)) % np.uint64(WIDTH)).astype(np.int64)
    i = np.minimum(np.searchsorted(singles, h), len(singles) - 1)
    return np.where(singles[i] == h, i, other)


def table_rows(n_rows: int) -> int:
    """Rows of the whole table: the classes' hashed rows, the subclasses', one bias for the classes and one for each class's subclasses."""
    return 2 * n_rows + 1 + WIDTH


def weight_rows(tokens: int) -> int:
    n = LEAST_ROWS
    while n < MOST_ROWS and n * TOKENS_A_ROW < tokens:
        n *= 2
    return n


def training_tasks(tokens: int) -> int:
    return max(LEAST_TASKS, tokens // (TOKENS_A_MOVE * weight_rows(tokens)))


def feature_rows(t: Tokens, classes: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weights and outcome of each token's two choices: its class, and its subclass given the class.

    The features are the word before, the word before that (skip), both, both subclasses, and a bias; for
    the second choice each is hashed together with the class. The first axis of the rows is the feature,
    the second the choice.
    """
    n = len(t.h)
    back1, back2 = np.empty(n, np.uint64), np.empty(n, np.uint64)
    c1, c2 = np.full(n, CLASSES, np.int64), np.full(n, CLASSES, np.int64)
    back1[1:], back2[2:] = t.h[:-1], t.h[:-2]
    c1[1:], c2[2:] = classes[:-1], classes[:-2]
    begin = t.at[:-1]
    second = begin[begin + 1 < t.at[1:]] + 1
    back1[begin], back2[begin], back2[second] = START[0], START[1], START[0]
    c1[begin], c2[begin], c2[second] = CLASSES, CLASSES, CLASSES
    two = back1 * np.uint64(0x9E3779B97F4A7C15) + back2 * np.uint64(0xC2B2AE3D27D4EB4F)
    pair = (c1 * 1024 + c2 + (1 << 40)).astype(np.uint64)
    top, sub = classes // WIDTH, classes % WIDTH
    mask, given = np.uint64(n_rows - 1), (top.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    rows = np.empty((5, 2, n), np.int64)
    for i, f in enumerate((back1 + np.uint64(1), back2 + np.uint64(2), two, pair)):
        rows[i, 0] = (mix(f) & mask).astype(np.int64)
        rows[i, 1] = (mix(f + given) & mask).astype(np.int64) + n_rows
    rows[4, 0] = 2 * n_rows
    rows[4, 1] = 2 * n_rows + 1 + top
    return rows, np.stack((top, sub))


def _chances(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Probabilities of the WIDTH outcomes of some choices."""
    x = weights.take(rows[0], axis=0)
    more = np.empty_like(x)
    for r in rows[1:]:
        np.take(weights, r, axis=0, out=more, mode="clip")  # all rows are there; clipping spares a copy
        x += more
    top = x
    while top.shape[1] > 1:  # halves against halves, as a maximum along short rows is slow
        half = top.shape[1] // 2
        top = np.maximum(top[:, :half], top[:, half:])
    x -= top
    np.exp(x, out=x)
    x /= x @ np.ones((WIDTH, 1), np.float32)
    return x


def _update(weights: np.ndarray, squares: np.ndarray, rows: np.ndarray, outcome: np.ndarray) -> None:
    """One gradient step (per-row AdaGrad) on a batch of choices, classes first; the last feature is the bias."""
    slope = _chances(weights, rows)
    slope[np.arange(len(outcome)), outcome] -= 1.0
    for r in rows[:-1]:  # a batch is a sparse matrix of choices by rows; its product with the slopes, row by row
        keyed = np.sort((r << 16) | np.arange(len(r)))  # far quicker than an argsort; batches are shorter than 2**16
        ordered, order = keyed >> 16, keyed & 0xFFFF
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        n = np.diff(np.append(first, len(order)))
        _step(weights, squares, ordered[first], _sums(slope, order, first, n), n)
    half, bias = len(outcome) // 2, rows[-1]  # one row of all classes, and one of the subclasses of each class: sums by a product
    own = outcome[:half] == np.arange(WIDTH)[:, None]
    n = own.sum(1)
    u = bias[0] + 1 + np.flatnonzero(n)
    sums = (own[n > 0].astype(np.float32) @ slope[half:]).astype(np.float32)
    _step(weights, squares, np.append(bias[0], u), np.vstack((slope[:half].sum(0), sums)), np.append(half, n[n > 0]))


def _sums(slope: np.ndarray, order: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sum of the slopes of each run of equal rows; only runs of several choices are added up, two columns at a time."""
    g = slope.take(order[first], axis=0)
    several = n > 1
    if several.any():
        m = n[several]
        run = slope.take(order[np.repeat(several, n)], axis=0).view(np.complex64)
        g[several] = np.add.reduceat(run, np.cumsum(m) - m, axis=0).view(np.float32)
    return g


def _step(weights, squares, u, g, n) -> None:
    n = n.astype(np.float32)
    now = squares.take(u) + np.einsum("ij,ij->i", g, g) / (n * np.float32(WIDTH))
    squares[u] = now
    g *= (np.float32(STEP) / ((np.sqrt(now) + np.float32(1e-3)) * np.sqrt(n)))[:, None]
    moved = weights.take(u, axis=0)
    moved -= g
    weights.view(_ROW)[u, 0] = moved.view(_ROW)[:, 0]  # whole rows, quicker than their numbers


def train_round(texts: DataFrame, weights: np.ndarray, singles: np.ndarray) -> np.ndarray:
    """Every task takes gradient steps over all of its texts; rows are then averaged by how many choices moved them.

    The tasks' moves are added in two rounds by block of rows, so no task or driver gets them all at once,
    and in order of the tasks, so that the sums do not depend on the shuffle.
    """
    now = texts.sparkSession.sparkContext.broadcast(weights)
    total_rows = len(weights)
    n_rows = (total_rows - 1 - WIDTH) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, squares, seen = now.value.copy(), np.zeros(total_rows, np.float32), np.zeros(total_rows, np.float64)
        for batch in batches:
            for _, _, t in _tokens(batch.column(0)):
                rows, outcome = feature_rows(t, class_of(t.h, t.tail, singles), n_rows)
                for lo in range(0, len(t.h), BATCH):
                    some = rows[:, :, lo : lo + BATCH]
                    _update(w, squares, some.reshape(len(some), -1), outcome[:, lo : lo + BATCH].reshape(-1))
                seen += np.bincount(rows.reshape(-1), minlength=total_rows)
        moved = ((w - now.value) * seen[:, None]).astype(np.float32)
        blocks = [i for i in range(0, total_rows, _BLOCK) if seen[i : i + _BLOCK].any()]
        task = TaskContext.get().partitionId()
        for i in blocks:
            packed = zlib.compress(np.column_stack((seen[i : i + _BLOCK], moved[i : i + _BLOCK])).astype(np.float32).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([task // FAN_IN], pa.int32()), pa.array([task], pa.int32()), pa.array([packed], pa.binary())], names=["block", "part", "task", "sums"])

    def add(pdf):
        pdf = pdf.sort_values("task")
        total = sum(np.frombuffer(zlib.decompress(x), np.float32).astype(np.float64) for x in pdf.sums)
        return pdf.iloc[:1].assign(sums=[zlib.compress(total.astype(np.float32).tobytes(), 1)])

    form = "block int, part int, task int, sums binary"
    some = texts.mapInArrow(run, form).groupBy("block", "part").applyInPandas(add, form)
    after = weights.copy()
    for r in some.groupBy("block").applyInPandas(add, form).toLocalIterator():
        x = np.frombuffer(zlib.decompress(r.sums), np.float32).reshape(-1, WIDTH + 1)
        after[r.block : r.block + _BLOCK] += x[:, 1:] / np.maximum(x[:, :1], 1.0)
    return after


def _frequent_from(counts: DataFrame) -> int:
    """The least count, of steps of an eighth of a power of two, that at most FREQUENT tokens reach."""
    steps = counts.groupBy(F.floor(8 * F.log2("c")).cast("int").alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).orderBy(F.desc("step")).collect()  # some hundred rows
    total, least = 0, 1 << 62
    for r in steps:
        total += r.n
        if total > FREQUENT:
            return least
        least = r.least
    return least


@dataclass
class Model:
    """Class weights, single words, log10 of each class's normaliser, and the counts of the most frequent tokens."""

    weights: np.ndarray
    singles: np.ndarray
    log_sizes: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray


def _known(m: Model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of frequent tokens, and which tokens are frequent."""
    i = np.minimum(np.searchsorted(m.hashes, h), len(m.hashes) - 1)
    there = m.hashes[i] == h
    return np.where(there, m.counts[i], 0), there


def _rare(docs: DataFrame, shared) -> DataFrame:
    """doc, h, n: the tokens of each text that aren't among the frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            for lo, hi, t in _tokens(batch.column(1)):
                rest = np.flatnonzero(~_known(shared.value, t.h)[1])
                text, h = np.searchsorted(t.at, rest, side="right") - 1, t.h[rest]
                order = np.lexsort((h, text))
                text, h = text[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi][text[first]]), pa.array(h[first].view(np.int64)), pa.array(n.astype(np.int32))], names=["doc", "h", "n"])

    return docs.select("_doc", "text").mapInArrow(run, "doc long, h long, n int")


def _scored(docs: DataFrame, shared) -> DataFrame:
    """_doc, doc_id, n_tokens, and over a text's tokens: known (frequent ones), logs (of their counts + 1), fit (class part of the score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi, t in _tokens(batch.column(2)):
                classes = class_of(t.h, t.tail, m.singles)
                rows, outcome = feature_rows(t, classes, (len(m.weights) - 1 - WIDTH) // 2)
                fit = np.zeros(len(classes))
                for a in range(0, len(classes), 4096):
                    for choice in (0, 1):
                        own = outcome[choice, a : a + 4096]
                        fit[a : a + 4096] += np.log10(_chances(m.weights, rows[:, choice, a : a + 4096])[np.arange(len(own)), own], dtype=np.float64)
                fit -= m.log_sizes[classes]
                counts, there = _known(m, t.h)
                begin = t.at[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(t.at).astype(np.int64)), pa.array(np.add.reduceat((there & (counts > 0)).astype(np.int64), begin)),
                        pa.array(np.add.reduceat(np.log10(counts + 1.0), begin)), pa.array(np.add.reduceat(fit, begin)),
                    ], names=["_doc", "doc_id", "n_tokens", "known", "logs", "fit"],
                )

    return docs.select("_doc", "doc_id", "text").mapInArrow(run, "_doc long, doc_id long, n_tokens long, known long, logs double, fit double")


def score_texts(docs: DataFrame, rounds: int = ROUNDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 probabilities) for each row of ``docs``.

    Training texts are those whose crc32(doc_id as text) mod 7 is not 2; rows without id train.

    * Counts: all tokens of all training texts, added per task and then by token.
    * Score: log10 of P(class | history) * P(subclass | class, history) * (count + 1) / (tokens + words + 1 of the
      subclass). The most frequent words are subclasses of their own, the others share one by their last two
      bytes. Both factors are softmaxes over hashed weights of the two words before, each alone, both, and
      their subclasses, trained by ``rounds`` passes of gradient steps over all training texts; after each
      pass the tasks' weights are averaged. A task takes more texts where the weights it sends would outgrow them. The rows of the weights grow with the training tokens up to
      MOST_ROWS; a word within its subclass is told by counts alone.
    * Counts of the FREQUENT commonest tokens go to every task; the other tokens of each text are joined with
      the counts by hash (64 bits) and summed per text, so no vocabulary is held in one place.

    A null or empty text is one token, its end. Without training texts all counts are 0. Repeated rows and
    ids are scored one by one; an empty table gives an empty table; other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "maxent")
    docs = with_order_key(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), scratch)
    train = docs.where(~held_out_rule(F.col("doc_id"))).select("text")
    counts = scratch.save(count_tokens(train))
    top = counts.where(F.col("c") >= _frequent_from(counts)).select("h", "c").toPandas().sort_values(["c", "h"], ascending=[False, True])  # FREQUENT rows at most
    hashes, c = top.h.to_numpy(np.int64).view(np.uint64), top.c.to_numpy(np.int64)
    singles = np.sort(np.append(hashes[hashes != np.uint64(END)][: SINGLES - 1], np.uint64(END)))
    order = np.argsort(hashes)
    hashes, c = (hashes[order], c[order]) if len(hashes) else (np.array([END], np.uint64), np.zeros(1, np.int64))

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = np.zeros(CLASSES), np.zeros(CLASSES)
        for batch in batches:
            k = class_of(batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), singles)
            n += np.bincount(k, weights=batch.column(2).to_numpy(), minlength=CLASSES)
            v += np.bincount(k, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(range(CLASSES), pa.int32()), pa.array(n.astype(np.int64)), pa.array(v.astype(np.int64))], names=["k", "n", "v"])

    sizes = {r.k: (r.n, r.v) for r in counts.mapInArrow(by_class, "k int, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    n, v = sum(x for x, _ in sizes.values()), sum(x for _, x in sizes.values())
    log_sizes = np.log10([float(sum(sizes.get(k, (0, 0)))) + 1.0 for k in range(CLASSES)])
    weights = np.zeros((table_rows(weight_rows(int(n))), WIDTH), np.float32)
    for _ in range(rounds):
        weights = train_round(train.coalesce(training_tasks(int(n))), weights, singles)
    shared = spark.sparkContext.broadcast(Model(weights, singles, log_sizes, hashes, c))

    rare = _rare(docs, shared).join(counts.select("h", "c"), "h")
    rare = rare.groupBy("doc").agg(F.sum("n").alias("more_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    all_ = _scored(docs, shared).join(rare, F.col("_doc") == F.col("doc"), "left")
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return all_.select(
        "doc_id", held_out_rule(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.log10(F.lit(float(n + v + 1)))).alias("base_score"), (logs + F.col("fit")).alias("score"),
    )
