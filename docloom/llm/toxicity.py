"""Toxicity: a learned lexicon as a trie, met with Levenshtein automata; hits are scored in their context."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.scratch import Scratch
from docloom.llm.words import PLAIN_LOWER

#: Labelled rows that the lexicon and the classifier are fitted on, at most; those with the smallest hash of their id.
TRAIN_ROWS = 8_000
#: Terms of the lexicon, at most, and lengths (in characters) of its stems; a stem ends in "*".
TERMS, STEMS = 400, (4, 5, 6, 7)
#: Words around a hit that may mark it as reported speech.
WINDOW = 6
#: Words that report what another one says.
REPORTING = frozenset("said says say quote quoted quotes wrote writes called calls word words term dit écrit mot appelle sagte sagt schrieb wort zitat dijo dice escribió palabra llama".split())
_TOKEN = re.compile("[\"“”«»„]|[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F“”«»„]+")
FEATURES = 7


def train_rule(doc_id) -> F.Column:
    """Rows whose labels may be learned."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def _words(text: str | None) -> list[str]:
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN_LOWER.table).decode("utf-8", "replace").split(" ")


def _terms(text: str | None) -> set[str]:
    words = set(_words(text))
    words.discard("")
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) >= n}


@dataclass
class Lexicon:
    """Weights of terms (and stems), terms that are also met one edit off, and words that only look like one."""

    weight: dict[str, float]
    fuzzy: frozenset[str]
    innocent: frozenset[str] = frozenset()
    _arcs: list[dict[str, int]] = field(default_factory=list)
    _ends: dict[int, str] = field(default_factory=dict)
    _steps: dict = field(default_factory=dict)
    _seen: dict = field(default_factory=dict)

    def __getstate__(self):
        return {"weight": self.weight, "fuzzy": self.fuzzy, "innocent": self.innocent}

    def __setstate__(self, state):
        self.__init__(**state)

    def _trie(self) -> None:
        self._arcs = [{}]
        for term in sorted(self.fuzzy):
            at = 0
            for c in term:
                if c not in self._arcs[at]:
                    self._arcs[at][c] = len(self._arcs)
                    self._arcs.append({})
                at = self._arcs[at][c]
            self._ends[at] = term
        self._start = self._spread({(0, 0)})

    def _spread(self, states: set) -> frozenset:
        """With the terms' letters that the word may have left out."""
        more = {(child, 1) for node, e in states if e == 0 for child in self._arcs[node].values()}
        return frozenset(states | more)

    def _step(self, states: frozenset, c: str) -> frozenset:
        """One letter of the word through the product of the trie and the automaton of one edit."""
        after = set()
        for node, e in states:
            child = self._arcs[node].get(c)
            if child is not None:
                after.add((child, e))
            if e == 0:
                after.add((node, 1))  # a letter too many
                after.update((other, 1) for other in self._arcs[node].values())  # another letter
        return self._spread(after)

    def near(self, word: str) -> str | None:
        """The term one edit from the word, by the lazily built deterministic product automaton."""
        if not self._arcs:
            self._trie()
        states = self._start
        for c in word:
            key = (states, c)
            after = self._steps.get(key)
            if after is None:
                if len(self._steps) > 200_000:
                    self._steps.clear()
                after = self._steps[key] = self._step(states, c)
            states = after
            if not states:
                return None
        found = [self._ends[node] for node, _ in states if node in self._ends]
        return min(found) if found else None

    def match(self, word: str) -> tuple[float, bool] | None:
        """Weight of a word, and whether it is misspelled; None for nearly all words."""
        if word in self._seen:
            return self._seen[word]
        known = [self.weight[t] for t in (word, *(word[:n] + "*" for n in STEMS if len(word) >= n)) if t in self.weight]
        got = (max(known), False) if known else None
        if got is None and self.fuzzy and len(word) >= 4 and word not in self.innocent and (term := self.near(word)):
            got = (0.8 * self.weight[term], True)
        if len(self._seen) > 500_000:
            self._seen.clear()
        self._seen[word] = got
        return got

    def features(self, text: str | None) -> list[float]:
        """Of a whole text: distinct hits, hits a 100 words, strongest and summed weight, all outside quotations; quoted hits; misspelled hits."""
        words = _words(text)
        hits = {w: m for w in set(words) if w and (m := self.match(w))}
        if not hits:
            return [0.0] * FEATURES
        open_, quoted, inside, tokens = [], 0, False, _TOKEN.findall((text or "").translate(_FOLD))
        plain: list[str] = []
        for token in tokens:
            if token in "\"“”«»„":
                inside = token in "“«„" or (token == '"' and not inside)
                continue
            plain.append(token)
            if token in hits:
                if inside or REPORTING.intersection(plain[-1 - WINDOW : -1]):
                    quoted += 1
                else:
                    open_.append(token)
        distinct = set(open_)
        weights = [hits[w][0] for w in distinct]
        n = max(1, len(plain))
        return [
            math.log1p(len(distinct)), math.log1p(100 * len(open_) / n), max(weights, default=0.0), math.log1p(sum(weights)),
            math.log1p(100 * len(distinct) / n), math.log1p(quoted), math.log1p(sum(hits[w][1] for w in distinct)),
        ]


_FOLD = {c: c + 32 for c in range(65, 91)}


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        x = (features - self.mean) / self.scale
        return 1.0 / (1.0 + np.exp(-np.clip(x @ self.beta[1:] + self.beta[0], -30, 30)))


def _counted(train: DataFrame, toxic: int, wanted: frozenset[str] | None) -> DataFrame:
    """term, n: texts of one label with the term; each task sends its sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                terms = _terms(text)
                counts.update(terms if wanted is None else terms & wanted)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["term", "n"])

    return train.where(F.col("toxic") == toxic).select("text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicon(train: DataFrame, n0: int, n1: int) -> Lexicon:
    """Terms whose share among toxic texts stands out, with their log odds ratio as weight."""
    least = max(2, math.ceil(0.01 * n1))
    df1 = {r.term: r.n for r in _counted(train, 1, None).where(F.col("n") >= least).toLocalIterator()}  # terms of 1 % of the toxic rows: bounded by their length
    df0 = {r.term: r.n for r in _counted(train, 0, frozenset(df1)).toLocalIterator()}
    rated = []
    for term, a in df1.items():
        b = df0.get(term, 0)
        odds = math.log((a + 0.5) / (n1 - a + 0.5)) - math.log((b + 0.5) / (n0 - b + 0.5))
        error = math.sqrt(1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5))
        if odds >= 1.5 and odds / error >= 3.0:
            rated.append((odds / error, term, odds))
    weight = {t: w for _, t, w in sorted(rated, reverse=True)[:TERMS]}
    fuzzy = frozenset(t for t in weight if len(t) >= 4 and t[-1] != "*" and not df0.get(t) and df1[t] >= max(3, 0.03 * n1))
    lexicon = Lexicon(weight, fuzzy)

    def strangers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(w for w in set(_words(text)) if len(w) >= 4 and (m := lexicon.match(w)) and m[1])
        yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["word"])

    if fuzzy:
        rows = train.where("toxic = 0").select("text").mapInArrow(strangers, "word string").distinct().toLocalIterator()
        lexicon = Lexicon(weight, fuzzy, frozenset(r.word for r in rows))
    return lexicon


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale == 0] = 1.0
    z = np.column_stack((np.ones(len(x)), (x - mean) / scale))
    beta, keep = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, beta


def learn(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    """Lexicon and classifier from at most TRAIN_ROWS labelled rows of the training part."""
    ids = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & train_rule(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    texts = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # one text of an id that repeats
    train = scratch.save(texts.select("text", "toxic").repartition(12))
    n = {r.toxic: r["count"] for r in train.groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    lexicon = learn_lexicon(train, n0, n1) if n0 and n1 else Lexicon({}, frozenset())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([lexicon.features(t) for t in batch.column(0).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([x, batch.column(1).cast(pa.float64())], names=["x", "y"])

    rows = train.mapInArrow(run, "x array<double>, y double").collect()  # TRAIN_ROWS short rows at most
    if not rows or not n0 or not n1:
        prior = (n1 + 0.5) / (n0 + n1 + 10)
        return Model(lexicon, np.zeros(FEATURES), np.ones(FEATURES), np.array([math.log(prior / (1 - prior)), *[0.0] * FEATURES]))
    return Model(lexicon, *_fit(np.array([r.x for r in rows]), np.array([r.y for r in rows])))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and hits (distinct lexicon words outside quotations) for each row of ``docs``.

    Labels are learned from rows whose crc32(doc_id as text) mod 5 is not 0, at most TRAIN_ROWS of them.
    The lexicon's plain terms form a trie; words one edit off are found by the product of the trie and a
    Levenshtein automaton, unless the word occurs in texts labelled clean. Quoted or reported hits are
    counted apart, so that quoting is told from abuse. Every text is scored whole, by one pass without a shuffle.

    A null or empty text has no hits and the score of such texts; a null id is not held out; repeated
    rows give repeated results; without labels of both kinds the score is a constant below 0.5; an empty
    table gives an empty table; other columns are not read.
    """
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    shared = _shared_model(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                x, score = _rated(shared.value, part.column(2))
                hits = np.rint(np.expm1(x[:, 0])).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(hits)], names=["doc_id", "held_out", "score", "predicted", "hits"]
                )

    held_out = F.coalesce(~train_rule(F.col("doc_id")), F.lit(False))
    return docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, hits int")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose own text has a score below 0.5.

    The model is that of score_toxicity. Each row is judged by its text alone, so ids that are null or
    repeat take no other row with them. A null or empty text is clean; an empty table stays empty.
    """
    at = docs.columns.index(text_col)
    shared = _shared_model(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                yield part.filter(pa.array(_rated(shared.value, part.column(at))[1] < 0.5))

    return docs.mapInArrow(run, docs.schema)


def _shared_model(docs: DataFrame, labels: DataFrame):
    spark: SparkSession = docs.sparkSession
    return spark.sparkContext.broadcast(learn(docs, labels.select("doc_id", "toxic"), Scratch(spark, "toxicity")))  # bounded by TERMS


def _rated(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features and scores of some texts."""
    x = np.array([model.lexicon.features(t) for t in texts.to_pylist()]).reshape(-1, FEATURES)
    return x, model.scores(x)
