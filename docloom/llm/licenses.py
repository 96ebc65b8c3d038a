"""Licence scan: Aho-Corasick over whole texts, and a shunting-yard reading of licence expressions."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docloom.llm.words import PLAIN_LOWER

# The phrases that the base columns count, with their labels.
BASE_PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
# Notice phrases of the method: phrase, label, how sure a single hit makes us.
NOTICE_PHRASES = {
    "cc by": ("cc-by", 0.8),
    "general public license": ("gpl", 0.9),
    "all rights reserved": ("reserved", 0.7),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "creative commons": ("creative-commons", 0.8),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "apache license": ("apache", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "mit license": ("mit", 0.9),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "bsd license": ("bsd", 0.8),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "public domain": ("public-domain", 0.6),
    "copyright": ("copyright", 0.3),
}
# Identifier tags: what follows on the line is a licence expression.
TAGS = ("spdx-license-identifier:", "license-expression:", "license:", "licence:")
TAG_LABELS = {
    "mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "mpl": "mpl", "bsd": "bsd",
    "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "cc-by": "cc-by", "cc0": "public-domain", "unlicense": "public-domain",
}
#: 0 free of duties, 1 permissive, 2 weak copyleft, 3 copyleft, 4 restricted.
DUTY = {"public-domain": 0, "mit": 1, "apache": 1, "bsd": 1, "cc-by": 1, "mpl": 2, "lgpl": 2, "cc-by-sa": 3, "gpl": 3, "agpl": 3, "cc-by-nc": 4, "cc-by-nd": 4, "reserved": 4}

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("base_labels", T.StringType()),
    T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("expressions", T.ArrayType(T.StringType())),
    T.StructField("duty", T.IntegerType()),
])

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"\(|\)|[A-Za-z0-9.+:-]+")


def to_postfix(text: str) -> list[str] | None:
    """Shunting-yard: operands and operators of a licence expression in postfix order; None if it isn't one.

    Reading stops before the first token that cannot go on, so prose behind an identifier is left alone.
    """
    out, ops, operand_next, depth = [], [], True, 0
    for token in _TOKEN.findall(text):
        low = token.lower()
        if operand_next:
            if token == "(":
                ops.append(token)
                depth += 1
            elif token == ")" or low in _PRECEDENCE:
                return None
            else:
                out.append(low.rstrip(".:"))
                operand_next = False
        elif token == ")":
            if not depth:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            depth -= 1
        elif low in _PRECEDENCE:
            while ops and ops[-1] != "(" and _PRECEDENCE[ops[-1]] >= _PRECEDENCE[low]:
                out.append(ops.pop())
            ops.append(low)
            operand_next = True
        else:
            break
    if operand_next or depth:
        return None
    return out + ops[::-1]


def label_of(identifier: str) -> str | None:
    """The label of an identifier: the longest known name that it starts with."""
    names = [n for n in TAG_LABELS if identifier == n or re.match(re.escape(n) + r"[-+.\d]", identifier)]
    return TAG_LABELS[max(names, key=len)] if names else None


def evaluate(postfix: list[str]) -> tuple[frozenset[str], int]:
    """Labels named, and the duty left to the user: ``and`` binds to both, ``or`` lets choose, ``with`` lightens copyleft."""
    stack: list[tuple[frozenset[str], int]] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            label = label_of(token)
            stack.append((frozenset([label] if label else []), DUTY.get(label, 1)))
            continue
        (b, y), (a, x) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((a, x - 1 if x in (2, 3) else x))
        else:
            stack.append((a | b, max(x, y) if token == "and" else min(x, y)))
    return stack[0]


@functools.cache
def _automata():
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for p in {**BASE_PHRASES, **NOTICE_PHRASES}:
        phrases.add_word(f" {p} ", p)
    for t in TAGS:
        tags.add_word(t, t)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan_text(text: str | None) -> tuple:
    """All columns but doc_id of one text."""
    phrases, tags = _automata()
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.translate(PLAIN_LOWER.table).split()
    line = " " + b" ".join(words).decode("latin-1") + " "  # one character a byte: only positions and ASCII phrases count
    n_base, first, last, base, labels, doubt = 0, None, None, set(), set(), 1.0
    seen, at, duty, found = 0, 0, None, []
    for end, phrase in phrases.iter(line):
        start = end - len(phrase) - 1  # of the space before the phrase
        if phrase in BASE_PHRASES:
            if start >= at:
                seen += line.count(" ", at, start)
                at = start
                place = seen
            else:
                place = line.count(" ", 0, start)
            n_base += 1
            first = place if first is None else min(first, place)
            last = place if last is None else max(last, place)
            base.add(BASE_PHRASES[phrase])
        label, sure = NOTICE_PHRASES[phrase]
        labels.add(label)
        doubt *= 1 - sure
        if label in DUTY:
            duty = max(duty or 0, DUTY[label])
    low = raw.translate(_LOWER).decode("latin-1")
    read_to = -1
    marks = list(tags.iter(low))
    for i, (end, _) in enumerate(marks):
        if end <= read_to:
            continue
        upto = next((e - len(t) + 1 for e, t in marks[i + 1 : i + 1 + len(TAGS)] if e > end), len(raw))  # a line with many tags is read once
        stop = raw.find(b"\n", end, max(upto, end + 1))
        rest = raw[end + 1 : stop if stop >= 0 else max(upto, end + 1)].decode("utf-8", "replace")
        read_to = end
        postfix = to_postfix(rest)
        if postfix is None:
            continue
        named, duty_here = evaluate(postfix)
        if named:
            labels |= named
            found.append(" ".join(postfix))
            doubt *= 0.02
            duty = max(duty or 0, duty_here)
    score = 1.0 - doubt
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels | base)), score, found, duty


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: words, base phrases, labels, expressions (postfix) and a score.

    Nothing is shuffled: each task scans its own rows. A null or empty text has 0 words, no place,
    empty label strings and score 0; a null id stays null; repeated rows give repeated results; an
    empty table gives an empty table; other columns of ``docs`` are not read. Overlapping places
    count each. The base labels are always among the labels.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows = [scan_text(t) for t in part.column(1).to_pylist()]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.int32()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=SCHEMA.names)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
