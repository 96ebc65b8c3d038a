"""Periodic runs of words, found on a run-length grammar that recompression builds.

A text's words are rewritten level by level: equal neighbours become one block, then neighbouring
symbols of two classes become pairs, and so on until one symbol is left. Equal stretches are
rewritten alike but for their ends, so how far two places of a text agree is read off the levels, one
step each on the way up and one on the way down.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docloom.llm.words import BASE, SPACED, hash_words, mix, slices, text_bytes

#: What keeps the names of blocks and of both parts of pairs apart.
_BLOCK, _LEFT, _RIGHT = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
#: Grid candidates that are compared at a time.
CANDIDATES = 1 << 18

SCHEMA = (
    "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, "
    "strongest struct<start: long, length: long, period: long>, collapsed string"
)


@dataclass
class Level:
    """Symbols in order; the symbol of the next level that each is part of; where each of those begins (and the end)."""

    symbols: np.ndarray
    up: np.ndarray
    first: np.ndarray
    blocks: bool

    def mirrored(self) -> Level:
        return Level(self.symbols[::-1], len(self.first) - 2 - self.up[::-1], len(self.symbols) - self.first[::-1], self.blocks)


def _pairs(symbols: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """Which symbols form a pair with their right neighbour: left and right classes are the values of one bit, that which makes most pairs."""
    h, free, best = mix(symbols), ~fixed, None
    both = free[:-1] & free[1:]
    for bit in range(4):
        one = (h >> np.uint64(bit)) & np.uint64(1) == 1
        for left in (one, ~one):
            joined = both & left[:-1] & ~left[1:]
            if best is None or np.count_nonzero(joined) > np.count_nonzero(best):
                best = joined
    return best


def grammar(symbols: np.ndarray, fixed: np.ndarray) -> list[Level]:
    """Levels of a sequence in which the fixed symbols, each unlike all others, are never joined with a neighbour.

    Symbols are named by 64-bit hashes of what they stand for.
    """
    levels, turn = [], 0
    while np.any(~fixed[:-1] & ~fixed[1:]):
        for blocks in (True, False):
            begins = np.ones(len(symbols), bool)
            if blocks:
                begins[1:] = symbols[1:] != symbols[:-1]
            else:
                begins[1:] = ~_pairs(symbols ^ np.uint64(turn), fixed)
            first = np.append(np.flatnonzero(begins), len(symbols))
            levels.append(Level(symbols, np.cumsum(begins) - 1, first, blocks))
            width, now = np.diff(first), symbols[first[:-1]]
            if blocks:
                made = mix(mix(now ^ _BLOCK) + width.astype(np.uint64) * np.uint64(BASE))
            else:
                made = mix(mix(now ^ _LEFT) * np.uint64(BASE) + mix(symbols[first[1:] - 1] ^ _RIGHT))
            fixed = fixed[first[:-1]]
            symbols = np.where(width > 1, made, now)
        turn += 1
    return levels


def extensions(levels: list[Level], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many symbols from x on equal those from y on, for each of many x < y; a fixed symbol must follow both."""
    ix, iy = x.copy(), y.copy()
    met = np.full(len(x), len(levels))  # the level on which the places are known to differ
    for n, level in enumerate(levels):
        going = np.flatnonzero(met > n)
        gx, gy = ix[going], iy[going]
        ux, uy = level.up[gx], level.up[gy]
        inside = (level.first[ux] != gx) | (level.first[uy] != gy)
        differ = inside & (level.symbols[gx] != level.symbols[gy])
        step = inside & ~differ
        if level.blocks:
            rx, ry = level.first[ux + 1] - gx, level.first[uy + 1] - gy
            move = np.where(step, np.minimum(rx, ry), 0)
            differ |= step & (rx != ry)
        else:
            move = step.astype(np.int64)
        gx, gy = gx + move, gy + move
        met[going[differ]] = n
        ix[going] = np.where(differ, gx, level.up[gx])
        iy[going] = np.where(differ, gy, level.up[gy])
    for n in range(len(levels) - 1, -1, -1):
        level = levels[n]
        down = np.flatnonzero(met > n)
        gx, gy = level.first[ix[down]], level.first[iy[down]]
        same = level.symbols[gx] == level.symbols[gy]
        if level.blocks:
            move = np.where(same, np.minimum(level.first[level.up[gx] + 1] - gx, level.first[level.up[gy] + 1] - gy), 0)
        else:
            move = same.astype(np.int64)
        ix[down], iy[down] = gx + move, gy + move
    return ix - x


def _grid(w: np.ndarray, at: np.ndarray, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and periods q, ascending in each text, where i is a multiple of q from the text's start and the words at i, i+q, ..., i+(times-1)q are equal.

    A run of ``times`` periods holds as many grid places of its period, so none is missed.
    """
    n = np.diff(at)
    top = n // times
    text = np.repeat(np.arange(len(n)), top)
    q = np.arange(len(text)) - np.repeat(np.cumsum(top) - top, top) + 1
    count = (n[text] - 1) // np.maximum(q, 1) - times + 2
    ends, lo = np.cumsum(count), 0
    while lo < len(q):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CANDIDATES, side="right")))
        c = count[lo:hi]
        which = np.repeat(np.arange(lo, hi), c)
        period = q[which]
        place = at[text[which]] + (np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)) * period
        for k in range(times - 1):
            same = np.flatnonzero(w[place + k * period] == w[place + (k + 1) * period])
            place, period = place[same], period[same]
        if len(place):
            yield place, period
        lo = hi


def runs_of(w: np.ndarray, at: np.ndarray, least: int, times: int) -> np.ndarray:
    """All runs of some texts, rows of text, start, length and period, in this order; w are the texts' words, at their starts (texts + 1)."""
    texts = len(at) - 1
    found, seen = [], np.full(len(w), -1)
    period_of, end_of = np.zeros(0, np.int64), np.zeros(0, np.int64)
    levels = back = shift = None
    for place, period in _grid(w, at, times):
        # a place inside a known run whose period divides this one would give that run again
        run = seen[place]
        known = np.zeros(len(place), bool)
        inside = np.flatnonzero(run >= 0)
        known[inside] = (period[inside] % period_of[run[inside]] == 0) & (end_of[run[inside]] > place[inside] + (times - 1) * period[inside])
        place, period = place[~known], period[~known]
        if not len(place):
            continue
        if levels is None:  # a fixed symbol stands before, between and after the texts
            text_of = np.repeat(np.arange(texts), np.diff(at))
            shift = text_of + 1
            symbols = mix(np.arange(len(w) + texts + 1, dtype=np.uint64) + np.uint64(BASE))
            fixed = np.ones(len(symbols), bool)
            symbols[np.arange(len(w)) + shift] = w
            fixed[np.arange(len(w)) + shift] = False
            levels = grammar(symbols, fixed)
            back = [level.mirrored() for level in levels]
        x = place + shift[place]
        fore = extensions(levels, x, x + period)
        aft = extensions(back, len(symbols) - x, len(symbols) - x - period)
        start, length = place - aft, fore + aft + period
        long = length >= np.maximum(least, times * period)
        new = np.unique(np.column_stack([start, length, period])[long], axis=0)
        found.append(new)
        number = len(period_of) + np.arange(len(new))
        period_of, end_of = np.append(period_of, new[:, 2]), np.append(end_of, new[:, 0] + new[:, 1])
        for r in np.argsort(new[:, 2], kind="stable"):
            cover = seen[new[r, 0] : new[r, 0] + new[r, 1]]
            cover[cover < 0] = number[r]
    if not found:
        return np.zeros((0, 4), np.int64)
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    smallest = np.ones(len(rows), bool)  # the same stretch also has the multiples of its period
    smallest[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    rows = rows[smallest]
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    text = np.searchsorted(at, rows[:, 0], side="right") - 1
    return np.column_stack([text, rows[:, 0] - at[text], rows[:, 1], rows[:, 2]])


def _strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; of equals the first by start, then period."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted_period(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Place and period from which a tenth of the texts, by crc32 of the id, repeat themselves; None for the others and for null ids."""
    if doc_id is None or not n or (h := zlib.crc32(str(doc_id).encode())) % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def find_runs(
    docs: DataFrame, least: int = 6, times: int = 4, rewrite: Callable[[int | None, int], tuple[int, int] | None] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words), the strongest run, and the collapsed text, for each row of ``docs``.

    A run is a stretch of words with smallest period q that no neighbouring word extends, of at least ``least``
    words and ``times`` periods (3 or more). Collapsing keeps the first period of each run; a word that any run
    holds after its first period goes. Kept words are joined by one space.

    ``rewrite`` (doc_id, number of words) may name a place a and a period p: words from a on then repeat words
    a to a+p-1, before runs are looked for.

    Each task reads its own rows, nothing is shuffled. For each period the places on its grid whose words agree
    are candidates (n log n comparisons for n words); the texts that have any get a grammar, whose extension
    queries give each candidate's exact stretch. Memory follows the longest text of a task. Words are compared by
    64-bit hashes, symbols of the grammar likewise.

    A null or empty text has no words, no runs, a null strongest run and an empty collapsed text; ids may be null
    or repeat, each row is a text of its own; an empty table gives an empty table; other columns are not read.
    """
    if times < 3:
        raise ValueError("times must be 3 or more")

    def rewritten(part: pa.RecordBatch, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """The words' hashes after rewriting, and the order of words of each rewritten text."""
        orders: dict[int, np.ndarray] = {}
        if rewrite:
            for i, doc in enumerate(part.column(0).to_pylist()):
                n = int(at[i + 1] - at[i])
                if (to := rewrite(doc, n)) is not None:
                    a, p = to
                    order = np.arange(n)
                    order[a:] = a + (order[a:] - a) % p
                    orders[i] = order
            if orders:
                h = h.copy()
                for i, order in orders.items():
                    h[at[i] : at[i + 1]] = h[at[i] : at[i + 1]][order]
        return h, orders

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for lo, hi in slices(offsets):
                part = batch.slice(lo, hi - lo)
                h, at = hash_words(data, offsets[lo : hi + 1], SPACED)
                h, orders = rewritten(part, h, at)
                rows = runs_of(h, at, least, times)
                cuts = np.searchsorted(rows[:, 0], np.arange(hi - lo + 1))
                found, best, kept = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    mine = [tuple(r) for r in rows[cuts[i] : cuts[i + 1], 1:].tolist()]
                    words = (text or "").encode().split()
                    if i in orders:
                        words = [words[j] for j in orders[i].tolist()]
                    if mine:
                        change = np.zeros(len(words) + 1, np.int64)
                        for start, length, period in mine:
                            change[start + period] += 1
                            change[start + length] -= 1
                        words = [words[j] for j in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                    found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in mine])
                    top = _strongest(mine)
                    best.append(top and dict(zip(("start", "length", "period"), top, strict=True)))
                    kept.append(b" ".join(words))
                one = pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(at), pa.int64()), pa.array(found, pa.list_(one)), pa.array(best, one), pa.array(kept, pa.binary()).view(pa.string())],
                    names=["doc_id", "n_words", "runs", "strongest", "collapsed"],
                )

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, SCHEMA)
