"""Words of whole texts as 64-bit hashes, by numpy over the bytes of an Arrow column.

Two word laws are used by the operators:

* ``SPACED``: maximal runs of anything but U+0020 and U+0009 to U+000D.
* ``PLAIN``: maximal runs of digits, ASCII letters and everything beyond ASCII.

A word's hash is a polynomial over its (mapped) bytes modulo 2**64, mixed at the end; it depends
on the word alone, so it is the same in every task and on every run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
_ONE = np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (two multiply-xorshift rounds)."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


@dataclass(frozen=True)
class Law:
    is_word: np.ndarray
    value: np.ndarray
    table: bytes


def _law(separators: set[int], lower: bool) -> Law:
    to = np.arange(256, dtype=np.uint8)
    if lower:
        to[65:91] += 32
    is_word = np.array([int(to[i]) not in separators for i in range(256)])
    value = mix((to.astype(np.uint64) + _ONE) * np.uint64(0xD6E8FEB86659FD93))
    table = bytes(int(to[i]) if is_word[i] else 32 for i in range(256))
    return Law(is_word, value, table)


_SPACE = {32, *range(9, 14)}
_SIGNS = {*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)}
SPACED = _law(_SPACE, lower=False)
SPACED_LOWER = _law(_SPACE, lower=True)
PLAIN_LOWER = _law(_SIGNS, lower=True)


class _Powers:
    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            n = max(n, CHUNK + 1)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps))


def _hash_piece(b: np.ndarray, bounds: np.ndarray, law: Law) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of each word of b; no word runs over one of the bounds."""
    word = law.is_word[b]
    before = np.empty_like(word)
    before[:1] = False
    before[1:] = word[:-1]
    inner = bounds[(bounds > 0) & (bounds < len(b))]
    before[inner] = False
    after = np.empty_like(word)
    after[-1:] = False
    after[:-1] = word[1:]
    after[inner - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    _Powers.reach(len(b) + 1)
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(law.value[b] * _Powers.up[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _Powers.down[starts]), starts, ends


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Runs of rows of up to ``most`` bytes, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


def hash_words(data: np.ndarray, offsets: np.ndarray, law: Law) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of some rows, and where each row's words begin among them (rows + 1 values)."""
    h, at, _ = hash_words_and_tails(data, offsets, law)
    return h, at


def hash_words_and_tails(data: np.ndarray, offsets: np.ndarray, law: Law) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As hash_words, and each word's last two bytes as a number."""
    base, end = int(offsets[0]), int(offsets[-1])
    b, at = data[base:end], offsets - base
    if len(b) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64), np.zeros(0, np.int64)
    hashes, starts, ends, lo = [], [], [], 0
    while lo < len(b):
        hi = min(len(b), lo + 2 * CHUNK)
        if hi < len(b):  # one long text: cut behind a separator
            free = np.flatnonzero(~law.is_word[b[lo:hi]])
            if len(free):
                hi = lo + int(free[-1]) + 1
            else:
                rest = np.flatnonzero(~law.is_word[b[hi:]])
                hi = hi + int(rest[0]) if len(rest) else len(b)
        h, s, e = _hash_piece(b[lo:hi], at - lo, law)
        hashes.append(h)
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    h, s, e = np.concatenate(hashes), np.concatenate(starts), np.concatenate(ends)
    tails = b[e - 1].astype(np.int64) + np.where(e - s > 1, b[np.maximum(e - 2, 0)].astype(np.int64) << 8, 0)
    return h, np.searchsorted(s, at).astype(np.int64), tails


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(BASE) + h[i : i + n]
    return mix(out)
