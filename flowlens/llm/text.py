"""Words and word shingles of Arrow string columns as numpy arrays.

Words are maximal runs of bytes outside [\\x20\\x09-\\x0D], with A-Z folded to
a-z on request. A word stands for its 64-bit hash; text is scanned in windows
of bounded size, so memory follows the window and not the document.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U = np.uint64
WINDOW = 1 << 20
#: Bytes of text whose word arrays are held at a time (or one document, if longer).
GROUP = 4 << 20

_WORD = np.ones(256, bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_PLAIN = mix(np.arange(1, 257, dtype=U) * U(0xA0761D6478BD642F))
_FOLDED = _PLAIN.copy()
_FOLDED[ord("A"):ord("Z") + 1] = _PLAIN[ord("a"):ord("z") + 1]
_LENGTH = U(0xE7037ED1A0B428DB)
_POSITION = mix(np.arange(1, 9, dtype=U) * U(0x8EBC6AF09C88C6E3)) | U(1)

_libc = ctypes.CDLL(None)


def trim() -> None:
    """Give memory that was freed back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def trimmed(run: Callable) -> Callable:
    """`run` of a mapInArrow, whose worker is kept for later tasks but not the
    memory that it freed: given back after each batch of texts and at the end."""
    def each(batches):
        for batch in batches:
            yield batch
            del batch
            trim()

    def lean(batches):
        yield from run(each(batches))
        trim()

    return lean


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= WINDOW + (1 << 16):
        n = WINDOW + (1 << 16)
        if n in _powers:
            return _powers[n]
    tables = []
    for base in (_BASE, _INVERSE):
        p = np.full(n, base, U)
        p[0] = 1
        tables.append(np.cumprod(p, dtype=U))
    if n == WINDOW + (1 << 16):
        _powers[n] = (tables[0], tables[1])
    return tables[0], tables[1]


class Words(NamedTuple):
    """Words of some documents: byte range and hash of each, and the index of
    each document's first word (with the total at the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def groups(offsets: np.ndarray, limit: int = GROUP) -> Iterator[tuple[int, int]]:
    """Ranges of documents with up to `limit` bytes, of one document at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def _cut(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int, in_word: np.ndarray) -> int:
    """End of the window that begins at lo: where a word ends, or a document."""
    if lo + WINDOW >= hi:
        return hi
    at = lo + WINDOW
    stop = min(hi, int(offsets[np.searchsorted(offsets, at, "left")]))
    while at < stop:
        gap = np.flatnonzero(~in_word[data[at:min(stop, at + 4096)]])
        if len(gap):
            return at + int(gap[0])
        at += 4096
    return stop


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True, in_word: np.ndarray = _WORD) -> Words:
    """All words of the documents that lie at `offsets` in `data`: maximal runs
    of the bytes that `in_word` marks."""
    lo, hi = int(offsets[0]), int(offsets[-1])
    table = _FOLDED if fold else _PLAIN
    starts, ends, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, U)]
    while lo < hi:
        to = _cut(data, offsets, lo, hi, in_word)
        b = data[lo:to]
        inner = offsets[np.searchsorted(offsets, lo, "right"):np.searchsorted(offsets, to, "left")] - lo
        is_word = in_word[b]
        opens = is_word.copy()
        opens[1:] &= ~is_word[:-1]
        opens[inner] = is_word[inner]
        closes = is_word.copy()
        closes[:-1] &= ~is_word[1:]
        closes[inner - 1] = is_word[inner - 1]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        up, down = _power_tables(len(b))
        total = np.zeros(len(b) + 1, U)
        np.cumsum(table[b] * up[:len(b)], out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(U) * _LENGTH))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = to
    start = np.concatenate(starts)
    return Words(start, np.concatenate(ends), np.concatenate(hashes), np.searchsorted(start, offsets, "left"))


def shingle_sets(w: Words, n: int = 5, weight: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """For each document the sorted distinct hashes of its n-word shingles and
    the sums of their words' weights (by the low bits of a word's hash); with
    fewer words the whole sequence is one shingle, without words there is none."""
    m = len(w.hash) - n + 1
    if m > 0:
        acc = w.hash[:m] * _POSITION[0]
        for j in range(1, n):
            acc = acc + w.hash[j:j + m] * _POSITION[j]
        acc = mix(acc)
    total = None
    if weight is not None:
        total = np.zeros(len(w.hash) + 1)
        np.cumsum(weight[(w.hash & U(len(weight) - 1)).astype(np.int64)], out=total[1:])
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if b - a >= n:
            if total is None:
                yield np.unique(acc[a:b - n + 1]), None
            else:
                values, at = np.unique(acc[a:b - n + 1], return_index=True)
                yield values, total[a + n:b + 1][at] - total[a:b - n + 1][at]
        elif b > a:
            short = mix((w.hash[a:b] * _POSITION[:b - a]).sum(dtype=U, keepdims=True) + np.array([b - a], U) * _LENGTH)
            yield short, None if total is None else total[b:b + 1] - total[a:a + 1]
        else:
            yield np.zeros(0, U), None if total is None else np.zeros(0)
