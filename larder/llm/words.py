"""Words of UTF-8 texts as 64-bit hashes, many texts at a time with numpy.

A word is a run of bytes other than space and the control characters 9 to 13. Its hash is a polynomial of
random byte values modulo 2**64, taken from running sums, so that no Python loop sees a word. Two given
different words agree with a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes that are hashed at a time; longer texts are taken in pieces cut at white space.
SEGMENT_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[~_IS_WORD] = 0
_FOLDED = _VALUES.copy()
_FOLDED[65:91] = _VALUES[97:123]
_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[[*range(65, 91), *range(97, 123)]] = True
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * SEGMENT_BYTES)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.full(size, b, dtype=np.uint64)) for b in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Segment:
    """Words of whole texts ``first`` to ``first + len(counts)``, or of a piece of one long text."""

    first: int
    counts: np.ndarray
    data: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray


def _marks_apart(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A final full stop or comma after a Latin letter becomes a word of its own."""
    before = raw[ends - 2]
    latin = (raw[ends - 3] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7)
    at = np.flatnonzero(((raw[ends - 1] == 46) | (raw[ends - 1] == 44)) & (ends - starts > 1) & (_IS_LETTER[before] | latin))
    starts = np.insert(starts, at + 1, ends[at] - 1)
    return starts, np.insert(ends, at, ends[at] - 1)


def _segment(first: int, docs: list[bytes], fold: bool, marks_apart: bool = False) -> Segment:
    data = b" ".join(docs) + b" "
    raw = np.frombuffer(data, dtype=np.uint8)
    word = _IS_WORD[raw]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]  # the data end with a space, so each word has an end
    if marks_apart and len(starts):
        starts, ends = _marks_apart(raw, starts, ends)
    power, inverse = _power_tables(len(raw))
    with np.errstate(over="ignore"):
        sums = (_FOLDED if fold else _VALUES)[raw]
        sums *= power[: len(raw)]
        np.cumsum(sums, out=sums)
        before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
        hashes = mixed((sums[ends - 1] - before) * inverse[starts])
    bounds = np.cumsum([0] + [len(d) + 1 for d in docs])
    return Segment(first, np.diff(np.searchsorted(starts, bounds)), data, starts, ends, hashes)


def word_segments(docs: list[bytes], fold: bool, marks_apart: bool = False) -> Iterator[Segment]:
    """Words of all texts in order. ``fold`` takes A to Z as a to z; ``marks_apart`` parts a final full stop
    or comma from a Latin letter before it."""
    first, size = 0, 0
    for i, d in enumerate(docs):
        if size and size + len(d) > SEGMENT_BYTES:
            yield _segment(first, docs[first:i], fold, marks_apart)
            first, size = i, 0
        size += len(d) + 1
        if len(d) > SEGMENT_BYTES:
            at = 0
            while at < len(d):
                to = at + SEGMENT_BYTES
                while to < len(d) and _IS_WORD[d[to]]:
                    to += 1
                yield _segment(i, [d[at:to]], fold, marks_apart)
                at = to
            first, size = i + 1, 0
    if first < len(docs):
        yield _segment(first, docs[first:], fold, marks_apart)


def utf8(column: pa.Array) -> list[bytes]:
    """A text column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def words_by_text(docs: list[bytes], fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes in order, and the number of words of each text."""
    hashes, counts = [], np.zeros(len(docs), dtype=np.int64)
    for s in word_segments(docs, fold):
        hashes.append(s.hashes)
        counts[s.first : s.first + len(s.counts)] += s.counts
    return np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64), counts
