"""Vectorised word hashing over Arrow string columns.

Works on UTF-8 bytes with numpy, a few megabytes of text at a time, so that its
memory follows the longest single text and never the size of a batch. Words are
maximal runs of bytes that a caller's mask accepts; letters of ASCII and Latin-1
are folded to lower case before hashing, which keeps every byte offset valid.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Text bytes handled at once; a single longer text is handled on its own.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD1342543DE82EF95)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Slice(NamedTuple):
    """Texts lo..hi of a column: their bytes and the n + 1 offsets into them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Per word: index of its text in the slice, byte range, 64-bit hash."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 .. n - 1 of the base and of its inverse. Those for a slice of usual
    length are kept; a longer text's go with it."""
    if n <= len(_powers[0]):
        return _powers[0], _powers[1]
    found = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(max(n, SLICE_BYTES + 2), base, np.uint64)
        steps[0] = 1
        found.append(np.multiply.accumulate(steps))
    if n <= SLICE_BYTES + 2:
        _powers[:] = found
    return found[0], found[1]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a string column (null: empty) into runs of about `limit` bytes."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    offsets = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def fold_case(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and Latin-1 letters; lengths stay."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        tail = data[1:]
        out[1:][(data[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 32
    return out


def not_blank(data: np.ndarray) -> np.ndarray:
    """Mask of words that are separated by spaces and control characters."""
    return data > 0x20


_ALNUM = np.zeros(256, bool)
_ALNUM[0x80:] = True
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    _ALNUM[_lo:_hi] = True


def alphanumeric(data: np.ndarray) -> np.ndarray:
    """Mask of words that are letters and digits alone (any non-ASCII counts)."""
    return _ALNUM[data]


def words(part: Slice, is_word=not_blank) -> Words:
    """The words of a slice, in order."""
    data, offsets = part.data, part.offsets
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none, none, none, np.zeros(0, np.uint64))
    inside = is_word(data)
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    up, down = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((fold_case(data).astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return Words(np.searchsorted(offsets, start, "right") - 1, start, end, mix((total[end] - total[start]) * down[start]))


def runs(values: np.ndarray, first: np.ndarray, last: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hash of each run values[first:last], order included."""
    up, down = _power_tables(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values, salt) * up[: len(values)], out=total[1:])
    return mix((total[last] - total[first]) * down[first], salt) + (last - first).astype(np.uint64) * _STEP


def shingles(w: Words, n_texts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of `size` successive words, text after text, sorted within
    each, and the n + 1 offsets. A shorter text gives one shingle of all its
    words, a text without words none."""
    first = np.searchsorted(w.text, np.arange(n_texts + 1))
    counts = np.diff(first)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(counts.dtype))
    ends = np.cumsum(made)
    text = np.repeat(np.arange(n_texts), made)
    begin = first[text] + np.arange(len(text)) - (ends - made)[text]
    value = runs(w.hash, begin, np.minimum(begin + size, first[text + 1]))
    offsets = np.zeros(n_texts + 1, np.int64)
    parts = []
    for k, (a, b) in enumerate(zip(ends - made, ends, strict=True)):
        parts.append(np.unique(value[a:b]))
        offsets[k + 1] = offsets[k] + len(parts[-1])
    return (np.concatenate(parts) if parts else value), offsets


def char_offsets(part: Slice) -> np.ndarray:
    """Code points before each byte of the slice (n + 1 values)."""
    out = np.zeros(len(part.data) + 1, np.int64)
    np.cumsum((part.data & 0xC0) != 0x80, out=out[1:])
    return out
