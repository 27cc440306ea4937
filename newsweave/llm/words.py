"""Vectorised word and shingle hashing over Arrow text buffers.

Texts are handled as UTF-8 bytes in one buffer with offsets, as Arrow holds
them.  Word separators are ASCII bytes only, so byte classes are exact.  A
word's 64-bit hash is a sum over its pieces of eight bytes, each mixed with
its place by a bijection that is not linear, so no Python object is made per
word and no structure of the letters cancels out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21  # bytes hashed at a time; a longer text is a slice of its own
_LANE = 8  # bytes mixed at a time
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_K = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Word bytes of `[^\x20\x09-\x0D]+`.
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False
#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if column.null_count:  # a null may hide bytes: close the gaps
        keep = np.asarray(column.is_valid())
        sizes = np.where(keep, np.diff(offsets), 0)
        parts = [buf[a:a + n] for a, n in zip(offsets[:-1], sizes) if n]
        buf = np.concatenate(parts) if parts else np.zeros(0, np.uint8)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
    return buf, offsets


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about ``size`` bytes together, one text at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross texts: starts, ends, and where
    each text's runs begin (one entry more than texts)."""
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = inside[:-1]
    after[:-1] = inside[1:]
    edges = offsets[(offsets > 0) & (offsets < n)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each [start, end) of the bytes; none may be empty."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = ends - starts
    lanes = -(-sizes // _LANE)
    firsts = np.cumsum(lanes) - lanes
    nth = np.arange(int(lanes.sum())) - np.repeat(firsts, lanes)
    padded = np.concatenate([buf, np.zeros(_LANE, np.uint8)])
    anywhere = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    values = anywhere[np.repeat(starts, lanes) + nth * _LANE]
    last = firsts + lanes - 1
    unused = (lanes * _LANE - sizes).astype(np.uint64) * np.uint64(8)
    values[last] = values[last] << unused  # what follows the word is shifted out
    places = mix(np.arange(1, int(lanes.max()) + 1, dtype=np.uint64) * _GOLD)
    return mix(np.add.reduceat(mix(values ^ places[nth]), firsts) + sizes.astype(np.uint64) * _GOLD)


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sizes[i] bytes of a from a_starts[i] are those of b from
    b_starts[i]; sizes are at least one."""
    if not len(sizes):
        return np.zeros(0, bool)
    firsts = np.cumsum(sizes) - sizes
    step = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    return np.logical_and.reduceat(a[np.repeat(a_starts, sizes) + step] == b[np.repeat(b_starts, sizes) + step], firsts)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``width``-word shingles of one text's word
    hashes; with fewer words the whole sequence is one, without words none."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    span = min(n, width)
    h = np.full(n - span + 1, np.uint64(span), dtype=np.uint64)
    for k in range(span):
        h = h * _K + words[k:n - span + 1 + k]
    return np.unique(mix(h))


def word_hashes(column: pa.Array, word_bytes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, bounds) for slices of a string column: the
    words of row ``first + k`` are ``hashes[bounds[k]:bounds[k + 1]]``."""
    buf, offsets = buffers(column)
    for i, j in slices(offsets):
        low = LOWER[buf[offsets[i]:offsets[j]]]
        starts, ends, bounds = runs(word_bytes[low], offsets[i:j + 1] - offsets[i])
        yield i, hashes(low, starts, ends), bounds
