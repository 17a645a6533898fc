"""Words and rolling hashes of whole Arrow text columns, without a Python object per word.

A word is a run of bytes that are none of the six ASCII white-space characters; all other bytes, valid or not, belong
to words. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Texts are worked on in slices of about this size, so that the arrays over bytes stay in the cache.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15  # odd, hence invertible modulo 2^64
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SEED = np.random.default_rng(42)
_BYTE_VALUE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all bits."""
    x = values ^ np.uint64(seed)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(4)
def _powers(base: int, size: int) -> np.ndarray:
    out = np.ones(size, np.uint64)
    out[1:] = base
    return np.multiply.accumulate(out)


def powers(base: int, size: int) -> np.ndarray:
    return _powers(base, 1 << max(10, (size - 1).bit_length()))[:size]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` bytes of text; a longer text has a range of its own."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64))
    row, base = 0, 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(ends, base + most, "right")))
        yield row, stop
        row, base = stop, int(ends[stop - 1])


class Words:
    """Byte ranges of the words of a column: word ``w`` is ``data[start[w]:stop[w]]`` and lies in row ``row[w]``;
    the words of row ``r`` are ``first[r]`` up to ``first[r + 1]``. With ``classes``, a number for each byte and zero for
    white space, words also end where the class changes."""

    def __init__(self, texts: pa.Array, classes: np.ndarray | None = None):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if len(texts):
            offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        else:
            offsets = np.zeros(1, np.int64)
        low, high = int(offsets[0]), int(offsets[-1])
        body = texts.buffers()[2] if len(texts) else None
        self.data = np.frombuffer(body, np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
        self.offsets = offsets - low
        gap = np.ones(len(self.data) + 1, bool)
        np.take(_IS_SPACE, self.data, out=gap[:-1])
        self.spaces = gap[:-1]
        inside = ~gap
        starts = inside[:-1].copy()
        starts[1:] &= gap[:-2]
        stops = inside[:-1] & gap[1:]
        if classes is not None:
            kind = classes[self.data]
            change = kind[1:] != kind[:-1]
            starts[1:] |= inside[1:-1] & change
            stops[:-1] |= inside[: len(kind) - 1] & change
        edges = self.offsets[(self.offsets > 0) & (self.offsets < len(self.data))]
        starts[edges] |= inside[edges]
        stops[edges - 1] |= inside[edges - 1]
        self.start, self.stop = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, equal for equal words anywhere."""
        out = np.empty(len(self), np.uint64)
        word = 0
        while word < len(self):
            base = int(self.start[word])
            end = max(word + 1, int(np.searchsorted(self.stop, base + SLICE_BYTES, "right")))
            piece = self.data[base : int(self.stop[end - 1])]
            sums = np.zeros(len(piece) + 1, np.uint64)
            np.cumsum(_BYTE_VALUE[piece] * powers(_BASE, len(piece)), out=sums[1:])
            at, to = self.start[word:end] - base, self.stop[word:end] - base
            out[word:end] = mix((sums[to] - sums[at]) * powers(inverse(_BASE), len(piece))[at])
            word = end
        return out


class Rolling:
    """Hashes of any runs of consecutive words, from one pass over their hashes."""

    def __init__(self, hashes: np.ndarray):
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * powers(_BASE, len(hashes)), out=self.sums[1:])

    def of(self, start: np.ndarray, length: np.ndarray | int, seed: int = 0) -> np.ndarray:
        back = powers(inverse(_BASE), len(self.sums))
        return mix((self.sums[start + length] - self.sums[start]) * back[start], seed)

    def windows(self, length: int, seed: int = 0) -> np.ndarray:
        """Of every run of ``length`` words, by its first word; runs over row ends are included."""
        count = max(0, len(self.sums) - length)
        back = powers(inverse(_BASE), len(self.sums))[:count]
        return mix((self.sums[length : length + count] - self.sums[:count]) * back, seed)


def minima(values: np.ndarray, length: int) -> np.ndarray:
    """The least of each ``length`` consecutive values."""
    out, done = values, 1
    while done < length:
        step = min(done, length - done)
        out = np.minimum(out[: len(out) - step], out[step:])
        done += step
    return out
