"""Encoding of whole columns through a dictionary of the distinct pieces of their texts.

Texts are cut where a tokenizer's tokens can never reach across; each distinct piece is encoded once by the library, and
a worker keeps what it has encoded for later batches, up to a bound.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain, islice, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT = 1 << 19
# The library's results are large objects, so it gets this many pieces at a time.
_LOT = 1 << 14


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places ``starts[i]`` up to ``starts[i] + lengths[i]``, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Dictionary:
    """Ids of pieces, by one call of ``encode`` for the pieces of a batch that are new."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], most: int = KEPT):
        self.encode, self.most = encode, most
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.ids = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)

    def __call__(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces ``data[cuts[i]:cuts[i + 1]]``, and the number of each piece's ids."""
        if len(cuts) < 2:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        pieces = pa.LargeStringArray.from_buffers(
            len(cuts) - 1, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))
        )
        coded = pieces.dictionary_encode()
        if len(self.known) > self.most:
            self._forget()
        place = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.known), -1).to_numpy(zero_copy_only=False).copy()
        unknown = place < 0
        new = coded.dictionary.filter(pa.array(unknown))
        place[unknown] = len(self.known) + np.arange(len(new))
        if len(new):
            counts, flat = [], []
            for at in range(0, len(new), _LOT):
                made = self.encode(new.slice(at, _LOT).to_pylist())
                counts.append(np.fromiter(map(len, made), np.int64, len(made)))
                flat.append(np.fromiter((i for ids in made for i in ids), np.uint32, int(counts[-1].sum())))
            self.known = pa.concat_arrays([self.known, new])
            self.ids = np.concatenate([self.ids, *flat])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(counts))])
        place = place[coded.indices.to_numpy()]
        counts = self.ends[place + 1] - self.ends[place]
        return self.ids[spread(self.ends[place], counts)], counts


def flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a library's lists, and the number of each list's."""
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts


class BytesDictionary:
    """As :class:`Dictionary`, by the bytes of the pieces and without copies of what is known: faster, for more memory.

    ``encode`` gives all ids of a list of pieces, one after another, and the number of each piece's. Beyond ``most`` known
    pieces the older half is forgotten.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = KEPT):
        self.encode, self.most = encode, most
        self.place: dict[bytes, int] = {}
        # With room to grow: the ids so far, and where those of each piece begin and end.
        self.ids = np.zeros(1 << 10, np.uint32)
        self.ends = np.zeros(1 << 10, np.int64)

    def _forget(self) -> None:
        cut = len(self.place) // 2
        used = self.ends[cut]
        self.ids[: self.ends[len(self.place)] - used] = self.ids[used : self.ends[len(self.place)]].copy()
        self.ends[: len(self.place) - cut + 1] = self.ends[cut : len(self.place) + 1] - used
        self.place = {piece: k for k, piece in enumerate(islice(self.place, cut, None))}

    def _learn(self, new: list[bytes]) -> None:
        for at in range(0, len(new), _LOT):
            lot = new[at : at + _LOT]
            ids, counts = self.encode([piece.decode() for piece in lot])
            known, used = len(self.place), int(self.ends[len(self.place)])
            self.ids = _with_room(self.ids, used + len(ids))
            self.ends = _with_room(self.ends, known + len(lot) + 1)
            self.ids[used : used + len(ids)] = ids
            self.ends[known + 1 : known + len(lot) + 1] = used + np.cumsum(counts)
            self.place.update(zip(lot, range(known, known + len(lot)), strict=True))

    def __call__(self, data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces ``data[cuts[i]:cuts[i + 1]]``, and the number of each piece's ids."""
        if len(cuts) < 2:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        pieces = pa.LargeStringArray.from_buffers(
            len(cuts) - 1, pa.py_buffer(np.ascontiguousarray(cuts, np.int64)), pa.py_buffer(np.ascontiguousarray(data))
        )
        coded = pieces.dictionary_encode()
        if len(self.place) > self.most:
            self._forget()
        ends = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1].tolist()
        body = coded.dictionary.buffers()[2].to_pybytes()
        names = [body[a:b] for a, b in pairwise(ends)]
        self._learn([name for name in names if name not in self.place])
        place = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]
        counts = self.ends[place + 1] - self.ends[place]
        return self.ids[spread(self.ends[place], counts)], counts


def _with_room(values: np.ndarray, size: int) -> np.ndarray:
    if size <= len(values):
        return values
    out = np.zeros(max(size, 2 * len(values)), values.dtype)
    out[: len(values)] = values
    return out
