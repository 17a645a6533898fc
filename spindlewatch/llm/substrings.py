"""Removal of long passages that occur before, by compaction of a De Bruijn graph of word k-mers.

A window of k consecutive words is an edge of the graph. Neighbouring windows that share their least *anchor* (the
hash of a few words inside the window, chosen by content alone) form a path. Equal windows have equal anchors, so:

1. Anchors are counted over the corpus. A path whose anchor occurs once holds no repeated edge and goes.
2. An anchor that has only one path in the whole corpus does not branch: the path is compacted to one key. Where paths
   branch (passage ends, edits, periodic texts) their edges are kept one by one. A path that may hold an edge twice, as
   in periodic texts, branches by itself, even if it is the only one of its anchor.
3. For each key the first source coordinates (doc_id, word) are found, and come back to the documents, where the
   words are covered anew from the text itself.

Documents travel once, in chunks of bounded size dealt by a hash; both visits read the same shuffle. Everything about
a key is combined within a chunk before it is shuffled, so that a passage in a third of all documents is a row for
each chunk, not for each document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindlewatch.llm.words import Rolling, Words, minima, mix, slices

ANCHOR = 6
CHUNK_BYTES = 8 << 20
_LONGEST = 32  # edges of a path; longer ones are cut, which only a periodic text can need
_NO_ID = -(1 << 63)


class Paths:
    """The paths of some texts: path p is the ``count[p]`` windows that begin at words ``start[p]`` and following."""

    def __init__(self, texts: pa.Array, window: int):
        self.words = words = Words(texts)
        self.rolling = Rolling(words.hashes())
        anchor = min(ANCHOR, window)
        span = window - anchor + 1
        last = words.first[1:] - window
        each = np.maximum(last - words.first[:-1] + 1, 0)
        self.window_row = np.repeat(np.arange(len(texts)), each)
        ends = np.cumsum(each)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - each, each) + np.repeat(words.first[:-1], each)
        value = self.rolling.windows(anchor, seed=1)
        tag = np.arange(len(value), dtype=np.uint64) & np.uint64(31)
        high = value & ~np.uint64(31)
        low, up = (minima(high | t, span) if len(value) >= span else value[:0] for t in (tag, np.uint64(31) - tag))
        low, up = low[at], up[at]
        least = low >> np.uint64(5)
        periodic = (low & np.uint64(31)) + (up & np.uint64(31)) != np.uint64(31)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | (self.window_row[1:] != self.window_row[:-1])
        heads = np.flatnonzero(fresh)
        if len(heads):
            run = np.cumsum(fresh) - 1
            fresh |= (np.arange(len(at)) - heads[run]) % _LONGEST == 0
            heads = np.flatnonzero(fresh)
        self.head = heads
        self.count = np.diff(np.append(heads, len(at)))
        self.start = at[heads]
        self.row = self.window_row[heads]
        self.at = at
        self.anchor = mix(least[heads], 2).view(np.int64)
        # An edge comes twice in a path only if an anchor does: within one window, or in windows further apart than a span.
        self.branches = (np.logical_or.reduceat(periodic, heads) if len(heads) else np.zeros(0, bool)) | (self.count > span)
        self.window = window

    def keys(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key and check of whole paths."""
        length = self.count[which] + self.window - 1
        return self._pair(self.start[which], length, 3)

    def edge_keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Key and check of the windows at some words."""
        return self._pair(at, self.window, 5)

    def _pair(self, start: np.ndarray, length: np.ndarray | int, seed: int) -> tuple[np.ndarray, np.ndarray]:
        key = self.rolling.of(start, length, seed)
        # Another hash of the same words, from the first ones and the last ones of the run.
        half = self.window // 2
        check = self.rolling.of(start, half, 7) * np.uint64(3) + self.rolling.of(start + length - half, half, 11)
        return key.view(np.int64), (check >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def edges_of(self, which: np.ndarray) -> np.ndarray:
        """Positions in ``at`` of all windows of some paths."""
        count = self.count[which]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return np.arange(total) - np.repeat(ends - count, count) + np.repeat(self.head[which], count)

    def position(self, word: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The number of a word in its text."""
        return word - self.words.first[row]


def _anchors(window: int):
    """Batches of (text, chunk) to rows (key, chunk, path, n, branches, more): one for each anchor and batch. n is 2 for
    an anchor that a batch holds more than once, or in a path that branches by itself. The chunks of an anchor that a
    batch holds more than once are in ``more``, as 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunk_of = batch.column("chunk").to_numpy(zero_copy_only=False).astype(np.int32)
            found = []
            for a, b in slices(batch.column("text")):
                paths = Paths(batch.column("text").slice(a, b - a), window)
                path = paths.keys(np.arange(len(paths.start)))[0]
                found.append((paths.anchor, path, chunk_of[a:b][paths.row], paths.branches))
            if not found:
                continue
            key, path, chunk, branches = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(key, kind="stable")
            key, path, chunk, branches = key[order], path[order], chunk[order], branches[order]
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
            count = np.diff(np.append(head, len(key)))
            more = [None] * len(head)
            if len(head):
                differ = np.logical_or.reduceat(np.concatenate([[False], path[1:] != path[:-1]]) & ~_first(len(key), head), head)
                alone = np.logical_or.reduceat(branches, head)
                differ |= alone
                for g in np.flatnonzero(count > 1):
                    more[g] = np.unique(chunk[head[g] : head[g] + count[g]]).tobytes()
            else:
                differ = alone = np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key[head]), pa.array(chunk[head]), pa.array(path[head]),
                    pa.array(np.minimum(count + alone, 2).astype(np.int8)), pa.array(differ), pa.array(more, pa.binary()),
                ],
                ["key", "chunk", "path", "n", "branches", "more"],
            )

    return run


def _first(n: int, heads: np.ndarray) -> np.ndarray:
    out = np.zeros(n, bool)
    out[heads] = True
    return out


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, chunk, branches, more) to one row for each chunk."""
    for batch in batches:
        more = batch.column("more")
        lone = more.is_null().to_numpy(zero_copy_only=False)
        key = batch.column("key").to_numpy()
        branches = batch.column("branches").to_numpy(zero_copy_only=False)
        lots = [np.frombuffer(x, np.int32) for x in more.drop_null().to_pylist()]
        sizes = np.array([len(x) for x in lots], np.int64)
        chunk = np.concatenate([batch.column("chunk").to_numpy()[lone], *lots])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([key[lone], np.repeat(key[~lone], sizes)])), pa.array(chunk.astype(np.int32)),
                pa.array(np.concatenate([branches[lone], np.repeat(branches[~lone], sizes)])),
            ],
            ["key", "chunk", "branches"],
        )


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each key its place among the sorted ones, or -1."""
    if not len(sorted_keys):
        return np.full(len(keys), -1)
    shift = np.uint64(44)
    sieve = np.zeros(1 << 20, bool)
    sieve[sorted_keys.view(np.uint64) >> shift] = True
    out = np.full(len(keys), -1)
    maybe = np.flatnonzero(sieve[keys.view(np.uint64) >> shift])
    at = np.minimum(np.searchsorted(sorted_keys, keys[maybe]), len(sorted_keys) - 1)
    hit = sorted_keys[at] == keys[maybe]
    out[maybe[hit]] = at[hit]
    return out


def _one(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column.chunk(0) if isinstance(column, pa.ChunkedArray) else column


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _coordinates(window: int):
    """A chunk's documents and repeated anchors to rows (key, check, chunk, doc, word, n): the first place of each path
    or edge in the chunk, and whether it has more."""

    def run(docs: pa.Table, flags: pa.Table) -> pa.Table:
        lots = []
        if docs.num_rows and flags.num_rows:
            texts, ids, chunk = _one(docs, "text"), _ids(_one(docs, "doc_id")), docs.column("chunk")[0].as_py()
            known, at = np.unique(flags.column("key").to_numpy(), return_index=True)
            branch = flags.column("branches").to_numpy()[at]
            for a, b in slices(texts):
                paths = Paths(texts.slice(a, b - a), window)
                place = _find(known, paths.anchor)
                whole = np.flatnonzero((place >= 0) & ~branch[place])
                split = np.flatnonzero((place >= 0) & branch[place])
                edges = paths.edges_of(split)
                for (key, check), word, row in (
                    (paths.keys(whole), paths.start[whole], paths.row[whole]),
                    (paths.edge_keys(paths.at[edges]), paths.at[edges], paths.window_row[edges]),
                ):
                    lots.append((key, check, ids[a:b][row], paths.position(word, row)))
        if not lots:
            return _COORDINATES.empty_table()
        key, check, doc, word = (np.concatenate(x) for x in zip(*lots, strict=True))
        order = np.lexsort((word, doc, check, key))
        key, check, doc, word = key[order], check[order], doc[order], word[order]
        head = np.ones(len(key), bool)
        head[1:] = (key[1:] != key[:-1]) | (check[1:] != check[:-1])
        head = np.flatnonzero(head)
        count = np.minimum(np.diff(np.append(head, len(key))), 2).astype(np.int8)
        return pa.table(
            [
                pa.array(key[head]), pa.array(check[head]), pa.array(np.full(len(head), chunk, np.int32)),
                pa.array(doc[head]), pa.array(word[head].astype(np.int32)), pa.array(count),
            ],
            schema=_COORDINATES,
        )

    return run


_COORDINATES = pa.schema(
    [("key", pa.int64()), ("check", pa.int32()), ("chunk", pa.int32()), ("doc", pa.int64()), ("word", pa.int32()), ("n", pa.int8())]
)
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def _cover(window: int):
    """A chunk's documents and the first places of its keys to the documents without their covered words."""

    def run(docs: pa.Table, firsts: pa.Table) -> pa.Table:
        out = []
        if docs.num_rows:
            texts, id_column = _one(docs, "text"), _one(docs, "doc_id")
            ids = _ids(id_column)
            key = firsts.column("key").to_numpy()
            order = np.argsort(key, kind="stable")
            key = key[order]
            check, doc, word = (firsts.column(c).to_numpy()[order] for c in ("check", "doc", "word"))
            for a, b in slices(texts):
                paths = Paths(texts.slice(a, b - a), window)
                covered = np.zeros(len(paths.words) + 1, np.int64)
                every = np.arange(len(paths.start))
                edge_keys, edge_checks = paths.edge_keys(paths.at)
                path_keys, path_checks = paths.keys(every)
                for keys, checks, at, row, length in (
                    (path_keys, path_checks, paths.start, paths.row, paths.count + window - 1),
                    (edge_keys, edge_checks, paths.at, paths.window_row, np.full(len(paths.at), window)),
                ):
                    place = _find(key, keys)
                    hit = np.flatnonzero(place >= 0)
                    p, own, pos = place[hit], ids[a:b][row[hit]], paths.position(at[hit], row[hit])
                    earlier = (doc[p] < own) | ((doc[p] == own) & (word[p] < pos))
                    hit = hit[earlier & (check[p] == checks[hit])]
                    np.add.at(covered, at[hit], 1)
                    np.add.at(covered, at[hit] + length[hit], -1)
                gone = np.cumsum(covered[:-1]) > 0
                out.append(_kept(id_column.slice(a, b - a), paths.words, gone))
        return pa.concat_tables(out) if out else _KEPT.empty_table()

    return run


_KEPT = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("removed", _SPAN)]
)


def _kept(ids: pa.Array, words: Words, gone: np.ndarray) -> pa.Table:
    rows = len(ids)
    size = words.stop - words.start + 1
    at = np.concatenate([[0], np.cumsum(size)])
    line = np.full(at[-1], 32, np.uint8)
    place = np.ones(at[-1], bool)
    place[at[1:] - 1] = False
    line[place] = words.data[~words.spaces]
    # A text's last kept word has no space after it.
    keep = ~gone
    in_row = np.concatenate([[0], np.cumsum(keep)])[words.first]
    mask = np.repeat(keep, size)
    kept_words = np.flatnonzero(keep)
    last = kept_words[in_row[1:][np.diff(in_row) > 0] - 1]
    mask[at[last + 1] - 1] = False
    bytes_before = np.concatenate([[0], np.cumsum(mask)])[at[words.first]]
    kept = pa.LargeStringArray.from_buffers(
        rows, pa.py_buffer(bytes_before.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(line[mask]))
    ).cast(pa.string())
    step = np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8))
    # A span does not go on into the next text.
    start, stop = step[:-1] == 1, step[1:] == -1
    edge = words.first[1:-1]
    edge = edge[(edge > 0) & (edge < len(gone))]
    both = edge[gone[edge] & gone[edge - 1]]
    start[both], stop[both - 1] = True, True
    start, stop = np.flatnonzero(start), np.flatnonzero(stop) + 1
    base = words.first[words.row[start]] if len(start) else start
    spans = pa.StructArray.from_arrays([pa.array((start - base).astype(np.int64)), pa.array((stop - base).astype(np.int64))], ["start", "stop"])
    offsets = pa.array(np.searchsorted(start, words.first).astype(np.int32))
    removed = np.concatenate([[0], np.cumsum(gone)])[words.first]
    return pa.table(
        [
            ids, pa.array(np.diff(words.first).astype(np.int64)), pa.array(np.diff(removed).astype(np.int64)), kept,
            pa.ListArray.from_arrays(offsets, spans),
        ],
        schema=_KEPT,
    )


def without_repeats(spark: SparkSession, docs: DataFrame, window: int = 20) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, removed) for every row of ``docs``.

    Words are runs of bytes other than ASCII white space. Each word covered by a run of ``window`` words that also
    begins earlier, at a smaller doc_id or at a smaller word of the same doc_id, is removed; all runs are judged on
    the input. ``kept`` has the other words joined by one space, ``removed`` the spans of word numbers that went.

    Null texts have no words. Rows that share a doc_id count as one document whose words are numbered in each row
    anew, so equal rows keep the same words. A null doc_id comes before all others. An empty table gives no rows.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"),
    )
    by_key = Window.partitionBy("key")
    anchors = own.select("text", "chunk").mapInArrow(
        _anchors(window), "key long, chunk int, path long, n byte, branches boolean, more binary"
    )
    flags = (
        anchors.select(
            "key", "chunk", "more",
            F.sum("n").over(by_key).alias("total"),
            (F.max("branches").over(by_key) | (F.min("path").over(by_key) != F.max("path").over(by_key))).alias("branches"),
        )
        .where("total > 1")
        .select("key", "chunk", "branches", "more")
        .mapInArrow(_expand, "key long, chunk int, branches boolean")
    )
    by_chunk = own.groupBy("chunk")
    places = by_chunk.cogroup(flags.groupBy("chunk")).applyInArrow(
        _coordinates(window), "key long, check int, chunk int, doc long, word int, n byte"
    )
    by_path = Window.partitionBy("key", "check")
    firsts = places.select(
        "key", "check", "chunk", F.sum("n").over(by_path).alias("total"), F.min(F.struct("doc", "word")).over(by_path).alias("first")
    ).where("total > 1").select("key", "check", "chunk", "first.doc", "first.word")
    return by_chunk.cogroup(firsts.groupBy("chunk")).applyInArrow(
        _cover(window),
        "doc_id long, n_words long, n_removed long, kept string, removed array<struct<start: long, stop: long>>",
    )
