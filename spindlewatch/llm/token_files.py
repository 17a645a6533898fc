"""Token ids of documents in binary files, Simple-8b coded, in ascending order of doc_id.

A file is: MAGIC; the words of all blocks; the escaped values; the footer; its size; MAGIC. All numbers are
little-endian. The footer has the numbers of documents, blocks, words, escapes and ids, then the doc_ids, a byte for each
that tells whether it is null, the number of ids of each document, and of each block the place of its first word and of
its first escape, so that any block can be decoded by itself.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindlewatch.llm import simple8b
from spindlewatch.llm.files import make_folder, new_file, read_range
from spindlewatch.llm.pieces import BytesDictionary, spread
from spindlewatch.llm.words import Words, slices
from spindlewatch.shared import scratch_path, written

MAGIC = b"SPIDS8B1"
FILE_IDS = 1 << 25
_SLICE = 4 << 20
# So many pieces are one text for the library.
_TOGETHER = 256

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,;:!?")] = True


class _Together:
    """Ids of pieces, many of them encoded as one text with spaces between them, which saves an Encoding for each.

    A piece of letters alone is one word to the tokenizer, so its ids end with the first that ends a word; should a lot
    have more words than pieces, as normalisation may part letters from marks, and for all other pieces, offsets tell.
    """

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        suffix = json.loads(tokenizer.to_str())["model"].get("end_of_word_suffix")
        vocabulary = tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.ends[[number for token, number in vocabulary.items() if token.endswith(suffix)]] = True

    def __call__(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words = np.fromiter(map(str.isalpha, pieces), bool, len(pieces))
        order = np.argsort(~words, kind="stable")
        pieces = [pieces[k] for k in order.tolist()]
        lots = [pieces[at : at + _TOGETHER] for at in range(0, len(pieces), _TOGETHER)]
        plain = int(words.sum()) // _TOGETHER
        found = self._by_word_ends(lots[:plain]) + self._by_offsets(lots[plain:])
        ids, counts = map(np.concatenate, zip(*found, strict=True))
        starts = np.empty(len(pieces), np.int64)
        sizes = np.empty(len(pieces), np.int64)
        starts[order], sizes[order] = np.cumsum(counts) - counts, counts
        return ids[spread(starts, sizes)], sizes

    def _by_word_ends(self, lots: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for lot, found in zip(lots, self.tokenizer.encode_batch_fast([" ".join(lot) for lot in lots], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            last = np.flatnonzero(self.ends[ids])
            if len(last) == len(lot) and last[-1] == len(ids) - 1:
                out.append((ids, np.diff(last, prepend=-1)))
            else:
                out += self._by_offsets([lot])
        return out

    def _by_offsets(self, lots: list[list[str]]) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for lot, found in zip(lots, self.tokenizer.encode_batch([" ".join(lot) for lot in lots], add_special_tokens=False), strict=True):
            begins = np.cumsum([0, *(len(piece) + 1 for piece in lot[:-1])])
            places = np.fromiter((start for start, _ in found.offsets), np.int64, len(found.ids))
            out.append((np.array(found.ids, np.uint32), np.bincount(np.searchsorted(begins, places, "right") - 1, minlength=len(lot))))
        return out


class WordEncoder:
    """Ids of whole texts by a tokenizer that drops white space, lower-cases, and never joins a letter to punctuation.

    Texts are cut at ASCII white space and between an ASCII letter and one of ``.,;:!?``. Words of ASCII alone are
    lower-cased before they are looked up; others are left to the library, as case and accents may interact, and so are
    words with ``<``, which may be special tokens.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.dictionary = BytesDictionary(_Together(tokenizer))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        words = Words(texts)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        inside = ~words.spaces
        body = words.data[inside]
        size = words.stop - words.start
        at = np.concatenate([[0], np.cumsum(size)])
        other = np.add.reduceat((body >= 128) | (body == 60), at[:-1]) > 0
        upper = (body >= 65) & (body <= 90) & ~np.repeat(other, size)
        body = body + np.where(upper, np.uint8(32), np.uint8(0))
        cut = np.zeros(len(body) + 1, bool)
        cut[at] = True
        cut[1:-1] |= _LETTER[body[:-1]] & _STOP[body[1:]]
        cuts = np.flatnonzero(cut)
        ids, counts = self.dictionary(body, cuts)
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(before[np.searchsorted(cuts, at[words.first])])


@lru_cache(2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class _File:
    """A token file that is being written, block by block."""

    def __init__(self, stream):
        self.stream = stream
        self.size = stream.write(MAGIC)
        self.ids: list[int | None] = []
        self.counts: list[np.ndarray] = []
        self.per_block: list[np.ndarray] = []
        self.escaped: list[np.ndarray] = []
        self.escapes: list[np.ndarray] = []
        self.rest = np.zeros(0, np.uint32)
        self.n_ids = 0

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def _code(self, values: np.ndarray) -> None:
        words, per_block, escaped, escapes = simple8b.encode(values)
        self._write(words.astype("<u8").tobytes())
        self.per_block.append(per_block)
        self.escaped.append(escaped)
        self.escapes.append(escapes)

    def add(self, ids: list[int | None], counts: np.ndarray, values: np.ndarray) -> None:
        self.ids += ids
        self.counts.append(counts)
        self.n_ids += len(values)
        values = np.concatenate([self.rest, values])
        whole = len(values) // simple8b.BLOCK * simple8b.BLOCK
        self._code(values[:whole])
        self.rest = values[whole:].copy()

    def close(self) -> None:
        self._code(self.rest)
        per_block, escapes = np.concatenate(self.per_block), np.concatenate(self.escapes)
        escaped = np.concatenate(self.escaped)
        self._write(escaped.astype("<u8").tobytes())
        footer = b"".join(
            x.tobytes()
            for x in (
                np.array([len(self.ids), len(per_block), per_block.sum(), len(escaped), self.n_ids], "<u8"),
                np.array([i or 0 for i in self.ids], "<i8"), np.array([i is None for i in self.ids], np.uint8),
                np.concatenate(self.counts).astype("<u8"),
                (np.cumsum(per_block) - per_block).astype("<u8"), (np.cumsum(escapes) - escapes).astype("<u8"),
            )
        )
        self._write(footer + len(footer).to_bytes(8, "little") + MAGIC)


class Reader:
    """A token file: its documents, and the ids of any of them."""

    def __init__(self, uri: str, size: int):
        tail = read_range(uri, size - 16, 16)
        if tail[8:] != MAGIC or read_range(uri, 0, 8) != MAGIC:
            raise ValueError(f"{uri} is no whole token file")
        length = int.from_bytes(tail[:8], "little")
        footer = read_range(uri, size - 16 - length, length)
        docs, blocks, self.words, self.escapes, self.n_ids = (int(x) for x in np.frombuffer(footer, "<u8", 5))
        at = 40
        self.doc_ids = np.frombuffer(footer, "<i8", docs, at)
        self.null = np.frombuffer(footer, np.uint8, docs, at + 8 * docs).astype(bool)
        self.counts = np.frombuffer(footer, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.block_words = np.append(np.frombuffer(footer, "<u8", blocks, at + 17 * docs).astype(np.int64), self.words)
        self.block_escapes = np.append(np.frombuffer(footer, "<u8", blocks, at + 17 * docs + 8 * blocks).astype(np.int64), self.escapes)
        self.uri = uri

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids number ``start`` to ``stop`` of the file; only their blocks are read."""
        if stop <= start:
            return np.zeros(0, np.uint64)
        low, high = start // simple8b.BLOCK, (stop - 1) // simple8b.BLOCK + 1
        w0, w1 = self.block_words[low], self.block_words[high]
        e0, e1 = self.block_escapes[low], self.block_escapes[high]
        words = np.frombuffer(read_range(self.uri, 8 + 8 * int(w0), 8 * int(w1 - w0)), "<u8")
        escaped = np.frombuffer(read_range(self.uri, 8 + 8 * int(self.words + e0), 8 * int(e1 - e0)), "<u8")
        base = np.repeat(self.block_escapes[low:high] - e0, np.diff(self.block_words[low : high + 1]))
        found = simple8b.decode(words, escaped, base)
        return found[start - low * simple8b.BLOCK : stop - low * simple8b.BLOCK]


def _writer(folder: str, path: str, end: int, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        lots = (
            (batch.column("text").slice(a, b - a), batch.column("doc_id").slice(a, b - a), batch.column("place")[a].as_py())
            for batch in batches
            for a, b in slices(batch.column("text"), _SLICE)
        )
        lot = next(lots, None)
        while lot is not None:
            place = lot[2]
            with new_file(folder, ".ids") as (uri, stream):
                file = _File(stream)
                while lot is not None and file.n_ids < file_ids:
                    found, count = encode(lot[0])
                    file.add(lot[1].to_pylist(), count + 1, np.insert(found, np.cumsum(count), end))
                    lot = next(lots, None)
                file.close()
            row = {"file": [uri], "bytes": [file.size], "place": [place], "ids": [file.n_ids], "docs": [len(file.ids)]}
            yield pa.RecordBatch.from_pydict(row)

    return run


def write_tokens(
    spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str | None = None, end: int = 2, file_ids: int = FILE_IDS
) -> DataFrame:
    """Write the ids of every text of ``docs``, each followed by ``end``, and return the files in order:
    (file, bytes, place, ids, docs, start), where ``start`` counts the ids of all files before.

    Null texts are empty. Rows with a null doc_id come first; rows that share a doc_id stand in the order of the
    input. The texts are dealt by ranges of doc_id, cut by the place in the input where many rows share one.
    """
    folder = folder or scratch_path(spark, "tokens")
    make_folder(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("at"))
    ranged = rows.repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at")
    ranged = ranged.select("doc_id", "text", F.monotonically_increasing_id().alias("place"))
    files = ranged.mapInArrow(_writer(folder, tokenizer, end, file_ids), "file string, bytes long, place long, ids long, docs long")
    # One row for each file.
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return written(spark, files, "files").withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            file = Reader(uri, size)
            ends = np.cumsum(file.counts)
            doc = 0
            while doc < len(ends):
                base = int(ends[doc - 1]) if doc else 0
                stop = max(doc + 1, int(np.searchsorted(ends, base + (1 << 20), "right")))
                ids = file.ids(base, int(ends[stop - 1])).astype("<u4")
                cut = ends[doc:stop] - base
                data, offsets = ids.tobytes(), np.concatenate([[0], cut])
                checks = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(file.doc_ids[doc:stop], mask=file.null[doc:stop]),
                        pa.array(start + base + offsets[:-1]), pa.array(file.counts[doc:stop]), pa.array(checks, pa.int64()),
                        pa.array([data[4 * a : 4 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                )
                doc = stop


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document of ``files`` as `write_tokens` returns them.

    ids are unsigned 32-bit little-endian integers, as are those of the checksum; n_tokens has the end id in it.
    """
    named = files.select("file", "bytes", "start")
    # A task for each file: by their rows alone they would all be merged into one.
    return named.repartition(max(1, files.count()), "file").mapInArrow(
        _reader, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    )
