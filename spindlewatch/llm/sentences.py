"""SentencePiece encoding and decoding with the tokenizers library.

The model file is read as a protobuf message and rebuilt: its normaliser (the identity, or the character map the file
carries), the marker for white space, the pieces with their scores as a unigram model or as merges in order of score,
and byte fallback. Texts are encoded in batches, multithreaded, through a dictionary of distinct pieces of text, cut
only between two bytes that are neighbours in no piece of the model, where no token can reach across.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from spindlewatch.llm.pieces import Dictionary, spread
from spindlewatch.llm.words import slices

# Fixed values of the format: types of pieces, types of models, the marker.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
MARKER = "▁"
_SLICE = 4 << 20


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protobuf message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield tag >> 3, message[at : at + size]
        at += size


class Model:
    """What a model file says."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            parts = list(_fields(file.read()))
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict[int, int | bytes] = {}
        normaliser: dict[int, int | bytes] = {}
        for number, value in parts:
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.charsmap = normaliser.get(2, b"")
        self.dummy_prefix = bool(normaliser.get(3, 1))
        self.one_space = bool(normaliser.get(4, 1))
        self.escape = bool(normaliser.get(5, 1))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)
        if bool(trainer.get(24, 0)) or not self.escape or any(p[2] == USER_DEFINED for p in self.pieces):
            raise ValueError("suffix markers, unescaped white space and user-defined pieces are not supported")
        self.normal = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind == NORMAL}

    def merges(self) -> list[tuple[str, str]]:
        """All ways to make a piece of two others, the best-scored pieces first."""
        found = []
        for piece, i in self.normal.items():
            cuts = [(piece[:k], piece[k:]) for k in range(1, len(piece))]
            found += [(-self.pieces[i][1], i, n, cut) for n, cut in enumerate(cuts) if cut[0] in self.normal and cut[1] in self.normal]
        return [cut for *_, cut in sorted(found)]

    def build(self):
        """The model in the tokenizers library, for texts that have their dummy prefix already."""
        from tokenizers import Regex, Tokenizer, models, normalizers

        if self.kind == BPE:
            vocabulary = {p: i for i, (p, _, _) in enumerate(self.pieces)}
            model = models.BPE(
                vocab=vocabulary, merges=self.merges(), unk_token=self.pieces[self.unknown][0], fuse_unk=True,
                byte_fallback=self.byte_fallback,
            )
        elif self.kind == UNIGRAM:
            scored = [(p, score) for p, score, _ in self.pieces]
            model = models.Unigram(scored, unk_id=self.unknown, byte_fallback=self.byte_fallback)
        else:
            raise ValueError("only unigram and BPE models are supported")
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.one_space:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        if self.dummy_prefix and not self.simple:
            steps.append(normalizers.Prepend(" "))
        tokenizer = Tokenizer(model)
        tokenizer.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARKER)])
        return tokenizer

    @property
    def simple(self) -> bool:
        """Whether normalising is only escaping, so that any part of a text can be normalised by itself."""
        return not self.charsmap and not self.one_space

    def cuts(self) -> np.ndarray:
        """Whether a text can be cut between two bytes: both are ASCII (the space stands for the marker) and neighbours
        in no piece. Scores of unigram models weigh whole texts, but cut at such places they weigh the parts alike."""
        table = np.zeros((256, 256), bool)
        table[:128, :128] = True
        for piece in self.normal:
            plain = piece.replace(MARKER, " ")
            for a, b in zip(plain, plain[1:], strict=False):
                if a < "\x80" and b < "\x80":
                    table[ord(a), ord(b)] = False
        # Unknown characters in a row are one token where there is no byte fallback.
        return table if self.byte_fallback else np.zeros_like(table)


class Codec:
    """Encodes and decodes columns of texts."""

    def __init__(self, path: str):
        self.model = model = Model(path)
        self.tokenizer = model.build()
        self.table = model.cuts()
        self.dictionary = Dictionary(lambda pieces: [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)])
        spelled = [self._spelled(i) for i in range(len(model.pieces))]
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum([len(s) for s in spelled])])

    def _spelled(self, i: int) -> bytes:
        piece, _, kind = self.model.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARKER, " ").encode()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text; null counts as empty."""
        plain = texts.fill_null("").cast(pa.large_string())
        if not self.model.simple:
            made = [e.ids for e in self.tokenizer.encode_batch_fast(plain.to_pylist(), add_special_tokens=False)]
            return np.array([i for ids in made for i in ids], np.uint32), np.array([len(x) for x in made], np.int64)
        offsets = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1] if len(plain) else np.zeros(1, np.int64)
        low, high = int(offsets[0]), int(offsets[-1])
        if high == low:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        data, offsets = np.frombuffer(plain.buffers()[2], np.uint8)[low:high], offsets - low
        if self.model.dummy_prefix:
            full = np.diff(offsets) > 0
            data = np.insert(data, offsets[:-1][full], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        cut[1:-1] |= self.table[data[:-1], data[1:]]
        cuts = np.flatnonzero(cut)
        ids, counts = self.dictionary(data, cuts)
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(before[np.searchsorted(cuts, offsets)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text of each run of ids: bytes that are no UTF-8 become U+FFFD."""
        lengths = self.ends[ids + 1] - self.ends[ids]
        data = self.bytes[spread(self.ends[ids], lengths)]
        before = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(counts)])]
        if self.model.dummy_prefix:
            full = np.flatnonzero(np.diff(before) > 0)
            led = full[data[before[full]] == 32]
            keep = np.ones(len(data), bool)
            keep[before[led]] = False
            data = data[keep]
            shift = np.zeros(len(before), np.int64)
            shift[led + 1] = 1
            before = before - np.cumsum(shift)
        body = np.ascontiguousarray(data)
        raw = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(before.astype(np.int64)), pa.py_buffer(body)])
        try:
            return raw.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([x.as_py().decode(errors="replace") for x in raw], pa.large_string())


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_crc32, round_trip) of every row of ``docs``.

    ids are those of the model at ``path`` without any begin or end mark, ids_crc32 the unsigned checksum of them as
    32-bit little-endian integers. round_trip tells whether decoding gives the text back, which a text that holds the
    marker character itself does not. A null text is empty and has no ids; rows are coded one by one, so null and repeated
    doc_ids and equal rows need no rule; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            for a, b in slices(batch.column("text"), _SLICE):
                texts = batch.column("text").slice(a, b - a)
                ids, counts = own.encode(texts)
                back = own.decode(ids.astype(np.int64), counts)
                same = pc.equal(back, texts.fill_null("").cast(pa.large_string()))
                ends = np.concatenate([[0], np.cumsum(counts)])
                data = ids.astype("<u4").tobytes()
                checks = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(counts), lists, pa.array(checks, pa.int64()), same],
                    ["doc_id", "n_tokens", "ids", "ids_crc32", "round_trip"],
                )

    columns = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text")
    return columns.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, ids_crc32 long, round_trip boolean")


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            lists = batch.column("ids")
            counts = np.array(lists.value_lengths().fill_null(0), np.int64)
            flat = lists.flatten().to_numpy().astype(np.int64)
            texts = own.decode(flat, counts).cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts], ["doc_id", "text"])

    return rows.selectExpr("CAST(doc_id AS LONG) AS doc_id", "CAST(ids AS ARRAY<INT>) AS ids").mapInArrow(run, "doc_id long, text string")
