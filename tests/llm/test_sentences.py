import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import decoders

from spindlewatch.llm import sentences

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = [
    None, "", " ", "   ", "a", " a", "a ", "a  b   c", "line\nline\n\n  indented\ttab", "x▁y ▁ z", "日本語 テキスト", "é ế ﬁ ½",
    "emoji 👩‍👩‍👧 \U0001F600\U0001F600", "<s> </s> <unk> <0x41>", "\x00\x01\x7f", "1234567890 3.14,15", "...,,, !!! ###", "a" * 3000,
    "hello " * 700, "don't can't I'm", "\r\n\r\n", "аб вг", "᠎᠎  　", "aaaaabaaab " * 50,
]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return sentences.Codec(PATH)


def noise(seed):
    rng = random.Random(seed)
    alphabet = [" ", "  ", "\n", "the", "ing", "Re", "é", "ß", "ión", ",", ".", "!!", "#", "9", "▁", "中", "th", "e", "aa"]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 200))) for _ in range(150)]


def split(ids, counts):
    ends = np.cumsum(counts)
    return [ids[e - c : e].tolist() for e, c in zip(ends, counts, strict=True)]


@pytest.mark.parametrize("texts", [HARD, noise(1), noise(2)], ids=["hard", "noise1", "noise2"])
def test_ids_and_texts_are_the_librarys(library, codec, texts):
    ids, counts = codec.encode(pa.array(texts, pa.string()))
    expected = [library.encode(t or "") for t in texts]
    assert split(ids, counts) == expected
    assert codec.decode(ids.astype(np.int64), counts).to_pylist() == [library.decode(i) for i in expected]


def test_real_documents(library, codec):
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").combine_chunks()
    ids, counts = codec.encode(texts)
    assert split(ids, counts) == [library.encode(t) for t in texts.to_pylist()]
    assert codec.decode(ids.astype(np.int64), counts).to_pylist() == texts.to_pylist()


def test_decoding_is_the_tokenizers_librarys(codec):
    ids, counts = codec.encode(pa.array(noise(3)))
    decoder = decoders.Sequence([decoders.Replace("▁", " "), decoders.ByteFallback(), decoders.Fuse(), decoders.Strip(" ", 1, 0)])
    pieces = [[codec.model.pieces[i][0] for i in run] for run in split(ids, counts)]
    assert codec.decode(ids.astype(np.int64), counts).to_pylist() == [decoder.decode(p) for p in pieces]


def test_broken_bytes_become_replacement_characters(codec):
    ids = np.array([3 + 0xC3, 3 + 0x28])
    assert codec.decode(ids, np.array([2, 0])).to_pylist() == ["�(", ""]


def test_unigram_models_are_rebuilt(tmp_path):
    """A model file of a unigram model, written field by field."""
    import struct

    def field(number, data):
        return bytes([number << 3 | 2]) + bytes([len(data) & 127 | (128 if len(data) > 127 else 0)]) + (bytes([len(data) >> 7]) if len(data) > 127 else b"") + data

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(f"<0x{i:02X}>", -20.0, 6) for i in range(256)]
    pieces += [("▁", -3.0, 1), ("▁a", -2.0, 1), ("b", -2.5, 1), ("ab", -2.2, 1), ("▁ab", -1.9, 1), ("a", -3.0, 1), ("c", -4.0, 1)]
    body = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + bytes([k])) for p, s, k in pieces)
    body += field(2, b"\x18\x01" + b"\x98\x02\x01") + field(3, b"\x18\x01\x20\x00\x28\x01")
    path = tmp_path / "unigram.model"
    path.write_bytes(body)
    own, library = sentences.Codec(str(path)), SentencePieceProcessor(model_file=str(path))
    texts = ["ab abab c", "a b  ab", "zab é", "", "cabcab"]
    ids, counts = own.encode(pa.array(texts))
    assert split(ids, counts) == [library.encode(t) for t in texts]


def test_documents(spark, documents, library):
    rows = list(enumerate(HARD)) + [(None, "no id"), (3, "same"), (3, "same")]
    docs = documents(rows).selectExpr("*", "1 AS ids", "2 AS n_tokens")
    out = sentences.encoded(docs, PATH)
    expected = []
    for i, t in rows:
        ids = library.encode(t or "")
        expected.append((i, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()), "▁" not in (t or "")))
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(expected, key=str)
    back = sentences.decoded(out, PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, (t or "").replace("▁", " ")) for i, t in rows), key=str)
    assert sentences.encoded(documents([]), PATH).collect() == []
