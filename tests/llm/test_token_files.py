import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindlewatch.llm import simple8b, token_files
from spindlewatch.llm.pieces import BytesDictionary, flat

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = [
    "Don't STOP, it's 3.5% <|endoftext|> <|ENDOFTEXT|>.", "J̌A É É! a̸.x ;: …, x…,", "don't'll 'S. I'M,you're.",
    " x　y\x1cz\x85.", None, "", "ΑΣ ΣΑΣ.", " tab\tnl\n\n.", "A.B.C.;:?!<x>.,", "\x0b\x0c", "ﬁ ½ Ⅷ ǅ İ", "a" * 500,
]


@pytest.mark.parametrize("n, high", [(0, 1), (1, 1), (5, 2**63), (9000, 50000), (9000, 3), (9000, 2**62)])
def test_simple8b_round_trip(n, high):
    rng = np.random.default_rng(n)
    values = rng.integers(0, high, n, dtype=np.uint64)
    if n > 50:
        values[::97] = np.uint64(2**64 - 1)
        values[100:400] = 0
        values[5000:5060] = np.uint64(1 << 60)
    for block in (1, 7, 4096):
        words, per_block, escaped, escapes = simple8b.encode(values, block)
        base = np.repeat(np.cumsum(escapes) - escapes, per_block)
        assert np.array_equal(simple8b.decode(words, escaped, base), values)


def test_small_ids_share_a_word():
    words, *_ = simple8b.encode(np.full(4096, 9, np.uint64))
    assert len(words) == 4096 // 15 + 1


def test_the_encoder_is_the_librarys_on_whole_texts():
    library = Tokenizer.from_file(PATH)
    encode = token_files.WordEncoder(PATH)
    for _ in range(2):
        ids, counts = encode(pa.array(HARD))
        ends = np.cumsum(counts)
        for text, end, count in zip(HARD, ends, counts, strict=True):
            assert ids[end - count : end].tolist() == library.encode(text or "", add_special_tokens=False).ids


def brute(rows):
    library = Tokenizer.from_file(PATH)
    out, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        data = np.array(ids, "<u4").tobytes()
        out.append((i, start, len(ids), zlib.crc32(data), data))
        start += len(ids)
    return out


def found(spark, df, **options):
    files = token_files.write_tokens(spark, df, PATH, **options)
    rows = token_files.read_tokens(files).collect()
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in rows), key=lambda r: r[1])


def test_files_hold_all_documents_in_order(spark, documents):
    rows = [((i * 7919) % 400, f"{HARD[i % len(HARD)]} number {i}" if i % 5 else HARD[i % len(HARD)]) for i in range(400)]
    assert found(spark, documents(rows)) == brute(rows)
    assert found(spark, documents(rows), file_ids=100) == brute(rows)


def test_null_and_repeated_ids_and_empty_tables(spark, documents):
    rows = [(None, "first"), (5, "same"), (5, "same"), (9, None)]
    assert found(spark, documents(rows)) == brute(rows)
    assert found(spark, documents([])) == []
    clash = documents([(1, "x")]).selectExpr("*", "1 AS at", "2 AS place", "3 AS ids", "4 AS start")
    assert found(spark, clash) == brute([(1, "x")])


def test_any_part_of_a_file_can_be_read(spark, documents):
    rows = [(i, f"words of document {i} " * 40) for i in range(200)]
    files = token_files.write_tokens(spark, documents(rows, 1), PATH).orderBy("start")
    whole = np.concatenate([np.frombuffer(r[4], "<u4") for r in brute(rows)])
    for f in files.collect():
        reader = token_files.Reader(f.file, f.bytes)
        own = whole[f.start : f.start + f.ids]
        for a, b in ((0, 1), (4095, 4097), (5000, 9000), (0, len(own)), (len(own) - 1, len(own)), (3, 3)):
            a, b = min(a, len(own)), min(b, len(own))
            assert np.array_equal(reader.ids(a, b), own[a:b])
    assert files.agg(F.sum("docs")).first()[0] == 200


def test_the_dictionary_forgets_the_older_half():
    seen = []

    def encode(names):
        seen.extend(names)
        return flat([[ord(c) for c in name] for name in names])

    known = BytesDictionary(encode, most=6)
    for words in (["a", "bb", "a"], ["ccc", "dd", "e"], ["ff", "g"], ["h"], ["h", "a", "ff", "bb", ""], ["x" * 3000], ["dd"]):
        data = np.frombuffer("".join(words).encode(), np.uint8)
        ids, counts = known(data, np.concatenate([[0], np.cumsum([len(w) for w in words])]))
        assert counts.tolist() == [len(w) for w in words] and bytes(ids.astype(np.uint8)).decode() == "".join(words)
    assert seen.count("a") == 2 and seen.count("ff") == 1


def test_pieces_encoded_together_have_the_ids_they_have_alone():
    rng = random.Random(5)
    tokenizer = Tokenizer.from_file(PATH)
    odd = [chr(c) for c in (0x85, 0xA0, 0x300, 0x308, 0xDF, 0x130, 0x200B, 0x200D, 0x3000, 0x4E00, 0xAC00, 0x1161, 0x1F600, 0xFE0F, 0xFB01, 0x0)]
    pieces = ["".join(rng.choice([*"abcXYZ019'<|>-.", *odd]) for _ in range(rng.randrange(1, 7))) for _ in range(5000)]
    pieces += ["".join(rng.choice("abcdefgéßñ\u0958ก") for _ in range(rng.randrange(1, 9))) for _ in range(5000)]
    pieces += ["<|endoftext|>", "a<|endoftext|>b", "'s", "\u0308", "\u200d", " "] * 9
    rng.shuffle(pieces)
    ids, counts = token_files._Together(tokenizer)(pieces)
    alone, each = flat([e.ids for e in tokenizer.encode_batch(pieces, add_special_tokens=False)])
    assert np.array_equal(counts, each) and np.array_equal(ids, alone)
