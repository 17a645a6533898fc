"""Phrases whose words occur together more often than their parts suggest, counted over a prefix-free parse of the texts.

Three words of a text whose hash is a multiple of ``period`` are a trigger. A chunk runs from a trigger to the end of the
next one, so equal stretches of text are cut alike wherever they stand, and neighbours share the trigger's three words.
The distinct chunks and the numbers of their occurrences, the dictionary of the parse, replace the texts from then on:
what occurs in many copies is read once and weighs as much as all of them. A phrase of up to four words lies whole in the
chunk that holds its last word behind the shared ones (the first chunk of a text shares none); only there it counts, once.

Most phrases are rare, so hashes are counted before phrases: first of pairs, then of words in frequent pairs and of longer
phrases whose pairs are all frequent, as a part is at least as frequent as the whole. Bitmaps keep the hashes that are
frequent enough, and the phrases themselves are counted where theirs are set. Phrases whose hashes or bits meet get through to that exact count
together; none is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindlewatch.llm.words import SLICE_BYTES, Rolling, Words, slices
from spindlewatch.shared import written

LONGEST = 4
LEAST = 30
SUBSUMED = 80
TOP = 2000
PERIOD = 64
_SHARED = LONGEST - 1

# A bitmap has 128 bits or more for each hash that is set, within these bounds (as logarithms), and is made in blocks.
LEAST_BITS, MOST_BITS = 20, 30
_BLOCK_BITS = 17
# Pairs are counted over slices of this size: the more at once, the fewer rows.
_PAIRS_SLICE = 4 << 20

_SPACE, _BREAK = 0x20, 0x0A
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[65:91] += 32
_PLAIN[0x09] = _SPACE
_PLAIN[[0x0A, 0x0B, 0x0C, 0x0D, *b".,;:!?"]] = _BREAK


def _strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The byte ranges of ``data`` as strings."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    body = data.tobytes()
    parts = b"".join([body[a:b] for a, b in zip(starts.tolist(), (starts + lengths).tolist(), strict=True)])
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(parts))


def _plain(texts: pa.Array) -> pa.Array:
    """Lower case for A to Z, one byte for all white space within pieces and another for all that parts pieces."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(_PLAIN[data]))


def chunks(texts: pa.Array, period: int = PERIOD) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, whether it is the row's first, and words of each chunk, with one space or, between pieces, a line feed."""
    words = Words(_plain(texts))
    n = len(words)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, bool), pa.array([], pa.large_string())
    inner = np.zeros(n, bool)
    inner[1:] = words.row[1:] == words.row[:-1]
    breaks = np.concatenate([[0], np.cumsum(words.data == _BREAK)])
    parted = np.zeros(n, bool)
    parted[1:] = breaks[words.start[1:]] > breaks[words.stop[:-1]]

    ends = np.zeros(n, bool)
    ends[:-1] = ~inner[1:]
    ends[-1] = True
    if n >= _SHARED:
        within = words.row[_SHARED - 1 :] == words.row[: n - _SHARED + 1]
        ends[_SHARED - 1 :] |= within & (Rolling(words.hashes()).windows(_SHARED) % np.uint64(period) == 0)
    last = np.flatnonzero(ends)
    row = words.row[last]
    head = np.ones(len(last), bool)
    head[1:] = row[1:] != row[:-1]
    begin = words.first[row]
    begin[1:] = np.where(head[1:], begin[1:], last[:-1] - _SHARED + 1)

    data, kept = words.data.copy(), ~words.spaces
    before = words.start[inner] - 1
    data[before] = np.where(parted[inner], _BREAK, _SPACE)
    kept[before] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    start, stop = place[words.start[begin]], place[words.stop[last]]
    return row, head, _strings(data[kept], start, stop - start)


def _parsed(batches: Iterator[pa.RecordBatch], period: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, langs = batch.column("text"), batch.column("lang")
        for a, b in slices(texts):
            row, head, words = chunks(texts.slice(a, b - a), period)
            table = pa.table({"lang": langs.slice(a, b - a).take(pa.array(row)), "head": head, "chunk": words})
            table = table.group_by(["lang", "head", "chunk"]).aggregate([([], "count_all")])
            yield from table.rename_columns(["lang", "head", "chunk", "n"]).to_batches()


def parse(docs: DataFrame, period: int = PERIOD) -> DataFrame:
    """(lang, head, chunk, n): the distinct chunks of the texts of each language and how often they occur."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    found = texts.mapInArrow(partial(_parsed, period=period), "lang string, head boolean, chunk string, n long")
    return found.groupBy("lang", "head", "chunk").agg(F.sum("n").alias("n"))


def _marks(langs: pa.Array) -> np.ndarray:
    """64 bits for the language of each row."""
    coded = langs.dictionary_encode()
    values = [int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest(), "little") for v in coded.dictionary.to_pylist()]
    return np.array(values, np.uint64)[coded.indices.to_numpy()] if values else np.zeros(0, np.uint64)


class _Chunks:
    """The words of a slice of the dictionary, with the hashes of their runs and where each run counts."""

    def __init__(self, batch: pa.RecordBatch):
        self.words = words = Words(batch.column("chunk"))
        self.langs, self.weight = batch.column("lang"), batch.column("n").to_numpy()
        self.rolling = Rolling(words.hashes() + _marks(self.langs)[words.row])
        self.own = words.first[:-1] + np.where(batch.column("head").to_numpy(zero_copy_only=False), 0, _SHARED)
        parted = np.zeros(len(words), np.int64)
        parted[1:] = words.data[words.start[1:] - 1] == _BREAK
        self.piece = np.cumsum(parted)

    def hashes(self, length: int) -> np.ndarray:
        """Of the run of ``length`` words that begins at each word."""
        return self.rolling.windows(length, length)

    def together(self, length: int) -> np.ndarray:
        """Whether the run that begins at each word lies in one chunk and one piece."""
        n = max(0, len(self.words) - length + 1)
        return (self.words.row[length - 1 :] == self.words.row[:n]) & (self.piece[length - 1 :] == self.piece[:n])

    def counts(self, length: int) -> np.ndarray:
        """Whether it also counts in this chunk."""
        together = self.together(length)
        return together & (np.arange(length - 1, length - 1 + len(together)) >= self.own[self.words.row[: len(together)]])


def _slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[_Chunks]:
    for batch in batches:
        for a, b in slices(batch.column("chunk"), most):
            yield _Chunks(batch.slice(a, b - a))


def is_set(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bits of the hashes are set; a bitmap has a power of two of bytes."""
    bits = (hashes >> np.uint64(64 - 3 - (len(bitmap).bit_length() - 1))).astype(np.int64)
    return (bitmap[bits >> 3] >> (7 - (bits & 7)).astype(np.uint8)) & 1 == 1


def _paired(common: np.ndarray, length: int) -> np.ndarray:
    """By ``common``, whether the pair that begins at each word is frequent: for runs of words, whether all their pairs are,
    for single words, whether one of theirs is."""
    if length == 1:
        return np.concatenate([common, [False]]) | np.concatenate([[False], common])
    out = common[: max(0, len(common) - length + 2)].copy()
    for at in range(1, length - 1):
        out &= common[at : at + len(out)]
    return out


def _grouped(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct hash stands first, and the sum of its weights. At least one hash."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return order[first], np.add.reduceat(weights[order], first)


def _sums(hashes: np.ndarray, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(hashes):
        at, sums = _grouped(hashes, weights)
        yield pa.RecordBatch.from_arrays([pa.array(hashes[at].view(np.int64)), pa.array(sums)], ["hash", "n"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of all pairs and their weights."""
    for chunks in _slices(batches, _PAIRS_SLICE):
        at = np.flatnonzero(chunks.counts(2))
        yield from _sums(chunks.hashes(2)[at], chunks.weight[chunks.words.row[at]])


def _others(batches: Iterator[pa.RecordBatch], pairs: Broadcast) -> Iterator[pa.RecordBatch]:
    """Hashes of longer phrases whose pairs are all frequent and their weights, and of words in frequent pairs. A word may
    count twice here, in two chunks, but none less often than its most frequent pair."""
    for chunks in _slices(batches):
        common = is_set(pairs.value, chunks.hashes(2)) & chunks.together(2)
        found = [np.flatnonzero(_paired(common, 1))]
        found += [np.flatnonzero(chunks.counts(length) & _paired(common, length)) for length in range(3, LONGEST + 1)]
        hashes = [chunks.hashes(length)[at] for length, at in zip((1, *range(3, LONGEST + 1)), found, strict=True)]
        yield from _sums(np.concatenate(hashes), chunks.weight[chunks.words.row[np.concatenate(found)]])


def _block(table: pa.Table) -> pa.Table:
    bits = np.zeros(1 << _BLOCK_BITS, np.uint8)
    place = table["bit"].to_numpy()
    bits[place & ((1 << _BLOCK_BITS) - 1)] = 1
    return pa.table({"block": [int(place[0]) >> _BLOCK_BITS], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def bitmap(spark: SparkSession, hashes: DataFrame) -> Broadcast:
    """The first bits of each hash as a bitmap, made block by block; 128 MB at most, for any number of hashes."""
    size = min(MOST_BITS, max(LEAST_BITS, (128 * hashes.count()).bit_length()))
    bits = hashes.select(F.shiftrightunsigned("hash", 64 - size).alias("bit")).distinct()
    blocks = bits.groupBy(F.shiftright("bit", _BLOCK_BITS)).applyInArrow(_block, "block long, bits binary").collect()
    out = np.zeros((1 << size - _BLOCK_BITS, 1 << _BLOCK_BITS - 3), np.uint8)
    for row in blocks:
        out[row.block] = np.frombuffer(row.bits, np.uint8)
    return spark.sparkContext.broadcast(out.ravel())


def _phrases(batches: Iterator[pa.RecordBatch], pairs: Broadcast, others: Broadcast) -> Iterator[pa.RecordBatch]:
    """Phrases whose bits are set and their weights. An empty phrase has each language's number of words."""
    for chunks in _slices(batches):
        words, coded = chunks.words, chunks.langs.dictionary_encode()
        lang = coded.indices.to_numpy()
        own = np.bincount(words.row[chunks.counts(1)], minlength=len(lang))
        columns = [(lang, pa.array([""] * len(lang), pa.large_string()), own * chunks.weight)]
        common = is_set(pairs.value, chunks.hashes(2)) & chunks.together(2)
        for length in range(1, LONGEST + 1):
            hashes, ok = chunks.hashes(length), chunks.counts(length)
            if length > 1:
                ok &= _paired(common, length)
            if length != 2:
                ok &= is_set(others.value, hashes)
            if ok.any():
                at = np.flatnonzero(ok)
                first, sums = _grouped(hashes[at], chunks.weight[words.row[at]])
                at = at[first]
                texts = _strings(words.data, words.start[at], words.stop[at + length - 1] - words.start[at])
                columns.append((lang[words.row[at]], texts, sums))
        langs, texts, sums = zip(*columns, strict=True)
        names = coded.dictionary.take(pa.array(np.concatenate(langs)))
        yield pa.RecordBatch.from_arrays([names, pa.concat_arrays(texts), pa.array(np.concatenate(sums))], ["lang", "phrase", "f"])


def counted(spark: SparkSession, dictionary: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, f): the phrases of up to ``LONGEST`` words with at least ``least`` occurrences, and as those of the
    empty phrase the number of all words of the language."""

    def frequent(rows: DataFrame, name: str) -> Broadcast:
        sums = rows.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("hash")
        return bitmap(spark, written(spark, sums, name))

    hashes = "hash long, n long"
    pairs = frequent(dictionary.mapInArrow(_pairs, hashes), "pairs")
    others = frequent(dictionary.mapInArrow(partial(_others, pairs=pairs), hashes), "others")
    rows = dictionary.mapInArrow(partial(_phrases, pairs=pairs, others=others), "lang string, phrase string, f long")
    sums = rows.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    return written(spark, sums.where((F.col("f") >= least) | (F.col("phrase") == "")), "phrases")


def _run(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored(phrases: DataFrame, parts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) by the worst of each phrase's cuts; of equal ones by the first.

    Products and sums are decimals, so counts may be as large as a long holds.
    """
    words = F.split("phrase", " ")
    cuts = phrases.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.size(words) - 1)).alias("k"))
    cuts = cuts.select(
        "*", _run(words, F.lit(1), F.col("k")).alias("left"), _run(words, F.col("k") + 1, F.size(words) - F.col("k")).alias("rest")
    )
    left = parts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rest = parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    score = F.expr("CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0)))")
    both = cuts.join(left, ["lang", "left"]).join(rest, ["lang", "rest"]).withColumn("score", score)
    worst = both.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return worst.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def not_subsumed(phrases: DataFrame, candidates: DataFrame, subsumed: int = SUBSUMED) -> DataFrame:
    """``phrases`` without those that lie in a longer candidate at least ``subsumed`` percent as frequent."""
    words = F.split("phrase", " ")
    size = F.size(words)
    lengths = F.explode(F.when(size > 2, F.sequence(F.lit(2), size - 1)).otherwise(F.array().cast("array<int>")))
    inner = candidates.select("lang", "f", words.alias("words"), lengths.alias("length"))
    inner = inner.select("lang", "f", "words", "length", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1)).alias("at"))
    inner = inner.select("lang", _run(F.col("words"), F.col("at"), F.col("length")).alias("phrase"), "f")
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    gone = F.col("longer").cast("decimal(19,0)") * 100 >= F.col("a").cast("decimal(19,0)") * subsumed
    return phrases.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | ~gone).drop("longer")


def collocations(
    spark: SparkSession, docs: DataFrame, least: int = LEAST, subsumed: int = SUBSUMED, top: int = TOP, period: int = PERIOD
) -> DataFrame:
    """The ``top`` phrases of each language as (lang, rank, phrase, a, l, r, n, score).

    ``a`` is the phrase's number of occurrences, ``l`` and ``r`` those of the parts of its worst cut, ``n`` the number of
    all words of the language. Ranks go by score and ``a``, largest first, then by the bytes of the phrase, so there are
    no ties. A null language is ``und``, a null or empty text has no words, equal rows all count. A language without a
    phrase that occurs ``least`` times gives no row, an empty table gives none. Other columns are ignored. Texts may be of
    any length; a chunk is as long as a text at most.
    """
    dictionary = written(spark, parse(docs, period), "chunks")
    counts = counted(spark, dictionary, least)
    parts = counts.where("phrase != ''")
    candidates = parts.where(F.instr("phrase", " ") > 0)
    kept = not_subsumed(scored(candidates, parts), candidates, subsumed)
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    totals = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


# The same in SQL, over whole texts.
ORACLE = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, regexp_extract_all(words, '[^\x20\x09]+') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(
          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS words
        FROM documents)
), words AS MATERIALIZED (
  SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM pieces
), runs AS MATERIALIZED (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4
  FROM words WINDOW p AS (PARTITION BY piece ORDER BY i)
), f AS MATERIALIZED (
  SELECT lang, 1 AS m, w1 AS phrase, count(*) AS f FROM runs GROUP BY ALL
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 AS phrase, count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 AS phrase, count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 AS phrase, count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY ALL
), n AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang
), candidates AS MATERIALIZED (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 30
), known AS MATERIALIZED (
  SELECT lang, phrase, f FROM f WHERE f >= 30
), halves AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(w[1 : k], ' ') AS first, array_to_string(w[k + 1 : m], ' ') AS rest
  FROM candidates, (VALUES (1), (2), (3)) AS cut(k) WHERE k < m
), firsts AS MATERIALIZED (
  SELECT h.*, f AS l FROM halves AS h JOIN known ON known.lang = h.lang AND known.phrase = h.first
), cuts AS MATERIALIZED (
  SELECT c.lang, c.phrase, a, k, l, f AS r, (2000000::HUGEINT * a) // (l::HUGEINT + f) AS score
  FROM firsts AS c JOIN known ON known.lang = c.lang AND known.phrase = c.rest
), worst AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), parts AS (
  SELECT lang, a, array_to_string(w[i : i + j - 1], ' ') AS phrase
  FROM (SELECT lang, a, w, j, unnest(range(1, m - j + 2)) AS i FROM candidates, (VALUES (2), (3)) AS lengths(j) WHERE j < m)
), longer AS (
  SELECT lang, phrase, max(a) AS longer FROM parts GROUP BY ALL
), ranked AS (
  SELECT worst.*, row_number() OVER (PARTITION BY worst.lang ORDER BY score DESC, a DESC, worst.phrase) AS rank
  FROM worst LEFT JOIN longer USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n,
       CAST(score AS BIGINT) AS score
FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
