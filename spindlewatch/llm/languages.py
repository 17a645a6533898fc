"""Language identification in two steps: the family first, then the language within it.

Each step is decided by linear support vector machines, one for each pair of families, then one for each pair of
languages of the chosen family. A machine votes for one of its two; the most votes win, then the larger margins. Telling
French from Spanish is so learnt from French and Spanish alone, with weights of its own.

A text's features are the shares of its hashed letter trigrams and of its hashed words, without case, digits and
punctuation. A machine's margin is their sparse dot product with its weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.llm.words import Words, slices

UNKNOWN = "und"
# A machine learns from about this many texts of each of its two sides, chosen by a hash of the text.
SIDE_ROWS = 2_000
EPOCHS = 12
_BITS = 16
_SIZE = (2 << _BITS) + 1
_SCALE = 20.0
_COST = 1.0

# Languages by family. Any other language is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca co es fr gl it oc pt rm ro sc",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "uralic": "et fi hu",
    "turkic": "az kk ky tk tr tt ug uz",
    "iranian": "fa ku ps tg",
    "indic": "as bn gu hi mr ne or pa sd si ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "austronesian": "id jv mg mi ms su tl",
    "bantu": "ny rw sn sw xh zu",
    "chinese": "yue zh",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}

_SPACE = 0x20
_LETTERS = np.full(256, _SPACE, np.uint8)
_LETTERS[97:123] = _LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def family_of(lang: str) -> str:
    """The family of a language code, whatever its case and region: ``de-AT`` is as ``de``."""
    return _FAMILY.get(lang.lower().replace("_", "-").split("-")[0], f"={lang}")


class Features:
    """Hashed trigrams and words of a column of texts, one after another, with the number of each text's."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        body = texts.buffers()[2] if len(texts) else None
        data = _LETTERS[np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]]] if body is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        plain = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(data))

        inner = np.zeros(len(data), bool)
        inner[:-2] = data[1:-1] != _SPACE
        for back in (1, 2):
            ends = offsets[1:][np.diff(offsets) >= back] - back
            inner[ends] = False
        at = np.flatnonzero(inner)
        code = (data[at].astype(np.uint32) << 16) | (data[at + 1].astype(np.uint32) << 8) | data[at + 2]
        self.trigrams = ((code * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)).astype(np.int32)
        self.trigram_counts = np.diff(np.searchsorted(at, offsets))
        words = Words(plain)
        self.words = ((words.hashes() >> np.uint64(64 - _BITS)).astype(np.int32)) + (1 << _BITS)
        self.word_counts = np.diff(words.first)

    def margins(self, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Of one machine, for the chosen ``rows`` (booleans): equal for equal texts wherever they stand."""
        out = np.full(int(rows.sum()), float(weights[-1]))
        for grams, counts in ((self.trigrams, self.trigram_counts), (self.words, self.word_counts)):
            own = counts[rows]
            some = own > 0
            if some.any():
                values = weights[grams[np.repeat(rows, counts)]].astype(np.float64)
                starts = np.concatenate([[0], np.cumsum(own[some])[:-1]])
                out[some] += _SCALE * np.add.reduceat(values, starts) / own[some]
        return out

    def sparse(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(Places, values) of each text, the constant one included."""
        a = np.split(self.trigrams, np.cumsum(self.trigram_counts)[:-1])
        b = np.split(self.words, np.cumsum(self.word_counts)[:-1])
        for trigrams, words in zip(a, b, strict=True):
            i, n = np.unique(trigrams, return_counts=True)
            j, m = np.unique(words, return_counts=True)
            values = np.concatenate([_SCALE * n / max(1, len(trigrams)), _SCALE * m / max(1, len(words)), [1.0]])
            yield np.concatenate([i, j, [_SIZE - 1]]).astype(np.int32), values.astype(np.float32)


def train(rows: Sequence[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, cost: float = _COST) -> np.ndarray:
    """Weights of a linear support vector machine over rows of (places, values, side 1 or -1), by dual coordinate descent.

    Both sides weigh the same together, however many rows each has.
    """
    weights = np.zeros(_SIZE)
    sides = np.array([side for _, _, side in rows])
    bound = cost * np.where(sides > 0, len(rows) / max(1, 2 * (sides > 0).sum()), len(rows) / max(1, 2 * (sides < 0).sum()))
    size = [float(np.dot(x.astype(np.float64), x)) for _, x, _ in rows]
    alpha = np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            place, x, side = rows[k]
            slope = side * float(weights[place] @ x) - 1
            new = min(max(alpha[k] - slope / size[k], 0.0), bound[k])
            if new != alpha[k]:
                weights[place] += (new - alpha[k]) * side * x
                alpha[k] = new
    return weights


@dataclass
class Model:
    """Languages by family, and the weights of the machines. A machine is (family, language, language), or (None, family,
    family); a positive margin is for the first of its two."""

    languages: dict[str, list[str]] = field(default_factory=dict)
    machines: dict[tuple[str | None, str, str], np.ndarray] = field(default_factory=dict)

    def pairs(self) -> list[tuple[str | None, str, str]]:
        levels = [(None, sorted(self.languages)), *sorted(self.languages.items())]
        return [(level, a, b) for level, names in levels for a, b in combinations(names, 2)]

    def winners(self, level: str | None, names: list[str], features: Features, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the chosen rows the place in ``names`` of the winner, and the least of its chances against the others."""
        n = int(rows.sum())
        votes, sums = np.zeros((n, len(names))), np.zeros((n, len(names)))
        chance = np.ones((n, len(names)))
        for a, b in combinations(range(len(names)), 2):
            margin = features.margins(self.machines[level, names[a], names[b]], rows)
            for own, m in ((a, margin), (b, -margin)):
                votes[:, own] += (m > 0) if own == a else (m >= 0)
                sums[:, own] += m
                chance[:, own] = np.minimum(chance[:, own], 1 / (1 + np.exp(-np.clip(2 * m, -35, 35))))
        # Margins decide between equal votes only: scaled to less than half a vote.
        best = np.argmax(votes + sums / (1 + 2 * np.abs(sums).max(axis=1, initial=0, keepdims=True)), axis=1)
        return best, chance[np.arange(n), best]

    def predict(self, texts: pa.Array, lettered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each text; those without a letter, or all if nothing was learnt, are unknown, score 0."""
        langs, scores = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if not self.languages or not lettered.any():
            return langs, scores
        features = Features(texts)
        families = sorted(self.languages)
        at = np.flatnonzero(lettered)
        family, chance = self.winners(None, families, features, lettered)
        for f, name in enumerate(families):
            own = at[family == f]
            if len(own):
                rows = np.zeros(len(texts), bool)
                rows[own] = True
                best, within = self.winners(name, self.languages[name], features, rows)
                langs[own] = np.array(self.languages[name], object)[best]
                scores[own] = chance[family == f] * within
        return langs, scores


def _held_out() -> Column:
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def _lettered() -> Column:
    return F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))


def learned(docs: DataFrame, side_rows: int = SIDE_ROWS) -> Model:
    """The machines, from the documents that are not held out, have a language and a letter.

    Each side of a machine learns from about ``side_rows`` distinct texts, chosen by a hash of the text, from all if there
    are fewer. To the driver come one row for each language and the weights, half a megabyte a machine.
    """
    usable = docs.where(~_held_out()).where("lang IS NOT NULL").where(_lettered())
    usable = usable.select("lang", "text", F.xxhash64("text").alias("key"))
    sizes = {r.lang: r.n for r in usable.groupBy("lang").agg(F.approx_count_distinct("key").alias("n")).collect()}
    model = Model()
    for lang in sorted(sizes):
        model.languages.setdefault(family_of(lang), []).append(lang)
    pairs = model.pairs()
    if not pairs:
        return model
    # For each language its share of texts for the machines of its family and for those between families, and its sides.
    shares, sides = {}, {}
    for family, langs in model.languages.items():
        total = sum(sizes[lang] for lang in langs)
        for lang in langs:
            shares[lang] = {level: min(1.0, side_rows / max(1, n)) for level, n in ((family, sizes[lang]), (None, total))}
            own = {family: lang, None: family}
            sides[lang] = [(k, 1 if a == own[level] else -1, level) for k, (level, a, b) in enumerate(pairs) if own.get(level) in (a, b)]

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                own = batch.slice(a, b - a)
                out = []
                for (place, value), lang, chance in zip(
                    Features(own.column("text")).sparse(), own.column("lang").to_pylist(), own.column("chance").to_pylist(), strict=True
                ):
                    out += [(k, side, place.tobytes(), value.tobytes()) for k, side, level in sides[lang] if chance < shares[lang][level]]
                columns = zip(*out, strict=True) if out else [[]] * 4
                types = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["machine", "side", "places", "shares"])

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("places", "shares", "side")), strict=True))
        made = train([(np.frombuffer(p, np.int32), np.frombuffer(x, np.float32), side) for p, x, side in rows])
        return pa.table({"machine": table["machine"][:1], "weights": pa.array([made.astype(np.float32).tobytes()], pa.binary())})

    chance = F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    most = F.create_map(*[F.lit(x) for lang in shares for x in (lang, max(shares[lang].values()))])
    chosen = usable.withColumn("chance", chance).where(F.col("chance") < F.element_at(most, F.col("lang")))
    chosen = chosen.dropDuplicates(["lang", "key"]).select("lang", "text", "chance")
    lots = chosen.mapInArrow(vectors, "machine int, side int, places binary, shares binary")
    for row in lots.groupBy("machine").applyInArrow(run, "machine int, weights binary").collect():
        model.machines[pairs[row.machine]] = np.frombuffer(row.weights, np.float32)
    for pair in pairs:
        model.machines.setdefault(pair, np.zeros(_SIZE, np.float32))
    return model


def identified(spark: SparkSession, docs: DataFrame, side_rows: int = SIDE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs`` (doc_id, text, lang).

    Rows are held out whose crc32 of the id as text leaves 2 when divided by 4; ids and sources are inputs of nothing,
    languages only of what is learnt from the other rows. ``lang_pred`` is a language of those, or ``und`` with score 0 for
    a text that is null, empty or without a letter, and for all texts if there is nothing to learn from. The score is the
    chance of the family times that of the language within it. A null id counts as an empty text for held_out. Equal texts
    get equal results; an empty table gives no rows. Texts of any length are read whole. Other columns are ignored.
    """
    model = spark.sparkContext.broadcast(learned(docs, side_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                own = batch.slice(a, b - a)
                langs, scores = model.value.predict(own.column("text"), own.column("lettered").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("held_out"), pa.array(langs, pa.string()), pa.array(scores)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out().alias("held_out"), "text", _lettered().alias("lettered"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
