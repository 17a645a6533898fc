"""Benchmark items in documents, found by their templates, with column expressions and joins only.

A text becomes a row of tokens. Numbers, names and units are replaced with typed placeholders; the other tokens are
lower-cased words. Windows of the resulting template are hash-joined with those of the benchmark. Windows that hit
along one diagonal, the same shift between document and item, belong together. A diagonal counts if it covers enough of
the item and if its slots are consistent: equal values of the item are equal in the document, and its names stay apart, so
that a question with other numbers or names is still caught, and prose that only shares the shape is not.

Windows dense in placeholders say little each, so they count on longer diagonals only, which must also share enough
words. A run of equal text counts whatever stands in it. An item of less than a window is one window of its own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.llm.columns import computed
from spindlewatch.shared import written

WINDOW = 8
# Windows on a diagonal that make a leak: 13 tokens in a row, or all windows of a shorter item.
LEAST_WINDOWS = 6
# A shorter item is only in a document that consists of nothing else.
LEAST_TOKENS = 5
# An item of less than a window with fewer words than this beside its placeholders counts with its own numbers and names only.
LEAST_SHORT_LITERALS = 4
# A window with more placeholders than this is dense. Diagonals that need dense windows must have so many windows, 19
# tokens in a row, or all windows of a shorter item, and so many words in common, unless they have a run of equal text.
MOST_SLOTS = 3
LEAST_DENSE_WINDOWS = 12
LEAST_LITERALS = 5
# The benchmark's windows are sent to all tasks up to this number of rows; beyond it both sides are shuffled.
BROADCAST_ROWS = 2_000_000
# So many diagonals or leaking documents, rows of a few numbers, likewise; beyond, the texts are shuffled to them.
BROADCAST_LEAKS = 100_000
# The texts of the benchmark likewise, up to so many bytes.
BROADCAST_BYTES = 32 << 20

# Units of measure, as written after a number.
UNITS = (
    "%", "a", "c", "cent", "centimeter", "centimeters", "cents", "cl", "cm", "day", "days", "degrees", "dollar", "dollars", "eur",
    "euro", "euros", "feet", "foot", "ft", "g", "gallon", "gallons", "gb", "gram", "grams", "h", "hour", "hours", "hz", "in", "inch",
    "inches", "j", "k", "kb", "kg", "kilogram", "kilograms", "kilometer", "kilometers", "kj", "km", "kmh", "kw", "kwh", "l", "lb", "lbs",
    "liter", "liters", "m", "mb", "meter", "meters", "mg", "mile", "miles", "min", "minute", "minutes", "ml", "mm", "month", "months",
    "mph", "ms", "n", "oz", "percent", "pound", "pounds", "s", "sec", "second", "seconds", "t", "ton", "tons", "usd", "v", "w", "week",
    "weeks", "yard", "yards", "year", "years",
)

# A name: a capitalised word that follows a lower-case word, a digit, a comma or the like, not the end of a sentence.
_NAME = r"\p{Lu}(?<=[\p{Ll}\d,;:(] ?\p{Lu})(?<![\p{L}\d]\p{Lu})(?=\p{Ll})"
_TOKEN = r"\x02?[\p{L}\p{M}]+|\d+(?:[.,]\d+)*|%"
_MARK = "\x02"
# What stands for a number, a name and a unit.
_NUMBER_SLOT, _NAME_SLOT, _UNIT_SLOT = 1, 2, 3


def _tokens(text: Column) -> Column:
    """Words, numbers and percent signs of a text; names begin with a mark."""
    marked = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), _MARK, " "), _NAME, f"{_MARK}$0")
    return F.regexp_extract_all(F.lower(marked), F.lit(_TOKEN), 0)


def _slot(tokens: Column, token: Column, at: Column) -> Column:
    """The kind of placeholder of a token, or null."""
    code = F.ascii(token)
    digit = (code >= 48) & (code <= 57)
    before = F.ascii(F.get(tokens, at - 1))
    return (
        F.when(digit, _NUMBER_SLOT)
        .when(code == 2, _NAME_SLOT)
        .when((before >= 48) & (before <= 57) & token.isin(*UNITS), _UNIT_SLOT)
    )


def _template(tokens: str) -> Column:
    """A hash of each token, or its placeholder's number."""
    column = F.col(tokens)
    return F.transform(column, lambda t, i: F.coalesce(_slot(column, t, i).cast("long"), F.xxhash64(t)))


def _is_slot(token: Column) -> Column:
    return token.isin(_NUMBER_SLOT, _NAME_SLOT, _UNIT_SLOT)


def _hash(template: Column, tokens: Column, at: Column, width: Column | int) -> Column:
    """The hash of the window of so many tokens. Windows of placeholders alone, as any table of numbers has their shape,
    and short ones with few words beside them are hashed by what stands in them."""
    own = F.slice(template, at + 1, width)
    # Most windows begin with a word, so that the others need not be looked at.
    bare = _is_slot(F.get(template, at)) & F.forall(own, _is_slot)
    short = F.size(F.filter(own, lambda token: ~_is_slot(token))) < LEAST_SHORT_LITERALS
    if not isinstance(width, int):
        bare = bare | (F.size(own) < WINDOW) & short
    elif width < WINDOW:
        bare = short
    return F.when(bare, F.xxhash64(F.slice(tokens, at + 1, width))).otherwise(F.xxhash64(own))


def _windows(template: str, tokens: str, widths: list[int]) -> Column:
    """(at, hash) of the windows of these widths, from 0; those under LEAST_TOKENS only where they are the whole text."""
    none = F.array().cast("array<struct<at:int,hash:bigint>>")
    column, words = F.col(template), F.col(tokens)
    size = F.size(column)

    def of(width: int) -> Column:
        places = F.sequence(F.lit(0), size - width)
        made = F.transform(places, lambda i: F.struct(i.alias("at"), _hash(column, words, i, width).alias("hash")))
        return F.when(size >= width if width >= LEAST_TOKENS else size == width, made).otherwise(none)

    return F.concat(*[of(width) for width in widths])


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, at, hash, width, slots, dense, windows, sparse_windows): the windows of the benchmark's items.

    width and slots are the numbers of the window's tokens and placeholders, windows and sparse_windows the numbers of all and of the not dense
    windows of the item."""
    tokens = benchmark.select(F.col("item_id").cast("long").alias("item"), _tokens(F.col("text")).alias("tokens"))
    tokens = tokens.where(F.col("item").isNotNull()).distinct()
    made = computed(tokens, ["item", "tokens"], template=_template("tokens"))
    width = F.least(F.size("template"), F.lit(WINDOW))
    places = F.when(F.size("template") > 0, F.sequence(F.lit(0), F.size("template") - width))
    rows = made.select("item", "tokens", "template", width.alias("width"), F.explode(places).alias("at"))
    slots = F.size(F.filter(F.slice("template", F.col("at") + 1, F.col("width")), _is_slot))
    rows = rows.select(
        "item", "at", _hash(F.col("template"), F.col("tokens"), F.col("at"), F.col("width")).alias("hash"), "width",
        slots.alias("slots"), ((F.col("width") == WINDOW) & (slots > MOST_SLOTS)).alias("dense"),
    )
    sizes = rows.groupBy("item").agg(F.count("*").alias("windows"), F.count_if(~F.col("dense")).alias("sparse_windows"))
    return rows.join(sizes, "item")


def _sent(df: DataFrame, rows: int, most: int) -> DataFrame:
    return F.broadcast(df) if rows <= most else df


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item, shift, hits) of the diagonals that make a leak, for the rows of ``docs`` with that id
    and xxhash64 of the text. Rows equal in both are one."""
    items = written(spark, _items(benchmark), "items")
    known = _sent(items.drop("width"), items.count(), BROADCAST_ROWS)
    # At most a handful of numbers: the lengths of items shorter than a window.
    widths = sorted({r.width for r in items.select("width").distinct().collect()} | {WINDOW})
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    made = computed(own, ["doc_id", "text_hash"], tokens=_tokens(F.col("text")))
    made = computed(made, ["doc_id", "text_hash", "tokens"], template=_template("tokens"))
    rows = made.select("doc_id", "text_hash", F.explode(_windows("template", "tokens", widths)).alias("w")).select(
        "doc_id", "text_hash", "w.at", "w.hash"
    )
    hits = rows.join(known.withColumnRenamed("at", "item_at"), "hash")
    # Rows that are equal hit alike.
    hits = hits.groupBy("doc_id", "text_hash", "item", (F.col("at") - F.col("item_at")).alias("shift"), "item_at").agg(
        *[F.max(c).alias(c) for c in ("slots", "dense", "windows", "sparse_windows")]
    )
    diagonals = hits.groupBy("doc_id", "text_hash", "item", "shift").agg(
        F.count("*").alias("hits"), F.count_if(~F.col("dense")).alias("sparse_hits"),
        F.max(F.when(~F.col("dense"), F.col("slots"))).alias("slots"),
        F.max("windows").alias("windows"), F.max("sparse_windows").alias("sparse_windows"),
        F.min("item_at").alias("low"), F.max("item_at").alias("high"),
    )
    sure = (F.col("sparse_hits") > 0) & (F.col("sparse_hits") >= F.least(F.lit(LEAST_WINDOWS), F.col("sparse_windows")))
    diagonals = diagonals.withColumn("sure", sure).where(F.col("sure") | (F.col("hits") >= F.least(F.lit(LEAST_WINDOWS), F.col("windows"))))
    diagonals = diagonals.select("doc_id", "text_hash", "item", "shift", "hits", "slots", "sure", "windows", "low", "high")
    diagonals = written(spark, diagonals, "diagonals")
    plain = diagonals.where("sure AND slots = 0").select("doc_id", "text_hash", "item", "shift", "hits")
    filled = _consistent(own, benchmark, diagonals.where("NOT (sure AND slots = 0)").drop("slots"))
    return plain.unionByName(filled)


def _consistent(docs: DataFrame, benchmark: DataFrame, diagonals: DataFrame) -> DataFrame:
    """The diagonals with a run of equal text, and those that are ``sure`` or long with enough words in common whose slots
    are consistent over the windows that match: equal values of the item are equal in the document, other names are other
    names, and, unless the diagonal is sure, other values are other values."""
    item = benchmark.select(F.col("item_id").cast("long").alias("item"), _tokens(F.col("text")).alias("item_tokens")).distinct()
    item = computed(item, ["item", "item_tokens"], item_template=_template("item_tokens"))
    texts = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    columns = ["item", "shift", "sure", "hits", "windows", "low", "high"]
    wanted = diagonals.select(F.struct("doc_id", "text_hash", *columns).alias("d"))
    wanted = wanted.select("d", F.col("d.doc_id").alias("id"), F.col("d.text_hash").alias("hash"))
    found = docs.join(
        _sent(wanted, diagonals.count(), BROADCAST_LEAKS),
        F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")),
    )
    # Templates and tokens take some twenty times the bytes of the text at most.
    found = found.join(_sent(item, texts * 20, BROADCAST_BYTES), F.col("d.item") == F.col("item"))
    found = computed(found, ["d", "item_tokens", "item_template"], tokens=_tokens(F.col("text")))
    found = computed(found, ["d", "item_tokens", "item_template", "tokens"], template=_template("tokens"))
    width = F.least(F.size("item_tokens"), F.lit(WINDOW))
    shift = F.col("d.shift")

    def hit(i: Column) -> Column:
        return _hash(F.col("item_template"), F.col("item_tokens"), i, width) == _hash(F.col("template"), F.col("tokens"), i + shift, width)

    run = width + F.least(F.lit(LEAST_WINDOWS), F.col("d.windows")) - 1

    def equal(i: Column) -> Column:
        return (i + run <= F.size("item_tokens")) & (F.slice("item_tokens", i + 1, run) == F.slice("tokens", (i + shift + 1).cast("int"), run))

    # An item id may have several texts, of which this one may end before.
    last = F.least(F.col("d.high"), F.size("item_tokens") - width)
    inside = F.when(last >= F.col("d.low"), F.sequence(F.col("d.low"), last))
    found = computed(found, ["d", "item_tokens", "item_template", "tokens"], matched=F.filter(inside, hit))
    covered = F.array_distinct(F.flatten(F.transform("matched", lambda i: F.sequence(i, i + width - 1))))
    verbatim = F.exists("matched", equal)
    found = computed(found, ["d", "item_tokens", "item_template", "tokens"], covered=covered, verbatim=verbatim)
    slots = F.filter("covered", lambda i: _is_slot(F.get("item_template", i)))
    pairs = F.array_distinct(F.transform(slots, lambda i: F.struct(
        F.get("item_tokens", i).alias("x"), F.get("tokens", i + shift).alias("y"), F.get("item_template", i).alias("kind")
    )))
    found = computed(found, ["d", "verbatim"], pairs=pairs, literals=F.size("covered") - F.size(slots))
    names = F.filter("pairs", lambda pair: pair["kind"] == _NAME_SLOT)
    function = F.size("pairs") == F.size(F.array_distinct("pairs.x"))
    apart = F.when(F.col("d.sure"), F.size(names) == F.size(F.array_distinct(F.transform(names, lambda pair: pair["y"]))))
    consistent = function & apart.otherwise(F.size("pairs") == F.size(F.array_distinct("pairs.y")))
    long = F.col("d.hits") >= F.least(F.lit(LEAST_DENSE_WINDOWS), F.col("d.windows"))
    enough = F.col("d.sure") | (long & (F.col("literals") >= LEAST_LITERALS))
    return found.where(F.col("verbatim") | (enough & consistent)).select("d.doc_id", "d.text_hash", "d.item", "d.shift", "d.hits").distinct()


def judged(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, contaminated, items) of every row of ``docs``; items are the ids of the benchmark items in it, in order.

    Null and empty texts hold no item, and null or empty items are in no document; an item without an id is left out.
    An item of 5 to 7 tokens is found with other numbers and names if it has 4 words beside them, else as it is; a shorter
    one only in a document that consists of nothing else.
    Equal rows are judged alike; an empty table gives no rows, an empty benchmark no contamination. Other columns of
    either table are ignored.
    """
    found = matches(spark, docs, benchmark)
    items = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("item")).alias("items"))
    items = written(spark, items, "leaks")
    leaks = _sent(items, items.count(), BROADCAST_LEAKS).select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "items")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    all_rows = rows.join(leaks, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")), "left")
    return all_rows.select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items")
    )


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns."""
    leaks = written(spark, matches(spark, docs, benchmark).select("doc_id", "text_hash").distinct(), "leaks")
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"))
    leaks = _sent(leaks, leaks.count(), BROADCAST_LEAKS)
    kept = own.join(leaks, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_anti")
    return kept.select("row.*")
