"""Quality rules as a short-circuit cascade of column expressions.

Base counts are computed for every text. The further rules run one after another, and a document that one rule rejects
is not looked at by the next. Next comes the rule with most rejections, of what the rules before it left of a sample, per
second of its own work. The order decides how much work is done, never which documents are kept.
"""

from __future__ import annotations

import math
import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.llm.columns import computed
from spindlewatch.shared import written

SPACE = r"\x20\x09-\x0D"
WINDOW = 8
SAMPLE_ROWS = 2_000
# A rule is timed over so many copies of the sample, more until its work takes so many seconds.
COPIES = (1, 8, 64)
LEAST_SECONDS = 0.1


@dataclass(frozen=True)
class Rule:
    """``passes`` is an SQL condition on ``text`` (never null), the base counts and ``hashes``, one for each word."""

    name: str
    passes: str


# Characters are counted by what goes when runs of them are cut out: a count of matches makes a string of each.
_LETTERS, _UPPER = (rf"(length(text) - length(regexp_replace(text, '\\p{{{kind}}}+', '')))" for kind in ("L", "Lu"))
# Texts pass where symbols, word lengths, repeated lines, words that follow themselves, exclamation marks, letters in
# upper case and other characters than letters are within bounds.
RULES = (
    Rule("few_symbols", "10 * n_symbols <= n_words"),
    Rule("mean_word_length", "word_chars >= 2 * n_words AND word_chars <= 15 * n_words"),
    Rule("few_repeated_lines", "2 * n_dup_lines <= n_lines"),
    Rule("few_stutters", "10 * size(filter(hashes, (h, i) -> i > 0 AND h = get(hashes, i - 1))) <= 3 * n_words"),
    Rule("few_exclamations", r"10 * regexp_count(text, '!') <= n_words"),
    Rule("mostly_lower_case", f"10 * {_UPPER} <= 4 * {_LETTERS}"),
    Rule("mostly_letters", f"2 * {_LETTERS} >= word_chars"),
)


def base_counts(docs: DataFrame) -> DataFrame:
    """``docs`` in a struct column ``row``, with ``text`` (null: empty) and the counts n_words, word_chars, n_symbols,
    n_lines, n_dup_lines and n_repeat_words, and ``hashes`` of the words."""
    texts = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    split = computed(
        texts, ["row", "text"],
        words=F.regexp_extract_all("text", F.lit(f"[^{SPACE}]+"), 0),
        lines=F.filter(F.split("text", "\n", -1), lambda line: line.rlike(f"[^{SPACE}]")),
    )
    hashed = computed(
        split, ["row", "text", "lines"],
        n_words=F.size("words").cast("long"), hashes=F.transform("words", lambda word: F.xxhash64(word)),
    )
    starts = F.sequence(F.lit(1), F.size("hashes") - (WINDOW - 1))
    windows = computed(
        hashed, ["row", "text", "lines", "n_words", "hashes"],
        windows=F.when(F.col("n_words") >= WINDOW, F.transform(starts, lambda i: F.xxhash64(F.slice("hashes", i, WINDOW)))).otherwise(
            F.array().cast("array<bigint>")
        ),
    )
    # Few texts repeat a window, and only theirs are sorted to find which.
    repeats = computed(
        windows, ["row", "text", "lines", "n_words", "hashes"],
        ordered=F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    )
    again = F.filter(
        F.transform(
            "ordered",
            lambda w, k: F.when(
                F.get("ordered", k - 1)["h"].eqNullSafe(w["h"]) | F.get("ordered", k + 1)["h"].eqNullSafe(w["h"]), w["i"]
            ),
        ),
        lambda i: i.isNotNull(),
    )

    def cover(now: Column, i: Column) -> Column:
        return F.struct((now["n"] + F.least(F.lit(WINDOW), i - now["last"])).alias("n"), i.alias("last"))

    covered = F.aggregate(F.array_sort(again), F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), cover)["n"]
    return computed(
        repeats, ["row", "text", "n_words", "hashes"],
        word_chars=F.length(F.regexp_replace("text", f"[{SPACE}]+", "")).cast("long"),
        n_symbols=F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long"),
        n_lines=F.size("lines").cast("long"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        n_repeat_words=F.coalesce(F.when(F.col("ordered").isNotNull(), covered), F.lit(0)).cast("long"),
    )


_BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def _cost(sample: DataFrame, rule: Rule) -> float:
    """Seconds of the rule's work on the sample, to a power of two, so that noise seldom changes an order.

    The sample is repeated until the rule's work stands out from the job without it, whose time is subtracted."""

    def seconds(copies: int, passes: str) -> float:
        job = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).agg(F.count_if(~F.expr(passes)))
        job.first()
        began = time.perf_counter()
        job.first()
        return time.perf_counter() - began

    for copies in COPIES:
        # The job without the rule passes over the same copies.
        own = seconds(copies, rule.passes) - seconds(copies, "copy > 0")
        if own >= LEAST_SECONDS:
            break
    return 2.0 ** round(math.log2(max(own, LEAST_SECONDS / 16) / copies))


def by_rate(rules: Sequence[Rule], costs: Sequence[float], patterns: Sequence[tuple[tuple[bool, ...], int]]) -> list[Rule]:
    """The rules by rejections per second of what the rules before left, highest first.

    ``patterns`` are the combinations of rejections by rule, and their numbers of rows. Rules of equal rate, as those
    that reject nothing more, stay in their order."""
    order, left = [], list(range(len(rules)))
    while left:
        rates = {i: sum(n for rejects, n in patterns if rejects[i]) / costs[i] for i in left}
        best = max(left, key=lambda i: (rates[i], -i))
        order.append(rules[best])
        left.remove(best)
        patterns = [(rejects, n) for rejects, n in patterns if not rejects[best]]
    return order


def ordered_rules(spark: SparkSession, docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules in the order of the cascade, as measured on a sample of about ``sample_rows`` rows.

    Only rows that the base passes count, as the cascade sees no others. They are written once with their counts, so that
    only the rules are timed. A rule's verdict is taken for each row of the sample, also where another rule rejects it."""
    total = docs.count()
    sample = docs.select("text").sample(min(1.0, sample_rows / max(1, total)), seed=7)
    counted = written(spark, base_counts(sample).drop("row").where(f"NOT ({_BASE_FAILED})"), "rules-sample")
    verdicts = [F.coalesce(~F.expr(rule.passes), F.lit(False)).alias(f"r{i}") for i, rule in enumerate(rules)]
    # No more rows than the sample has.
    rows = counted.groupBy(*verdicts).count().collect()
    patterns = [(tuple(row[:-1]), row[-1]) for row in rows]
    rejecting = [any(rejects[i] for rejects, _ in patterns) for i in range(len(rules))]
    # A rule that rejects nothing has rate 0 whatever it costs.
    costs = [_cost(counted, rule) if rejects else 1.0 for rule, rejects in zip(rules, rejecting, strict=True)]
    return by_rate(rules, costs, patterns)


def judged(spark: SparkSession, docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` in a struct column ``row``, with the counts, ``base_failed``, ``failed_rule`` and ``kept``.

    base_failed: under 20 words, or over 30 % of them in 8-word windows that the text holds more than once.
    ``failed_rule`` is the first rule of the cascade that rejects the document, null if none does or the base has failed.
    Null and empty texts have no words and fail the base. Documents are judged one by one, so repeated rows and ids
    need no rule; an empty table gives no rows.
    """
    cascade = F.when(F.expr(_BASE_FAILED), None)
    for rule in ordered_rules(spark, docs, rules):
        cascade = cascade.when(~F.expr(rule.passes), rule.name)
    verdicts = computed(
        base_counts(docs), ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        base_failed=F.expr(_BASE_FAILED), failed_rule=cascade.cast("string"),
    )
    return verdicts.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull())


ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents
), split AS (
  SELECT doc_id, r, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM base
), windows AS (
  SELECT r, i, array_to_string(words[i:i + 7], ' ') AS w FROM split, unnest(range(1, greatest(1, len(words) - 6))) AS t(i)
), again AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, w) > 1
), covered AS (
  SELECT r, count(DISTINCT j) AS n FROM again, unnest(range(i, i + 8)) AS t(j) GROUP BY r
), counted AS (
  SELECT doc_id, text, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words,
         len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS stutters,
         length(regexp_replace(text, '[^!]', '', 'g')) AS marks,
         length(regexp_replace(text, '\P{Lu}', '', 'g')) AS upper_case, length(regexp_replace(text, '\P{L}', '', 'g')) AS letters
  FROM split LEFT JOIN covered USING (r)
), failed AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counted
)
SELECT @columns FROM failed
"""
# The rules in SQL.
KEPT = (
    "NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 2 * n_words AND 15 * n_words "
    "AND 2 * n_dup_lines <= n_lines AND 10 * stutters <= 3 * n_words AND 10 * marks <= n_words AND 10 * upper_case <= 4 * letters AND 2 * letters >= word_chars"
)
