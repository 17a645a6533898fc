"""Pseudonyms for personal data that keep its format, by keyed Feistel permutations.

A value is found by a pattern and validated (check digits, ranges, the calendar). Its free symbols are a number in a
mixed radix, which a Feistel network permutes over exactly the valid values of the same format; check digits are
computed anew. Equal values get equal pseudonyms in all documents, different values different ones, and whoever has
the key can turn a pseudonym back. No value is its own pseudonym: the permutation is one cycle over all values, the
network being used to pick the order of the cycle.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache, reduce
from hashlib import blake2b
from operator import mul

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
_FIRST_DAY, _LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
_SLICE_ROWS = 2000


class Feistel:
    """A keyed permutation of the tuples (v1, ..., vn) with 0 <= vi < ri, for any radices r."""

    def __init__(self, key: bytes, kind: str, radices: tuple[int, ...]):
        self.radices = radices
        half = len(radices) // 2 if len(radices) > 1 else 1
        self.sizes = reduce(mul, radices[:half], 1), reduce(mul, radices[half:], 1)
        self.hash = blake2b(f"{kind}:{radices}".encode(), key=key[:64], digest_size=32)

    def _draw(self, turn: int, value: int) -> int:
        own = self.hash.copy()
        own.update(b"%d:%d" % (turn, value))
        return int.from_bytes(own.digest(), "big")

    def _turns(self, pair: list[int], back: bool) -> list[int]:
        for turn in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
            side = turn % 2
            drawn = self._draw(turn, pair[1 - side])
            pair[side] = (pair[side] - drawn if back else pair[side] + drawn) % self.sizes[side]
        return pair

    def __call__(self, values: list[int], step: int = 1) -> list[int]:
        """The tuple ``step`` places on in the cycle; -1 turns a pseudonym back."""
        number = 0
        for v, r in zip(values, self.radices, strict=True):
            number = number * r + v
        left, right = self._turns(list(divmod(number, self.sizes[1])), back=False)
        place = (left * self.sizes[1] + right + step) % (self.sizes[0] * self.sizes[1])
        left, right = self._turns(list(divmod(place, self.sizes[1])), back=True)
        number, out = left * self.sizes[1] + right, []
        for r in reversed(self.radices):
            number, v = divmod(number, r)
            out.append(v)
        return out[::-1]


def luhn(digits: str) -> int:
    """The check digit that goes after ``digits``."""
    total = 0
    for n, d in enumerate(reversed(digits)):
        d = int(d) * (2 - n % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _refill(text: str, symbols: str) -> str:
    """``text`` with its ASCII digits and letters replaced by ``symbols``, in order."""
    fresh = iter(symbols)
    return "".join(next(fresh) if c.isascii() and c.isalnum() else c for c in text)


class Pseudonyms:
    """The pseudonym of a validated value, or None if the value is none of its kind."""

    def __init__(self, key: bytes):
        if not key:
            raise ValueError("a key is needed")
        self.key = key
        self.networks: dict[tuple, Feistel] = {}

    def _move(self, kind: str, values: list[int], radices: list[int], step: int) -> list[int]:
        name = (kind, *radices)
        if name not in self.networks:
            if len(self.networks) > 10_000:
                self.networks.clear()
            self.networks[name] = Feistel(self.key, kind, tuple(radices))
        return self.networks[name](values, step)

    def _classes(self, kind: str, text: str, step: int) -> str:
        """Digits to digits, lower to lower and upper to upper case; all else stays."""
        bases = [("0", 10) if c.isdigit() else ("a", 26) if c.islower() else ("A", 26) for c in text if c.isascii() and c.isalnum()]
        plain = [c for c in text if c.isascii() and c.isalnum()]
        moved = self._move(kind, [ord(c) - ord(b) for c, (b, _) in zip(plain, bases, strict=True)], [r for _, r in bases], step)
        return _refill(text, "".join(chr(ord(b) + v) for v, (b, _) in zip(moved, bases, strict=True)))

    def _within(self, kind: str, text: str, alphabet: str, step: int) -> str:
        moved = self._move(kind, [alphabet.index(c) for c in text], [len(alphabet)] * len(text), step)
        return "".join(alphabet[v] for v in moved)

    def email(self, text: str, step: int = 1) -> str | None:
        """The last label of the domain stays."""
        body, dot, top = text.rpartition(".")
        return self._classes("email", body, step) + dot + top if top.isalpha() and re.search("[A-Za-z0-9]@", body) else None

    def card(self, text: str, step: int = 1) -> str | None:
        """13 to 19 digits with a Luhn check digit; the first digit, the kind of card, stays."""
        digits = re.sub(r"\D", "", text)
        if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or luhn(digits[:-1]) != int(digits[-1]):
            return None
        # One digit repeated is no card number, so such places are walked over.
        while True:
            moved = self._move("card", [int(d) for d in digits[1:-1]], [10] * (len(digits) - 2), step)
            digits = digits[0] + "".join(map(str, moved))
            digits += str(luhn(digits))
            if len(set(digits)) > 1:
                return _refill(text, digits)

    def ip(self, text: str, step: int = 1) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        return ".".join(map(str, self._move("ip", [int(p) for p in parts], [256] * 4, step)))

    def phone(self, text: str, step: int = 1) -> str | None:
        """The last ten digits move, the country code stays. The way it is written makes a phone number; any area code
        counts, as people also write ones that no exchange has."""
        digits = re.sub(r"\D", "", text)
        code, own = digits[:-10], digits[-10:]
        if len(own) < 10:
            return None
        return _refill(text, code + "".join(map(str, self._move("phone", [int(d) for d in own], [10] * 10, step))))

    def ssn(self, text: str, step: int = 1) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        area, group, serial = self._move("ssn", [area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], step)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def iban(self, text: str, step: int = 1) -> str | None:
        """Country and length stay; the two check digits are those of the new number."""
        plain = text.replace(" ", "")

        def rest(body: str) -> int:
            return int("".join(str(int(c, 36)) for c in body)) % 97

        # 00, 01 and 99 leave the same rest as 97, 98 and 02, which alone are check digits.
        if not 15 <= len(plain) <= 34 or rest(plain[4:] + plain[:4]) != 1 or not 2 <= int(plain[2:4]) <= 98:
            return None
        body = self._classes("iban" + plain[:2], plain[4:], step)
        return _refill(text, f"{plain[:2]}{98 - rest(body + plain[:2] + '00'):02d}{body}")

    def day(self, text: str, step: int = 1) -> str | None:
        """A date of the 20th or 21st century, as year-month-day, day.month.year, month/day/year or, if it is none
        of these, day/month/year. The latter stay dates that can only be read so."""
        numbers = [int(x) for x in re.findall(r"\d+", text)]
        mark = re.search(r"\D", text)[0]
        order = {"-": (0, 1, 2), ".": (2, 1, 0), "/": (2, 0, 1)}[mark]
        day_first = mark == "/" and numbers[0] > 12
        if day_first:
            order = (2, 1, 0)
        try:
            found = date(*(numbers[i] for i in order))
        except ValueError:
            return None
        if not _FIRST_DAY <= found <= _LAST_DAY:
            return None
        days = (_LAST_DAY - _FIRST_DAY).days + 1
        # Two digits of mixed radix, so that the network has two sides; places of no such day are walked over.
        place = [(found - _FIRST_DAY).days // 271, (found - _FIRST_DAY).days % 271]
        while True:
            place = self._move("day", place, [270, 271], step)
            number = place[0] * 271 + place[1]
            if number < days and (not day_first or (_FIRST_DAY + timedelta(number)).day > 12):
                break
        new = _FIRST_DAY + timedelta(number)
        parts = {0: f"{new.year:04d}", 1: f"{new.month:02d}", 2: f"{new.day:02d}"}
        return mark.join(parts[{v: k for k, v in enumerate(order)}[i]] for i in range(3))

    def secret(self, text: str, step: int = 1) -> str | None:
        """A key or password: hexadecimal ones, which have a digit, among themselves, others with the same characters'
        classes. Each walks on over the places of the other."""

        def hexadecimal(value: str) -> bool:
            return re.fullmatch("[0-9a-f]+", value) is not None and re.search("[0-9]", value) is not None

        own = hexadecimal(text)
        while True:
            text = self._within("hex", text, "0123456789abcdef", step) if own else self._classes("secret", text, step)
            if hexadecimal(text) == own:
                return text

    def access_key(self, text: str, step: int = 1) -> str | None:
        return text[:4] + self._within("access", text[4:], "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", step)


# The patterns of the kinds, the first that matches and is valid counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "access_key": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?i:(?<=password=)|(?<=passwd=)|(?<=token=)|(?<=secret=)|(?<=api_key=)|(?<=token = \")|(?<=secret = \")|(?<=password = \")|(?<=api_key = \")|(?<=password: )|(?<=token: ))[A-Za-z0-9_+/-]{8,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "day": r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\d|[./-]\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?!\d|-\d)",
    "phone": r"(?<![\d-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d|-\d)",
    "card": r"(?<![\d.-])(?:\d{13,19}|\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{4} \d{6} \d{5})(?!\d|-\d)",
}
KINDS = tuple(PATTERNS)
_ANY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
_EACH = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
# What a text must have for any of the patterns to match.
_HINT = r"[0-9@]|(?i:password|passwd|token|secret|api_key)(?:=|: | = \")"


def replaced(text: str, names: Pseudonyms, find: Callable | None = None) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and the (kind, start, stop) of each value in the text as it was."""
    find = find or names_of(names)
    out, spans, done, at = [], [], 0, 0
    while match := _ANY.search(text, at):
        kind, value = match.lastgroup, match[0]
        start = match.start()
        new = find(kind, value)
        # A value that is not valid may hold a valid one of a later kind.
        for other in KINDS[KINDS.index(kind) + 1 :] if new is None else ():
            if (again := _EACH[other].match(text, start)) and (new := find(other, again[0])) is not None:
                kind, value = other, again[0]
                break
        if new is None:
            at = start + 1
            # Go on behind the digits of an invalid number, not inside them.
            while at < match.end() and text[at].isalnum() and text[at - 1].isalnum():
                at += 1
            continue
        out += [text[done:start], new]
        done = at = start + len(value)
        spans.append((kind, start, done))
    return "".join([*out, text[done:]]), spans


def names_of(names: Pseudonyms) -> Callable[[str, str], str | None]:
    @lru_cache(100_000)
    def find(kind: str, value: str) -> str | None:
        return getattr(names, kind)(value)

    return find


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, one struct column ``row`` with all its columns, and ``found``, the values'
    kinds and places (in characters) in the text as it was.

    Null texts stay null and empty ones empty, with nothing found. Where ``docs`` has a column n_chars it follows the new
    text. Rows are independent, so null and repeated ids need no rule; an empty table gives no rows.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    plain = docs.toDF(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonyms(key)
        find = names_of(own)
        for whole in batches:
            for first in range(0, whole.num_rows, _SLICE_ROWS):
                batch = whole.slice(first, _SLICE_ROWS)
                texts = batch.column(at)
                maybe = pc.fill_null(pc.match_substring_regex(texts, _HINT), False).to_pylist()
                new, found = [], []
                for hit, text in zip(maybe, texts, strict=True):
                    body, spans = replaced(text.as_py(), own, find) if hit else (None, [])
                    new.append(body if spans else None)
                    found.append([dict(zip(("kind", "start", "stop"), s, strict=True)) for s in spans])
                columns = list(batch.columns)
                columns[at] = pc.coalesce(pa.array(new, pa.string()), texts)
                spans = pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))
                yield pa.RecordBatch.from_arrays([*columns, spans], [*names, "found"])

    kinds = ", ".join(f"{n} {t.dataType.simpleString()}" for n, t in zip(names, docs.schema.fields, strict=True))
    done = plain.mapInArrow(run, f"{kinds}, found array<struct<kind: string, start: bigint, stop: bigint>>")
    changed = F.size("found") > 0
    row = [
        F.when(changed, F.length(names[at])).otherwise(F.col(n)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(n).alias(c)
        for n, c in zip(names, docs.columns, strict=True)
    ]
    return done.select(F.struct(*row).alias("row"), "found")
