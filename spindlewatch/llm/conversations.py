"""Repair of the turn structure of conversations by least-cost edits, found by divide and conquer in linear space.

A sound conversation has the role initials ``(s?(ua)+)?``. While it is read it is in one of four states: nothing yet,
after the system turn, after a user turn, after an assistant turn. Each turn can be kept, get another role or be
deleted, and turns without text can be inserted; the edits' initials are the audit.

The search is Hirschberg's: a vector of four costs runs forward from the first turn, another backward from the last;
they meet in the middle, where the state of the least sum is where a best path crosses, and both halves are searched in
the same way. No path is stored. The forward vector also carries the rank of each state's least audit among the four.
Audits that lead to different states are no prefixes of one another, so a rank settles which crossing has the least audit.

Conversations are cut into chunks of bounded size. Between chunks only the costs from each of the four states to each
other travel, so the chunks of one very long conversation are searched in different tasks.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from functools import cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.shared import written

# A chunk of a conversation ends beyond so many bytes of text or so many turns.
CHUNK_BYTES = 16 << 20
CHUNK_TURNS = 1 << 17

# The costs of edits, and the white space of the texts.
COSTS = {"K": 0, "R": 2, "D": 3, "I": 2}
_CUT_COST = 1
_SPACE = " \t\n\x0b\x0c\r"

_NOTHING, _SYSTEM, _USER, _ASSISTANT = _STATES = range(4)
_NEXT = {(_NOTHING, "s"): _SYSTEM, (_NOTHING, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _ASSISTANT, (_ASSISTANT, "u"): _USER}
# The only turn that can be inserted, or a turn be made into, in each state; what is missing when the turns end.
_DUE = {_NOTHING: "u", _SYSTEM: "u", _USER: "a", _ASSISTANT: "u"}
_MISSING = {_NOTHING: "", _SYSTEM: "II", _USER: "I", _ASSISTANT: ""}
_ROLES = {"u": "user", "a": "assistant"}

# A kind of turn: 0 has to go; others are 1 + 2 * (place of the initial in _INITIALS, or 3) + (1 if truncated).
_INITIALS = "sua"
_GONE = 0


def kind_of(role: str, truncated: bool) -> int:
    at = _INITIALS.find(role[:1]) if role else -1
    return 1 + 2 * (at if at >= 0 else 3) + truncated


@cache
def _moves(kind: int) -> list[list[tuple[int, str] | None]]:
    """For each pair of states the least (cost, letters) of one turn of this kind, insertions before it included."""
    best: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in _STATES]

    def offer(a: int, b: int, cost: int, letters: str) -> None:
        if best[a][b] is None or (cost, letters) < best[a][b]:
            best[a][b] = (cost, letters)

    for start in _STATES:
        state = start
        for inserted in range(4):
            before, cost = "I" * inserted, COSTS["I"] * inserted
            offer(start, state, cost + COSTS["D"], before + "D")
            if kind != _GONE:
                at, cut = divmod(kind - 1, 2)
                kept = _NEXT.get((state, _INITIALS[at])) if at < 3 else None
                if kept is not None:
                    offer(start, kept, cost + COSTS["K"] + _CUT_COST * cut, before + "K")
                offer(start, _NEXT[state, _DUE[state]], cost + COSTS["R"] + _CUT_COST * cut, before + "R")
            state = _NEXT[state, _DUE[state]]
    return best


@cache
def _ahead(costs: tuple, ranks: tuple, kind: int) -> tuple[tuple, tuple, float]:
    """The forward vector after one more turn. There are few different vectors, as the least cost is taken off."""
    moves, found = _moves(kind), {}
    for b in _STATES:
        offers = [(costs[a] + moves[a][b][0], ranks[a], moves[a][b][1]) for a in _STATES if moves[a][b] and costs[a] < math.inf]
        if offers:
            found[b] = min(offers)
    least = min(cost for cost, _, _ in found.values())
    order = sorted(found, key=lambda b: found[b][1:])
    return (
        tuple(found[b][0] - least if b in found else math.inf for b in _STATES),
        tuple(order.index(b) if b in found else 4 for b in _STATES),
        least,
    )


@cache
def _behind(costs: tuple, kind: int) -> tuple:
    """The backward vector before one more turn, less its least cost."""
    moves = _moves(kind)
    found = [min((moves[a][b][0] + costs[b] for b in _STATES if moves[a][b]), default=math.inf) for a in _STATES]
    least = min(found)
    return tuple(cost - least for cost in found)


def _only(state: int) -> tuple:
    return tuple(0 if s == state else math.inf for s in _STATES)


def forward(kinds: bytes, entry: int) -> tuple[list[float], tuple]:
    """Costs from ``entry`` to each state over all turns, and the ranks of the least audits."""
    costs, ranks, total = _only(entry), (0, 0, 0, 0), 0
    for kind in kinds:
        costs, ranks, more = _ahead(costs, ranks, kind)
        total += more
    return [cost + total for cost in costs], ranks


def backward(kinds: bytes, leave: int) -> tuple:
    """Costs from each state to ``leave`` over all turns, less the least of them."""
    costs = _only(leave)
    for kind in reversed(kinds):
        costs = _behind(costs, kind)
    return costs


def ending(costs: Sequence[float], ranks: Sequence[int]) -> tuple[int, int]:
    """(Least cost, state after the last turn) of a conversation, with the turns that are then still missing."""
    cost, _, state = min((costs[s] + COSTS["I"] * len(_MISSING[s]), ranks[s], s) for s in _STATES)
    return int(cost), state


def edits(kinds: bytes, entry: int, leave: int) -> str:
    """The least audit of least cost that leads from state ``entry`` to ``leave`` over all turns."""
    letters, halves = [], [(0, len(kinds), entry, leave)]
    while halves:
        low, high, a, b = halves.pop()
        if high - low > 1:
            middle = (low + high) // 2
            costs, ranks = forward(kinds[low:middle], a)
            rest = backward(kinds[middle:high], b)
            crossing = min(_STATES, key=lambda s: (costs[s] + rest[s], ranks[s]))
            halves += [(middle, high, crossing, b), (low, middle, a, crossing)]
        elif high > low:
            letters.append(_moves(kinds[low])[a][b][1])
    return "".join(letters)


def applied(audit: str, turns: Sequence[tuple[str, str]], entry: int = _NOTHING) -> list[tuple[str, str]]:
    """The (role, text) pairs that the edits make of ``turns``."""
    out, state, at = [], entry, 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else turns[at]
        at += letter != "I"
        if letter != "D":
            initial = role[:1] if letter == "K" else _DUE[state]
            out.append((role if letter == "K" else _ROLES[initial], text))
            state = _NEXT[state, initial]
    return out


def faults(turns: Sequence[tuple[str, str]], blank: Sequence[bool], cut: Sequence[bool], repeats: set[int]) -> tuple[bytes, list[int]]:
    """The kinds of the turns, and the numbers of blank, duplicate and truncated ones by each turn's first fault."""
    kinds, counts = bytearray(), [0, 0, 0]
    for at, (role, _) in enumerate(turns):
        fault = 0 if blank[at] else 1 if at in repeats else 2 if cut[at] else 3
        if fault < 3:
            counts[fault] += 1
        kinds.append(_GONE if fault < 2 else kind_of(role, fault == 2))
    return bytes(kinds), counts


def repeated(turns: Sequence[tuple[str, str]]) -> set[int]:
    seen, out = set(), set()
    for at, turn in enumerate(turns):
        if turn in seen:
            out.add(at)
        seen.add(turn)
    return out


def illegal(initials: Sequence[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def span(numbers: Sequence[int | None]) -> tuple[int | None, int | None, int]:
    """Least, greatest and number of distinct turn numbers."""
    known = {n for n in numbers if n is not None}
    return (min(known), max(known), len(known)) if known else (None, None, 0)


def _gaps(least: int | None, most: int | None, distinct: int) -> int:
    return 0 if least is None else most - least + 1 - distinct


_TURN = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("blank", pa.bool_()), ("cut", pa.bool_())])
_REPAIRED = pa.struct([("role", pa.string()), ("text", pa.string())])
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_PIECE = (
    "part int, chunk int, whole boolean, "
    + ", ".join(f"{name} bigint" for name in _COUNTS)
    + ", audit string, turns array<struct<role string, text string>>"
)
_PIECE_ARROW = [
    ("part", pa.int32()), ("chunk", pa.int32()), ("whole", pa.bool_()), *[(name, pa.int64()) for name in _COUNTS],
    ("audit", pa.string()), ("turns", pa.list_(_REPAIRED)),
]
_RAW = "rows array<struct<turn bigint, role string, text string, blank boolean, cut boolean>>"


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults that a checksum of the conversation and turn chooses.

    A null counts as one space. Of 20 remainders 0 loses the row, 1 empties the text, 2 takes its ``.``, ``!`` and ``?``,
    3 repeats the row and 4 makes it a user's. A lost row stays as one that is ``lost``, to name its conversation.
    """
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    text = F.coalesce(F.col("text"), blank)
    return rows.withColumn("__harm", F.crc32(name) % 20).select(
        "conv_id",
        "turn",
        F.when(F.col("__harm") == 4, "user").otherwise(F.coalesce(F.col("role"), blank)).alias("role"),
        F.when(F.col("__harm") == 1, "").when(F.col("__harm") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (F.col("__harm") == 0).alias("lost"),
        F.explode(F.when(F.col("__harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"),
    ).drop("__copy")


def _in_order(rows: DataFrame) -> DataFrame:
    """Turns by conversation and place, in ranges: a conversation larger than a range goes over several tasks. The last
    key deals turns that are equal in all else, which may fall on both sides of a border."""
    trimmed = F.rtrim(F.col("text"), F.lit(_SPACE))
    keys = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "__hash", "__deal")]
    lost = F.col("lost") if "lost" in rows.columns else F.lit(False)
    return (
        rows.select(
            "conv_id",
            F.col("turn").try_cast("long").alias("turn"),
            F.coalesce("role", F.lit(" ")).alias("role"),
            F.when(~lost, F.coalesce("text", F.lit(" "))).alias("text"),
            lost.alias("lost"),
        )
        .withColumns({
            "blank": trimmed == "",
            "cut": ~F.right(trimmed, F.lit(1)).isin(".", "!", "?"),
            "__hash": F.xxhash64("text"),
            "__deal": F.xxhash64(F.monotonically_increasing_id()),
        })
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .drop("__hash", "__deal")
    )


class _Open:
    """The chunk that is being read."""

    def __init__(self, conv_id, first: bool):
        self.conv_id, self.whole = conv_id, not first
        self.clear()

    def clear(self) -> None:
        self.turns, self.numbers, self.blank, self.cut, self.bytes = [], [], [], [], 0


def _pieces(batches: Iterator[pa.RecordBatch], most_turns: int) -> Iterator[pa.RecordBatch]:
    """Chunks of the sorted turns of one task. A conversation that is whole here is repaired at once; the first and the
    last of a task may go on in another, and those with several chunks do, so their turns are handed on."""
    part, chunks, now, first = TaskContext.get().partitionId(), 0, None, True
    out: dict[str, list] = {}
    schema, waiting = None, 0

    def put(values: dict) -> None:
        for name in schema.names:
            out.setdefault(name, []).append(values.get(name))

    def close(last: bool) -> None:
        nonlocal chunks, waiting
        waiting += now.bytes + 100 * len(now.turns) + 100
        key = {"conv_id": now.conv_id, "part": part, "chunk": chunks}
        if now.whole and not last:
            kinds, counts = faults(now.turns, now.blank, now.cut, repeated(now.turns))
            cost, leave = ending(*forward(kinds, _NOTHING))
            audit = edits(kinds, _NOTHING, leave) + _MISSING[leave]
            numbers = (_gaps(*span(now.numbers)), *counts, illegal([r[:1] for r, _ in now.turns]), cost)
            fixed = [{"role": r, "text": t} for r, t in applied(audit, now.turns)]
            put(key | {"whole": True, "audit": audit, "turns": fixed} | dict(zip(_COUNTS, numbers, strict=True)))
        else:
            rows = zip(now.numbers, now.turns, now.blank, now.cut, strict=True)
            put(key | {"whole": False, "rows": [{"turn": n, "role": r, "text": t, "blank": b, "cut": c} for n, (r, t), b, c in rows]})
        chunks += 1
        now.clear()

    def ready() -> pa.RecordBatch:
        nonlocal waiting
        batch = pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)
        out.clear()
        waiting = 0
        return batch

    for batch in batches:
        if schema is None:
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), *_PIECE_ARROW, ("rows", pa.list_(_TURN))])
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "lost", "blank", "cut")]
        for conv_id, turn, role, text, lost, blank, cut in zip(*columns, strict=True):
            if now is None or conv_id != now.conv_id:
                if now is not None:
                    close(False)
                    first = False
                now = _Open(conv_id, first)
            elif now.bytes > CHUNK_BYTES or len(now.turns) >= most_turns:
                now.whole = False
                close(False)
            if waiting > CHUNK_BYTES:
                yield ready()
            if not lost:
                now.turns.append((role, text))
                now.numbers.append(turn)
                now.blank.append(blank)
                now.cut.append(cut)
                now.bytes += len(text)
    if now is not None:
        close(True)
        yield ready()


_FACTS = (
    "part int, chunk int, kinds binary, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string, "
    "least bigint, most bigint, distinct bigint, costs array<double>, ranks array<int>"
)


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What other chunks need to know of each chunk."""
    for batch in batches:
        out = []
        for rows, repeats in zip(batch.column("rows"), batch.column("repeats"), strict=True):
            rows = rows.as_py()
            turns = [(r["role"], r["text"]) for r in rows]
            kinds, counts = faults(turns, [r["blank"] for r in rows], [r["cut"] for r in rows], set(repeats.as_py() or ()))
            initials = [role[:1] for role, _ in turns]
            ways = [forward(kinds, state) for state in _STATES]
            out.append((
                kinds, *counts, illegal(initials), initials[0] if turns else None, initials[-1] if turns else None,
                *span([r["turn"] for r in rows]), [c for costs, _ in ways for c in costs], [r for _, ranks in ways for r in ranks],
            ))
        types = [pa.binary(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 3, pa.list_(pa.float64()), pa.list_(pa.int32())]
        names = [field.split(" ")[0] for field in _FACTS.split(", ")][2:]
        own = [pa.array(column, kind) for column, kind in zip(zip(*out, strict=True) if out else [[]] * len(types), types, strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "part", "chunk")), *own], ["conv_id", "part", "chunk", *names])


_CROSSINGS = "part int, chunk int, entry int, leave int, last boolean, " + ", ".join(f"{name} bigint" for name in _COUNTS)


def _crossings(facts: pa.Table) -> pa.Table:
    """The states in which the best path enters and leaves each chunk of one conversation, and the conversation's numbers,
    which stand on its first chunk. Equal turn numbers meet in order, so chunks can share only those at their borders."""
    facts = facts.sort_by([("part", "ascending"), ("chunk", "ascending")])
    costs, ranks, came = list(_only(_NOTHING)), [0] * 4, []
    for way, rank in zip(facts["costs"].to_pylist(), facts["ranks"].to_pylist(), strict=True):
        found = {}
        for b in _STATES:
            offers = [(costs[a] + way[4 * a + b], ranks[a], rank[4 * a + b], a) for a in _STATES]
            if min(offers)[0] < math.inf:
                found[b] = min(offers)
        order = sorted(found, key=lambda b: found[b][1:3])
        costs = [found[b][0] if b in found else math.inf for b in _STATES]
        ranks = [order.index(b) if b in found else 4 for b in _STATES]
        came.append([found[b][3] if b in found else 0 for b in _STATES])
    cost, state = ending(costs, ranks)
    leave = []
    for before in reversed(came):
        leave.append(state)
        state = before[state]
    leave.reverse()
    heads, tails = facts["head"].to_pylist(), facts["tail"].to_pylist()
    ends = [(h, t) for h, t in zip(heads, tails, strict=True) if h is not None]
    between = sum(illegal([a[1], b[0]]) for a, b in zip(ends, ends[1:], strict=False))
    spans = [s for s in zip(*(facts[c].to_pylist() for c in ("least", "most", "distinct")), strict=True) if s[2]]
    shared = sum(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    gaps = spans[-1][1] - spans[0][0] + 1 - sum(s[2] for s in spans) + shared if spans else 0
    sums = [sum(facts[c].to_pylist()) for c in ("blank", "duplicate", "truncated", "illegal")]
    numbers = (gaps, *sums[:3], sums[3] + between, cost)
    n = len(facts)
    columns = {"part": facts["part"], "chunk": facts["chunk"], "entry": [_NOTHING, *leave[:-1]], "leave": leave, "last": [False] * (n - 1) + [True]}
    columns |= {name: pa.array([number] + [0] * (n - 1), pa.int64()) for name, number in zip(_COUNTS, numbers, strict=True)}
    return pa.table(columns).cast(pa.schema([
        ("part", pa.int32()), ("chunk", pa.int32()), ("entry", pa.int32()), ("leave", pa.int32()), ("last", pa.bool_()),
        *[(name, pa.int64()) for name in _COUNTS],
    ]))


def _repaired_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        audits, fixed = [], []
        columns = [batch.column(c) for c in ("kinds", "entry", "leave", "last", "rows")]
        for kinds, entry, leave, last, rows in zip(*columns, strict=True):
            turns = [(r["role"], r["text"]) for r in rows.as_py()]
            entry, leave = entry.as_py(), leave.as_py()
            audits.append(edits(kinds.as_py(), entry, leave) + (_MISSING[leave] if last.as_py() else ""))
            fixed.append([{"role": r, "text": t} for r, t in applied(audits[-1], turns, entry)])
        own = [pa.array(audits, pa.string()), pa.array(fixed, pa.list_(_REPAIRED))]
        names = ["conv_id", "part", "chunk", "whole", *_COUNTS]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *own], [*names, "audit", "turns"])


def repaired(spark: SparkSession, rows: DataFrame, most_turns: int = CHUNK_TURNS) -> DataFrame:
    """The repaired conversations of ``rows`` (conv_id, turn, role, text and, if there is one, a boolean column ``lost``).

    One row for each chunk: conv_id, part and chunk (their order in the conversation), whole (the chunk is all of the
    conversation), gaps, blank, duplicate, truncated, illegal and cost (numbers whose sums over the chunks are the
    conversation's), audit (the chunk's edits) and turns (the chunk's repaired roles and texts).

    The turns of a conversation go by turn, nulls first, those of one turn by role and a hash of the text; equal ones
    stay apart as duplicates. A null role or text is one space, a null conv_id is a conversation like any other. Lost
    rows only name their conversation; one without other rows has one chunk with nothing in it. A turn that is no number
    counts as null. Other columns are ignored. An empty table gives no rows.

    A task works on one chunk at a time, ``most_turns`` turns and 16 MB, or one longer text. One row of some 300 bytes for each chunk of a
    conversation meets the others in one task, which is all that is gathered of it.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    made = written(spark, _in_order(rows).mapInArrow(partial(_pieces, most_turns=most_turns), f"conv_id {kind}, {_PIECE}, {_RAW}"), "conversations")
    open_ = made.where("NOT whole").select("conv_id", "part", "chunk", "whole", "rows")
    turns = open_.select("conv_id", "part", "chunk", F.posexplode("rows").alias("at", "row"))
    named = turns.select(
        F.struct("part", "chunk", "at").alias("place"), F.sha2(F.to_json(F.struct("conv_id", "row.role", "row.text")), 256).alias("name")
    )
    firsts = named.groupBy("name").agg(F.min("place").alias("first"))
    repeats = named.join(firsts, "name").where("place != first").groupBy("place.part", "place.chunk").agg(F.collect_list("place.at").alias("repeats"))
    facts = open_.join(repeats, ["part", "chunk"], "left").mapInArrow(_facts, f"conv_id {kind}, {_FACTS}")
    facts = written(spark, facts, "conversation-chunks")
    crossings = facts.drop("kinds").groupBy("conv_id").applyInArrow(_crossings, _CROSSINGS)
    chunks = open_.join(facts.select("part", "chunk", "kinds"), ["part", "chunk"]).join(crossings, ["part", "chunk"])
    whole = made.where("whole").drop("rows")
    return whole.unionByName(chunks.mapInArrow(_repaired_chunks, f"conv_id {kind}, {_PIECE}"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums, audit and digest of each conversation, over its chunks as they come by."""
    now, found = None, []

    def done() -> tuple:
        return (now["conv_id"], *now["sums"], "".join(now["audit"]), now["digest"].hexdigest())

    schema = None
    for batch in batches:
        schema = pa.schema([batch.schema.field("conv_id"), *[(n, pa.int64()) for n in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
        for row in range(len(batch)):
            values = {c: batch.column(c)[row].as_py() for c in ("conv_id", *_COUNTS, "audit")}
            if now is None or now["conv_id"] != values["conv_id"]:
                if now is not None:
                    found.append(done())
                now = {"conv_id": values["conv_id"], "sums": [0] * len(_COUNTS), "audit": [], "digest": hashlib.sha256(), "any": False}
            now["sums"] = [a + values[c] for a, c in zip(now["sums"], _COUNTS, strict=True)]
            now["audit"].append(values["audit"])
            for turn in batch.column("turns")[row].as_py():
                now["digest"].update(f"{chr(10) if now['any'] else ''}{turn['role']}:{turn['text']}".encode())
                now["any"] = True
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
            found = []
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(done(), schema, strict=True)], schema=schema)


def summaries(pieces: DataFrame) -> DataFrame:
    """One row for each conversation of :func:`repaired`: its numbers, its audit and ``repaired_sha256``, the SHA-256 of the
    repaired ``role:text`` lines joined by newlines.

    A digest is one sequence, so the chunks of a conversation with several pass through one task, one at a time.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    whole = pieces.where("whole").select("conv_id", *_COUNTS, "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
    keys = ["conv_id", "part", "chunk"]
    several = pieces.where("NOT whole").drop("whole").repartition("conv_id").sortWithinPartitions(*keys)
    columns = ", ".join(f"{name} bigint" for name in _COUNTS)
    return whole.unionByName(several.mapInArrow(_joined, f"conv_id {kind}, {columns}, audit string, repaired_sha256 string"))
