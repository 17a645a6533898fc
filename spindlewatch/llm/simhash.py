"""Near-duplicate documents by SimHash: fingerprints, a trie self-join within a Hamming distance, and components.

The join walks a binary trie of the distinct fingerprints, node pair by node pair: a pair's differing bits add up on
the way down and a pair over the budget is dropped with all below it. Pairs of large nodes are expanded by Spark, one
level of ``STEP`` bits a round; once the two nodes of a pair hold at most ``LEAF`` fingerprints, one task walks the
rest of their subtries. A node of any depth that is too large is just split further, so no group of similar
fingerprints has to fit in a task. A task returns a spanning forest of the links it finds, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindlewatch.llm.components import components
from spindlewatch.llm.words import Words, slices
from spindlewatch.shared import written

STEP = 4
LEAF = 1 << 15
_BATCH = 1 << 18

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(0x9E3779B185EBCA87),
    np.uint64(0xC2B2AE3D27D4EB4F),
    np.uint64(0x165667B19E3779F9),
    np.uint64(0x85EBCA77C2B2AE63),
    np.uint64(0x27D4EB2F165667C5),
)
# Each bit of a byte in a byte of its own.
_SPREAD = np.packbits(
    np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")[:, :, None]
    * np.array([1, 0, 0, 0, 0, 0, 0, 0], np.uint8),
    axis=2,
    bitorder="little",
).reshape(256, 8).copy().view("<u8").reshape(256)


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(state: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(state + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of ``data[start:start + length]`` for all ranges at once."""
    padded = np.concatenate([data, np.zeros(32, np.uint8)])
    lanes = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,)).copy()
    size, at = length.astype(np.uint64), start.copy()
    base = np.array([seed], np.uint64)
    state = np.repeat(base + _P5, len(start))
    long = np.flatnonzero(length >= 32)
    if len(long):
        four = [np.repeat(x, len(long)) for x in (base + _P1 + _P2, base + _P2, base, base - _P1)]
        left, where = length[long].copy(), at[long]
        live = np.arange(len(long))
        while len(live):
            for k in range(4):
                four[k][live] = _round(four[k][live], lanes[where[live] + 8 * k])
            where[live] += 32
            left[live] -= 32
            live = live[left[live] >= 32]
        whole = _turn(four[0], 1) + _turn(four[1], 7) + _turn(four[2], 12) + _turn(four[3], 18)
        for k in range(4):
            whole = (whole ^ _round(np.zeros_like(whole), four[k])) * _P1 + _P4
        state[long], at[long] = whole, where
    state += size
    left = start + length - at
    for _ in range(3):
        live = np.flatnonzero(left >= 8)
        if not len(live):
            break
        state[live] = _turn(state[live] ^ _round(np.zeros(len(live), np.uint64), lanes[at[live]]), 27) * _P1 + _P4
        at[live] += 8
        left[live] -= 8
    live = np.flatnonzero(left >= 4)
    state[live] = _turn(state[live] ^ ((lanes[at[live]] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at[live] += 4
    left[live] -= 4
    for _ in range(3):
        live = np.flatnonzero(left > 0)
        if not len(live):
            break
        state[live] = _turn(state[live] ^ (padded[at[live]].astype(np.uint64) * _P5), 11) * _P1
        at[live] += 1
        left[live] -= 1
    state = (state ^ (state >> np.uint64(33))) * _P2
    state = (state ^ (state >> np.uint64(29))) * _P3
    return state ^ (state >> np.uint64(32))


def fingerprints(texts: pa.Array, shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The SimHash of each text over its shingles of ``shingle`` lower-cased (A-Z) words, joined by one space.

    A text of fewer words is one shingle; one without words, or null, has fingerprint zero.
    """
    words = Words(texts)
    out = np.zeros(len(texts), np.uint64)
    if not len(words):
        return out
    size = words.stop - words.start
    at = np.concatenate([[0], np.cumsum(size + 1)])
    body = words.data[~words.spaces]
    upper = (body >= 65) & (body <= 90)
    line = np.full(at[-1], 32, np.uint8)
    place = np.ones(at[-1], bool)
    place[at[1:] - 1] = False
    line[place] = np.where(upper, body + np.uint8(32), body)
    count = np.diff(words.first)
    shingles = np.where(count >= shingle, count - shingle + 1, np.minimum(count, 1))
    row = np.repeat(np.arange(len(texts)), shingles)
    begin = np.concatenate([[0], np.cumsum(shingles)])
    head = words.first[row] + (np.arange(begin[-1]) - begin[row])
    tail = head + np.minimum(shingle, count[row])
    hashes = xxh64(line, at[head], at[tail] - 1 - at[head], seed)
    # Counts of 64 bits, each in a byte, over at most 255 shingles; then over those segments.
    within = np.arange(begin[-1]) - begin[row]
    cut = np.flatnonzero(within % 255 == 0)
    lanes = np.add.reduceat(_SPREAD[hashes.view(np.uint8).reshape(-1, 8)], cut, axis=0)
    counts = np.ascontiguousarray(lanes).view(np.uint8).reshape(len(cut), 64).astype(np.int64)
    segment = row[cut]
    rows, heads = np.unique(segment, return_index=True)
    total = np.add.reduceat(counts, heads, axis=0)
    bits = total * 2 > shingles[rows][:, None]
    out[rows] = np.packbits(bits, axis=1, bitorder="little").view("<u8").reshape(-1)
    return out


def fingerprinted(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint as a long, text_hash) for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            parts = [fingerprints(texts.slice(a, b - a), shingle, seed) for a, b in slices(texts)]
            found = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found.view(np.int64)), batch.column("text_hash")],
                ["doc_id", "fingerprint", "text_hash"],
            )

    columns = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return columns.mapInArrow(run, "doc_id long, fingerprint long, text_hash long")


def _prefix(depth: int) -> Column:
    """The trie node of ``depth`` bits above a fingerprint."""
    return F.shiftrightunsigned("fingerprint", 64 - depth)


def links(spark: SparkSession, distinct: DataFrame, most: int = 2, leaf: int = LEAF) -> DataFrame:
    """Links (u, v) among distinct ``fingerprint`` values that join the same values into components as all pairs
    at ``most`` or fewer differing bits do."""
    count = distinct.count()
    if 2 * count <= leaf:
        root = distinct.select(*[F.lit(0).cast("long").alias(c) for c in ("a", "b", "node")], F.lit(0).alias("bits"), "fingerprint")
        return written(spark, _walk(root, 0, most), "links")
    pairs = written(spark, distinct.limit(1).selectExpr("0L AS a", "0L AS b", "0 AS bits"), "pairs")
    found = []
    for depth in range(STEP, 64 + 1, STEP):
        children = distinct.select(_prefix(depth).alias("child")).groupBy("child").agg(F.count("*").alias("size"))
        children = children.select(F.shiftrightunsigned("child", STEP).alias("node"), "child", "size")
        below = (
            pairs.join(children.selectExpr("node AS a", "child AS x", "size AS size_x"), "a")
            .join(children.selectExpr("node AS b", "child AS y", "size AS size_y"), "b")
            .where("a < b OR x <= y")
        )
        differ = F.bit_count(F.col("x").bitwiseXOR(F.col("y")).bitwiseAND(F.lit((1 << STEP) - 1)))
        below = below.select(
            F.col("x").alias("a"), F.col("y").alias("b"), (F.col("bits") + differ).alias("bits"), F.expr("size_x + size_y AS size")
        )
        below = written(spark, below.where(F.col("bits") <= most), "pairs")
        small = below.where(F.col("size") <= leaf) if depth < 64 else below
        found.append(_walk(_members(distinct, small, depth), depth, most))
        pairs = below.where(F.col("size") > leaf).select("a", "b", "bits")
        if depth == 64 or pairs.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return written(spark, out, "links")


def _members(distinct: DataFrame, pairs: DataFrame, depth: int) -> DataFrame:
    """The fingerprints below both nodes of each pair of nodes of ``depth`` bits."""
    own = distinct.select(_prefix(depth).alias("node"), "fingerprint")
    both = F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))
    return pairs.select("a", "b", "bits", F.explode(both).alias("node")).join(own, "node")


def _walk(members: DataFrame, depth: int, most: int) -> DataFrame:
    """The links below pairs of nodes, as a forest for each pair."""

    def run(table: pa.Table) -> pa.Table:
        values = table.column("fingerprint").to_numpy().view(np.uint64)
        a, b, bits = (table.column(name)[0].as_py() for name in ("a", "b", "bits"))
        nodes = table.column("node").to_numpy()
        left = np.sort(values[nodes == a])
        right = left if a == b else np.sort(values[nodes == b])
        u, v = walk(left, right, depth, bits, most)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return members.groupBy("a", "b").applyInArrow(run, "u long, v long")


def walk(left: np.ndarray, right: np.ndarray, depth: int, bits: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest over the values of two subtries (sorted, distinct, unsigned) that are at ``most`` or fewer differing
    bits; ``left is right`` for a subtrie with itself. ``depth`` bits are done and hold ``bits`` differences."""
    same = left is right
    one = np.array([0]), np.array([len(left)]), np.array([0]), np.array([len(right)]), np.array([bits])
    stack = [(depth, one)]
    forest = _Forest(len(left) + (0 if same else len(right)))
    ones: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def counts(level: int) -> tuple[np.ndarray, np.ndarray]:
        if level not in ones:
            made = [
                np.concatenate([[0], np.cumsum((x >> np.uint64(63 - level)) & np.uint64(1))]).astype(np.int64)
                for x in ((left,) if same else (left, right))
            ]
            ones[level] = made[0], made[-1]
        return ones[level]

    while stack:
        level, state = stack.pop()
        if len(state[0]) > _BATCH:
            for k in range(0, len(state[0]), _BATCH):
                stack.append((level, tuple(x[k : k + _BATCH] for x in state)))
            continue
        a0, a1, b0, b1, used = state
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = np.bitwise_count(left[i] ^ right[j]) <= most
            if same:
                near &= i != j
            forest.add(i[near], j[near] + (0 if same else len(left)))
            a0, a1, b0, b1, used = (x[~single] for x in state)
        if not len(a0):
            continue
        in_left, in_right = counts(level)
        a = a1 - (in_left[a1] - in_left[a0])
        b = b1 - (in_right[b1] - in_right[b0])
        cross = (used < most)
        swap = cross & (a0 != b0) if same else cross
        parts = [
            (a0, a, b0, b, used, None), (a, a1, b, b1, used, None),
            (a0, a, b, b1, used + 1, cross), (a, a1, b0, b, used + 1, swap),
        ]
        kept = []
        for x0, x1, y0, y1, d, ask in parts:
            ok = (x1 > x0) & (y1 > y0)
            if ask is not None:
                ok &= ask
            kept.append((x0[ok], x1[ok], y0[ok], y1[ok], d[ok]))
        stack.append((level + 1, tuple(np.concatenate(x) for x in zip(*kept, strict=True))))
    i, j = forest.edges()
    values = left if same else np.concatenate([left, right])
    return values[i], values[j]


class _Forest:
    """Components of the nodes 0 to n - 1 under links that arrive in lots."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            x, y = self.label[i], self.label[j]
            apart = x != y
            if not apart.any():
                return
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        child = np.flatnonzero(self.label != np.arange(len(self.label)))
        return child, self.label[child]


def near_duplicates(spark: SparkSession, docs: DataFrame, shingle: int = 3, most: int = 2, seed: int = 42) -> DataFrame:
    """(fingerprint as a long, doc_id, text_hash, root, component_id) for every row of ``docs``.

    root is one fingerprint of the component, the same for all its rows. Documents are linked at ``most`` or fewer differing bits; component_id is the smallest doc_id reachable. Null and
    empty texts have fingerprint zero and are linked like any other. A null doc_id counts for nobody's component_id,
    which is null only where no row of the component has an id. Equal rows are returned as often as they occur, other
    columns are ignored, and an empty table gives an empty result.
    """
    rows = written(spark, fingerprinted(docs, shingle, seed), "fingerprints")
    nodes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    distinct = written(spark, nodes, "distinct")
    roots = components(spark, links(spark, distinct.select("fingerprint"), most))
    member = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    lowest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    found = member.join(lowest, "root").select("fingerprint", "root", "component_id")
    return rows.join(found, "fingerprint")


def keep_one(spark: SparkSession, docs: DataFrame, shingle: int = 3, most: int = 2) -> DataFrame:
    """The rows of ``docs`` less all but one of each component: the one with the smallest doc_id, and of rows that
    share it the one with the smallest hash of its text; of rows that share both, any one. A row
    without an id stays only where its component has no ids. The columns are those of ``docs``."""
    rows = near_duplicates(spark, docs, shingle, most)
    one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("one")
    first = rows.groupBy("root").agg(one).select("one.doc_id", "one.text_hash")
    # A null id has a key too, so that the join and the grouping are dealt by the same columns: the texts move once.
    key = [F.coalesce("doc_id", F.lit(0)).cast("long").alias("id"), F.col("doc_id").isNull().alias("none")]
    own = docs.select(F.struct("*").alias("row"), *key, F.xxhash64("text").alias("hash"))
    kept = own.join(first.select(*key, F.col("text_hash").alias("hash")), ["id", "none", "hash"])
    return kept.groupBy("id", "none", "hash").agg(F.first("row").alias("row")).select("row.*")
