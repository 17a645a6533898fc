"""Simple-8b: unsigned integers packed in 64-bit words, as many to a word as fit.

The top four bits of a word select how many values of how many bits follow, the first in the lowest bits. Selector 0 is
an escape: one value of more than 60 bits, found in the block's list of escapes at the place the other bits give.
Values are coded in blocks that can be decoded by themselves, all values of a selector at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 4096

# Number and width of the values of each selector.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits of each value, at least one."""
    if values.max() < 1 << 53:
        return np.maximum(np.frexp(values.astype(np.float64))[1], 1).astype(np.int8)
    out = np.ones(len(values), np.int8)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        more = rest >= (np.uint64(1) << np.uint64(step))
        out += np.where(more, np.int8(step), np.int8(0))
        rest = np.where(more, rest >> np.uint64(step), rest)
    return out


def encode(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, words of each block, escaped values, escapes of each block) of unsigned 64-bit ``values``.

    Every block but the last holds ``block`` values. Each word takes the most values that fit from where it begins.
    """
    values = np.ascontiguousarray(values, np.uint64)
    n = len(values)
    blocks = -(-n // block)
    if not n:
        return values, np.zeros(0, np.int64), values, np.zeros(0, np.int64)
    bits = _bits(values)
    # Values up to the end of each one's block, as far as a word could take them.
    place = np.arange(n)
    room = np.minimum(np.minimum(block - place % block, n - place), COUNTS.max()).astype(np.int8)
    selector = np.where(bits > 60, np.int8(0), np.int8(len(COUNTS) - 1))
    # The widest of so many values from each place on; each is made of two overlapping shorter runs.
    widest, length = bits, 1
    for s in range(len(COUNTS) - 2, 0, -1):
        if COUNTS[s] > n:
            break
        shift = COUNTS[s] - length
        longer = widest.copy()
        longer[: n - shift] = np.maximum(widest[: n - shift], widest[shift:])
        widest, length = longer, COUNTS[s]
        fits = (widest <= WIDTHS[s]) & (room >= COUNTS[s])
        # More values of fewer bits hold some of more bits, so no later selector fits either.
        if not fits.any():
            break
        selector[fits] = s
    step = COUNTS[selector]
    # All blocks are followed at once.
    at = np.arange(blocks) * block
    ends = np.minimum(at + block, n)
    begun = np.zeros(n, bool)
    while len(at):
        begun[at] = True
        at = at + step[at]
        going = at < ends
        at, ends = at[going], ends[going]
    starts = np.flatnonzero(begun)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(1, len(COUNTS)):
        which = np.flatnonzero(chosen == s)
        first, body = starts[which], np.zeros(len(which), np.uint64)
        for k in range(COUNTS[s] if len(which) else 0):
            body |= values[first + k] << np.uint64(k * WIDTHS[s])
        words[which] |= body
    of_block = starts // block
    escaped = chosen == 0
    escapes = np.bincount(of_block[escaped], minlength=blocks)
    if escaped.any():
        base = np.cumsum(escapes) - escapes
        words[escaped] |= (np.arange(int(escaped.sum())) - base[of_block[escaped]]).astype(np.uint64)
    return words, np.bincount(of_block, minlength=blocks), values[starts[escaped]], escapes


def decode(words: np.ndarray, escaped: np.ndarray, escape_base: np.ndarray | int = 0) -> np.ndarray:
    """The values of consecutive words. ``escape_base`` is the first escape of each word's block in ``escaped``."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selector]
    ends = np.cumsum(counts)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint64)
    first = ends - counts
    for s in np.unique(selector):
        which = np.flatnonzero(selector == s)
        body = words[which] & np.uint64((1 << 60) - 1)
        if s == 0:
            base = np.broadcast_to(escape_base, len(words))[which]
            out[first[which]] = escaped[base + body.astype(np.int64)]
            continue
        mask = np.uint64((1 << int(WIDTHS[s])) - 1)
        for k in range(COUNTS[s]):
            out[first[which] + k] = (body >> np.uint64(k * WIDTHS[s])) & mask
    return out
