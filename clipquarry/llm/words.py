"""Words and their hashes in a batch of texts, with numpy over the bytes of all of them."""

from __future__ import annotations

import numpy as np

# Positions are hashed relative to the start of a stretch of this many bytes, so powers need no more room.
STRETCH = 1 << 17
BASE = 0x100000001B3
WORD_BITS = 1 << 64


def _powers(factor: int) -> np.ndarray:
    out = np.full(STRETCH + 1, factor, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


POWERS = _powers(BASE)
INVERSES = _powers(pow(BASE, -1, WORD_BITS))

BLANKS = b" \t\n\v\f\r"
LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
AS_IS = np.arange(256, dtype=np.uint8)
NOT_BLANK = np.array([c not in BLANKS for c in range(256)])


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread each number over all 64 bits, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def doc_words(flat: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word; `inside` tells which bytes words are made of. No word spans two rows."""
    word = np.concatenate([[False], inside[flat], [False]])
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(word[1:-1] & (~word[:-2] | edge[:-1]))
    stops = np.flatnonzero(word[1:-1] & (~word[2:] | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, stops, rows


def word_hashes(flat: np.ndarray, starts: np.ndarray, stops: np.ndarray, table: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each span of bytes as `table` shows them (A-Z as a-z). Starts and ends have to rise."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = int(np.searchsorted(stops, base + STRETCH, side="right"))
        if to <= at:
            out[at] = _long_hash(flat[base : stops[at]], table)
            at += 1
            continue
        part = table[flat[base : stops[to - 1]]].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * POWERS[: len(part)], out=sums[1:])
        s, e = starts[at:to] - base, stops[at:to] - base
        out[at:to] = (sums[e] - sums[s]) * INVERSES[s]
        at = to
    return mixed(out)


def _long_hash(span: np.ndarray, table: np.ndarray) -> np.uint64:
    total, power, step = 0, 1, pow(BASE, STRETCH, WORD_BITS)
    for at in range(0, len(span), STRETCH):
        part = table[span[at : at + STRETCH]].astype(np.uint64) + np.uint64(1)
        total = (total + int((part * POWERS[: len(part)]).sum(dtype=np.uint64)) * power) % WORD_BITS
        power = power * step % WORD_BITS
    return np.uint64(total)
