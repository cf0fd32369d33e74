"""Removal of long byte strings that occur earlier in the corpus, by longest-previous-factor arrays.

A byte goes if a string of `LENGTH` bytes that covers it also starts earlier: in a smaller document, or further left
in the same one. First occurrences stay. Matches never cross documents and are judged on the texts as they came.

Equal strings are brought together without moving texts. Of the `GRAM`-byte grams in a window of `LENGTH` bytes, the
one that comes first in a hashed order is the window's anchor (the last of equals), so equal windows have equal
anchors. Neighbouring windows with one anchor are a stretch of up to 176 bytes. Stretches meet by their anchor:

1. A stretch that equals an earlier one goes as a whole. Most are settled inside a task, before the shuffle, so a
   passage that very many documents share sends one row per task.
2. An anchor with several different stretches needs a look at the bytes. These few are fetched from their documents
   and handed over by anchor. Their suffix array up to `LENGTH` bytes is built by prefix doubling; previous and next
   smaller positions in suffix order give the longest previous factor of each window, and windows whose factor reaches
   `LENGTH` go. A task holds a batch of anchors at a time.
3. An anchor with more than `CROWD` different stretches is settled by hashing each of its windows; hashes are grouped
   with a map-side combine, so no task holds the crowd.

Stretches and windows are taken as equal if their hashes of 128 bits are. Null texts are empty and lose nothing.
Null ids come after all others. Rows that repeat an id are ordered by a hash of their text; rows equal in both are
one document given twice, and get equal results. Extra columns stay where the function keeps the frame's columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipquarry.llm.shared import KEY, KEY_TYPES, TAGS, boxed, gathered, keyed, landed, pieces, text_bytes, whole_groups
from clipquarry.llm.words import AS_IS, mixed, word_hashes

LENGTH = 100
GRAM = 24
WIDE = LENGTH - GRAM + 1  # grams in a window
CROWD = 4096

# Bytes whose places fit beside a hash in one number.
PLACE_BITS = 24
SECTION = 1 << (PLACE_BITS - 1)
PLACE_MASK = np.uint64((1 << PLACE_BITS) - 1)
SIZE_BITS = 9  # of a stretch, in a packed place

# Of a window's bytes besides its anchor at least this many lie on one side of it. While stretches meet, a packed place also has a short hash
# of so many bytes on either side, 0 where a stretch has fewer.
SIDE = -(-(LENGTH - GRAM) // 2)
PLACE_OF = (1 << 40) - 1
SIDE_BITS = 11

# Text bytes within which equal stretches are settled before the shuffle.
SETTLED_BYTES = 32 << 20

# Bytes of stretches whose suffixes are sorted together; one anchor may have more, CROWD stretches at most.
SORTED_BYTES = 1 << 20

STEP = np.uint64(0x9E3779B97F4A7C15)
STEP2 = np.uint64(0xC2B2AE3D27D4EB4F)

REPEAT, OPEN, CROWDED = 0, 1, 2


def eights(flat: np.ndarray, order: str = "<u8") -> np.ndarray:
    """The eight bytes from each place on as a number; beyond the end stand zeros."""
    padded = np.concatenate([flat, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(flat)]).view(order)[:, 0]


def side_hash(eight: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
    """A hash of the `SIDE` bytes from each place on, 1 at least; 0 where they are not there."""
    out = np.zeros(len(at), np.uint64)
    at, h = at[there], np.zeros(np.count_nonzero(there), np.uint64)
    for k in (*range(0, SIDE - 8, 8), SIDE - 8):
        h = mixed(h * STEP + eight[at + k])
    out[there] = 1 + h % np.uint64((1 << SIDE_BITS) - 1)
    return out


def stretches(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, stretch hash, start, stop, sides) of all stretches in a batch of texts, by place."""
    found = []
    for at in range(0, max(1, len(flat)), SECTION):
        part = flat[at : at + SECTION + LENGTH - 1]
        if len(part) < LENGTH:
            break
        eight = eights(part)
        grams = len(part) - GRAM + 1
        h = mixed(eight[:grams] * STEP + eight[8 : grams + 8])
        h = mixed(h * STEP2 + eight[16 : grams + 16])
        low = (h & ~PLACE_MASK) | (PLACE_MASK - np.arange(grams, dtype=np.uint64))
        reach = 1
        while 2 * reach <= WIDE:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < WIDE:
            low = np.minimum(low[: reach - WIDE], low[WIDE - reach :])
        starts = np.arange(len(part) - LENGTH + 1)
        row = np.searchsorted(offsets, at + starts, side="right") - 1
        starts = starts[(at + starts + LENGTH <= offsets[row + 1]) & (starts < SECTION)]
        if not len(starts):
            continue
        anchor = (PLACE_MASK - (low[starts] & PLACE_MASK)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        start, last = starts[first], starts[np.r_[first[1:] - 1, len(starts) - 1]]
        stop = last + LENGTH
        inside = (anchor[first] - start).astype(np.uint64)
        whole = word_hashes(part, start, stop, AS_IS)
        whole = mixed(whole + inside * STEP + (stop - start).astype(np.uint64) * STEP2)
        mid = anchor[first]
        left = side_hash(eight, mid - SIDE, mid - start >= SIDE)
        right = side_hash(eight, mid + GRAM, stop - mid - GRAM >= SIDE)
        found.append((h[mid], whole, at + start, at + stop, (left | right << np.uint64(SIDE_BITS)).astype(np.int64)))
    if not found:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found))


def joined_spans(start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans as maximal runs."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.flatnonzero(np.r_[True, start[1:] > stop[:-1]]) if len(start) else np.empty(0, np.int64)
    return start[new], stop[np.r_[new[1:] - 1, len(stop) - 1]] if len(new) else new


MET = f"route bigint, whole bigint, {KEY_TYPES}, place bigint, repeat boolean"


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first of equal stretches in each part of a task, routed by anchor, and spans of the others as packed places."""
    for table in gathered(batches, SETTLED_BYTES):
        order = np.lexsort([table.column(c).to_numpy() for c in reversed(KEY)])
        table = table.take(pa.array(order)).combine_chunks()
        key = np.column_stack([table.column(c).to_numpy() for c in KEY])
        parts, seen = [], 0
        for piece in pieces(table.to_batches()):
            flat, offsets = text_bytes(piece.column("text"))
            anchor, whole, start, stop, sides = stretches(flat, offsets)
            row = np.searchsorted(offsets, start, side="right") - 1
            parts.append((anchor, whole, row + seen, start - offsets[row], stop - offsets[row], sides))
            seen += piece.num_rows
        if not parts:
            continue
        anchor, whole, row, start, stop, sides = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(mixed(anchor + whole * STEP), kind="stable")
        same = (anchor[order][1:] == anchor[order][:-1]) & (whole[order][1:] == whole[order][:-1])
        head = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(order)), 0)) if len(order) else order
        first = np.empty(len(order), np.int64)
        first[order] = order[head]
        own = first == np.arange(len(first))
        again = (key[row] == key[row[first]]).all(axis=1) & (start == start[first])
        gone = ~own & ~again
        yield _met_rows(anchor[own].view(np.int64), whole[own].view(np.int64), key[row[own]], start[own], stop[own], False, sides[own])
        if gone.any():
            # Touching spans of one document become one row, in pieces that a packed place can hold.
            base = row[gone] << 40
            low, high = joined_spans(base + start[gone], base + stop[gone])
            most = (1 << SIZE_BITS) - 1
            count = -(-(high - low) // most)
            low = np.repeat(low, count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * most
            high = np.minimum(low + most, np.repeat(high, count))
            doc = low >> 40
            spread = mixed(low.astype(np.uint64) + key[doc, 0].astype(np.uint64) * STEP).view(np.int64)
            low, high = low & ((1 << 40) - 1), high - (doc << 40)
            yield _met_rows(spread, np.zeros(len(low), np.int64), key[doc], low, high, True)


def _met_rows(route, whole, key, start, stop, repeat, sides=0) -> pa.RecordBatch:
    place = sides * (PLACE_OF + 1) | (start << SIZE_BITS) | (stop - start)
    arrays = [pa.array(route), pa.array(whole), *map(pa.array, key.T), pa.array(place), pa.array(np.full(len(route), repeat))]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in MET.split(", ")])


SETTLED = f"{KEY_TYPES}, place bigint, kind int, route bigint"


def _settled(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted by (route, whole, did, tag, tie, place): later equals are repeats. First ones stay open if their anchor has several, and
    another of them shares the bytes on one side: windows that are equal share them on the side where they have more."""
    none = np.empty((0, 3 + len(KEY)), np.int64)
    last = None  # the row before, and the first row of its stretch
    head = None
    waiting, crowded_route = none, None  # first rows of the open anchor; the anchor if they were sent as a crowd

    def out(rows: np.ndarray, kind) -> pa.RecordBatch:
        kinds = np.broadcast_to(np.asarray(kind, np.int32), len(rows))
        arrays = [*map(pa.array, rows[:, 2:-1].T), pa.array(rows[:, -1] & PLACE_OF), pa.array(kinds), pa.array(rows[:, 0])]
        return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in SETTLED.split(", ")])

    def open_ones(firsts: np.ndarray) -> pa.RecordBatch:
        group = np.cumsum(np.r_[False, firsts[1:, 0] != firsts[:-1, 0]])
        size = np.bincount(group)[group]
        sides = firsts[:, -1] >> 40
        shared = np.zeros(len(firsts), bool)
        for side in (sides & (1 << SIDE_BITS) - 1, sides >> SIDE_BITS):
            _, number, count = np.unique(group << SIDE_BITS | side, return_inverse=True, return_counts=True)
            shared |= (side > 0) & (count[number] > 1)
        return out(firsts[shared], np.where(size[shared] > most, CROWDED, OPEN))

    for batch in batches:
        repeat = batch.column("repeat").to_numpy(zero_copy_only=False)
        rows = np.column_stack([batch.column(c).to_numpy().astype(np.int64) for c in ("route", "whole", *KEY, "place")])
        if repeat.any():
            yield out(rows[repeat], REPEAT)
            rows = rows[~repeat]
        if not len(rows):
            continue
        before = np.vstack([rows[:1] if last is None else last[None], rows[:-1]])
        new = (rows[:, :2] != before[:, :2]).any(axis=1)
        new[0] |= last is None
        at = np.maximum.accumulate(np.where(new, np.arange(len(rows)), -1))
        heads = rows[np.maximum(at, 0)]
        if head is not None:
            heads[at < 0] = head
        later = ~new & (rows[:, 2:] != heads[:, 2:]).any(axis=1)
        if later.any():
            yield out(rows[later], REPEAT)
        last, head = rows[-1], heads[-1]

        firsts = np.vstack([waiting, rows[new]])
        route, last_route = firsts[:, 0], rows[-1, 0]
        if crowded_route is not None:  # more of the anchor that was sent already
            more = route == crowded_route
            if more.any():
                yield out(firsts[more], CROWDED)
            firsts, route = firsts[~more], route[~more]
            if last_route != crowded_route:
                crowded_route = None
        closed, waiting = firsts[route != last_route], firsts[route == last_route]
        if len(closed):
            yield open_ones(closed)
        if len(waiting) > most:
            yield out(waiting, CROWDED)
            waiting, crowded_route = none, last_route
    if len(waiting) > 1:
        yield open_ones(waiting)


# --- suffix order ---


def ranked(key: np.ndarray) -> np.ndarray:
    """The place of each key among the distinct keys."""
    order = np.argsort(key)
    ordered = key[order]
    rank = np.empty(len(key), np.uint64)
    rank[order] = np.cumsum(np.r_[False, ordered[1:] != ordered[:-1]])
    return rank


def smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one to the left, and to the right, with a smaller value; -1 if there is none."""

    def left(v: np.ndarray) -> np.ndarray:
        near = np.arange(len(v)) - 1
        while True:
            wrong = np.flatnonzero((near >= 0) & (v[near] >= v))
            if not len(wrong):
                return near
            near[wrong] = near[near[wrong]]

    mirrored = left(values[::-1])[::-1]
    return left(values), np.where(mirrored < 0, -1, len(values) - 1 - mirrored)


def longest_previous_factors(flat: np.ndarray, starts: np.ndarray, cap: int = LENGTH) -> np.ndarray:
    """For each of `starts`, rising, the length up to `cap` of the longest string there that also begins at an earlier
    one of them. From each start at least `cap` bytes have to follow; cap is 64 to 128.

    Ranks of strings of 8, 16, 32 and 64 bytes come from prefix doubling; two of 64 that overlap rank the suffixes up
    to `cap`. In that order an earlier suffix with the longest common prefix is next to the left or right of all
    earlier ones, that is a previous or next smaller position.
    """
    n = len(flat)
    ranks = {8: ranked(eights(flat, ">u8"))}
    for size in (16, 32, 64):
        half = ranks[size // 2]
        after = np.concatenate([half[size // 2 :], np.zeros(min(n, size // 2), np.uint64)])
        ranks[size] = ranked(half << np.uint64(32) | after)
    order = np.argsort(ranks[64][starts] << np.uint64(32) | ranks[64][starts + cap - 64], kind="stable")
    place = starts[order]

    def common(other: np.ndarray) -> np.ndarray:
        there = other >= 0
        a, b = place[there], place[other[there]]
        size = np.zeros(len(a), np.int64)
        for step in (64, 32, 16, 8, 4, 2, 1):
            i, j = a + size, b + size
            inside = np.maximum(i, j) + step <= n
            i, j = np.where(inside, i, 0), np.where(inside, j, 0)
            if step >= 8:
                equal = ranks[step][i] == ranks[step][j]
            else:
                equal = np.ones(len(a), bool)
                for k in range(step):
                    equal &= flat[np.minimum(i + k, n - 1)] == flat[np.minimum(j + k, n - 1)]
            size += np.where(inside & equal, step, 0)
        out = np.zeros(len(place), np.int64)
        out[there] = np.minimum(size, cap)
        return out

    before, after = smaller(place)
    factor = np.empty(len(starts), np.int64)
    factor[order] = np.maximum(common(before), common(after))
    return factor


SPANS = f"{KEY_TYPES}, start bigint, stop bigint"


def _factored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches sorted by (route, did, tag, tie, start): spans of windows that begin earlier among them."""
    held: list[pa.Table] = []
    size = 0

    def out() -> pa.RecordBatch:
        table = pa.concat_tables(held).combine_chunks()
        flat, offsets = text_bytes(table.column("raw").combine_chunks())
        *key, start = (table.column(c).to_numpy() for c in (*KEY, "start"))
        windows = np.diff(offsets) - LENGTH + 1
        row = np.repeat(np.arange(len(windows)), windows)
        within = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        gone = longest_previous_factors(flat, offsets[row] + within) >= LENGTH
        row, within = row[gone], within[gone]
        base = row << 20  # a stretch is far shorter
        low, high = joined_spans(base + within, base + within + LENGTH)
        row = low >> 20
        low, high = low - (row << 20), high - (row << 20)
        arrays = [*[pa.array(k[row]) for k in key], pa.array(start[row] + low), pa.array(start[row] + high)]
        return pa.RecordBatch.from_arrays(arrays, names=[*KEY, "start", "stop"])

    for groups in whole_groups(batches, ["route"]):
        route = groups.column("route").to_numpy()
        ends = np.flatnonzero(np.r_[route[1:] != route[:-1], True]) + 1
        sizes = np.cumsum(groups.column("stop").to_numpy() - groups.column("start").to_numpy())
        at = 0
        while at < len(route):
            used = sizes[at - 1] if at else 0
            fits = ends[(ends > at) & (sizes[ends - 1] - used <= SORTED_BYTES - size)]
            to = int(fits[-1]) if len(fits) else int(ends[ends > at][0])
            if not len(fits) and held:
                yield out()
                held, size = [], 0
                continue
            held.append(groups.slice(at, to - at))
            size += int(sizes[to - 1] - used)
            at = to
    if held:
        yield out()


RAW = f"route bigint, {KEY_TYPES}, start bigint, stop bigint, raw binary"


def _fetched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted stretches of each text."""
    for piece in pieces(batches):
        flat, offsets = text_bytes(piece.column("text"))
        wanted = piece.column("wanted")
        count = np.diff(wanted.offsets.to_numpy())
        fields = wanted.flatten()
        place, route = fields.field("place").to_numpy(), fields.field("route").to_numpy()
        row = np.repeat(np.arange(piece.num_rows), count)
        start, size = place >> SIZE_BITS, place & ((1 << SIZE_BITS) - 1)
        data = flat.tobytes()
        raw = [data[s : s + n] for s, n in zip((offsets[row] + start).tolist(), size.tolist())]
        arrays = [pa.array(route), *[piece.column(c).take(pa.array(row)) for c in KEY]]
        arrays += [pa.array(start), pa.array(start + size), pa.array(raw, pa.binary())]
        yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in RAW.split(", ")])


WINDOWS = f"one bigint, two bigint, {KEY_TYPES}, start bigint"


def _windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two hashes of each window of each stretch."""
    for batch in batches:
        flat, offsets = text_bytes(batch.column("raw"))
        windows = np.diff(offsets) - LENGTH + 1
        row = np.repeat(np.arange(len(windows)), windows)
        within = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = offsets[row] + within
        one = word_hashes(flat, at, at + LENGTH, AS_IS)
        eight = eights(flat)
        two = np.zeros(len(at), np.uint64)
        for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
            two = mixed(two * STEP + eight[at + k])
        *key, start = (batch.column(c).to_numpy() for c in (*KEY, "start"))
        arrays = [pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), *[pa.array(k[row]) for k in key], pa.array(start[row] + within)]
        yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in WINDOWS.split(", ")])


def _packed_span() -> list[Column]:
    start = F.shiftright("place", SIZE_BITS)
    return [start.alias("start"), (start + F.col("place").bitwiseAND((1 << SIZE_BITS) - 1)).alias("stop")]


def repeated_spans(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(did, tag, tie, spans) of keyed documents that lose something; spans are byte ranges, not in order and overlapping."""
    texts = rows.select(*KEY, "text")
    met = texts.mapInArrow(_met, MET).repartition("route").sortWithinPartitions("route", "whole", *KEY, "place")
    settled = landed(met.mapInArrow(lambda batches: _settled(batches, crowd), SETTLED), "settled")

    def fetched(kind: int) -> DataFrame:
        asked = settled.filter(F.col("kind") == kind).groupBy(*KEY)
        asked = asked.agg(F.collect_list(F.struct("place", "route")).alias("wanted")).hint("shuffle_hash")
        return texts.join(asked, KEY).mapInArrow(_fetched, RAW)

    spans = settled.filter(F.col("kind") == REPEAT).select(*KEY, *_packed_span())
    by_anchor = fetched(OPEN).repartition("route").sortWithinPartitions("route", *KEY, "start")
    spans = spans.unionByName(by_anchor.mapInArrow(_factored, SPANS))
    if not settled.filter(F.col("kind") == CROWDED).isEmpty():
        # Not landed: as a part of the caller's query it reads the shuffle of the texts that open stretches are fetched from.
        windows = fetched(CROWDED).mapInArrow(_windows, WINDOWS)
        order = F.struct(*KEY, "start")
        first = windows.groupBy("one", "two").agg(F.min(order).alias("first"))
        later = windows.join(first, ["one", "two"]).filter(order != F.col("first"))
        spans = spans.unionByName(later.select(*KEY, "start", (F.col("start") + LENGTH).alias("stop")))
    return spans.groupBy(*KEY).agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def _runs(spans: pa.Array, row: int) -> tuple[np.ndarray, np.ndarray]:
    value = spans[row].values
    if value is None:
        none = np.empty(0, np.int64)
        return none, none
    return joined_spans(value.field("start").to_numpy(), value.field("stop").to_numpy())


OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = []
        for n, text in enumerate(batch.column("text").to_pylist()):
            raw = memoryview(text.encode())
            start, stop = _runs(batch.column("spans"), n)
            kept, at = hashlib.sha256(), 0
            for s, e in zip(start.tolist(), stop.tolist()):
                kept.update(raw[at:s])
                at = e
            kept.update(raw[at:])
            found.append((len(raw), int((stop - start).sum()), len(start), kept.hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array(c, k) for c, k in zip(zip(*found), kinds)] if found else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[f.split()[0] for f in OUT.split(", ")])


def measured(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """What each document loses, and the checksum of what it keeps."""
    rows = keyed(docs.select("doc_id", "text")).select(*KEY, "text")
    rows = rows.join(repeated_spans(rows, crowd).hint("shuffle_hash"), KEY, "left")
    doc_id = F.when(F.col("tag") < TAGS, F.col("did")).alias("doc_id")
    return rows.select(doc_id, "text", "spans").mapInArrow(_measured, OUT)


def kept_text(text: str, start: np.ndarray, stop: np.ndarray) -> str:
    """The text without these byte ranges. A character goes only with all of its bytes."""
    raw, out, at = text.encode(), [], 0
    inner = lambda i: i < len(raw) and raw[i] & 0xC0 == 0x80  # noqa: E731  not the first byte of a character
    for s, e in zip(start.tolist(), stop.tolist()):
        while inner(s):
            s += 1
        while e > s and inner(e):
            e -= 1
        if e > s:
            out.append(raw[at:s])
            at = e
    return b"".join([*out, raw[at:]]).decode()


def without_repeats(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """docs with all columns, their texts without repeated strings; null texts become empty."""

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, found):
            if found is None or not len(found):
                return text
            start = np.array([s["start"] for s in found], np.int64)
            stop = np.array([s["stop"] for s in found], np.int64)
            return kept_text(text, *joined_spans(start, stop))

        return pd.Series([one(t, s) for t, s in zip(texts, spans)], dtype=object)

    spans = repeated_spans(keyed(docs.select("doc_id", "text")), crowd)
    rows = boxed(docs).join(spans.hint("shuffle_hash"), KEY, "left")
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    return rows.select(F.col("row").withField("text", cut(text, "spans")).alias("row")).select("row.*")
