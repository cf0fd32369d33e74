"""SimHash fingerprints and the groups of documents whose fingerprints are close.

A fingerprint bit is 1 if it is set in over half of the hashes of all word shingles. Two fingerprints link if they
differ in `RADIUS` bits or fewer, and linked fingerprints form groups.

Fingerprints are made distinct first, so copies cost nothing further. Two of them at distance two agree in two of
four 16-bit blocks at least, so they meet under one of six 32-bit keys. Under a key they are compared bit-sliced:
plane b holds bit b of 64 fingerprints in a word, so one exclusive-or compares a bit with 64 others, carry-save
counters add up the differences, and words in which all exceed the radius are dropped early. A key with more than
`CROWD` fingerprints is not compared; its fingerprints meet under the same rule on the 32 bits that the key leaves
(48 bits shared), and crowds there on the last 16 (56 bits shared, 256 fingerprints at most). No pair is lost.

Null and empty texts have the fingerprint zero and link like any other. Repeated rows get equal results. Null ids
get no say in the smallest id of a group. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from clipquarry.llm.components import components
from clipquarry.llm.shared import KEY, KEY_TYPES, TAGS, boxed, keyed, landed, whole_groups
from clipquarry.skew import salted_join

BITS = 64
RADIUS = 2
SHINGLE = 3
SEED = 42
CROWD = 1024
HASHES_AT_ONCE = 1 << 15

# Planes that are added between two looks at which words can still hold a pair.
PLANES_BETWEEN = 8


def shingle_hashes(text: str | None, width: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles of one text, repeats included, some at a time."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and ASCII blanks only
    if not words:
        return
    line = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda end, size: end + 1 + size))
    starts = [0, *[end + 1 for end in ends[: max(0, len(words) - width)]]]
    ends = ends[min(width, len(words)) - 1 :]
    for at in range(0, len(starts), HASHES_AT_ONCE):
        spans = zip(starts[at : at + HASHES_AT_ONCE], ends[at : at + HASHES_AT_ONCE])
        yield np.array([xxh64_intdigest(line[s:e], seed) for s, e in spans], np.uint64)


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text, zero if it has no word."""
    total, ones = 0, np.zeros(BITS, np.int64)
    for hashes in shingle_hashes(text, width, seed):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(hashes)
    most = np.packbits(2 * ones > total, bitorder="little") if total else np.zeros(8, np.uint8)
    return int(most.view("<u8")[0])


def with_fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(did, tag, tie, fp) for each keyed row, fp as a signed number with the same bits. Reads whole texts, moves none."""

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, width, seed) for t in batch.column("text").to_pylist()]
            arrays = [*[batch.column(c) for c in KEY], pa.array(np.array(found, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*KEY, "fp"])

    return keyed(docs.select("doc_id", "text")).select(*KEY, "text").mapInArrow(hashed, f"{KEY_TYPES}, fp bigint")


def block_masks() -> list[list[list[int]]]:
    """For each level the masks that continue a mask of the level before: two of four equal blocks of the bits left."""
    levels, open_masks = [], [0]
    for width in (16, 8, 4):
        added = []
        for mask in open_masks:
            free = [b for b in range(BITS) if not mask >> b & 1]
            blocks = [sum(1 << b for b in free[i : i + width]) for i in range(0, len(free), width)]
            added.append([mask | x | y for x, y in combinations(blocks, 2)])
        levels.append(added)
        open_masks = [m for masks in added for m in masks]
    return levels


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _keyed(rows: DataFrame, level: list[list[int]]) -> DataFrame:
    """Rows (path, fp) under each key of the next level; a path numbers the masks on the way there."""
    first = [[(p * len(masks) + i, _signed(m)) for i, m in enumerate(masks)] for p, masks in enumerate(level)]
    if len(first) == 1:
        options = F.array(*[F.struct(F.lit(n).alias("path"), F.lit(m).cast("bigint").alias("mask")) for n, m in first[0]])
    else:
        table = F.array(
            *[F.array(*[F.struct(F.lit(n).alias("path"), F.lit(m).cast("bigint").alias("mask")) for n, m in ms]) for ms in first]
        )
        options = F.element_at(table, F.col("path") + 1)
    opened = rows.select("fp", F.explode(options).alias("o"))
    return opened.select(F.col("o.path").alias("path"), F.col("fp").bitwiseAND(F.col("o.mask")).alias("key"), "fp")


def near_in_runs(values: np.ndarray, run: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j), i < j, of equal `run` whose values differ in `radius` (2 or less) bits or fewer.

    `run` numbers the runs in rising order. Lane n % 64 of word n // 64 stands for value n.
    """
    n = len(values)
    words = -(-n // 64)
    bits = np.zeros((words * 64, BITS), np.uint8)
    bits[:n] = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8").reshape(BITS, words)
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    stops = np.r_[starts[1:], n]
    size = np.repeat(stops, stops - starts)
    stop = size  # of the run of each value
    here = np.arange(n)
    reach = (stop - 1) // 64 - here // 64 + 1  # words from that of a value to the end of its run
    item = np.repeat(here, reach)
    word = np.arange(len(item)) - np.repeat(np.cumsum(reach) - reach, reach) + item // 64
    ones64 = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.clip(item + 1 - word * 64, 0, 64)
    high = np.clip(stop[item] - word * 64, 0, 64)

    def below(k):  # the lowest k bits
        return np.where(k >= 64, ones64, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))

    open_lanes = below(high) & ~below(low)
    live = open_lanes != 0
    item, word, open_lanes = item[live], word[live], open_lanes[live]
    one, two = np.zeros(len(item), np.uint64), np.zeros(len(item), np.uint64)
    for b in range(BITS):
        own = (values[item] >> np.uint64(b)) & np.uint64(1)
        differ = planes[b][word] ^ (np.uint64(0) - own)
        carry = one & differ
        one ^= differ
        over = two & carry
        two ^= carry
        open_lanes &= ~over  # four differences
        open_lanes &= ~(two & one) if radius == 2 else ~two if radius == 1 else ~(two | one)
        if b % PLANES_BETWEEN == PLANES_BETWEEN - 1:
            live = open_lanes != 0
            item, word, open_lanes, one, two = item[live], word[live], open_lanes[live], one[live], two[live]
    lanes = np.unpackbits(open_lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(lanes)
    return item[row], word[row] * 64 + lane


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is connected with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        while (jump := new[new]).tobytes() != new.tobytes():
            new = jump
        if (new == root).all():
            return root
        root = new


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_groups(batches, ["path", "key"]):
        path, key, fp = (table.column(c).to_numpy() for c in ("path", "key", "fp"))
        run = np.cumsum(np.r_[False, (path[1:] != path[:-1]) | (key[1:] != key[:-1])])
        shared = np.bincount(run)[run] > 1
        fp, run = fp[shared], run[shared]
        if not len(fp):
            continue
        root = forest(len(fp), *near_in_runs(fp.view(np.uint64), run))
        tied = root != np.arange(len(fp))
        yield pa.RecordBatch.from_arrays([pa.array(fp[tied]), pa.array(fp[root[tied]])], names=["a", "b"])


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between the distinct values `fp`, which connect the same fingerprints as all links together."""
    found, rows = None, fps.select("fp").distinct().withColumn("path", F.lit(0))
    levels = block_masks()
    for at, level in enumerate(levels):
        rows = _keyed(rows, level)
        crowded = None
        if at + 1 < len(levels):
            counts = rows.groupBy("path", "key").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).drop("n")
            crowded = landed(counts, "crowds")
            if crowded.isEmpty():
                crowded = None
        calm = rows if crowded is None else rows.join(crowded, ["path", "key"], "left_anti")
        edges = (
            calm.repartition("path", "key").sortWithinPartitions("path", "key").mapInArrow(_compared, "a bigint, b bigint")
        )
        found = edges if found is None else found.unionByName(edges)
        if crowded is None:
            return found
        rows = landed(rows.join(crowded, ["path", "key"], "left_semi").select("fp", "path"), "crowded")
    return found


def _grouped(docs: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """(did, tag, tie, fp) of all rows, and (fp, component) of all fingerprints, where component is one of them."""
    prints = landed(with_fingerprints(docs), "prints")
    distinct = prints.select("fp").distinct()
    tied = landed(components(links(distinct, crowd), "a", "b"), "components")
    groups = distinct.join(tied, distinct["fp"] == tied["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"))
    return prints, groups


def near_groups(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that linked fingerprints reach."""
    prints, groups = _grouped(docs, crowd)
    own_id = F.when(F.col("tag") < TAGS, F.col("did"))
    first = prints.groupBy("fp").agg(F.min(own_id).alias("first"))
    smallest = groups.join(first, "fp").groupBy("component").agg(F.min("first").alias("component_id"))
    named = groups.join(smallest, "component").select("fp", "component_id")
    return salted_join(prints, named, ["fp"], KEY).select(own_id.alias("doc_id"), "fp", "component_id")


def one_of_each(docs: DataFrame, crowd: int = CROWD) -> DataFrame:
    """One row of each group with all its columns: that of the smallest doc_id, a null id only if all are null."""
    prints, groups = _grouped(docs, crowd)
    first = prints.groupBy("fp").agg(F.min(F.struct(*KEY)).alias("first"))
    chosen = groups.join(first, "fp").groupBy("component").agg(F.min("first").alias("first")).select("first.*")
    kept = boxed(docs).join(chosen.hint("shuffle_hash"), KEY, "left_semi")
    return kept.dropDuplicates(KEY).select("row.*")


def hex_form(column: Column) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")
