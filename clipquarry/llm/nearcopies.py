"""Groups of documents that are near copies: a Jaccard likeness of `LIKENESS` or more on `fingerprints.SHINGLE`-word shingles.

Every link is judged on the whole shingle sets. What is looked at comes from SimHash fingerprints that link (`simhash`: three words,
two bits; the smallest set of a fingerprint stands for it), and, as most near copies are further apart than that, from
one-permutation MinHash (256 bins):

1. Documents with equal shingle sets (128-bit hash) become one set, so copies cost nothing further.
2. Sets meet under the hash of any of 51 bands of five bins. Two sets at 0.8 miss each other with a chance of
   (1 - 0.8^5)^51 = 2e-9, likelier ones less. Keys that one set has alone are dropped before anything else is sent.
   Under a key with more than `CROWD` sets one of them leads: sets near it (as in step 3) are linked to it where they
   lie, and need not be compared with each other any more. If others are left, these are met again under the key and one more band
   (50 tries), together with those near the leader that share such a longer key with one of them. This is repeated, each time
   with a band that the key does not have yet, until no group is larger, or `LEVELS` bands are in the key.
3. Under a key each set reached so far is held against those not yet reached, by four bits a bin, with a margin of nine
   standard errors below 0.8. What is left are loose groups, which hold every group of near copies as a whole.
4. SimHash links join loose groups further. The shingle sets of a loose group come together, and the same walk is made with their exact likeness. A group of more than
   `CHUNK` sets is cut into chunks, and every two chunks meet, so no task holds more than two.

Linked documents form groups. Texts without a word are alike. Repeated rows are one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquarry.llm import simhash
from clipquarry.llm.components import components
from clipquarry.llm.fingerprints import BINS, LOW_BITS, STEP, bin_minima, shingles
from clipquarry.llm.shared import KEY, KEY_TYPES, boxed, keyed, landed, pieces, text_bytes, whole_groups
from clipquarry.llm.words import mixed
from clipquarry.skew import salted_join

LIKENESS = 0.8
BAND = 5
BANDS = BINS // BAND
CROWD = 1 << 15
CHUNK = 2048

# Bands in a key at most. Sets at 0.6 that share one band share four more given ones with a chance of 4e-5.
LEVELS = 5

# Standard errors below the likeness at which two sketches still count as near.
MARGIN = 9

STEP2 = np.uint64(0xC2B2AE3D27D4EB4F)
NIBBLES = np.uint64(0x1111111111111111)


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, by row and value, and the row of each."""
    value, row = shingles(*text_bytes(column))
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])] if len(row) else np.empty(0, bool)
    return value[new], row[new]


def _set_names(value: np.ndarray, row: np.ndarray, n: int) -> list[bytes]:
    """128 bits for each row's set, the same whatever order its shingles come in."""
    sums = np.zeros((n, 2), np.uint64)
    np.add.at(sums[:, 0], row, mixed(value + STEP))
    np.add.at(sums[:, 1], row, mixed(value * STEP2 + STEP))
    return [s.tobytes() for s in sums]


def _band_keys(minima: np.ndarray) -> np.ndarray:
    keys = np.empty((len(minima), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(minima), b, np.uint64)
        for bin_ in range(b * BAND, (b + 1) * BAND):
            key = mixed(key * STEP + minima[:, bin_])
        keys[:, b] = key
    return keys


PRINTS = f"{KEY_TYPES}, name binary, sketch binary, bands binary, fp bigint"


def _printed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        value, row = shingle_sets(piece.column("text"))
        n = piece.num_rows
        worded = np.bincount(row, minlength=n) > 0
        minima = bin_minima(value, row, n)
        low = (minima & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint8)
        sketch = (low[:, 0::2] << 4) | low[:, 1::2]
        bands = _band_keys(minima)
        arrays = [piece.column(c) for c in KEY]
        arrays += [pa.array(_set_names(value, row, n), pa.binary()), pa.array([s.tobytes() for s in sketch], pa.binary())]
        arrays += [pa.array([b.tobytes() if w else b"" for b, w in zip(bands, worded)], pa.binary())]
        prints = [simhash.fingerprint(t) for t in piece.column("text").to_pylist()]
        arrays += [pa.array(np.array(prints, np.uint64).view(np.int64))]
        yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in PRINTS.split(", ")])


def _rows_of(column: pa.Array, kind: type) -> np.ndarray:
    """Values of equal size as rows of numbers."""
    flat = b"".join(column.to_pylist())
    return np.frombuffer(flat, kind).reshape(len(column), -1)


MEETS = "key bigint, used bigint, name binary"
REFINED = f"{MEETS}, near boolean"
BAND_BITS = np.int64(1) << np.arange(BANDS, dtype=np.int64)


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set under all its bands; `used` has the bits of the bands in a key."""
    for batch in batches:
        if batch.num_rows:
            keys = _rows_of(batch.column("bands"), np.uint64)
            names = batch.column("name").take(pa.array(np.repeat(np.arange(len(keys)), BANDS)))
            arrays = [pa.array(keys.ravel().view(np.int64)), pa.array(np.tile(BAND_BITS, len(keys))), names]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "used", "name"])


def _refined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row (key, used, name, near, bands) under its key and any band that is not in it. Keys are sums, so the order
    in which bands came into them does not matter."""
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            keys = _rows_of(part.column("bands"), np.uint64) + part.column("key").to_numpy().view(np.uint64)[:, None]
            used = part.column("used").to_numpy()[:, None]
            row, band = np.nonzero(used & BAND_BITS == 0)
            of = pa.array(row)
            arrays = [pa.array(keys[row, band].view(np.int64)), pa.array(used[row, 0] | BAND_BITS[band])]
            arrays += [part.column("name").take(of), part.column("near").take(of)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "used", "name", "near"])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bins of four bits in which rows of sketches differ."""
    apart = a ^ b
    apart |= apart >> np.uint64(2)
    apart |= apart >> np.uint64(1)
    return np.bitwise_count(apart & NIBBLES).sum(axis=1, dtype=np.int64)


LED = f"{MEETS}, leader binary, near boolean"


def _led(batches: Iterable[pa.RecordBatch], likeness: float) -> Iterator[pa.RecordBatch]:
    """Whether a set's sketch is near that of its group's leader."""
    most = most_different(likeness)
    for batch in batches:
        if batch.num_rows:
            sketch, first = (_rows_of(batch.column(c), np.uint64) for c in ("sketch", "first"))
            arrays = [batch.column(c) for c in ("key", "used", "name", "leader")]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(_apart(sketch, first) <= most)], names=["key", "used", "name", "leader", "near"])


def _groups(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of rows sorted by `key`, one for each key that has several."""
    for table in whole_groups(batches, [key]):
        values = table.column(key).to_numpy()
        starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
        stops = np.r_[starts[1:], len(values)]
        for start, stop in zip(starts.tolist(), stops.tolist()):
            if stop - start > 1:
                yield table.slice(start, stop - start)


def _several(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, sorted by key, whose key another row has. The last row of a batch waits for the next one; no key is held as a whole."""
    last, more = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        if last is not None:
            batch = pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        key = batch.column("key").to_numpy()
        same = key[1:] == key[:-1]
        keep = np.r_[more, same] | np.r_[same, False]
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1]))
        last, more = batch.slice(batch.num_rows - 1), bool(keep[-1])
    if more:
        yield last


def walked(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[list[int], list[int]]:
    """Edges that connect the same of n nodes as all pairs that are near: each node reached is held against all that are
    not yet reached. A group in which most are near each other costs few looks."""
    left, queue, a, b = np.arange(1, n), [0], [], []
    while len(left):
        if not queue:
            queue, left = [int(left[0])], left[1:]
            continue
        node = queue.pop(0)
        hit = near(node, left)
        found = left[hit].tolist()
        left = left[~hit]
        queue += found
        a += [node] * len(found)
        b += found
    return a, b


EDGES = "a binary, b binary"


def _edges(table: pa.Table, a: list[int], b: list[int]) -> pa.RecordBatch:
    name = table.column("name").combine_chunks()
    return pa.RecordBatch.from_arrays([name.take(pa.array(a, pa.int64())), name.take(pa.array(b, pa.int64()))], names=["a", "b"])


def most_different(likeness: float) -> int:
    """Bins of four bits in which two sketches of this likeness differ at most, up to chance."""
    share = (1 - likeness) * (1 - 1 / (1 << LOW_BITS))
    return int(BINS * (share + MARGIN * (share * (1 - share) / BINS) ** 0.5)) + 1


def _loose(batches: Iterable[pa.RecordBatch], likeness: float) -> Iterator[pa.RecordBatch]:
    most = most_different(likeness)
    for table in _groups(batches, "key"):
        sketch = _rows_of(table.column("sketch"), np.uint64)

        def near(node: int, others: np.ndarray) -> np.ndarray:
            return _apart(sketch[others], sketch[node]) <= most  # noqa: B023

        a, b = walked(table.num_rows, near)
        if a:
            yield _edges(table, a, b)


SETS = "name binary, component binary, values binary"


def _fetched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches):
        value, row = shingle_sets(piece.column("text"))
        ends = np.searchsorted(row, np.arange(piece.num_rows + 1))
        values = pa.array([value[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:])], pa.binary())
        arrays = [piece.column("name"), piece.column("component"), values]
        yield pa.RecordBatch.from_arrays(arrays, names=["name", "component", "values"])


def _judged(batches: Iterable[pa.RecordBatch], likeness: float) -> Iterator[pa.RecordBatch]:
    for table in _groups(batches, "route"):
        sets = [np.frombuffer(v, np.uint64) for v in table.column("values").to_pylist()]
        size = np.array([len(s) for s in sets])
        starts = np.cumsum(size) - size
        distinct, code = np.unique(np.concatenate(sets), return_inverse=True)
        marked = np.zeros(len(distinct), bool)

        def near(node: int, others: np.ndarray) -> np.ndarray:
            small, large = np.minimum(size[others], size[node]), np.maximum(size[others], size[node])  # noqa: B023
            hit = small >= likeness * large - 1e-9  # else even a part of the larger one is too small
            some = others[hit]
            if not len(some):
                return hit
            own = code[starts[node] : starts[node] + size[node]]  # noqa: B023
            marked[own] = True  # noqa: B023
            ends = np.cumsum(size[some])  # noqa: B023
            at = np.arange(ends[-1]) + np.repeat(starts[some] - ends + size[some], size[some])  # noqa: B023
            common = np.add.reduceat(marked[code[at]].astype(np.int64), ends - size[some])  # noqa: B023
            marked[own] = False  # noqa: B023
            hit[hit] = common >= likeness * (size[some] + size[node] - common) - 1e-9  # noqa: B023
            return hit

        a, b = walked(len(sets), near)
        if a:
            yield _edges(table, a, b)


def small_groups(sets: DataFrame, likeness: float, crowd: int, levels: int = LEVELS) -> tuple[list[DataFrame], list[DataFrame]]:
    """Groups (key, name) in which sets have to be compared, none larger than `crowd` unless its key has `levels` bands; and
    the edges (a, b) to the leaders of larger ones."""

    def several(rows: DataFrame) -> DataFrame:
        rows = rows.select("key", "used", "name").repartition("key").sortWithinPartitions("key")
        return landed(rows.mapInArrow(_several, MEETS), "meets")

    worded = sets.filter(F.octet_length("bands") > 0)
    meets = several(worded.select("name", "bands").mapInArrow(_met, MEETS))
    small, edges = [], []
    for _ in range(levels - 1):
        crowds = landed(meets.groupBy("key").agg(F.count("*").alias("n"), F.min("name").alias("leader")).filter(F.col("n") > crowd), "crowds")
        if crowds.isEmpty():
            break
        small.append(meets.join(crowds, "key", "left_anti"))
        leaders = crowds.join(worded.select(F.col("name").alias("leader"), F.col("sketch").alias("first")), "leader").drop("n")
        members = salted_join(meets, leaders, ["key"], ["name"], counted=meets.select("key")).join(worded.select("name", "sketch"), "name")
        led = landed(members.mapInArrow(lambda b: _led(b, likeness), LED), "led")
        edges.append(led.filter("near and name <> leader").select(F.col("leader").alias("a"), F.col("name").alias("b")))
        # Groups without anyone unlike the leader are settled; they are not met again.
        open_keys = led.filter("not near").select("key").distinct()
        longer = led.join(open_keys, "key", "left_semi").drop("leader").join(worded.select("name", "bands"), "name")
        longer = longer.mapInArrow(_refined, REFINED)
        # A set may come under one longer key from two shorter ones; unlike one leader counts.
        longer = landed(longer.groupBy("key", "used", "name").agg(F.min("near").alias("near")), "longer")
        unlike = longer.filter("not near").select("key").distinct()
        meets = several(longer.join(unlike, "key", "left_semi"))
    return [*small, meets], edges


def loose_links(sets: DataFrame, likeness: float = LIKENESS, crowd: int = CROWD) -> DataFrame:
    """Edges (a, b) between the names of `sets` (name, sketch, bands), which connect all that may be alike."""
    groups, edges = small_groups(sets, likeness, crowd)
    for meets in groups:
        rows = meets.select("key", "name").join(sets.select("name", "sketch"), "name").select("key", "name", "sketch")
        rows = rows.repartition("key").sortWithinPartitions("key")
        edges.append(rows.mapInArrow(lambda b: _loose(b, likeness), EDGES))
    return reduce(DataFrame.unionByName, edges)


def fingerprint_links(prints: DataFrame, crowd: int = simhash.CROWD) -> DataFrame:
    """Edges (a, b) between names of `prints` (name, fp), which connect all sets whose fingerprints are equal or link."""
    named = landed(prints.select("fp", "name").distinct(), "fingerprints")
    leaders = landed(named.groupBy("fp").agg(F.min("name").alias("leader")), "leaders")
    equal = salted_join(named, leaders, ["fp"], ["name"]).filter("name <> leader").select(F.col("leader").alias("a"), F.col("name").alias("b"))
    links = simhash.links(leaders.select("fp"), crowd).withColumnsRenamed({"a": "fp", "b": "other"})
    near = links.join(leaders.withColumnRenamed("leader", "a"), "fp").join(leaders.select(F.col("fp").alias("other"), F.col("leader").alias("b")), "other")
    return equal.unionByName(near.select("a", "b"))


def _grouped(docs: DataFrame, likeness: float, crowd: int, chunk: int) -> DataFrame:
    """(component, first): the key of the first document of each group."""
    texts = keyed(docs.select("doc_id", "text")).select(*KEY, "text")
    prints = landed(texts.mapInArrow(_printed, PRINTS), "prints")
    sets = landed(prints.select("name", "sketch", "bands").dropDuplicates(["name"]), "sets")
    first = landed(prints.groupBy("name").agg(F.min(F.struct(*KEY)).alias("first")), "firsts")

    links = fingerprint_links(prints.select("name", "fp")).unionByName(loose_links(sets, likeness, crowd))
    loose = components(links, "a", "b").withColumnRenamed("node", "name")
    wanted = first.join(loose, "name").select("first.*", "name", "component")
    found = texts.join(wanted.hint("shuffle_hash"), KEY).dropDuplicates(KEY)
    found = landed(found.select("text", "name", "component").mapInArrow(_fetched, SETS), "shingle_sets")
    chunks = found.groupBy("component").agg(F.ceil(F.count("*") / chunk).cast("bigint").alias("chunks"))
    own = F.pmod(F.xxhash64("name"), F.col("chunks")).alias("own")
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)).alias("other")
    met = found.join(chunks, "component").select("name", "values", "component", own, "chunks").select("*", other)
    route = F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("route")
    met = met.select(route, "name", "values").repartition("route").sortWithinPartitions("route")
    links = met.mapInArrow(lambda b: _judged(b, likeness), EDGES)

    tied = landed(components(links, "a", "b"), "components")
    groups = first.join(tied, first["name"] == tied["node"], "left")
    return groups.groupBy(F.coalesce("component", "name").alias("component")).agg(F.min("first").alias("first"))


def one_of_each(docs: DataFrame, likeness: float = LIKENESS, crowd: int = CROWD, chunk: int = CHUNK) -> DataFrame:
    """One row of each group with all its columns: that of the smallest doc_id, a null id only if all are null. Of rows with
    the same id and text, that with the smallest hash of all columns."""
    chosen = _grouped(docs, likeness, crowd, chunk).select("first.*")
    kept = boxed(docs).join(chosen.hint("shuffle_hash"), KEY, "left_semi")
    return kept.groupBy(*KEY).agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
