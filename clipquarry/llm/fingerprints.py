"""Document fingerprints by one-permutation MinHash.

Each word shingle is hashed once: the top bits of the hash choose a bin, the rest compete for the bin's minimum.
An empty bin copies the first filled one in an order fixed for that bin (optimal densification), mixed with its own
number, so that the low bits of copies agree by chance independently of each other. The low bits of all bins, packed,
are the fingerprint; as low bits of different minima agree by chance, likeness is corrected for it.

Words are runs between ASCII blanks with A-Z lower-cased. A text with fewer words than a shingle is one shingle;
a text without words, empty or null, has the empty fingerprint, which is like another empty one (1) and unlike any
other (0). Equal texts have equal fingerprints. Nothing depends on other rows, so a lost task repeats exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipquarry.llm.shared import pieces, text_bytes
from clipquarry.llm.words import doc_words, mixed, word_hashes

SHINGLE = 5
BINS = 256
LOW_BITS = 4
BIN_SHIFT = np.uint64(64 - 8)
STEP = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(flat: np.ndarray, offsets: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles of a batch of texts, and the row that each is from."""
    starts, stops, rows = doc_words(flat, offsets)
    words = word_hashes(flat, starts, stops)
    rest = np.searchsorted(rows, rows, side="right") - np.arange(len(rows)) if len(rows) else rows
    first = np.r_[True, rows[1:] != rows[:-1]] if len(rows) else np.empty(0, bool)
    whole = (rest >= width) | first  # a short text starts one shingle, of all its words
    at = np.flatnonzero(whole)
    value = np.zeros(len(at), np.uint64)
    for k in range(width):
        inside = rest[at] > k
        value[inside] = mixed(value[inside] * STEP + words[at[inside] + k])
    return value, rows[at]


def _orders() -> np.ndarray:
    """For each bin all bins in an order of its own, the bin itself first."""
    i, j = np.meshgrid(np.arange(BINS, dtype=np.uint64), np.arange(BINS, dtype=np.uint64), indexing="ij")
    draw = mixed(i * np.uint64(BINS) + j)
    draw[i == j] = 0
    return np.argsort(draw, axis=1)


ORDERS = _orders()


def bin_minima(value: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """(n, BINS) minima; rows without shingles stay EMPTY."""
    least = np.full(n * BINS, EMPTY, np.uint64)
    np.minimum.at(least, row * BINS + (value >> BIN_SHIFT).astype(np.int64), value & ((np.uint64(1) << BIN_SHIFT) - np.uint64(1)))
    least = least.reshape(n, BINS)
    filled = least != EMPTY
    doc, bin_ = np.nonzero(~filled & filled.any(axis=1)[:, None])
    dense = least.copy()
    for k in range(1, BINS):
        if not len(doc):
            break
        donor = ORDERS[bin_, k]
        hit = filled[doc, donor]
        dense[doc[hit], bin_[hit]] = mixed(least[doc[hit], donor[hit]] + bin_[hit].astype(np.uint64) * STEP)
        doc, bin_ = doc[~hit], bin_[~hit]
    return dense


def low_bits(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The low bits of each row's bins, (rows, BINS), and which rows have words."""
    flat, offsets = text_bytes(column)
    value, row = shingles(flat, offsets)
    dense = bin_minima(value, row, len(column))
    return (dense & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint8), dense[:, 0] != EMPTY


def packed(low: np.ndarray, worded: np.ndarray) -> list[str]:
    """Two bins a byte, in hexadecimal."""
    both = (low[:, 0::2] << 4) | low[:, 1::2]
    return [b.tobytes().hex() if w else "" for b, w in zip(both, worded)]


def likeness(a: np.ndarray, a_worded: np.ndarray, b: np.ndarray, b_worded: np.ndarray) -> np.ndarray:
    """The estimated share of common shingles, row by row."""
    chance = 1 / (1 << LOW_BITS)
    share = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(a_worded & b_worded, share, (a_worded == b_worded).astype(float))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text column."""

    @F.pandas_udf("string")
    def made(texts: pd.Series) -> pd.Series:
        column = pa.array(texts, pa.string(), from_pandas=True)
        batch = pa.RecordBatch.from_arrays([column], names=["text"])
        return pd.Series([x for piece in pieces([batch]) for x in packed(*low_bits(piece.column(0)))], dtype=object)

    return made(text)


def fingerprint_likeness(a: Column, b: Column) -> Column:
    """The likeness of two fingerprint columns, in plain expressions; null if one is null."""
    bins = F.sequence(F.lit(1), F.lit(BINS * LOW_BITS // 4))
    equal = F.size(F.filter(bins, lambda i: F.substr(a, i, F.lit(1)) == F.substr(b, i, F.lit(1))))
    chance = 1 / (1 << LOW_BITS)
    share = F.greatest((equal / BINS - chance) / (1 - chance), F.lit(0.0))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(share)


# --- each document beside the next one ---


def _routed(docs: DataFrame) -> DataFrame:
    """Rows with `part`: each document in the part of its id, and each part's largest id in the part above too, where
    it comes next. Parts are ranges of ids, cut at approximate quantiles, as many as there are shuffle partitions, so
    what the driver holds is bounded by that setting."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64))

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), side="left"), dtype="int32")

    largest = docs.select("doc_id").groupBy(part_of("doc_id").alias("part")).agg(F.max("doc_id")).orderBy("part").collect()
    heads = np.array([r[1] for r in largest], np.int64)
    above = np.roll(np.array([r[0] for r in largest], np.int32), -1)  # the first comes after the last

    @F.pandas_udf("array<int>")
    def parts_of(ids: pd.Series) -> pd.Series:
        ids = ids.to_numpy(np.int64)
        own = np.searchsorted(cuts, ids, side="left")
        at = np.clip(np.searchsorted(heads, ids), 0, max(0, len(heads) - 1))
        return pd.Series([[int(o), int(above[k])] if heads[k] == i else [int(o)] for o, k, i in zip(own, at, ids)])

    seen = docs.select("*", F.posexplode(parts_of("doc_id")).alias("guest", "part"))
    return seen.withColumn("guest", F.col("guest") == 1)


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    size = len(text) // 3
    return text[: len(text) - size] + following[:size]


OUT = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _fingerprinted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, guests last, ids falling: every own row has its next one right after it."""

    def out(piece: pa.RecordBatch) -> pa.RecordBatch | None:
        part, guest = piece.column("part").to_numpy(), piece.column("guest").to_numpy(zero_copy_only=False)
        text = pc.fill_null(piece.column("text"), "")
        low, worded = low_bits(text)
        own = np.flatnonzero(~guest[:-1])
        following = np.where(part[own + 1] == part[own], own + 1, own)
        texts = text.to_pylist()
        edited = pa.array([edited_text(texts[i], texts[j]) for i, j in zip(own, following)], pa.string())
        low_e, worded_e = low_bits(edited)
        ids = piece.column("doc_id").to_pylist()
        arrays = [
            pa.array([None if piece.column("absent")[int(i)].as_py() else ids[i] for i in own], pa.int64()),
            pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited.to_pylist()], pa.string()),
            pa.array(packed(low[own], worded[own]), pa.string()),
            pa.array(packed(low_e, worded_e), pa.string()),
            pa.array(likeness(low[own], worded[own], low_e, worded_e)),
            pa.array(likeness(low[own], worded[own], low[following], worded[following])),
        ]
        return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in OUT.split(", ")])

    last = None
    for piece in pieces(batches):
        if last is not None:
            piece = pa.Table.from_batches([last, piece]).combine_chunks().to_batches()[0]
        last = piece.slice(piece.num_rows - 1)
        if piece.num_rows > 1:
            yield out(piece)
    if last is not None and not last.column("guest")[0].as_py():
        yield out(pa.Table.from_batches([last, last]).combine_chunks().to_batches()[0])


def beside_next(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and the likeness to it and to the next document's.

    Next means the next smaller doc_id, after the smallest the largest; a null id counts as the smallest there is.
    Rows of one id follow each other by text. A single document is its own next one. Texts move once; a task holds a
    few of them at a time.
    """
    ids = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)).cast("bigint"))
    rows = docs.select(ids.alias("doc_id"), F.col("doc_id").isNull().alias("absent"), F.col("text").cast("string").alias("text"))
    spread = _routed(rows).repartition("part")
    return spread.sortWithinPartitions("part", "guest", F.desc("doc_id"), "text").mapInArrow(_fingerprinted, OUT)
