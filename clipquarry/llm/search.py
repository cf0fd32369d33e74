"""Ranked lexical search by NRA: no document is ever looked up, all reads are sequential and in order of impact.

Queries are taken in blocks of bounded size. For each block the documents are read twice, where they lie. The first pass counts, per task,
the documents, their terms and how many documents hold each queried term; sums are all that is shuffled. Term weights follow from them.
The second pass makes postings of the block's terms for one shard of documents at a time (`SHARD_BYTES` of text), with each term's list sorted by
falling impact, and answers every query on it:

Lists are read from the top, in steps that double. A document's lower bound is the sum of the impacts read for it, its
upper bound adds, for each list in which it has not been met, the impact where that list's reading stands. The k-th greatest lower
bound, or the k-th best score of the task's earlier shards, is the bar. Reading ends when documents not met at all are below the
bar, and every document whose upper bound reaches it has equal bounds: then membership, ties and scores are final.

Each task returns its k best of each query, which a window ranks. No task holds more than a shard, and k rows a query leave it.

Terms are maximal runs of letters, digits and characters beyond ASCII, A-Z in lower case. Terms are equal if their 64-bit hashes, lengths, first and last eight
bytes are. Null and empty texts have no terms. Rows that repeat an id are documents of their own, null ids come after all others among equal
scores. Queries equal in id and text are one; a query without terms, or without a document above zero, has no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipquarry.llm.repeats import eights
from clipquarry.llm.shared import pieces, text_bytes
from clipquarry.llm.words import LOWER, doc_words, word_hashes

BEST = 10
QUERY_BYTES = 4 << 20  # text of the queries in a block, unless a single one is longer
SHARD_BYTES = 32 << 20  # text of the documents whose postings a task holds
FIRST_READ = 64  # postings of each list that are read first

# The scoring rule's saturation and length share.
SCALE, TIMES, LENGTH_SHARE = 10**9, 8, 75

IN_TERMS = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
FOUND = "query bigint, item_id bigint, doc_id bigint, score bigint"


@dataclass
class Queries:
    """A block of queries: the distinct terms in order of their hashes, and for each query its terms' numbers and repeats."""

    item_ids: list[int | None]
    hashes: np.ndarray
    prints: np.ndarray
    terms: list[np.ndarray]
    repeats: list[np.ndarray]


def printed(flat: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Length, first and last eight bytes of each span, A-Z in lower case."""
    eight, size = eights(LOWER[flat]), stops - starts
    mask = np.uint64(2**64 - 1) >> (np.uint64(8) * (8 - np.minimum(size, 8)).astype(np.uint64))
    return np.stack([size.astype(np.uint64), eight[starts] & mask, eight[np.maximum(stops - 8, starts)] & mask])


def read_queries(item_ids: list[int | None], texts: list[str | None]) -> Queries:
    flat, offsets = text_bytes(pa.array(texts, pa.string()))
    starts, stops, rows = doc_words(flat, offsets, IN_TERMS)
    hashes, first, number = np.unique(word_hashes(flat, starts, stops), return_index=True, return_inverse=True)
    prints = printed(flat, starts, stops)[:, first] if len(first) else np.empty((3, 0), np.uint64)
    cuts = np.searchsorted(rows, np.arange(len(texts) + 1))
    each = [np.unique(number[a:b], return_counts=True) for a, b in zip(cuts, cuts[1:])]
    return Queries(item_ids, hashes, prints, [t for t, _ in each], [n for _, n in each])


def postings(texts: pa.Array, queries: Queries) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of terms of each text, and (term, row, occurrences) of the queried terms."""
    flat, offsets = text_bytes(texts)
    starts, stops, rows = doc_words(flat, offsets, IN_TERMS)
    sizes = np.bincount(rows, minlength=len(texts))
    if not len(starts) or not len(queries.hashes):
        none = np.empty(0, np.int64)
        return sizes, none, none, none
    hashes = word_hashes(flat, starts, stops)
    term = np.minimum(np.searchsorted(queries.hashes, hashes), len(queries.hashes) - 1)
    hit = np.flatnonzero(queries.hashes[term] == hashes)
    hit = hit[(printed(flat, starts[hit], stops[hit]) == queries.prints[:, term[hit]]).all(0)]
    places, times = np.unique(term[hit] * len(texts) + rows[hit], return_counts=True)
    return sizes, places // len(texts), places % len(texts), times


def statistics(docs: DataFrame, queries: Queries) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all documents, and documents that hold each queried term."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holders = np.zeros(len(queries.hashes) + 2, np.int64)
        for piece in pieces(batches):
            sizes, term, _, _ = postings(piece.column("text"), queries)
            holders += np.bincount(term + 2, minlength=len(holders))
            holders[:2] += np.count_nonzero(sizes), sizes.sum()
        at = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(holders[at])], names=["number", "rows"])

    counted = docs.select("text").mapInArrow(made, "number bigint, rows bigint").groupBy("number").agg(F.sum("rows").alias("rows"))
    out = np.zeros(len(queries.hashes) + 2, np.int64)
    for r in counted.collect():  # no more rows than the block has terms
        out[r["number"]] = r["rows"]
    return int(out[0]), int(out[1]), out[2:]


def term_weights(documents: int, holders: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in holders], np.int64)


def saturated(times: np.ndarray, sizes: np.ndarray, documents: int, total: int) -> np.ndarray:
    """A term's share of its weight from its occurrences and the number of terms of the document."""
    distinct, at = np.unique(sizes, return_inverse=True)
    norm = [100 - LENGTH_SHARE + LENGTH_SHARE * int(n) * documents // total for n in distinct]
    return SCALE * times // (1000 * times + TIMES * np.array(norm, np.int64)[at])


def best_rows(lists: list[tuple[np.ndarray, np.ndarray]], size: int, most: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that can be among the `most` best with a score of `floor` at least, and their final scores.

    Each list has the rows that hold one term, and their impacts, which fall and are above zero. Rows that tie with the last one stay.
    """
    lower = np.zeros(size, np.int64)
    start, stop = 0, FIRST_READ
    while True:
        for rows, impacts in lists:
            lower[rows[start:stop]] += impacts[start:stop]
        # What a row can still gain from each list it has not been met in.
        next_impacts = [int(impacts[stop]) if stop < len(impacts) else 0 for _, impacts in lists]
        unmet = sum(next_impacts)
        met = np.flatnonzero(lower)
        bar = max(floor, 1)
        if len(met) >= most:
            bar = max(bar, int(np.partition(lower[met], len(met) - most)[len(met) - most]))
        if unmet < bar:
            gain = np.full(size, unmet, np.int64)
            for (rows, _), impact in zip(lists, next_impacts):
                if impact:
                    gain[rows[:stop]] -= impact
            able = met[lower[met] + gain[met] >= bar]
            if not gain[able].any():
                return able, lower[able]
        start, stop = stop, 2 * stop


class Shard:
    """Documents of a task whose postings are held together."""

    def __init__(self) -> None:
        self.ids: list[int | None] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.bytes = 0

    def add(self, piece: pa.RecordBatch, queries: Queries) -> None:
        sizes, term, row, times = postings(piece.column("text"), queries)
        self.parts.append((term, row + len(self.ids), times, sizes[row]))
        self.ids += piece.column("doc_id").to_pylist()
        self.bytes += piece.nbytes

    def lists(self, weights: np.ndarray, documents: int, total: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Rows and impacts of each term that the shard's documents hold, by falling impact."""
        if not total:
            return {}
        term, row, times, sizes = (np.concatenate(x) for x in zip(*self.parts))
        impact = weights[term] * saturated(times, sizes, documents, total)
        above = impact > 0
        term, row, impact = term[above], row[above], impact[above]
        order = np.lexsort((-impact, term))
        term, row, impact = term[order], row[order], impact[order]
        cuts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else []
        ends = [*cuts[1:], len(term)] if len(cuts) else []
        return {int(term[a]): (row[a:b], impact[a:b]) for a, b in zip(cuts, ends)}


def ranked_in_tasks(docs: DataFrame, queries: Queries, most: int) -> DataFrame:
    """(query, item_id, doc_id, score): the best documents of each query in each task."""
    documents, total, holders = statistics(docs, queries)
    weights = term_weights(documents, holders)

    def answer(shard: Shard, best: list[list[tuple]]) -> None:
        lists = shard.lists(weights, documents, total)
        for number, (terms, repeats) in enumerate(zip(queries.terms, queries.repeats)):
            own = [(lists[t][0], lists[t][1] * n) for t, n in zip(terms.tolist(), repeats.tolist()) if t in lists]
            floor = best[number][-1][0] if len(best[number]) == most else 0
            if sum(int(impacts[0]) for _, impacts in own) < max(floor, 1):
                continue
            rows, scores = best_rows(own, len(shard.ids), most, floor)
            found = [(s, shard.ids[r]) for r, s in zip(rows.tolist(), scores.tolist())]
            best[number] = sorted(best[number] + found, key=lambda f: (-f[0], f[1] is None, f[1] or 0))[:most]

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in queries.item_ids]
        shard = Shard()
        for piece in pieces(batches):
            shard.add(piece, queries)
            if shard.bytes >= SHARD_BYTES:
                answer(shard, best)
                shard = Shard()
        if shard.ids:
            answer(shard, best)
        rows = [(n, queries.item_ids[n], doc_id, score) for n, found in enumerate(best) for score, doc_id in found]
        columns = zip(*rows) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "item_id", "doc_id", "score"])

    return docs.mapInArrow(made, FOUND)


def query_blocks(items: DataFrame) -> Iterator[Queries]:
    """The distinct queries in blocks of about `QUERY_BYTES`, so that what goes through the driver and to each task is bounded."""
    items = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).filter(F.length("text") > 0).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // QUERY_BYTES)
    for block in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = sorted(part.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        yield read_queries([r["item_id"] for r in rows], [r["text"] for r in rows])


def top_documents(docs: DataFrame, items: DataFrame, most: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each item, rank from 1."""
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    out = docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for queries in query_blocks(items):
        ranked = ranked_in_tasks(docs, queries, most).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
        out = out.unionByName(ranked.select("item_id", "rank", "doc_id", "score"))
    return out
