"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent letter n-grams (1 to 3 letters, word edges included), learnt from
all labelled training rows. A document's own most frequent n-grams are compared with each profile by the out-of-place
distance: how far each n-gram's rank lies from its rank in the profile, or the most there is if it has none.

Letters are lower-cased, everything else is a word edge. Texts that are null or have no letter are `und` with score 0,
as are all texts if there is nothing to learn from. Ties between languages go to the first in order; equal counts rank
by n-gram. Repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipquarry.llm.shared import pieces

PROFILE = 300
UNKNOWN = "und"
HELD_OUT = 2

# Texts below this are like no profile: a third or less of a usual score, whatever the script.
LEAST_SCORE = 0.2

PIECE = 1 << 19  # text bytes whose n-grams are sorted together
EDGE = 1
LETTER_BITS = 18  # three letters fill 54 bits, which leaves 10 for the row
ROWS_AT_ONCE = 1 << (64 - 3 * LETTER_BITS)
SHIFT1, SHIFT2, SHIFT3 = (np.uint64(LETTER_BITS * k) for k in (1, 2, 3))


@lru_cache(1)
def letter_numbers() -> np.ndarray:
    """For each code point the number of its lower-case letter, or EDGE."""
    numbers, table = {}, np.full(0x110000, EDGE, np.uint32)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()[0]
            table[point] = numbers.setdefault(low if low.isalpha() else char, len(numbers) + 2)
    if len(numbers) + 2 > 1 << LETTER_BITS:
        raise ValueError("more letters than LETTER_BITS can number")
    return table


def gram_counts(texts: list[str], owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, n-gram and count of all n-grams of the texts, ordered by owner and n-gram; owners are below ROWS_AT_ONCE."""
    points = np.frombuffer("\n".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    letters = letter_numbers()[points]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    of = np.r_[0, np.repeat(np.arange(len(texts)), sizes)]
    kept = np.r_[True, (letters[1:] != EDGE) | (letters[:-1] != EDGE)]
    c, of = letters[kept].astype(np.uint64), owner[of[kept]].astype(np.uint64) << SHIFT3
    inner = c != EDGE
    middle = np.flatnonzero(inner)
    if not len(middle):
        empty = np.empty(0, np.uint64)
        return empty.astype(np.int64), empty, empty.astype(np.int64)
    before, here, after = c[middle - 1], c[middle], c[middle + 1]
    who = of[middle]
    starts = before == EDGE
    keys = np.concatenate(
        [
            who | here,
            who | here | after << SHIFT1,
            (who | before | here << SHIFT1)[starts],
            who | before | here << SHIFT1 | after << SHIFT2,
        ]
    )
    keys.sort()
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    count = np.diff(np.r_[first, len(keys)])
    keys = keys[first]
    return (keys >> SHIFT3).astype(np.int64), keys & ((np.uint64(1) << SHIFT3) - np.uint64(1)), count


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, limit=PIECE):
        for at in range(0, piece.num_rows, ROWS_AT_ONCE):
            part = piece.slice(at, ROWS_AT_ONCE)
            coded = part.column("lang").dictionary_encode()
            owner, gram, count = gram_counts(part.column("text").to_pylist(), coded.indices.to_numpy())
            yield pa.RecordBatch.from_arrays(
                [coded.dictionary.take(pa.array(owner)), pa.array(gram.view(np.int64)), pa.array(count)],
                names=["lang", "gram", "n"],
            )


def profiles(labelled: DataFrame, size: int = PROFILE) -> DataFrame:
    """(lang, gram, place) for the `size` most frequent n-grams of each language, over whole texts of all rows given."""
    rows = labelled.select(F.col("text").cast("string"), F.col("lang").cast("string")).dropna()
    counts = rows.mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("place", F.row_number().over(ranked) - 1).filter(F.col("place") < size).drop("n")


class Profiles:
    """All profiles as one table of places, small enough to go to every task: `size` n-grams per language."""

    def __init__(self, rows: list, size: int):
        self.size = size
        self.langs = sorted({r["lang"] for r in rows})
        self.grams = np.unique(np.array([r["gram"] for r in rows], np.uint64))
        self.places = np.full((len(self.langs), len(self.grams) + 1), size, np.int32)  # the last: in no profile
        lang = np.array([self.langs.index(r["lang"]) for r in rows], np.int64)
        at = np.searchsorted(self.grams, np.array([r["gram"] for r in rows], np.uint64))
        self.places[lang, at] = [r["place"] for r in rows]

    def best(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest language of each text, -1 without letters, and the score: 1 less the share of the
        greatest distance."""
        n = len(texts)
        lang, score = np.full(n, -1), np.zeros(n)
        if not self.langs:
            return lang, score
        for at in range(0, n, ROWS_AT_ONCE):
            part = texts[at : at + ROWS_AT_ONCE]
            row, gram, count = gram_counts(part, np.arange(len(part)))
            order = np.lexsort((-count, row)) if count.max(initial=0) >> 22 else self._by_count(row, count)
            row, gram = row[order], gram[order]
            first = np.searchsorted(row, row, side="left")
            place = np.arange(len(row)) - first
            top = place < self.size
            row, gram, place = row[top], gram[top], place[top]
            where = np.searchsorted(self.grams, gram)
            found = np.minimum(where, len(self.grams) - 1)
            where = np.where(self.grams[found] == gram, found, len(self.grams))
            used = np.bincount(row, minlength=len(part))
            far = []
            for places in self.places:
                known = places[where]
                away = np.where(known < self.size, np.abs(known - place), self.size)
                far.append(np.bincount(row, weights=away, minlength=len(part)))
            far = np.array(far)
            has = used > 0
            near = far.argmin(axis=0)
            lang[at : at + len(part)] = np.where(has, near, -1)
            least = far[near, np.arange(len(part))]
            score[at : at + len(part)] = np.where(has, 1 - least / np.maximum(used * self.size, 1), 0)
        return lang, score

    @staticmethod
    def _by_count(row: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The order by row, falling count and present place, from one sort of packed numbers."""
        key = row.astype(np.uint64) << np.uint64(54) | (np.uint64((1 << 22) - 1) - count.astype(np.uint64)) << np.uint64(32)
        key |= np.arange(len(row), dtype=np.uint64)
        key.sort()
        return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: the checksum of the id's digits leaves 2 when divided by 4."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def language_of(text: Column, known: Profiles) -> Column:
    """STRUCT<lang_pred, score> of a text column, from the text alone."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        column = pa.array(texts, pa.string(), from_pandas=True)
        names, scores = [], []
        for piece in pieces([pa.RecordBatch.from_arrays([column], names=["text"])], limit=PIECE):
            lang, score = known.best(pc.fill_null(piece.column(0), "").to_pylist())
            names += [known.langs[k] if k >= 0 else UNKNOWN for k in lang]
            scores.append(score)
        return pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores) if scores else []})

    return predicted(text.cast("string"))


def identified(docs: DataFrame, known: Profiles) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row."""
    found = docs.select("doc_id", language_of(F.col("text"), known).alias("found"))
    return found.select(F.col("doc_id").cast("bigint"), held_out(F.col("doc_id")).alias("held_out"), "found.*")


def in_known_language(docs: DataFrame, known: Profiles, least: float = LEAST_SCORE) -> DataFrame:
    """The rows, with all columns, whose text is in a language and scores `least` or more."""
    rows = docs.select(F.struct("*").alias("row"), language_of(F.col("text"), known).alias("found"))
    return rows.filter((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= least)).select("row.*")


def learnt(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles from the labelled rows that are not held out."""
    return Profiles(profiles(docs.filter(~held_out(F.col("doc_id"))), size).collect(), size)
