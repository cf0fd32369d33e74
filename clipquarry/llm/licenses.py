"""License texts and phrases in documents, found by diagonal voting.

Every pair of neighbouring words of every document (or every `width` words) is hashed and joined with the places of the same pair in the
templates, which may be whole license texts. A meeting votes for a diagonal, the offset between document and template. Neighbouring diagonals with
several votes (more for long templates, in which common pairs meet by chance) are merged, as inserted or lost words move the offset, and a merged span counts if it covers enough
of the template without being much longer. Phrases count only where all their pairs lie on one diagonal.

Two hashes of 64 bits have to agree for a meeting, so a meeting means equal words. Only meetings are shuffled.
Rows are told apart by their place in the scan, so repeated rows and ids do not mix. Null and empty texts have no
words, no labels and score 0. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipquarry.llm.shared import pieces, text_bytes
from clipquarry.llm.words import doc_words, mixed, word_hashes

# Phrases that count wherever their words stand consecutively, and wordings of common license lines.
PHRASES = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
WORDINGS = [
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0"),
]

GRAM = 2
NEAR = 3  # diagonals this close are merged
COVER = 0.8  # share of a template's pairs that a span has to hold
STRETCHED = 1.5  # a span's length over its template's, at most
LEAST_VOTES = 2
VOTES_SHARE = 0.02  # of a template's pairs, if that is more
BLOCK = 63  # places in a template are bits of a number, one for each block of so many
BROADCAST_GRAMS = 100_000  # template pairs that are broadcast at most; larger sets are joined by shuffle

STEP = np.uint64(0x9E3779B97F4A7C15)
STEP2 = np.uint64(0xC2B2AE3D27D4EB4F)

# Letters, digits and all bytes beyond ASCII make words.
INSIDE = np.array([chr(c).isalnum() if c < 128 else True for c in range(256)])


def grams(flat: np.ndarray, offsets: np.ndarray, width: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words per row, and row, place and two hashes of each `width` neighbouring words."""
    starts, stops, rows = doc_words(flat, offsets, INSIDE)
    words = word_hashes(flat, starts, stops)
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    place = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.flatnonzero(rows[width - 1 :] == rows[: len(rows) - width + 1]) if len(rows) >= width else np.empty(0, np.int64)
    gram, proof = words[at], words[at]
    for k in range(1, width):
        gram, proof = mixed(gram * STEP + words[at + k]), mixed(proof + words[at + k] * STEP2)
    return counts, rows[at], place[at], gram, proof


EMITTED = "uid bigint, doc_id bigint, n_words bigint, pos int, gram bigint, proof bigint"


def _emitted(batches: Iterable[pa.RecordBatch], width: int = GRAM) -> Iterator[pa.RecordBatch]:
    """A row for each document and one for each gram of its words."""
    task = TaskContext.get()
    uid = (task.partitionId() if task else 0) << 40
    for piece in pieces(batches):
        n = piece.num_rows
        uids = uid + np.arange(n)
        counts, row, place, gram, proof = grams(*text_bytes(piece.column("text")), width)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(uids),
                piece.column("doc_id"),
                pa.array(counts.astype(np.int64)),
                pa.nulls(n, pa.int32()),
                pa.nulls(n, pa.int64()),
                pa.nulls(n, pa.int64()),
            ],
            names=[f.split()[0] for f in EMITTED.split(", ")],
        )
        m = len(row)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(uids[row]),
                pa.nulls(m, pa.int64()),
                pa.nulls(m, pa.int64()),
                pa.array(place.astype(np.int32)),
                pa.array(gram.view(np.int64)),
                pa.array(proof.view(np.int64)),
            ],
            names=[f.split()[0] for f in EMITTED.split(", ")],
        )
        uid += n


def template_grams(spark: SparkSession, phrases=PHRASES, wordings=WORDINGS, width: int = GRAM) -> DataFrame:
    """Places of word pairs in the templates, broadcast while they are few."""
    rows = []
    for n, (label, text) in enumerate([*phrases, *wordings]):
        _, row, place, gram, proof = grams(*text_bytes(pa.array([text])), width)
        if not len(row):
            raise ValueError(f"a template needs {width} words: {text}")
        found = zip(place.tolist(), gram.view(np.int64).tolist(), proof.view(np.int64).tolist())
        rows += [(g, f, n, label, n < len(phrases), p, len(row)) for p, g, f in found]
    schema = "gram bigint, proof2 bigint, tpl int, label string, exact boolean, tpos int, grams int"
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_GRAMS else table


def license_scan(docs: DataFrame, phrases=PHRASES, wordings=WORDINGS, width: int = GRAM) -> DataFrame:
    """One row per document: (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    Templates may have any length from `width` words on. With many whole license texts a larger width lets fewer words meet by chance; phrases have to be
    as long."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(lambda b: _emitted(b, width), EMITTED)
    met = rows.join(template_grams(docs.sparkSession, phrases, wordings, width), "gram", "left")
    met = met.filter("n_words is not null or proof = proof2").repartition("uid")

    block = F.expr(f"tpos div {BLOCK}").alias("block")
    diagonals = met.groupBy("uid", "tpl", (F.col("pos") - F.col("tpos")).alias("diagonal"), block).agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.max("label").alias("label"),
        F.max("exact").alias("exact"),
        F.max("grams").alias("grams"),
        F.count("gram").alias("votes"),
        F.bit_or(F.expr(f"shiftleft(1L, tpos % {BLOCK})")).alias("covered"),
        F.min("pos").alias("first"),
        F.max("pos").alias("last"),
    )
    diagonals = diagonals.withColumn("votes", F.sum("votes").over(Window.partitionBy("uid", "tpl", "diagonal")))
    least = F.greatest(F.least(F.lit(LEAST_VOTES), F.col("grams")), F.ceil(F.col("grams") * VOTES_SHARE))
    votes = diagonals.filter(F.col("tpl").isNull() | F.col("exact") | (F.col("votes") >= least))
    along = Window.partitionBy("uid", "tpl").orderBy("diagonal", "block")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.when(F.col("exact"), 0).otherwise(NEAR)
    islands = (
        votes.withColumn("apart", F.coalesce(apart, F.lit(True)).cast("int"))
        .withColumn("island", F.sum("apart").over(along))
        .groupBy("uid", "tpl", "island", "block")
        .agg(
            *[F.max(c).alias(c) for c in ("doc_id", "n_words", "label", "exact", "grams")],
            F.bit_count(F.bit_or("covered")).alias("covered"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
        )
        .groupBy("uid", "tpl", "island")
        .agg(
            *[F.max(c).alias(c) for c in ("doc_id", "n_words", "label", "exact", "grams")],
            F.sum("covered").alias("covered"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
        )
        .withColumn("cover", F.col("covered") / F.col("grams"))
    )
    whole = F.col("cover") == 1
    verified = F.when(F.col("exact"), whole).otherwise(
        (F.col("cover") >= COVER) & (F.col("last") - F.col("first") + 1 <= F.col("grams") * STRETCHED)
    )
    base = F.col("exact") & whole
    span = F.struct(F.col("first").alias("start"), (F.col("last") + width).alias("end"), "label", "cover")
    joined = lambda label: F.array_join(F.array_sort(F.collect_set(label)), ",")
    return (
        islands.groupBy("uid")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.count(F.when(base, 1)).alias("n_base"),
            F.min(F.when(base, F.col("first").cast("bigint"))).alias("first_word"),
            F.max(F.when(base, F.col("first").cast("bigint"))).alias("last_word"),
            joined(F.when(base, F.col("label"))).alias("base_labels"),
            joined(F.when(verified, F.col("label"))).alias("labels"),
            F.coalesce(F.max("cover"), F.lit(0.0)).alias("score"),
            F.array_sort(F.collect_list(F.when(verified, span))).alias("spans"),
        )
        .drop("uid")
    )
