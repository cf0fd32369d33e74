import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clipquarry.llm import fingerprints as fp
from clipquarry.llm.words import LOWER, doc_words, word_hashes


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def expected(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    out = []
    for k, (doc_id, text) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        size = len(text) // 3
        edited = text[: len(text) - size] + following[:size]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), text, edited, following))
    return out


@pytest.mark.parametrize("which", ["rows", "given_rows"])
def test_beside_next(spark, request, which):
    rows = request.getfixturevalue(which)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = fp.beside_next(docs).collect()
    wanted = expected(rows)
    # A null text and an empty one are the same to this query, so ties between them have no visible order.
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted((tuple(r)[:3] for r in found), key=key) == sorted((w[:3] for w in wanted), key=key)

    prints = {}
    for r in found:
        prints.setdefault((r.doc_id, r.n_chars, r.edited_sha256), r)
    off = []
    for doc_id, n, sha, text, edited, following in wanted:
        r = prints[doc_id, n, sha]
        for other, value in ((edited, r.near_edited), (following, r.near_next)):
            a, b = shingle_set(text), shingle_set(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            off.append(abs(value - true))
            assert 0 <= value <= 1
            assert text.split() != other.split() or value == 1
    assert max(off) < 0.2 and sum(off) / len(off) < 0.05


def test_equal_texts_have_equal_fingerprints(odd, rows):
    found = odd.select("text", fp.fingerprint(F.col("text")).alias("f")).collect()
    by_text = {}
    for r in found:
        assert by_text.setdefault(r["text"], r["f"]) == r["f"]
    assert by_text[None] == by_text[""] == by_text[" \t\n "] == ""
    assert len({f for t, f in by_text.items() if (t or "").strip()}) > 10


def test_columns_compare_like_batches(spark):
    texts = ["a b c d e f g", "a b c d e f h", "", "x", "y"]
    pairs = [(a, b) for a in texts for b in texts]
    df = spark.createDataFrame(pairs, "a string, b string")
    df = df.select(fp.fingerprint(F.col("a")).alias("a"), fp.fingerprint(F.col("b")).alias("b"))
    got = [r[0] for r in df.select(fp.fingerprint_likeness(F.col("a"), F.col("b"))).collect()]
    low, worded = fp.low_bits(pa.array([a for a, _ in pairs]))
    low_b, worded_b = fp.low_bits(pa.array([b for _, b in pairs]))
    assert np.allclose(got, fp.likeness(low, worded, low_b, worded_b))


def test_short_texts_are_not_alike_by_chance(spark):
    low, worded = fp.low_bits(pa.array([f"word{i}" for i in range(400)]))
    share = fp.likeness(low[:-1], worded[:-1], low[1:], worded[1:])
    assert share.max() < 0.2


def test_empty_table_and_single_row(spark, none):
    assert fp.beside_next(none).count() == 0
    one = fp.beside_next(spark.createDataFrame([(7, "a b c d e f")], "doc_id bigint, text string")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(7, 1.0)]


def test_long_words_hash_like_short_ones():
    import clipquarry.llm.words as w

    text = ("Q" * 300_000 + " b " + "q" * 300_000 + " c").encode()
    flat = np.frombuffer(text, np.uint8)
    starts, stops, _ = doc_words(flat, np.array([0, len(flat)]))
    long = word_hashes(flat, starts, stops)
    assert long[0] == long[2] and len(set(long.tolist())) == 3
    total = 0
    for c in reversed(LOWER[flat[starts[0] : stops[0]]].tolist()):
        total = (total * w.BASE + c + 1) % 2**64
    assert int(w.mixed(np.array([total], np.uint64))[0]) == int(long[0])
