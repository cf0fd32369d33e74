import zlib
from collections import Counter

import pytest
from conftest_llm import frame, same
from pyspark.sql import functions as F

from clipquarry.llm import language as lang


def plain_grams(text):
    """Letter n-grams of words with one edge mark on either side."""
    words = "".join(c.lower()[0] if c.isalpha() else " " for c in text or "").split()
    out = Counter()
    for w in words:
        marked = f" {w} "
        out.update(w)
        out.update(marked[i : i + 2] for i in range(len(marked) - 1))
        out.update(marked[i : i + 3] for i in range(len(marked) - 2))
    return out


def number(gram):
    """The packed form that ties are ordered by."""
    table = lang.letter_numbers()
    codes = [lang.EDGE if c == " " else int(table[ord(c)]) for c in gram]
    return sum(c << (lang.LETTER_BITS * k) for k, c in enumerate(codes))


def top(counts, size=lang.PROFILE):
    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:size]


def plain_prediction(text, profiles):
    own = top(plain_grams(text))
    if not own or not profiles:
        return "und", 0.0
    far = {}
    for name, places in profiles.items():
        far[name] = sum(abs(places[g] - k) if g in places else lang.PROFILE for k, g in enumerate(own))
    best = min(sorted(far), key=far.get)
    return best, 1 - far[best] / (len(own) * lang.PROFILE)


def held(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def expected(rows):
    counts = {}
    for doc_id, text, name in rows:
        if not held(doc_id) and name is not None and text is not None:
            counts.setdefault(name, Counter()).update(plain_grams(text))
    profiles = {n: {g: k for k, g in enumerate(top(c))} for n, c in counts.items() if c}
    out = []
    for doc_id, text, _ in rows:
        name, score = plain_prediction(text, profiles)
        out.append((doc_id, held(doc_id), name, round(score, 9)))
    return out


def found(docs):
    rows = lang.identified(docs, lang.learnt(docs)).collect()
    return [(r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in rows]


@pytest.mark.parametrize("which", ["odd", "given"])
def test_like_brute_force(spark, request, which):
    docs = request.getfixturevalue(which)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    same(found(docs), expected(rows))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lang.identified(docs, lang.learnt(docs)).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98


def test_prediction_reads_the_text_only(given):
    known = lang.learnt(given)
    plain = {r.text: r.lang_pred for r in given.select("text", lang.language_of(F.col("text"), known).alias("f")).select("text", "f.*").collect()}
    moved = given.withColumns({"lang": F.lit("xx"), "source": F.lit("yy"), "doc_id": F.col("doc_id") + 10**9})
    again = moved.select("text", lang.language_of(F.col("text"), known).alias("f")).select("text", "f.*").collect()
    assert all(plain[r.text] == r.lang_pred for r in again)


def test_rejects_and_keeps(spark, given):
    known = lang.learnt(given)
    rows = [(1, None), (2, ""), (3, "12 !!"), (4, "Это совсем другой язык и письмо"), (5, given.filter("lang = 'en'").first().text)]
    docs = frame(spark, rows)
    kept = lang.in_known_language(docs, known)
    assert kept.dtypes == docs.dtypes and [r.doc_id for r in kept.collect()] == [5]
    assert lang.in_known_language(given, known).count() == given.count()


def test_nothing_to_learn_from(spark, none):
    assert found(none) == []
    assert {(r[2], r[3]) for r in found(frame(spark, [(7, "abc")]).withColumn("lang", F.lit(None).cast("string")))} == {("und", 0.0)}
