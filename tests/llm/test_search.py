import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from compare import difference
from conftest_llm import frame, prose, same

from clipquarry.llm import oracles, search
from clipquarry.llm.queries import QUERIES as QUERIES_BY_NAME

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain_ranks(docs, items, most=10):
    terms = [Counter(plain_terms(t)) for _, t in docs]
    n = [sum(c.values()) for c in terms]
    documents, total = sum(map(bool, n)), sum(n)
    holders = Counter(t for c in terms for t in c)
    out = []
    for item_id, text in dict.fromkeys(items):
        scores = []
        for (doc_id, _), held, size in zip(docs, terms, n):
            score = 0
            for term, repeats in Counter(plain_terms(text)).items():
                if held[term]:
                    m = 100 - 75 + 75 * size * documents // total
                    w = math.floor(1000 * math.log((2 * documents + 2) / (2 * holders[term] + 1)))
                    score += repeats * w * (10**9 * held[term] // (1000 * held[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:most], 1)]
    return out


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, 1, "x", 2.5) for i, t in items], "item_id bigint, text string, score int, query string, rank double")


QUERIES = [
    (1, prose(1, 60)),
    (1, prose(1, 60)),
    (2, "one TWO three"),
    (3, "to to to"),
    (4, None),
    (5, ""),
    (6, "... !!"),
    (7, "중 中 한국어 é straße"),
    (None, "alpha beta"),
    (9, "unheard-of wördz"),
    (10, prose(7, 3000)),
    (1, "another of this id: alpha"),
    (11, "alphaalphaalphaalphaalpha xiphias"),
]


def test_like_brute_force_on_odd_texts(spark, odd, rows):
    same(search.top_documents(odd, items_frame(spark, QUERIES)).collect(), plain_ranks(rows, QUERIES))


def test_small_shards_and_blocks_change_nothing(spark, odd, rows, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BYTES", 300)
    found = search.top_documents(odd, items_frame(spark, QUERIES), 3).collect()
    same(found, plain_ranks(rows, QUERIES, 3))


def test_given(spark, given, given_rows, data):
    items = spark.read.parquet(f"{data}/benchmark.parquet")
    same(search.top_documents(given, items).collect(), plain_ranks(given_rows, [tuple(r) for r in items.collect()]))


def test_shards_of_a_task(monkeypatch, spark):
    """Shards of one task share their bar; ties across shards go to the smaller id."""
    docs = [(900 - i, prose(i % 40, 12)) for i in range(400)]
    items = [(i, prose(i, 12)) for i in range(12)]
    one = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    queries = search.read_queries([i for i, _ in items], [t for _, t in items])
    wanted = plain_ranks(docs, items)
    documents, total, holders = search.statistics(one, queries)
    weights = search.term_weights(documents, holders)
    import pyarrow as pa

    best = [[] for _ in items]
    for at in range(0, 400, 37):  # what a task does with small shards
        shard = search.Shard()
        ids, texts = zip(*docs[at : at + 37])
        shard.add(pa.RecordBatch.from_pydict({"doc_id": list(ids), "text": list(texts)}), queries)
        lists = shard.lists(weights, documents, total)
        for n, (terms, repeats) in enumerate(zip(queries.terms, queries.repeats)):
            own = [(lists[t][0], lists[t][1] * k) for t, k in zip(terms.tolist(), repeats.tolist()) if t in lists]
            floor = best[n][-1][0] if len(best[n]) == 10 else 0
            rows, scores = search.best_rows(own, len(shard.ids), 10, floor)
            best[n] = sorted(best[n] + [(s, shard.ids[r]) for r, s in zip(rows, scores)], key=lambda f: (-f[0], f[1]))[:10]
    assert [(i, r, d, s) for (i, _), b in zip(items, best) for r, (s, d) in enumerate(b, 1)] == wanted
    same(search.top_documents(one, items_frame(spark, items)).collect(), wanted)


def test_bounds_are_resolved_without_reading_all():
    """A row far ahead ends the reading early; nothing that may tie is left out."""
    draw = random.Random(5)
    for trial in range(60):
        size = 3000
        lists = []
        for _ in range(draw.randint(1, 6)):
            rows = np.array(draw.sample(range(size), draw.randint(1, 2500)))
            impacts = np.sort(np.array([draw.choice([1, 2, 5, 9, 60, 400]) for _ in rows]))[::-1].copy()
            lists.append((rows, impacts))
        total = np.zeros(size, np.int64)
        for rows, impacts in lists:
            total[rows] += impacts
        floor = draw.choice([0, 0, 30, 500])
        most = draw.choice([1, 5, 10])
        found, scores = search.best_rows(lists, size, most, floor)
        bar = max(sorted(total)[-most], floor, 1)
        wanted = np.flatnonzero(total >= bar)
        assert set(wanted) <= set(found.tolist())
        assert (total[found] == scores).all()


def test_reading_stops_early():
    read = []

    class Spy(np.ndarray):
        def __getitem__(self, at):
            if isinstance(at, slice) and at.start is not None and at.stop is not None:
                read.append(at.stop)
            return super().__getitem__(at)

    rows = np.arange(100_000).view(Spy)
    impacts = np.sort(np.r_[np.full(20, 10**6), np.ones(99_980, np.int64)])[::-1].copy()
    found, _ = search.best_rows([(rows, impacts)], 100_000, 10, 0)
    assert len(found) == 20 and max(read) == search.FIRST_READ


def test_empty(spark, none, odd):
    assert search.top_documents(none, items_frame(spark, QUERIES)).collect() == []
    assert search.top_documents(odd, items_frame(spark, [(1, None)])).collect() == []
    assert search.top_documents(odd, items_frame(spark, QUERIES).limit(0)).collect() == []


@pytest.mark.parametrize("word", ["a", "abcdefgh", "abcdefghi", "ABCdefghijklmnopqr", "x" * 5000])
def test_prints_tell_words_apart(word):
    queries = search.read_queries([1], [word])
    import pyarrow as pa

    _, term, row, times = search.postings(pa.array([f"{word.lower()} {word[:-1]}é {word.upper()}", word + "z", "-" + word]), queries)
    assert list(zip(term, row, times)) == [(0, 0, 2), (0, 2, 1)]


def test_like_sql(spark, data, duck):
    assert difference(QUERIES_BY_NAME["op13_search"](spark, data), duck, oracles.oracle_sql()["op13_search"]) is None
