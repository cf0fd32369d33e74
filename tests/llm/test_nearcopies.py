import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import frame, prose

import corpus_pipeline
from clipquarry.llm import nearcopies as nc
from clipquarry.llm.simhash import fingerprint


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def first_of_each(rows):
    """The smallest id of each group, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if (not a and not b) or 5 * len(a & b) >= 4 * len(a | b):
            root[find(i)] = find(j)
    groups = {}
    for n, (i, _) in enumerate(rows):
        groups.setdefault(find(n), []).append(i)
    key = lambda i: (i is None, i or 0)
    return sorted((min(ids, key=key) for ids in groups.values()), key=key)


def found(df):
    return sorted((r.doc_id for r in df.collect()), key=lambda i: (i is None, i or 0))


def edited():
    """Texts of many lengths with edits all over them, on both sides of 0.8, among unlike texts that share a passage."""
    draw = random.Random(4)
    passage, rows = prose(90, 40), []
    for n in range(40):
        words = prose(500 + n, draw.choice([4, 8, 20, 60, 300])).split()
        for k in range(4):
            other = list(words)
            for _ in range(draw.randint(0, 1 + len(words) // 30) if k else 0):
                other[draw.randrange(len(other))] = "edited" + str(draw.randint(0, 9))
            rows.append((n * 10 + k, " ".join(other)))
    rows += [(1000 + n, f"{passage} {prose(700 + n, 60)}") for n in range(60)]
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowd, chunk", [(nc.CROWD, nc.CHUNK), (2, 2)])
@pytest.mark.parametrize("which", ["rows", "given_rows", "edits"])
def test_like_brute_force(spark, request, which, crowd, chunk):
    rows = edited() if which == "edits" else request.getfixturevalue(which)
    assert found(nc.one_of_each(frame(spark, rows), crowd=crowd, chunk=chunk)) == first_of_each(rows)


def test_stage_drops_edits_that_are_far_in_fingerprints(spark):
    words = prose(1, 400).split()
    edits = [" ".join("changed" if n % 60 == k * 15 else w for n, w in enumerate(words)) for k in range(3)]
    rows = [(5, " ".join(words)), *[(10 + k, t) for k, t in enumerate(edits)], (20, prose(2, 400))]
    assert all((fingerprint(rows[0][1]) ^ fingerprint(t)).bit_count() > 2 for t in edits)
    assert found(dict(corpus_pipeline.STAGES)["near copies"](spark, frame(spark, rows), "")) == [5, 20] == first_of_each(rows)


def test_chains_are_walked():
    a, b = nc.walked(50, lambda i, others: abs(others - i) == 1)
    assert sorted(zip(a, b)) == [(i, i + 1) for i in range(49)]
    assert nc.walked(3, lambda i, others: others < 0) == ([], [])


def test_columns_and_empty_table(odd, none):
    assert nc.one_of_each(odd).dtypes == odd.dtypes
    assert nc.one_of_each(none).count() == 0


def band_sets(spark, rows):
    """(name, sketch, bands) with given numbers for the minima's low bits and bands."""
    data = [(n.to_bytes(16, "big"), low.tobytes(), bands.tobytes()) for n, low, bands in rows]
    return spark.createDataFrame(data, "name binary, sketch binary, bands binary")


def sizes(groups):
    return [max((r["count"] for r in g.groupBy("key").count().collect()), default=0) for g in groups]


def test_crowded_band_is_split(spark):
    draw = np.random.default_rng(5)
    n, crowd = 50_000, 2000
    bands = draw.integers(0, 2**63, (n, nc.BANDS)).astype(np.uint64)
    bands[:, 7] = 12345  # boilerplate: all unlike, one band in common
    low = draw.integers(0, 256, (n, 128)).astype(np.uint8)
    bands[n // 2, 9], low[n // 2] = bands[n // 3, 9], low[n // 3]  # and one pair that is alike
    sets = band_sets(spark, zip(range(n), low, bands))
    groups, edges = nc.small_groups(sets, nc.LIKENESS, crowd)
    assert max(sizes(groups)) <= 2
    assert all(e.count() == 0 for e in edges)
    links = [{int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")} for r in nc.loose_links(sets, crowd=crowd).collect()]
    assert {n // 2, n // 3} in links and all(x == {n // 2, n // 3} for x in links)


def test_crowd_of_near_copies_is_linked_to_its_leader(spark):
    draw = np.random.default_rng(6)
    n, crowd = 5000, 500
    bands = np.tile(draw.integers(0, 2**63, nc.BANDS).astype(np.uint64), (n, 1))
    low = np.tile(draw.integers(0, 256, 128).astype(np.uint8), (n, 1))
    low[np.arange(n), draw.integers(0, 128, n)] ^= 1
    sets = band_sets(spark, zip(range(n), low, bands))
    groups, edges = nc.small_groups(sets, nc.LIKENESS, crowd)
    assert max(sizes(groups)) == 0 and len(edges) == 1
    assert edges[0].distinct().count() == n - 1


def test_rows_of_one_key_are_not_gathered():
    keys = [1, 2, 2, 2, 3, 4, 4, 5, 6, 6]
    rows = pa.table({"key": pa.array(keys, pa.int64()), "name": [str(n) for n in range(10)]})
    for size in range(1, 11):
        out = [r for b in nc._several(iter(rows.to_batches(size))) for r in b.column("key").to_pylist()]
        assert out == [2, 2, 2, 4, 4, 6, 6]


def test_rows_that_differ_elsewhere(spark):
    rows = [(1, "a b c", x) for x in range(20)]
    make = lambda r: spark.createDataFrame(r, "doc_id bigint, text string, extra int").repartition(4)
    assert len({nc.one_of_each(make(r)).first().extra for r in (rows, rows[::-1])}) == 1


def test_simhash_brings_near_copies_together(spark, monkeypatch):
    """Also without MinHash the stage finds texts whose fingerprints link, and keeps those that are unlike all the same."""
    base, refrain = prose(8, 400), (prose(3, 21) + " ") * 100
    rows = [(5, base), (6, base + " end"), (20, prose(2, 400))]
    rows += [(30, refrain + prose(4, 40)), (31, refrain + prose(5, 40)), (40, "a b c a b c"), (41, "a b c a b c a b c")]
    apart = lambda x, y: (fingerprint(rows[x][1]) ^ fingerprint(rows[y][1])).bit_count()
    assert apart(0, 1) <= 2 and apart(3, 4) <= 2 and apart(0, 2) > 2
    docs = frame(spark, rows)
    prints = nc.keyed(docs).select(*nc.KEY, "text").mapInArrow(nc._printed, nc.PRINTS)
    assert nc.fingerprint_links(prints).distinct().count() >= 2
    monkeypatch.setattr(nc, "loose_links", lambda *_: spark.createDataFrame([], nc.EDGES))
    assert found(dict(corpus_pipeline.STAGES)["near copies"](spark, docs, "")) == [5, 20, 30, 31, 40, 41] == first_of_each(rows)


def test_sets_of_one_fingerprint_are_tied_once(spark):
    rows = [(bytes([n]) * 16, fp) for n, fp in enumerate([7, 7, 7, 6, 5, -1, -1, 1 << 40])]
    links = nc.fingerprint_links(spark.createDataFrame(rows * 2, "name binary, fp bigint")).collect()
    assert {(r.a[0], r.b[0]) for r in links if rows[r.a[0]][1] == rows[r.b[0]][1]} == {(0, 1), (0, 2), (5, 6)}
    assert all(not {5, 6, 7} & {r.a[0], r.b[0]} or {r.a[0], r.b[0]} in ({5, 6}, {3, 7}, {0, 7}, {4, 7}) for r in links)
