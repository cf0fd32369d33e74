import random
import re

import numpy as np
import pytest
import xxhash
from conftest_llm import frame, same

from clipquarry.llm import simhash as sh
from clipquarry.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_groups(prints):
    """fingerprint -> smallest linked one, by comparing all pairs."""
    values = sorted(set(prints))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def expected(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    group = plain_groups(prints)
    least = {}
    for (doc_id, _), p in zip(rows, prints):
        if doc_id is not None:
            least[group[p]] = min(least.get(group[p], doc_id), doc_id)
    return [(i, f"{p:016x}", least.get(group[p])) for (i, _), p in zip(rows, prints)]


@pytest.mark.parametrize("which", ["rows", "given_rows"])
def test_groups_like_brute_force(spark, request, which):
    rows = request.getfixturevalue(which)
    found = sh.near_groups(frame(spark, rows))
    same(found.select("doc_id", sh.hex_form(found["fp"]), "component_id").collect(), expected(rows))


def near_values(count, seed):
    draw = random.Random(seed)
    out = set()
    for _ in range(count):
        v = draw.getrandbits(64)
        out.add(v)
        for _ in range(6):
            v ^= 1 << draw.randrange(64)
            out.add(v)
            out.add(v ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)))
    return sorted(out)


def test_bit_planes_find_all_pairs():
    values = np.array(near_values(60, 1), np.uint64)
    run = np.sort(np.random.default_rng(2).integers(0, 3, len(values)))
    for radius in (0, 1, 2):
        i, j = sh.near_in_runs(values, run, radius)
        far = np.bitwise_count(values[:, None] ^ values[None])
        want = np.argwhere((far <= radius) & (run[:, None] == run[None]) & np.triu(np.ones_like(far, bool), 1))
        assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist()))


@pytest.mark.parametrize("crowd", [1, 3, 1024])
def test_crowds_lose_no_pair(spark, crowd):
    """Values that agree in 40 bits crowd under the first keys and under the second ones."""
    draw = random.Random(5)
    values = near_values(30, 3) + sorted({(0xABCDEF0123 << 24) | draw.getrandbits(24) for _ in range(400)})
    df = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for v in values], "fp bigint")
    found = {r["node"] % 2**64: r["component"] % 2**64 for r in components(sh.links(df, crowd), "a", "b").collect()}
    want = plain_groups(values)
    parts = lambda label: {frozenset(v for v in values if label(v) == c) for c in {label(v) for v in values}}
    assert parts(lambda v: found.get(v, v)) == parts(want.get)


def test_components_of_chains_stars_and_loops(spark):
    chain = [(f"c{i:04}", f"c{i + 1:04}") for i in range(300)]
    star = [("hub", f"s{i}") for i in range(200)]
    edges = [*chain, *star, ("x", "x"), ("y", None), (None, None), ("p", "q"), ("q", "p"), ("p", "q")]
    found = components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()
    groups = {}
    for r in found:
        groups.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(len, groups.values())) == [2, 201, 301]
    assert all(c in nodes for c, nodes in groups.items())
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "a", "b").count() == 0


def test_one_of_each_keeps_all_columns(odd, rows):
    kept = sh.one_of_each(odd)
    assert kept.columns == odd.columns and kept.dtypes == odd.dtypes
    prints = [plain_fingerprint(t) for _, t in rows]
    group = plain_groups(prints)
    least = {group[p]: c for p, (_, _, c) in zip(prints, expected(rows))}
    same([(r.doc_id,) for r in kept.collect()], [(c,) for c in least.values()])


def test_empty_table(none):
    assert sh.near_groups(none).count() == 0 and sh.one_of_each(none).count() == 0
