import hashlib
import random

import numpy as np
import pytest
from conftest_llm import frame, prose, same
from xxhash import xxh64_intdigest

from clipquarry.llm import nearcopies, simhash
from clipquarry.llm import repeats as rep


def covered(rows):
    """For each row the bytes that go, by remembering every string of 100 bytes."""
    seen, out = {}, {}
    order = sorted({(i is None, i or 0, _tag(t), t or "") for i, t in rows})
    for n, (_, _, _, text) in enumerate(order):
        raw = text.encode()
        cover = bytearray(len(raw))
        for at in range(len(raw) - 99):
            if seen.setdefault(raw[at : at + 100], (n, at)) != (n, at):
                cover[at : at + 100] = b"\1" * 100
        out[order[n]] = raw, cover
    return [(i, *out[(i is None, i or 0, _tag(t), t or "")]) for i, t in rows]


TAGS = {}


def _tag(text):
    return TAGS[text or ""]


def learn_tags(spark, rows):
    made = rep.keyed(frame(spark, rows)).select("text", "tag").collect()
    TAGS.update({r["text"]: r["tag"] % rep.TAGS for r in made})


def expected(rows):
    out = []
    for doc_id, raw, cover in covered(rows):
        runs = sum(c and (not i or not cover[i - 1]) for i, c in enumerate(cover))
        kept = bytes(b for b, c in zip(raw, cover) if not c)
        out.append((doc_id, len(raw), sum(cover), runs, hashlib.sha256(kept).hexdigest()))
    return out


def shared_passages(spark=None):
    """Common passages of many lengths between different neighbours, runs, and copies."""
    draw = random.Random(9)
    common = [prose(k, n) for k, n in ((50, 14), (51, 15), (52, 16), (53, 17), (54, 30), (55, 200))]
    rows = []
    for n in range(120):
        parts = [prose(1000 + n * 9 + k, draw.randint(0, 12)) + draw.choice(["", " "]) + draw.choice(common) for k in range(draw.randint(0, 4))]
        rows.append((draw.randint(-500, 500), "".join(parts) + "é" * draw.randint(0, 120)))
    rows += [(1000 + n, "ab" * draw.randint(0, 150)) for n in range(20)] + [(2000, common[5]), (2000, common[5]), (2001, common[5])]
    return rows


@pytest.mark.parametrize("crowd", [1, 4, 4096])
@pytest.mark.parametrize("which", ["rows", "given_rows", "passages"])
def test_like_brute_force(spark, request, which, crowd):
    rows = shared_passages() if which == "passages" else request.getfixturevalue(which)
    learn_tags(spark, rows)
    same(rep.measured(frame(spark, rows).repartition(6), crowd).collect(), expected(rows))


def test_sections_of_a_long_text(monkeypatch):
    flat = np.frombuffer(prose(3, 3000).encode() * 2, np.uint8)
    offsets = np.array([0, 50, len(flat) // 3, len(flat)])
    whole = rep.stretches(flat, offsets)
    monkeypatch.setattr(rep, "SECTION", 1000)
    parts = rep.stretches(flat, offsets)
    windows = lambda s: sorted(w for a, b in zip(s[2], s[3]) for w in range(a, b - 99))
    assert windows(whole) == windows(parts) and len(set(windows(parts))) == len(windows(parts))
    assert (parts[3] - parts[2]).max() < 1 << rep.SIZE_BITS


def test_longest_previous_factors():
    draw = random.Random(1)
    text = bytes(draw.choice(b"ab") for _ in range(250)) * 3 + bytes(draw.choice(b"abc") for _ in range(400)) + b"z" * 300
    flat = np.frombuffer(text, np.uint8)
    starts = np.array([i for i in range(len(flat) - 99) if i % 7 != 3])

    def common(i, j):
        n = 0
        while n < 100 and text[i + n] == text[j + n]:
            n += 1
        return n

    want = [max((common(i, j) for j in starts[:k]), default=0) for k, i in enumerate(starts)]
    assert rep.longest_previous_factors(flat, starts).tolist() == want


def test_nearest_smaller():
    values = np.random.default_rng(1).permutation(400)
    left, right = rep.smaller(values)
    for i, v in enumerate(values):
        below = np.flatnonzero(values < v)
        assert left[i] == max((j for j in below if j < i), default=-1)
        assert right[i] == min((j for j in below if j > i), default=-1)


def test_texts_stay_texts(spark, odd, rows):
    learn_tags(spark, rows)
    found = rep.without_repeats(odd)
    assert found.dtypes == odd.dtypes
    want = []
    for (doc_id, _), (_, raw, cover) in zip(rows, covered(rows)):
        gone, at = [], 0
        for char in raw.decode():
            size = len(char.encode())
            gone.append(all(cover[at : at + size]))
            at += size
        want.append((doc_id, "".join(c for c, g in zip(raw.decode(), gone) if not g)))
    same([(r.doc_id, r.text) for r in found.collect()], want)


def test_one_passage_in_many_documents(spark):
    """The passage stays once, whatever stands around it, and nothing else goes."""
    passage = prose(77, 60)
    rows = [(n, f"{prose(3000 + n, 8)} {passage} {prose(9000 + n, 8)}") for n in range(800)]
    learn_tags(spark, rows)
    same(rep.measured(frame(spark, rows), crowd=50).collect(), expected(rows))


def test_empty_table(none):
    assert rep.measured(none).count() == 0 and rep.without_repeats(none).count() == 0


def alike_in_30_bits():
    """Two texts without ids whose XXH64 agree in the lowest 30 bits; one shares a passage with a third."""
    passage = prose(61, 40)
    rows = [(None, f"4225 {passage}"), (None, " ".join(str(14810 * k) for k in range(1, 40))), (1, passage)]
    assert (xxh64_intdigest(rows[0][1], 42) - xxh64_intdigest(rows[1][1], 42)) % 2**30 == 0
    return rows


def test_texts_without_ids_keep_their_own_spans(spark):
    rows = alike_in_30_bits()
    learn_tags(spark, rows)
    same(rep.measured(frame(spark, rows)).collect(), expected(rows))
    keys = rep.keyed(frame(spark, rows)).select(*rep.KEY).collect()
    assert len({tuple(k) for k in keys}) == 3 and [k.tie != 0 for k in keys] == [True, True, False]


def test_texts_without_ids_are_no_copies(spark):
    rows = [r for r in alike_in_30_bits() if r[0] is None]
    for kept in (simhash.one_of_each, nearcopies.one_of_each):
        assert kept(frame(spark, rows)).count() == 2


def test_texts_are_shuffled_once(spark):
    """Open and crowded stretches are fetched from the shuffle that the result reads."""
    rows = shared_passages()
    learn_tags(spark, rows)
    found = rep.measured(frame(spark, rows).repartition(6), crowd=1)
    same(found.collect(), expected(rows))
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    texts = [line for line in plan if "ReusedExchange" in line and "text#" in line]
    # Crowded stretches twice: their windows meet the first of equal ones.
    assert sum("_windows" in line for line in plan) == 2 and len(texts) >= 2
