"""Groups that grow with arrivals, against groups of all clips at once."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipquarry import queries
from clipquarry.operators import hashes, links
from clipquarry.operators.hashindex import Index

CLIPS = "clip_id bigint, frame_idx int, phash bigint"


def _signed(h):
    return h - 2**64 if h >= 2**63 else h


def _near_clips(rng, seeds, threshold, shared=False):
    """Chains of edits of random clips, some cut shorter, some exact copies, a frame that all share."""
    clips = []
    for _ in range(seeds):
        clip = [0 if f == 0 and shared else int(rng.integers(0, 2**63)) for f in range(int(rng.integers(1, 9)))]
        for _ in range(6):
            clips.append(clip[: int(rng.integers(1, len(clip) + 1))] if rng.random() < 0.3 else clip)
            edited = []
            for h in clip:
                for bit in rng.choice(64, int(rng.integers(0, threshold + 2)), replace=False):
                    h ^= 1 << int(bit)
                edited.append(h)
            clip = clip if rng.random() < 0.2 else edited
    order = rng.permutation(len(clips))
    return {i: clips[k] for i, k in enumerate(order)}


def _groups(clips, threshold):
    parent = {c: c for c in clips}

    def root(c):
        while parent[c] != c:
            c = parent[c]
        return c

    for a in clips:
        for b in clips:
            ds = [(x ^ y).bit_count() for x, y in zip(clips[a], clips[b])]
            if a < b and sum(ds) <= threshold * len(ds):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    named = {c: root(c) for c in clips}
    return sorted((c, g, sum(o == g for o in named.values())) for c, g in named.items())


def _frame(spark, clips):
    return spark.createDataFrame([(c, f, _signed(h)) for c, hs in clips.items() for f, h in enumerate(hs)], CLIPS)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _index(spark, folder=None, **given):
    return Index(spark, folder or tempfile.mkdtemp(prefix="index-"), buckets=4, **given)


@pytest.mark.parametrize("threshold,heavy_rows,shared,band_bits", [(4, 100_000, False, 16), (10, 8, True, 16), (20, 100_000, False, 16), (0, 5, True, 13)])
def test_three_arrivals_like_all_at_once(spark, threshold, heavy_rows, shared, band_bits):
    rng = np.random.default_rng(threshold)
    clips = _near_clips(rng, 8, threshold, shared)
    index = _index(spark, band_bits=band_bits)
    seen = {}
    for number in (3, 5, 6):
        some = {c: hs for c, hs in clips.items() if c % 3 == number % 3 or number == 6 and c % 3 == 1 or number == 5 and c % 3 == 2}
        some = {c: hs for c, hs in some.items() if c not in seen}
        seen |= some
        assert index.arrive(_frame(spark, some), number, threshold, heavy_rows)
        assert _rows(index.groups(heavy_rows)) == _groups(seen, threshold)
    assert len(seen) == len(clips)


def test_old_index_is_not_shuffled(spark):
    clips = _near_clips(np.random.default_rng(1), 6, 10)
    index = _index(spark)
    index.arrive(_frame(spark, {c: h for c, h in clips.items() if c % 2}), 1)
    new = {c: h for c, h in clips.items() if c % 2 == 0}
    probes = hashes._signatures(_frame(spark, new)).select(F.unhex(F.md5(F.col("clip_id").cast("string"))).alias("name"), F.posexplode("signature").alias("pos", "h"))
    met = index.met(probes, 2, 10)
    plan = met._jdf.queryExecution().executedPlan().toString()
    scan = [line for line in plan.splitlines() if "FileScan" in line and "value" in line]
    assert scan and all("Bucketed: true" in line for line in scan)
    # From the scan up to the join there are sorts, filters and projections only.
    lines = plan.split("FileScan parquet")
    above = lines[0].splitlines()
    join = max(i for i, line in enumerate(above) if "SortMergeJoin" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    right = [line for line in above[join + 1 :] if line.lstrip().startswith("+-") and depth(line) <= depth(above[join]) + 3]
    assert right and "Exchange" not in "".join(above[above.index(right[0], join) :])


def test_stopped_repeated_and_reopened(spark):
    clips = _near_clips(np.random.default_rng(2), 5, 10)
    folder = tempfile.mkdtemp(prefix="index-")
    first, second = ({c: h for c, h in clips.items() if c % 2 == k} for k in (0, 1))
    index = _index(spark, folder)
    assert index.arrive(_frame(spark, first), 1)
    stopped = _index(spark, folder)
    rows_ = hashes._signatures(_frame(spark, second)).select("clip_id", F.unhex(F.md5(F.lit("x"))).alias("name"), "signature")
    stopped._insert("members", rows_, 2)
    stopped._insert("signatures", rows_, 2)
    assert _rows(_index(spark, folder).groups()) == _groups(first, 10)
    again = _index(spark, folder)
    assert not again.arrive(_frame(spark, second), 1)
    assert _rows(again.groups()) == _groups(first, 10)
    assert again.arrive(_frame(spark, second), 2)
    assert _rows(_index(spark, folder).groups()) == _groups(clips, 10)
    # What is known already, and rows without a clip, a place or a hash, change nothing.
    more = _frame(spark, first).union(spark.createDataFrame([(None, 0, 5), (900, None, 5), (901, 0, None)], CLIPS))
    assert again.arrive(more, 3)
    assert _rows(again.groups()) == _groups(clips, 10)


def test_no_clips(spark):
    index = _index(spark)
    assert _rows(index.groups()) == []
    assert index.arrive(spark.createDataFrame([], CLIPS), 1)
    assert _rows(index.groups()) == []
    assert index.arrive(_frame(spark, {7: [1, 2]}), 2)
    assert _rows(index.groups()) == [(7, 7, 1)]


@pytest.mark.parametrize("heavy_rows", [3, 100_000])
def test_connected_groups(spark, heavy_rows):
    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(500, i) for i in range(501, 540)]
    random = [(int(a) + 1000, int(b) + 1000) for a, b in rng.integers(0, 60, (40, 2))]
    given = [*chain, *star, *random, (1, 1), (None, 4), (4, None), *star[:5]]
    got = links.connected(spark.createDataFrame(given, "a bigint, b bigint"), "a", "b", heavy_rows)
    nodes = {n for a, b in given if a is not None and b is not None and a != b for n in (a, b)}
    least = {n: n for n in nodes}
    for _ in nodes:
        for a, b in given:
            if a in least and b in least and a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert _rows(got) == sorted(least.items())
    assert _rows(links.connected(spark.createDataFrame([], "a bigint, b bigint"), "a", "b")) == []


@pytest.mark.parametrize("threshold", [0, 1, 4, 10])
def test_distances_dealt_to_any_frame(spark, threshold):
    """Pairs of three frames with a sum right at the limit or one more, wherever it lies."""
    rng = np.random.default_rng(threshold)
    most = 3 * threshold
    even = [threshold] * 3
    dealt = [(most, 0, 0), (0, most, 0), (0, 0, most), even, (threshold + 1, threshold, threshold - 1), (threshold - 1, threshold, threshold + 1)]
    dealt += [(threshold + 1, threshold, threshold), (threshold, threshold + 1, threshold), (threshold, threshold, threshold + 1), (0, 0, most + 1)]
    clips = {}
    for k, distances in enumerate(d for d in dealt if min(d) >= 0):
        clip = [int(rng.integers(0, 2**63)) for _ in distances]
        clips[2 * k] = clip
        clips[2 * k + 1] = [h ^ sum(1 << int(bit) for bit in rng.choice(64, d, replace=False)) for h, d in zip(clip, distances)]
    index = _index(spark)
    for number in (1, 2):
        assert index.arrive(_frame(spark, {c: h for c, h in clips.items() if c % 2 == number - 1}), number, threshold)
    assert _rows(index.groups()) == _groups(clips, threshold)


def test_frames_send_few_rows(spark):
    index = _index(spark)
    frames = spark.createDataFrame([(bytes([c]), pos, c * 77 + pos) for c in range(20) for pos in range(3)], "name binary, pos int, h bigint").coalesce(1)
    sent = index.sent(frames, 10)
    counts = {(r.pos, r["count"]) for r in sent.groupBy("a", "pos").count().collect()}
    assert counts == {(0, 135), (1, 69), (2, 69)}
    assert sent.distinct().count() == sent.count()
    # A single task held them all.
    assert sent.rdd.getNumPartitions() > 1


def test_arrivals_read_frames_once(spark, monkeypatch):
    clips = _near_clips(np.random.default_rng(3), 3, 10)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(queries, "_hashes", lambda spark, root, *_: _frame(spark, clips).mapInArrow(counted, CLIPS))
    got = queries.QUERIES["near_duplicate_arrivals"](spark, "nowhere")
    assert sorted((r.clip_id, r.group_id, r.group_clips) for r in got.collect()) == _groups(clips, 10)
    assert seen.value == sum(map(len, clips.values()))
