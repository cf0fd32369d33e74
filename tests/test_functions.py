"""Routing, responses, metadata, captions, draws."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clipquarry.functions import draws, geometry, phash, routing, text


def one(spark, schema, row, *columns):
    out = spark.createDataFrame([row], schema).select(*columns).first()
    return out[0] if len(columns) == 1 else tuple(out)


@pytest.mark.parametrize(
    "url,want",
    [
        ("https://www.instagram.com/p/x/", "instagram"),
        ("https://instagram.com/reels/x", "instagram"),
        ("https://instagram.com/reel", "direct"),
        ("https://INSTAGRAM.com/reel/x/", "direct"),
        ("see tiktok.com/t/abc", "tiktok"),
        ("https://www.tiktok.com/@a/b/video/1", "direct"),
        ("  ", "direct"),
        ("", None),
        (None, None),
    ],
)
def test_platform(spark, url, want):
    assert one(spark, "u string", (url,), routing.platform(F.col("u"))) == want


@pytest.mark.parametrize(
    "error,description,want",
    [
        ("Post not found or private", None, "restricted_page"),
        ("Post DELETED, login required", None, "not_found"),
        ("notfound", None, "not_found"),
        ("empty message", None, "restricted_page"),
        ("", "geoblock", "restricted_page"),
        (None, None, "unknown"),
        ("timeout", "deleted", "unknown"),
    ],
)
def test_fetch_error_reason(spark, error, description, want):
    got = one(spark, "e string, d string", (error, description), routing.fetch_error_reason(F.col("e"), F.col("d")))
    assert got == want


@pytest.mark.parametrize(
    "size,direct,indirect,tracks",
    [
        (999, None, "too_small", ("silent", "no_audio", "usable")),
        (1000, None, None, ("silent", "no_audio", "usable")),
        (1001, None, None, ("usable", "no_audio", "usable")),
        (2000, None, None, ("usable", "usable", "usable")),
        (60 * 2**20 + 1, None, None, ("usable", "usable", "too_large")),
        (200 * 2**20 + 1, "too_large", None, ("usable", "usable", "too_large")),
        (900 * 2**20, "too_large", None, ("usable", "usable", "too_large")),
    ],
)
def test_payload_limits(spark, size, direct, indirect, tracks):
    row = ("direct", "tiktok", "video/mp4", "ftyp", size)
    got = one(
        spark,
        "a string, b string, t string, h string, s bigint",
        row,
        routing.analysis_reject_reason(F.col("a"), F.col("t"), F.col("h"), F.col("s")),
        routing.analysis_reject_reason(F.col("b"), F.col("t"), F.col("h"), F.col("s")),
        routing.speech_track_state(F.col("s")),
        routing.extracted_track_state(F.col("s")),
        routing.timing_track_state(F.col("s")),
    )
    assert got == (direct, indirect, *tracks)


@pytest.mark.parametrize(
    "size,reasons",
    [(200, ("too_large", None, None)), (250, ("too_large", None, None)), (300, ("too_large", None, "too_large")), (0, ("too_small",) * 3)],
)
def test_audio_limits_by_platform(spark, size, reasons):
    row = ("instagram", "tiktok", "direct", size * 2**20 + 1)
    sources = [routing.audio_reject_reason(F.col(c), F.col("s")) for c in "abc"]
    assert one(spark, "a string, b string, c string, s bigint", row, *sources) == reasons


def test_texts_are_cut_by_utf16_units(spark):
    got = one(
        spark, "x string, y string", ("ab🙂cd", "é" * 9), *[text.truncated(F.col("x"), n) for n in (2, 3, 4, 5, 9)], text.truncated(F.col("y"), 3)
    )
    assert got == ("ab", "ab", "ab🙂", "ab🙂c", "ab🙂cd", "ééé")


@pytest.mark.parametrize(
    "response,lane,talking,body,error",
    [
        ("  LANE: HIGH-END \n\nTALKING: yes\nBody", "HIGH-END", True, "Body", None),
        ("lane:authentic\nTALKING: NO\n\n\nBody\nmore", "AUTHENTIC", False, "Body\nmore", None),
        ("LANE: OTHER\nTALKING: YES\nBody", "AUTHENTIC", False, "LANE: OTHER\nTALKING: YES\nBody", None),
        ("TALKING: YES\nBody", "AUTHENTIC", True, "Body", None),
        ("LANE: HIGH-END", "AUTHENTIC", False, "LANE: HIGH-END", None),
        (" \n ", "AUTHENTIC", False, "", "Empty response"),
        (None, "AUTHENTIC", False, "", "Empty response"),
    ],
)
def test_header(spark, response, lane, talking, body, error):
    parts = text.parse_header(F.col("r"))
    got = one(spark, "r string", (response,), parts["lane"], parts["talking"], parts["body"], parts["error"])
    assert got == (lane, talking, body, error)


def test_sections(spark):
    response = "noise\nAnalysis  \nsum\nPROMPT A | warm \nfirst\n\nprompt b\n \nPROMPT C |\nlabel\nthird"
    got = one(spark, "r string", (response,), text.parse_sections(F.col("r")))
    assert got.analysis == "sum"
    assert [tuple(p) for p in got.prompts] == [("A", "warm", "first"), ("C", "label", "third")]


def test_sections_without_headings(spark):
    got = one(spark, "r string", ("plain answer",), text.parse_sections(F.col("r")))
    assert got.analysis == "plain answer" and got.prompts == []


def test_metadata(spark):
    row = ({"make": " a\n\tb ", "model": "\x01 ", "x": "y", "creation_time": "z" * 300, "com.apple.quicktime.make": None},)
    got = one(spark, "m map<string,string>", row, text.allowed_metadata(F.col("m")))
    assert got == {"make": "ab", "creation_time": "z" * 256}


def test_error_message_order(spark):
    def message(body):
        return one(spark, "b string", (body,), text.error_message(F.col("b"), F.lit("own")))

    assert message('{"error":{"message":"a"},"message":"b"}') == "a"
    assert message('{"error":{"message":""},"message":"","msg":"c"}') == "c"
    assert message('{"error":"text"}') == "own"
    assert message(None) == "own"


def test_canvas(spark):
    w, h = F.col("w"), F.col("h")
    stitch, reel = geometry.stitch_canvas(w, h), geometry.reel_canvas(w, h)

    def canvas(*row):
        return one(spark, "w double, h double", row, *stitch, *reel)

    assert canvas(481.0, 854.0) == (482, 854, 482, 854)
    assert canvas(100.0, 854.0) == (1080, 1920, 100, 854)
    assert canvas(None, 854.0) == (1080, 1920, 1080, 854)
    assert canvas(5000.0, 0.0) == (1080, 1920, 5000, 1920)


def test_font_size_fits_the_longest_text(spark):
    px = geometry.caption_font_px(F.col("w"), F.col("h"), F.col("n"), F.lit(0.0175))
    assert one(spark, "w int, h int, n bigint", (1080, 1920, 5), px) == 34
    assert one(spark, "w int, h int, n bigint", (1080, 1920, 80), px) == 20
    assert one(spark, "w int, h int, n bigint", (480, 640, 200), px) == 16


def _draws(seed, index, count):
    """Plain restatement of the generator, one step at a time."""
    state = 0
    for ch in f"{seed}::{index}":
        state = (state * 31 + ord(ch)) % 2**32
    state ^= state >> 16
    state = state * 2246822507 % 2**32
    state ^= state >> 13
    state = state * 3266489909 % 2**32
    state ^= state >> 16
    out = []
    for _ in range(12 + count):
        state = (state * 1664525 + 1013904223) % 2**32
        out.append(state / 2**32)
    return out[12:]


def test_draws(spark):
    for seed, index in [("run", 0), ("run", 1), ("1754000000000", 9), ("x", 123456789)]:
        got = one(spark, "s string, i bigint", (seed, index), *[draws.uniform(F.col("s"), F.col("i"), k) for k in (1, 2, 5)])
        want = _draws(seed, index, 5)
        assert got == (want[0], want[1], want[4])


def test_data_url_is_one_line(spark):
    got = one(spark, "b binary", (bytes(range(256)),), text.data_url(F.col("b")))
    assert got.startswith("data:image/jpeg;base64,AAEC") and "\n" not in got and "\r" not in got


def test_frames_are_hashed_in_blocks(monkeypatch):
    """A batch of any size is worked on block by block; odd frames keep their places."""
    draw = np.random.default_rng(3)
    frames = [[int(v) for v in draw.integers(0, 256, 1024)] for _ in range(40)]
    frames[3], frames[17], frames[39] = None, [1, 2], [None] * 1024
    whole = phash._hashed(pa.array(frames, pa.list_(pa.int32()))).to_pylist()
    assert [n for n, h in enumerate(whole) if h is None] == [3, 17, 39]
    sizes, hashed = [], phash._hashed
    monkeypatch.setattr(phash, "HASH_BLOCK", 7)
    monkeypatch.setattr(phash, "_hashed", lambda part: sizes.append(len(part)) or hashed(part))
    out = [a.to_pylist() for a in phash.phash64.func(iter([pa.array(frames, pa.list_(pa.int32())), pa.array([], pa.list_(pa.int32()))]))]
    assert out == [whole, []] and max(sizes) == 7 and sum(sizes) == 40


def test_queries_on_frames_bound_their_batches(spark, data):
    from clipquarry.queries import QUERIES
    from clipquarry.session import BATCH_BYTES, BATCH_SETTING

    before = spark.conf.get(BATCH_SETTING)
    try:
        for name in ("phash_distance_stats", "near_duplicate_members"):
            spark.conf.set(BATCH_SETTING, str(256 << 20))
            QUERIES[name](spark, data)
            assert int(spark.conf.get(BATCH_SETTING)) == BATCH_BYTES
    finally:
        spark.conf.set(BATCH_SETTING, before)
