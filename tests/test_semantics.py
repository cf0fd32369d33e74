"""Coercion traps."""

import math

import pytest
from pyspark.sql import functions as F

from clipquarry.functions import semantics as sem
from clipquarry.plans import sampling


def values(spark, kind, items, rule):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"n int, x {kind}")
    return [r[1] for r in df.select("n", rule(F.col("x"))).orderBy("n").collect()]


def test_round_half_goes_up(spark):
    assert values(spark, "double", [-2.5, 2.5, 0.5, -0.5, 1.49], sem.round_half_up) == [-2, 3, 1, 0, 1]


def test_default_replaces_zero_and_nan(spark):
    assert values(spark, "double", [None, 0.0, math.nan, 2.0], lambda x: sem.or_default(x, 7.0)) == [7.0, 7.0, 7.0, 2.0]


def test_leading_int(spark):
    texts = ["6.7", "12abc", "abc", "", None, " -4", "+9", "99999999999999999999999"]
    assert values(spark, "string", texts, sem.leading_int) == [6, 12, None, None, None, -4, 9, 1e23]


def test_int_param(spark):
    texts = [None, "0", "-4", "abc", "6.7", "12abc", "", "999", "99999999999999999999999"]
    assert values(spark, "string", texts, sampling.frame_count_param) == [3, 3, 1, 3, 5, 5, 3, 5, 5]
    assert values(spark, "string", texts, sampling.hash_count_param) == [6, 6, 3, 6, 6, 12, 6, 12, 12]


def test_number_of_text(spark):
    texts = [None, "", "  ", "12", " -1.5 ", "1e3", ".5", "5.", "abc", "12abc", "0x1F", "1d", " 7﻿"]
    want = [0.0, 0.0, 0.0, 12.0, -1.5, 1000.0, 0.5, 5.0, None, None, 31.0, None, 7.0]
    assert values(spark, "string", texts, sem.to_number) == want


def test_trim_knows_all_blanks(spark):
    assert values(spark, "string", ["   a b﻿\n", "\u0085x"], sem.trim_blanks) == ["a b", "\u0085x"]


def test_length_in_utf16_units(spark):
    assert values(spark, "string", ["abc", "é", "\U0001f600"], sem.utf16_length) == [3, 1, 2]


@pytest.mark.parametrize("count,keep", [(12, 12), (13, 12), (20, 20), (21, 20), (80, 20), (80, 12), (1, 12)])
def test_even_sample(spark, count, keep):
    (picks,) = values(spark, "bigint", [count], lambda x: sampling.even_sample(x, keep))
    assert len(picks) == min(count, keep) == len(set(picks))
    assert picks == sorted(picks) and picks[0] == 0 and picks[-1] == count - 1
    if count > keep:
        assert picks == [math.floor(i * (count - 1) / (keep - 1) + 0.5) for i in range(keep)]
