import math

import numpy as np
import pytest

from clipquarry.llm import whitening
from clipquarry.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int, n string, component double, x binary, ids int"


def plain(rows, most=32):
    """The same by a dense eigenvalue solver; {(vec_id, component): row} and the eigenvectors' signs left open."""
    kept = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    count = min(most, len(sums), int((values > 1e-12 * values[0]).sum()))
    w = centred @ vectors[:, :count] / np.sqrt(values[:count])
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    return [i for i, _ in kept], n, deviation, w, values[:count] / values.sum()


def agrees(found, rows, most=32):
    ids, n, deviation, w, explained = plain(rows, most)
    by_row = {}
    for r in found:
        by_row.setdefault(r.component, []).append(r)
    assert len(found) == w.size and sorted(by_row) == list(range(1, w.shape[1] + 1))
    assert len({r.identity_error for r in found}) == 1 and found[0].identity_error <= 1e-8
    for c, some in by_row.items():
        key = lambda r: (r[0] is None, r[0] or 0, r[1], abs(round(r[2], 6)))
        have = sorted([(r.vec_id, r.deviation, r.whitened) for r in some], key=key)
        want = sorted(zip(ids, deviation, w[:, c - 1]), key=key)
        assert [h[:2] for h in have] == [t[:2] for t in want]
        a, b = np.array([h[2] for h in have]), np.array([t[2] for t in want])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-6
        assert all(r.n == n and abs(r.explained / explained[c - 1] - 1) < 1e-9 for r in some)


def odd_rows(count=400, dimension=40):
    draw = np.random.default_rng(4)
    v = (draw.standard_normal((count, dimension)) * np.linspace(3, 0.5, dimension)).astype(np.float32).tolist()
    rows = list(enumerate(v))
    rows[3] = (3, None)
    rows[4] = (4, [])
    rows[5] = (5, [float("nan"), *v[5][1:]])
    rows[6] = (6, [None, *v[6][1:]])
    rows[7] = (7, [*v[7][:-1], float("-inf")])
    rows[8] = (None, v[8])
    rows[9] = rows[10] = (10, v[10])
    return rows + [(None, None), (11, v[12])]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "n", 0.5, b"x", 3) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("most", [3, 32])
def test_like_a_dense_solver(spark, most):
    rows = odd_rows()
    agrees(whitening.whitened(frame(spark, rows), most).collect(), rows, most)


def test_given_table(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    agrees(QUERIES["op12_whitening"](spark, data).collect(), rows)


def test_fewer_vectors_than_dimensions(spark):
    rows = odd_rows(30, 40)
    found = whitening.whitened(frame(spark, rows)).collect()
    agrees(found, rows)
    assert max(r.component for r in found) == 24 - 1


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])]):
        assert whitening.whitened(frame(spark, rows)).collect() == []


def test_odd_vectors_raise(spark):
    with pytest.raises(ValueError, match="entries"):
        whitening.whitened(frame(spark, [(1, [0.5, 0.25]), (2, [0.5])]))
    with pytest.raises(Exception, match="too great"):
        whitening.whitened(frame(spark, [(1, [3e38, 0.25])])).collect()


def test_great_values(spark):
    """Wide numbers, and deviations beyond a long."""
    rows = [(i, [float(2**40 * (i % 3)), float(i % 5), float(i)]) for i in range(60)]
    found = whitening.whitened(frame(spark, rows)).collect()
    assert {r.vec_id for r in found if r.deviation is None} == {i for i in range(60) if i % 3 != 1} and max(r.component for r in found) == 1
    x = np.array([[64 * int(c) for c in v] for _, v in rows], object)
    fit = whitening.Fit(60, x.sum(0).tolist())
    small = x // 2**22
    fit_small = whitening.Fit(60, small.sum(0).tolist())
    want = ((60 * small - small.sum(0)) ** 2).sum(1).tolist()
    assert whitening.deviations(small.astype(np.int64), fit_small) == want
    found = whitening.deviations(x.astype(np.int64), fit)
    assert found == [v if v < 2**63 else None for v in ((60 * x - x.sum(0)) ** 2).sum(1)]


@pytest.mark.parametrize("kind", ["wide", "flat", "equal", "few"])
def test_solver(kind):
    draw = np.random.default_rng(2)
    if kind == "wide":
        a = draw.standard_normal((900, 200)) * np.geomspace(300, 1, 200)
    elif kind == "flat":
        a = draw.standard_normal((5000, 150))
    elif kind == "equal":
        a = np.linalg.qr(draw.standard_normal((200, 90)))[0] * np.r_[np.full(40, 5.0), np.ones(50)]
    else:
        a = draw.standard_normal((20, 70))
    cov = a.T @ a / len(a)
    found = whitening.eigenvectors(lambda q: cov @ q, len(cov), 32)
    wanted = np.linalg.eigvalsh(cov)[::-1][:32]
    assert np.abs(found.values - wanted).max() <= 1e-12 * wanted[0]
    assert np.abs(found.vectors.T @ found.vectors - np.eye(32)).max() < 1e-12
    assert np.abs(cov @ found.vectors - found.vectors * found.values).max() <= 1e-12 * wanted[0]


def test_a_wrong_edge_is_given_up(monkeypatch):
    """A lower edge far above the least eigenvalue costs passes, not results."""
    monkeypatch.setattr(whitening.LowerEdge, "value", lambda self: 55.0)
    values = np.r_[np.linspace(100, 60, 80), np.linspace(50, 0, 120)]
    found = whitening.eigenvectors(lambda q: values[:, None] * q, 200, 32)
    assert np.abs(found.values - values[:32]).max() < 1e-10


def test_uncertified_raises(monkeypatch):
    monkeypatch.setattr(whitening, "ROUNDS", 2)
    values = np.linspace(100, 99, 300)
    with pytest.raises(ArithmeticError):
        whitening.eigenvectors(lambda q: values[:, None] * q, 300, 32)
