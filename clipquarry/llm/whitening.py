"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

Vectors are read once, checked, turned into whole numbers x = floor(64 c) + 1000000 and landed in blocks of bytes, as narrow as their values allow.
The covariance V = X'X / n of the centred vectors is never made: a pass over the blocks gives V Q for a block of columns Q, each task adds up its
own vectors, centred before they are multiplied, and a grouped sum adds the tasks. Only matrices of dimension x columns reach the driver.

Filter: T_m(V) Q by the three-term recurrence, one pass a degree, where T_m is the Chebyshev polynomial that stays within 1 on the
unwanted part of the spectrum and grows beyond. Its upper edge is the least Ritz value of the block, its lower edge comes from a Lanczos
vector that rides along in the first passes as one more column. Then QR, and Rayleigh-Ritz from one more pass, whose product also gives the residuals.
The degree is held down where the polynomial would grow so much on the first columns that the last ones lose their digits. Iteration ends when all
wanted components are certified: |V q - e q| is at most `TOLERANCE` of the greatest eigenvalue. Else it raises after `ROUNDS` rounds.

Rows whose vector is null or empty, or holds null or non-finite entries, go. All others are fitted and returned, repeated rows and rows without id too. Extra
columns are ignored. Vectors of different lengths raise, as do entries that are no longs. An empty table gives an empty one. Components end where
eigenvalues are zero to rounding (fewer vectors than dimensions, constant dimensions), as these have no whitened value. `deviation` is exact; beyond a long it is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipquarry.llm.shared import landed

COMPONENTS = 32
GUARD = 16  # further columns, which let the last components converge
BLOCK_VALUES = 1 << 18  # values of the vectors in one landed row
TOLERANCE = 1e-13  # residual of a certified component, relative to the greatest eigenvalue
DEGREE = 12
ROUNDS = 60
GROWTH = 1e9  # how much more the filter may raise the first column than the last one
NOTHING = 1e-12  # eigenvalues below this share of the greatest one are zero

# How an entry becomes a whole number.
FACTOR, SHIFT = 64.0, 1_000_000

PACKED = "ids array<bigint>, vectors bigint, dimension int, width int, x binary"
OUT = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def packed(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """The usable vectors in blocks: ids, and floor(64 c) in row order as little-endian integers of `width` bytes."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column("v"), batch.column("vec_id")
            sizes = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            starts = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
            for size in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == size)
                step = max(1, BLOCK_VALUES // size)
                for at in range(0, len(rows), step):
                    some = rows[at : at + step]
                    values = flat[starts[some][:, None] + np.arange(size)]
                    usable = np.isfinite(values).all(1)
                    if usable.any():
                        yield block(ids.take(pa.array(some[usable])), values[usable])

    def block(ids: pa.Array, values: np.ndarray) -> pa.RecordBatch:
        floors = np.floor(FACTOR * values)
        if np.abs(floors).max() >= 2.0**62:
            raise ValueError("an entry is too great to become a whole number")
        x = floors.astype(np.int64)
        width = next(w for w in (1, 2, 4, 8) if x.min() >= -(2 ** (8 * w - 1)) and x.max() < 2 ** (8 * w - 1))
        columns = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), pa.array([len(x)], pa.int64())]
        columns += [pa.array([x.shape[1]], pa.int32()), pa.array([width], pa.int32())]
        columns.append(pa.array([x.astype(f"<i{width}").tobytes()], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PACKED.split(", ")])

    return vectors.select(F.col("vec_id").cast("bigint"), F.col(column).alias("v")).mapInArrow(made, PACKED)


def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and floor(64 c) of each landed row."""
    for batch in batches:
        for at in range(batch.num_rows):
            ids, _, dimension, width, x = (batch.column(k)[at] for k in range(5))
            yield ids.values, np.frombuffer(x.as_py(), f"<i{width.as_py()}").reshape(-1, dimension.as_py())


@dataclass
class Fit:
    """Size of the fit list, and per dimension the sum of floor(64 c), which `SHIFT` does not change the covariance of."""

    n: int
    sums: list[int]

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # of whole numbers, so rounded once


def summed(parts: DataFrame) -> np.ndarray:
    """Grouped sums of the rows (place, value) that tasks make, by place. Places are bounded by dimensions x columns."""
    found = parts.groupBy("place").agg(F.sum("value").alias("value")).toPandas().sort_values("place")
    return found["value"].to_numpy()


def fit_of(table: DataFrame) -> Fit | None:
    found = table.agg(F.sum("vectors"), F.min("dimension"), F.max("dimension")).first()
    if not found[0]:
        return None
    if found[1] != found[2]:
        raise ValueError(f"vectors of {found[1]} and of {found[2]} entries")

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [0] * found[1]
        for _, x in blocks(batches):
            part = x.astype(np.int64) if x.itemsize < 8 else x.astype(object)
            totals = [a + int(b) for a, b in zip(totals, part.sum(0))]
        columns = [pa.array(range(len(totals)), pa.int64()), pa.array(totals, pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(columns, names=["place", "value"])

    totals = summed(table.mapInArrow(made, "place bigint, value decimal(38,0)"))
    return Fit(int(found[0]), [int(v) for v in totals])


def added_up(table: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of `part` of each block, which is a matrix of the given shape, over all blocks."""

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in blocks(batches):
            total += part(x)
        columns = [pa.array(np.arange(total.size)), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(columns, names=["place", "value"])

    return summed(table.mapInArrow(made, "place bigint, value double")).reshape(shape)


def covariance_times(table: DataFrame, fit: Fit) -> Callable[[np.ndarray], np.ndarray]:
    """V Q for given columns Q, by one pass."""
    mean, n = fit.mean, fit.n

    def times(columns: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ columns)

        return added_up(table, part, columns.shape) / n

    return times


class LowerEdge:
    """A Lanczos run that takes one product at a time, and tells where the spectrum begins."""

    def __init__(self, dimension: int):
        start = np.random.default_rng(7).standard_normal(dimension)
        self.basis = [start / np.linalg.norm(start)]
        self.diagonal: list[float] = []
        self.beside: list[float] = []

    def add(self, product: np.ndarray) -> None:
        q = self.basis[-1]
        self.diagonal.append(float(q @ product))
        rest = product.copy()
        for _ in range(2):
            for b in self.basis:
                rest -= (b @ rest) * b
        self.beside.append(float(np.linalg.norm(rest)))
        # A run that has spanned its space starts nowhere new; further products are of a zero column.
        self.basis.append(rest / self.beside[-1] if self.beside[-1] > 1e-10 * abs(self.diagonal[0]) else np.zeros_like(rest))

    def value(self) -> float:
        between = self.beside[:-1]
        ritz, vectors = np.linalg.eigh(np.diag(self.diagonal) + np.diag(between, 1) + np.diag(between, -1))
        return max(0.0, float(ritz[0] - self.beside[-1] * abs(vectors[-1, 0])))


def growth(values: np.ndarray, low: float, high: float) -> np.ndarray:
    """By how much one degree raises each eigenvalue above `high`."""
    place = np.maximum(1.0, (values - (high + low) / 2) / ((high - low) / 2))
    return place + np.sqrt(place * place - 1)


def filtered(times: Callable, columns: np.ndarray, degree: int, low: float, high: float, top: float, edge: LowerEdge | None) -> np.ndarray:
    """T_degree of V mapped from [low, high] to [-1, 1], scaled to 1 at `top`, times the columns."""
    centre, half = (high + low) / 2, (high - low) / 2

    def product(y: np.ndarray) -> np.ndarray:
        if edge is None:
            return times(y)
        both = times(np.column_stack([y, edge.basis[-1]]))
        edge.add(both[:, -1])
        return both[:, :-1]

    first = half / (top - centre)
    scale = first
    before, now = columns, (product(columns) - centre * columns) * (scale / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        before, now = now, 2 * following / half * (product(now) - centre * now) - scale * following * before
        scale = following
    return now


@dataclass
class Spectrum:
    values: np.ndarray
    vectors: np.ndarray
    residual: float
    passes: int


def eigenvectors(times: Callable[[np.ndarray], np.ndarray], dimension: int, wanted: int) -> Spectrum:
    """The greatest eigenvalues and unit eigenvectors of a covariance that is known by its products only."""
    wanted = min(wanted, dimension)
    width = min(dimension, wanted + GUARD)
    passes = 0

    def counting(columns: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        return times(columns)

    columns = np.linalg.qr(np.random.default_rng(1).standard_normal((dimension, width)))[0]
    edge = LowerEdge(dimension)
    last, low_known = np.inf, True
    for turn in range(ROUNDS):
        product = counting(columns)
        small = columns.T @ product
        values, rotation = np.linalg.eigh((small + small.T) / 2)
        values, rotation = values[::-1], rotation[:, ::-1]
        columns, product = columns @ rotation, product @ rotation
        top = max(float(values[0]), 0.0)
        residuals = np.linalg.norm(product - columns * values, axis=0)[:wanted]
        if residuals.max() <= TOLERANCE * top or width == dimension and turn:
            return Spectrum(values[:wanted], columns[:, :wanted], float(residuals.max()), passes)
        # An edge that was guessed too high raises what it should damp; zero is always right, though slower.
        low_known, last = low_known and residuals.max() < 0.9 * last, residuals.max()
        low = edge.value() if edge.diagonal and low_known else 0.0
        high = max(float(values[-1]), 1e-9 * top)
        low = min(low, 0.999999 * high)
        raised = growth(values[[0, -1 if wanted == width else wanted - 1]], low, high)
        most = np.log(GROWTH) / max(np.log(raised[0] / raised[1]), 1e-9)
        degree = int(np.clip(most, 2, DEGREE))
        columns = filtered(counting, columns, degree, low, high, top, edge if len(edge.diagonal) < DEGREE else None)
        columns = np.linalg.qr(columns)[0]
    raise ArithmeticError(f"components are not certified after {ROUNDS} rounds: residual {residuals.max() / top:.1e} of the greatest eigenvalue")


def deviations(x: np.ndarray, fit: Fit) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; null beyond a long."""
    about = ((x - fit.mean) ** 2).sum(1) * float(fit.n) ** 2
    greatest = float(np.abs(x.astype(np.float64)).max()) * fit.n + max(map(abs, fit.sums))
    if about.max() < 2.0**62 and greatest < 2.0**62:
        return ((fit.n * x.astype(np.int64) - np.array(fit.sums, np.int64)) ** 2).sum(1).tolist()
    exact = ((fit.n * x.astype(object) - np.array(fit.sums, object)) ** 2).sum(1)
    return [int(v) if v < 2**63 else None for v in exact]


def whitened(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each usable vector and component."""
    table = landed(packed(vectors, column), "vectors")
    fit = fit_of(table)
    if fit is None:
        return vectors.sparkSession.createDataFrame([], OUT)
    mean, n, dimension = fit.mean, fit.n, len(fit.sums)

    def squares(x: np.ndarray) -> np.ndarray:
        return ((x - mean) ** 2).sum(0)[:, None]

    trace = float(added_up(table, squares, (dimension, 1)).sum() / n)
    found = eigenvectors(covariance_times(table, fit), dimension, components) if trace > 0 else None
    count = int((found.values > NOTHING * found.values[0]).sum()) if found else 0
    if not count:
        return vectors.sparkSession.createDataFrame([], OUT)
    values = found.values[:count]
    projection = found.vectors[:, :count] / np.sqrt(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ projection
        return w.T @ w

    # The whitened vectors have mean zero, as they are made of centred ones.
    error = float(np.abs(added_up(table, moments, (count, count)) / n - np.eye(count)).max())
    explained = values / trace

    def made(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in blocks(batches):
            step = max(1, BLOCK_VALUES // 8 // count)
            for at in range(0, len(x), step):
                part = x[at : at + step]
                rows = len(part) * count
                each = np.repeat(np.arange(len(part)), count)
                columns = [
                    ids.slice(at, len(part)).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(part))),
                    pa.array(np.full(rows, n)),
                    pa.array(deviations(part, fit), pa.int64()).take(pa.array(each)),
                    pa.array(((part - mean) @ projection).ravel()),
                    pa.array(np.tile(explained, len(part))),
                    pa.array(np.full(rows, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in OUT.split(", ")])

    return table.mapInArrow(made, OUT)
