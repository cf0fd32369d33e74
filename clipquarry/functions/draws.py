"""Repeatable uniform draws for (seed, index), row by row on the JVM.

The start state is a polynomial hash of the text `seed::index`, mixed twice. From there the state moves by
x -> a*x + c modulo 2^32. Since k such steps are again one affine step, whose factors are computed here
once, the warm-up and the choice of the k-th draw cost one multiplication per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the generator.
MODULUS = 2**32
TEXT_FACTOR = 31
MIX_FACTORS = (2246822507, 3266489909)
STEP_FACTOR = 1664525
STEP_OFFSET = 1013904223
WARM_UP = 12
SEPARATOR = "::"


def _affine_steps(count: int) -> tuple[int, int]:
    factor, offset = 1, 0
    for _ in range(count):
        factor, offset = factor * STEP_FACTOR % MODULUS, (offset * STEP_FACTOR + STEP_OFFSET) % MODULUS
    return factor, offset


def _times(x: Column, factor: int) -> Column:
    """x * factor modulo 2^32; `factor` is split in halves, since the whole product overflows BIGINT."""
    high, low = divmod(factor, 2**16)
    return F.pmod(F.pmod(x * F.lit(high), F.lit(MODULUS)) * F.lit(2**16) + x * F.lit(low), F.lit(MODULUS))


def _mixed(x: Column, shift: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, shift))


def start_state(seed: Column, index: Column) -> Column:
    text = F.concat(seed.cast("string"), F.lit(SEPARATOR), index.cast("string"))
    hashed = F.aggregate(
        F.sequence(F.lit(1), F.length(text)),
        F.lit(0).cast("bigint"),
        lambda acc, i: F.pmod(acc * F.lit(TEXT_FACTOR) + F.ascii(F.substr(text, i, F.lit(1))), F.lit(MODULUS)),
    )
    mixed = _mixed(_times(_mixed(hashed, 16), MIX_FACTORS[0]), 13)
    return _mixed(_times(mixed, MIX_FACTORS[1]), 16)


def uniform(seed: Column, index: Column, draw: int = 1) -> Column:
    """The `draw`-th uniform number in [0, 1) of (seed, index)."""
    factor, offset = _affine_steps(WARM_UP + draw)
    state = F.pmod(_times(start_state(seed, index), factor) + F.lit(offset), F.lit(MODULUS))
    return state / F.lit(float(MODULUS))
