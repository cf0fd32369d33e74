"""64-bit perceptual hash of gray frames and match verdict.

The hash keeps the 8x8 low-frequency corner of the cosine transform of a 32x32 gray frame. A bit is set
where a coefficient exceeds the middle of the 63 coefficients other than the first, so a change of
brightness alone leaves the hash as it is.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Ship the hash with the query, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the hash and of the match bands.
FRAME_SIDE = 32
FRAME_SIZE = FRAME_SIDE * FRAME_SIDE
CORNER = 8
MATCH_MAX = 10
BORDERLINE_MAX = 20
MATCH = "would still match"
BORDERLINE = "borderline"
DISTINCT = "likely distinct"
DETAILS = {
    MATCH: "A dedup system would very likely treat this as the same video.",
    BORDERLINE: "Close enough that a match is plausible.",
    DISTINCT: "Far enough apart that a perceptual match is unlikely.",
}

# Frames transformed at once, which bounds the memory of a worker whatever the batch size.
HASH_BLOCK = 1024


def cosine_basis() -> np.ndarray:
    """Row u holds the samples of the u-th cosine over the frame side."""
    u, x = np.ogrid[:CORNER, :FRAME_SIDE]
    return np.cos((2 * x + 1) * u * np.pi / (2 * FRAME_SIDE))


def hash_frames(gray: np.ndarray) -> np.ndarray:
    """Signed 64-bit hashes of n frames given as an (n, 1024) array.

    Both transform passes add their 32 terms one after the other for the whole batch, so a flat frame,
    whose coefficients are rounding noise, hashes the same in every batch.
    """
    basis = cosine_basis()
    grid = gray.reshape(-1, FRAME_SIDE, FRAME_SIDE).astype(np.float64)
    across = sum(grid[:, :, x, None] * basis[:, x] for x in range(FRAME_SIDE))
    corner = sum(across[:, y, None, :] * basis[:, y][:, None] for y in range(FRAME_SIDE))
    coefs = corner.reshape(len(grid), CORNER * CORNER)
    ranked = np.sort(coefs[:, 1:], axis=1)
    middle = (ranked[:, 30] + ranked[:, 31]) / 2
    bits = np.packbits(coefs > middle[:, None], axis=1)
    return np.ascontiguousarray(bits).view(">i8").ravel().astype(np.int64)


def _hashed(frames: pa.Array) -> pa.Array:
    """Hashes of a block of frames. A block is all that is held in a second form, whatever the size of a batch."""
    whole = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(frames), FRAME_SIZE), False))
    pixels = frames.filter(pa.array(whole)).flatten()
    gray = np.asarray(pc.fill_null(pixels, 0)).reshape(-1, FRAME_SIZE)
    known = np.asarray(pixels.is_valid()).reshape(-1, FRAME_SIZE).all(axis=1)
    hashed = np.zeros(len(frames), dtype=np.int64)
    hashed[whole] = hash_frames(gray) if len(gray) else 0
    whole[whole] = known
    return pa.array(hashed, mask=~whole)


@F.arrow_udf(LongType())
def phash64(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Hash of a row-major 32x32 gray frame; null for a frame of any other size or with missing values."""
    for batch in batches:
        parts = [_hashed(batch.slice(i, HASH_BLOCK)) for i in range(0, len(batch), HASH_BLOCK)]
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.int64())


def match_verdict(mean_distance: Column) -> Column:
    """Band of an unrounded mean distance."""
    return (
        F.when(mean_distance <= MATCH_MAX, F.lit(MATCH))
        .when(mean_distance <= BORDERLINE_MAX, F.lit(BORDERLINE))
        .when(mean_distance.isNotNull(), F.lit(DISTINCT))
    )


def verdict_detail(verdict: Column) -> Column:
    """What a verdict means, in words."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in DETAILS.items() for x in pair]), verdict)
