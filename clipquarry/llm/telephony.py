"""Telephony audio as a column: WAV bytes in mu-law, A-law or IMA ADPCM, expanded to PCM and resampled.

The two laws are expanded by tables of 256 values. ADPCM blocks are decoded together: step k of all blocks of a
batch is one set of array operations. PCM is resampled by linear interpolation, in windows, into a column of its own, from
which features are read.

Null payloads are stored as empty recordings. Equal payloads give equal media and features. Extra columns stay
where the function keeps the frame's columns; repeated rows are handled one by one. Empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipquarry.llm.shared import pieces

RATE = 8000
RESAMPLED = 16000
BLOCK = 576
FILL = 255
MULAW, ALAW, ADPCM = "mulaw", "alaw", "ima_adpcm"

# Format tags of WAV files, and the step sizes and index moves of IMA ADPCM.
TAGS = {ALAW: 6, MULAW: 7, ADPCM: 17}
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
        118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
        1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
        6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
        32767,
    ],
    np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)

# Payload bytes that are expanded at a time.
WINDOW = BLOCK * 4096

# Media bytes whose PCM is made at a time, unless one file is longer; PCM is up to eight times as large.
PCM_BYTES = 1 << 20


def mulaw_table() -> np.ndarray:
    """The PCM value of each mu-law byte."""
    u = ~np.arange(256) & 0xFF
    size = (((u & 0x0F) << 3) + 132 << ((u & 0x70) >> 4)) - 132
    return np.where(u & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """The PCM value of each A-law byte."""
    a = np.arange(256) ^ 0x55
    part, low = (a & 0x70) >> 4, (a & 0x0F) << 4
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


LAWS = {MULAW: mulaw_table(), ALAW: alaw_table()}


def wav(payload: bytes, codec: str, rate: int = RATE) -> bytes:
    """A mono WAV file that holds the payload's bytes as they are. ADPCM needs whole blocks of `BLOCK` bytes."""
    if codec == ADPCM:
        per_block = (BLOCK - 4) * 2 + 1
        samples = len(payload) // BLOCK * per_block
        form = struct.pack("<HHIIHHHH", TAGS[codec], 1, rate, rate * BLOCK // per_block, BLOCK, 4, 2, per_block)
    else:
        samples = len(payload)
        form = struct.pack("<HHIIHHH", TAGS[codec], 1, rate, rate, 1, 8, 0)
    chunks = [(b"fmt ", form), (b"fact", struct.pack("<I", samples & 0xFFFFFFFF)), (b"data", payload)]
    body = b"WAVE" + b"".join(n + struct.pack("<I", len(c)) + c + b"\0" * (len(c) % 2) for n, c in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parsed(media: bytes) -> tuple[str, int, memoryview]:
    """Codec, rate and payload of a file that `wav` made; other chunks are skipped."""
    view, at, codec, rate = memoryview(media), 12, "", 0
    while at + 8 <= len(view):
        name, size = bytes(view[at : at + 4]), struct.unpack_from("<I", view, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", view, at + 8)
            codec = {t: c for c, t in TAGS.items()}[tag]
        elif name == b"data":
            return codec, rate, view[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def adpcm_decoded(blocks: np.ndarray) -> np.ndarray:
    """(n, samples) PCM of n blocks, each a start value, a start index and two steps a byte, the low half first."""
    n, width = blocks.shape
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    halves = np.empty(((width - 4) * 2, n), np.uint8)
    halves[0::2] = blocks[:, 4:].T & 15
    halves[1::2] = blocks[:, 4:].T >> 4
    out = np.empty((len(halves) + 1, n), np.int16)
    out[0] = value
    for k, half in enumerate(halves, 1):
        step = STEPS[index]
        change = step >> 3
        change += np.where(half & 4, step, 0) + np.where(half & 2, step >> 1, 0) + np.where(half & 1, step >> 2, 0)
        value += np.where(half & 8, -change, change)
        np.clip(value, -32768, 32767, out=value)
        out[k] = value
        index += MOVES[half & 7]
        np.clip(index, 0, len(STEPS) - 1, out=index)
    return out.T


def expanded(codec: str, payload: memoryview) -> Iterator[np.ndarray]:
    """PCM of a payload, window by window."""
    flat = np.frombuffer(payload, np.uint8)
    for at in range(0, len(flat), WINDOW):
        part = flat[at : at + WINDOW]
        yield adpcm_decoded(part.reshape(-1, BLOCK)).ravel() if codec == ADPCM else LAWS[codec][part]


def resampled(windows: Iterable[np.ndarray], rate: int, to: int) -> Iterator[np.ndarray]:
    """The same sound at another rate: output i lies at input i * rate / to, between two samples by a straight line."""
    seen, made, held = 0, 0, np.empty(0, np.int16)
    for window in chain(windows, [None]):
        held = np.concatenate([held, held[-1:] if window is None else window]).astype(np.int64)
        known = seen + len(held) - 1  # inputs before this one have their next one
        stop = -(-known * to // rate) if known > 0 else 0
        place = np.arange(made, stop, dtype=np.int64) * rate
        left, rest = place // to - seen, place % to
        if len(place):
            yield (held[left] + (held[left + 1] - held[left]) * rest // to).astype(np.int16)
        made = max(made, stop)
        if len(held):
            seen, held = seen + len(held) - 1, held[-1:]


def pcm_of(files: list[bytes], to: int = RESAMPLED) -> list[bytes]:
    """Resampled 16-bit PCM of each file. The ADPCM blocks of all small files are decoded together."""
    read = [parsed(f) for f in files]
    small = [i for i, (codec, _, payload) in enumerate(read) if codec == ADPCM and len(payload) <= WINDOW]
    ready = {}
    if small:
        counts = [len(read[i][2]) // BLOCK for i in small]
        blocks = np.frombuffer(b"".join(read[i][2] for i in small), np.uint8).reshape(-1, BLOCK)
        parts = np.split(adpcm_decoded(blocks), np.cumsum(counts)[:-1])
        ready = {i: [part.ravel()] for i, part in zip(small, parts)}
    sounds = (resampled(ready.pop(i, None) or expanded(codec, payload), rate, to) for i, (codec, rate, payload) in enumerate(read))
    return [b"".join(p.astype("<i2").tobytes() for p in sound) for sound in sounds]


def feature_line(codec: str, pcm: bytes, rate: int = RESAMPLED) -> str:
    """Peak, loudness and sign changes of 16-bit PCM, and its checksum."""
    sound = np.frombuffer(pcm, "<i2")
    peak, power, crossings, crc, below = 0, 0, 0, 0, None
    for at in range(0, len(sound), WINDOW):
        part = sound[at : at + WINDOW]
        wide = part.astype(np.int64)
        peak = max(peak, int(np.abs(wide).max()))
        power += int(wide @ wide)
        sign = part < 0
        crossings += int((sign[1:] != sign[:-1]).sum()) + (below is not None and bool(sign[0] != below))
        below = sign[-1]
        crc = zlib.crc32(part.tobytes(), crc)
    loud = (power / len(sound)) ** 0.5 if len(sound) else 0.0
    return f"codec={codec};rate={rate};samples={len(sound)};peak={peak};rms={loud:.3f};crossings={crossings};pcm_crc32={crc:08x}"


def padded(text: Column) -> Column:
    """UTF-8 bytes of a text, null as empty, filled up to a positive multiple of `BLOCK`."""
    raw = F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8")
    size = F.octet_length(raw)
    whole = F.greatest(F.ceil(size / BLOCK), F.lit(1)) * BLOCK
    return F.concat(raw, F.unhex(F.repeat(F.lit(f"{FILL:02X}"), (whole - size).cast("int"))))


def codec_of(payload: Column) -> Column:
    """One of the three codecs, chosen by the payload's checksum, so that equal payloads get the same."""
    return F.element_at(F.array(*[F.lit(c) for c in (MULAW, ALAW, ADPCM)]), (F.crc32(payload) % 3 + 1).cast("int"))


def stored(payload: Column, codec: Column) -> Column:
    """The payload as WAV bytes."""

    @F.pandas_udf("binary")
    def made(payloads: pd.Series, codecs: pd.Series) -> pd.Series:
        return pd.Series([wav(p or b"", c) for p, c in zip(payloads, codecs)], dtype=object)

    return made(payload, codec)


def with_pcm(frame: DataFrame, media: str, name: str = "pcm", to: int = RESAMPLED) -> DataFrame:
    """Add the resampled 16-bit PCM of a media column; null stays null."""

    @F.pandas_udf("binary")
    def made(column: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(column, pa.binary(), from_pandas=True)], names=["media"])
        out = []
        for piece in pieces([batch], "media", PCM_BYTES):
            files = piece.column(0).to_pylist()
            pcm = iter(pcm_of([f for f in files if f is not None], to))
            out += [None if f is None else next(pcm) for f in files]
        return pd.Series(out, dtype=object)

    return frame.withColumn(name, made(media))


STORED = "doc_id bigint, n_bytes bigint, media binary, pcm binary"


def _decoded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "media", PCM_BYTES):
        pcm = pa.array(pcm_of(piece.column("media").to_pylist()), pa.binary())
        yield pa.RecordBatch.from_arrays([*piece.columns, pcm], names=[f.split()[0] for f in STORED.split(", ")])


READ = (
    "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, "
    "media_sha256 string, feature string"
)


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "media", PCM_BYTES):
        rows = []
        for file, pcm in zip(piece.column("media").to_pylist(), piece.column("pcm").to_pylist()):
            codec, _, payload = parsed(file)
            rows.append(
                (
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-32:]),
                    len(file),
                    hashlib.sha256(file).hexdigest(),
                    feature_line(codec, pcm),
                )
            )
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        names = [f.split()[0] for f in READ.split(", ")]
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("n_bytes"), *columns], names=names)


def recordings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media, pcm): each text as a recording, and the resampled PCM read from its stored bytes, to be written
    as a table. Nothing is shuffled."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = docs.select(F.col("doc_id").cast("bigint"), F.octet_length(text).cast("bigint").alias("n_bytes"), padded(text).alias("payload"))
    files = made.select("doc_id", "n_bytes", stored(F.col("payload"), codec_of(F.col("payload"))).alias("media"))
    return files.mapInArrow(_decoded, STORED)


def telephony(docs: DataFrame) -> DataFrame:
    """Store each text as a recording with its PCM, read the stored bytes back and describe them."""
    return recordings(docs).mapInArrow(_read, READ)
