import hashlib
import zlib

import numpy as np
import pytest
from conftest_llm import frame
from pyspark.sql import functions as F

from clipquarry.llm import telephony as tel


def test_payloads_come_back(spark, odd, rows):
    found = tel.telephony(odd).collect()
    assert len(found) == len(rows)
    want = {}
    for doc_id, text in rows:
        raw = (text or "").encode()
        full = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        row = (doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        want[row] = want.get(row, 0) + 1
    got = {}
    for r in found:
        key = tuple(r)[:5]
        got[key] = got.get(key, 0) + 1
        assert r.media_bytes > r.payload_bytes and r.feature.startswith("codec=")
    assert got == want
    by_payload = {}
    for r in found:
        mine = (r.media_bytes, r.media_sha256, r.feature)
        assert by_payload.setdefault(r.payload_sha256, mine) == mine
    assert {r.feature.split(";")[0] for r in found} == {"codec=mulaw", "codec=alaw", "codec=ima_adpcm"}


def test_law_tables():
    """Reference points of both laws: extremes, zeros and signs."""
    mu, a = tel.LAWS[tel.MULAW], tel.LAWS[tel.ALAW]
    assert (mu[0x00], mu[0x80], mu[0xFF], mu[0x7F]) == (-32124, 32124, 0, 0)
    assert (a[0x2A], a[0xAA], a[0xD5], a[0x55]) == (-32256, 32256, 8, -8)
    assert len(set(a.tolist())) == 256 and len(set(mu.tolist())) == 255


def plain_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for half in (byte & 15, byte >> 4):
            step = int(tel.STEPS[index])
            change = (step >> 3) + (step if half & 4 else 0) + (step >> 1 if half & 2 else 0) + (step >> 2 if half & 1 else 0)
            value = max(-32768, min(32767, value - change if half & 8 else value + change))
            index = max(0, min(88, index + (-1, -1, -1, -1, 2, 4, 6, 8)[half & 7]))
            out.append(value)
    return out


def test_adpcm_blocks_like_one_by_one():
    blocks = np.random.default_rng(1).integers(0, 256, (7, 576)).astype(np.uint8)
    assert tel.adpcm_decoded(blocks).tolist() == [plain_adpcm(bytes(b)) for b in blocks]


@pytest.mark.parametrize("to", [8000, 16000, 11025, 4000])
def test_resampling_in_windows(to):
    x = np.random.default_rng(2).integers(-32768, 32768, 5000).astype(np.int16)
    whole = np.concatenate(list(tel.resampled([x], 8000, to)))
    parts = np.concatenate(list(tel.resampled([x[:1], x[1:700], x[700:701], x[701:]], 8000, to)))
    assert (whole == parts).all()
    place = np.arange(len(whole)) * 8000
    y = np.r_[x, x[-1]].astype(int)
    assert (whole == y[place // to] + (y[place // to + 1] - y[place // to]) * (place % to) // to).all()
    assert len(whole) == -(-len(x) * to // 8000)


def test_stored_media_and_pcm(spark):
    df = frame(spark, [(1, "abc"), (2, None)]).withColumn("payload", tel.padded(F.col("text")))
    df = df.withColumn("media", tel.stored(F.col("payload"), F.lit(tel.MULAW)))
    for r in tel.with_pcm(df, "media").collect():
        codec, rate, payload = tel.parsed(r.media)
        assert (codec, rate, bytes(payload)) == (tel.MULAW, 8000, bytes(r.payload))
        pcm = np.frombuffer(r.pcm, "<i2")
        assert len(pcm) == 2 * len(r.payload) and (pcm[::2] == tel.LAWS[tel.MULAW][np.frombuffer(r.payload, np.uint8)]).all()


def test_empty_table(none):
    assert tel.telephony(none).count() == 0


def _features(codec, payload):
    """Sample by sample, with no arrays: expansion, every second sample the middle of its neighbours, and the figures of the result."""
    if codec == "ima_adpcm":
        pcm = []
        for at in range(0, len(payload), 576):
            block = payload[at : at + 576]
            value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
            pcm.append(value)
            for half in (h for b in block[4:] for h in (b & 15, b >> 4)):
                step = int(tel.STEPS[index])
                change = (step >> 3) + (step if half & 4 else 0) + (step >> 1 if half & 2 else 0) + (step >> 2 if half & 1 else 0)
                value = max(-32768, min(32767, value - change if half & 8 else value + change))
                pcm.append(value)
                index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][half & 7]))
    else:
        pcm = []
        for b in payload:
            if codec == "mulaw":
                b ^= 255
                size = ((((b & 15) << 3) + 132) << ((b >> 4) & 7)) - 132
                pcm.append(-size if b & 128 else size)
            else:
                b ^= 0x55
                part, low = (b >> 4) & 7, ((b & 15) << 4) + 8
                size = low if not part else (low + 256) << (part - 1)
                pcm.append(size if b & 128 else -size)
    out = []
    for a, b in zip(pcm, [*pcm[1:], pcm[-1]]):
        out += [a, a + (b - a) // 2]
    crossings = sum((a < 0) != (b < 0) for a, b in zip(out, out[1:]))
    loud = (sum(x * x for x in out) / len(out)) ** 0.5
    crc = zlib.crc32(b"".join(x.to_bytes(2, "little", signed=True) for x in out))
    peak = max(abs(x) for x in out)
    return f"codec={codec};rate=16000;samples={len(out)};peak={peak};rms={loud:.3f};crossings={crossings};pcm_crc32={crc:08x}", out


def test_features_sample_by_sample(odd):
    """Features are those of the stored PCM, which is that of a plain decoder."""
    stored = {(r.doc_id, r.media): r.pcm for r in tel.recordings(odd).collect()}
    lines = {r.media_sha256: r.feature for r in tel.telephony(odd).collect()}
    codecs = set()
    for (_, media), pcm in stored.items():
        codec, _, payload = tel.parsed(bytes(media))
        line, sound = _features(codec, bytes(payload))
        assert lines[hashlib.sha256(media).hexdigest()] == line
        assert bytes(pcm) == b"".join(x.to_bytes(2, "little", signed=True) for x in sound)
        codecs.add(codec)
    assert codecs == {tel.MULAW, tel.ALAW, tel.ADPCM}
