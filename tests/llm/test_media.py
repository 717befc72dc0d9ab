import hashlib
import math
import struct
import zlib

import numpy as np
import pytest

from tarn.llm import media as m


def test_tables_are_the_published_laws():
    # Code words of G.711 and their samples.
    assert [int(m.MULAW_PCM[x]) for x in (0x00, 0x7F, 0x80, 0xFF, 0x8F)] == [-32124, 0, 32124, 0, 16764]
    assert [int(m.ALAW_PCM[x]) for x in (0xD5, 0x55, 0xAA, 0x2A)] == [8, -8, 32256, -32256]


def scalar_adpcm(block):
    """One block, one nibble at a time, as the format states it."""
    value, index = struct.unpack_from("<hB", block)
    index = min(index, 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(m.IMA_STEPS[index])
            move = step >> 3
            move += step * (code >> 2 & 1) + (step >> 1) * (code >> 1 & 1) + (step >> 2) * (code & 1)
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + int(m.IMA_MOVES[code])))
            out.append(value)
    return out


def test_adpcm_blocks_equal_the_scalar_decoder():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 256, 7 * 36, dtype=np.uint8).tobytes()
    want = [s for i in range(0, len(data), 36) for s in scalar_adpcm(data[i : i + 36])]
    assert m.decode_adpcm(data, 36).tolist() == want
    short = m.decode_adpcm(data[:-10], 36)
    assert short.tolist() == want[: len(short)] and len(short) == len(want) - 20
    assert m.decode_adpcm(b"", 36).size == 0
    rate, pcm = m.decode(m.wav(data, m.ADPCM, 8000, 36))
    assert rate == 8000 and pcm.tolist() == want
    with pytest.raises(ValueError):
        m.decode_adpcm(b"xx", 3)


def test_resampling():
    tone = (1000 * np.sin(np.arange(800) * 2 * math.pi * 100 / 8000)).astype(np.int16)
    up = m.resample(tone, 8000, 16000)
    assert up.size == 1600 and (up[::2] == tone).all() and up[1] == (int(tone[0]) + int(tone[1])) >> 1
    assert m.resample(tone, 8000, 8000).tolist() == tone.tolist() and abs(m.resample(tone, 8000, 11025).size - 1102) <= 1
    assert m.resample(tone[:0], 8000, 16000).size == 0
    rate, pcm = m.decode(m.to_pcm(m.wav(bytes(range(256)))))
    assert rate == 16000 and (pcm[::2] == m.MULAW_PCM).all()


def test_containers():
    for tag in (m.MULAW, m.ALAW):
        got = m.read_wav(m.wav(b"abc", tag))
        assert got == (tag, 8000, 1, b"abc")
    for bad in (b"", b"RIFFxxxxWAVE", b"nonsense" * 9):
        with pytest.raises(ValueError):
            m.read_wav(bad)


def by_hand(payload, tag):
    """The file and the signal at 16 kHz, sample by sample, from the formats' definitions."""
    if tag == 17:
        fmt = struct.pack("<HHIIHHHH", 17, 1, 8000, 8000 * 64 // 121, 64, 4, 2, 121)
        pcm = [x for i in range(0, len(payload), 64) for x in scalar_adpcm(payload[i : i + 64])]
    else:
        fmt = struct.pack("<HHIIHHH", tag, 1, 8000, 8000, 1, 8, 0)
        pcm = [scalar_law(x, tag) for x in payload]
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(pcm)) + b"data" + struct.pack("<I", len(payload)) + payload
    signal = [y for a, b in zip(pcm, [*pcm[1:], pcm[-1]]) for y in (a, (a + b) >> 1)]
    return b"RIFF" + struct.pack("<I", len(body)) + body, signal


def scalar_law(x, tag):
    if tag == 7:
        x ^= 255
        size = (((x & 15) * 8 + 132) << (x >> 4 & 7)) - 132
        return -size if x & 128 else size
    x ^= 0x55
    e, f = x >> 4 & 7, x & 15
    size = f * 16 + 8 if e == 0 else (f * 16 + 264) << (e - 1)
    return size if x & 128 else -size


def described(signal):
    rms = math.sqrt(sum(x * x for x in signal) / len(signal))
    turns = sum((a < 0) != (b < 0) for a, b in zip(signal, signal[1:]))
    return f"rate=16000;samples={len(signal)};seconds={len(signal) / 16000:.4f};rms={rms:.3f};peak={max(map(abs, signal))};crossings={turns};pcm_crc={zlib.crc32(struct.pack(f'<{len(signal)}h', *signal)):08x}"


def test_lower_rates_do_not_alias():
    """A tone above the new rate's reach goes, one below it stays."""
    tone = lambda f: (8000 * np.sin(np.arange(8000) * 2 * math.pi * f / 8000)).astype(np.int16)
    level = lambda x: float(np.sqrt(np.mean(x[200:-200].astype(float) ** 2)))
    assert level(m.resample(tone(3500), 8000, 4000)) < 60 and level(m.resample(tone(500), 8000, 4000)) > 5500


def test_digests_against_plain_python(spark):
    rows = [(1, "hello", "x"), (2, None, "x"), (3, "", None), (4, "é" * 64, "x"), (5, "y" * 64, "x"), (6, "long " * 6000, "x"), *[(i, f"text {i}", "x") for i in range(20, 40)], (1, "hello", "x"), (None, "z", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, feature string")
    got = m.media_digests(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, _ in rows if i == r["doc_id"])
        raw = (text or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored, signal = by_hand(padded, r["codec"])
        assert r["codec"] == {0: 7, 1: 6, 2: 17}[zlib.crc32(padded) % 3]
        assert r["media_bytes"] == len(stored) and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
        assert r["feature"] == described(signal)
    assert {r["codec"] for r in got} == {6, 7, 17}
    assert m.media_digests(df.limit(0)).count() == 0
    assert [m.decode(m.to_pcm(m.store(b"a" * 128, t)))[1].size for t in (m.MULAW, m.ALAW, m.ADPCM)] == [256, 256, 484]


def test_columns_hold_files(spark):
    df = spark.createDataFrame([(1, b"abc", "keep"), (2, None, None)], "id long, raw binary, media string")
    stored = m.store_media(df, "raw")
    assert stored.columns == ["id", "raw", "media"]
    got = {r["id"]: m.read_wav(bytes(r["media"]))[3] for r in stored.collect()}
    assert got == {1: b"abc", 2: b""}
    pcm = m.decoded_pcm(stored.select("id", "media"))
    assert {r["id"]: m.decode(bytes(r["pcm"]))[1].size for r in pcm.collect()} == {1: 6, 2: 0}
