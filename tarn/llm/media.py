"""Telephony audio: mu-law, A-law and IMA ADPCM in WAV containers, decoded to resampled PCM.

The G.711 laws are expanded by 256-entry lookup tables built from their formulas. IMA ADPCM blocks
carry their own predictor, so numpy decodes all blocks of a file side by side, one sample step at a
time. Every function works on one file in memory; the Spark operators are narrow (no shuffle): ``store_media``
puts payloads into files, ``decoded_pcm`` files into resampled PCM files, ``describe_pcm`` tells what is in them.

A table of media holds several codecs. ``codec_of`` gives a payload mu-law, A-law or ADPCM by its CRC, so that
the registered query stores, reads and decodes all three; the bytes of the payload are the file's samples.

Defined results: a null payload counts as empty; an empty payload still gives one positive multiple
of 64 bytes; equal payloads give equal files and features; a null key stays; extra input columns pass through
under their own names unless they clash with an output column, which then wins.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stage, utf8

RATE = 8000
OUT_RATE = 16000
UNIT = 64
MULAW, ALAW, ADPCM = 7, 6, 17

# The step sizes and index moves of the IMA ADPCM format.
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    dtype=np.int32,
)
IMA_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)


def _mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.uint8)
    size = ((((u & 15).astype(np.int32) << 3) + 132) << ((u >> 4) & 7)) - 132
    return np.where(u & 128, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, mantissa = ((a >> 4) & 7).astype(np.int32), (a & 15).astype(np.int32)
    size = np.where(exponent == 0, (mantissa << 4) + 8, ((mantissa << 4) + 264) << np.maximum(exponent - 1, 0))
    return np.where(a & 128, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = _mulaw_table(), _alaw_table()


def wav(data: bytes, tag: int = MULAW, rate: int = RATE, block: int = 1, samples: int | None = None) -> bytes:
    """A RIFF file of 8-bit law samples, or of ADPCM blocks of ``block`` bytes."""
    if tag == ADPCM:
        per = 2 * (block - 4) + 1
        fmt = struct.pack("<HHIIHHHH", tag, 1, rate, rate * block // per, block, 4, 2, per)
    elif tag == 1:
        fmt = struct.pack("<HHIIHH", 1, 1, rate, rate * 2, 2, 16)
    else:
        fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
    count = len(data) if samples is None else samples
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt
    if tag != 1:
        body += b"fact" + struct.pack("<II", 4, count)
    body += b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format tag, rate, block size, data) of a RIFF file; chunks are walked, not assumed."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, tag, rate, block = 12, 0, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate, _, block = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            return tag, rate, block, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def decode_adpcm(data: bytes, block: int) -> np.ndarray:
    """IMA ADPCM to PCM; a last short block is padded for the walk and cut afterwards."""
    if block < 4:
        raise ValueError("an ADPCM block holds a 4-byte header at least")
    if not data:
        return np.empty(0, np.int16)
    n = -(-len(data) // block)
    whole = np.frombuffer(data.ljust(n * block, b"\0"), np.uint8).reshape(n, block)
    value = whole[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(whole[:, 2], 88).astype(np.int32)
    nibbles = np.empty((n, 2 * (block - 4)), np.uint8)
    nibbles[:, 0::2], nibbles[:, 1::2] = whole[:, 4:] & 15, whole[:, 4:] >> 4
    out = np.empty((n, nibbles.shape[1] + 1), np.int16)
    out[:, 0] = value
    for i in range(nibbles.shape[1]):
        code, step = nibbles[:, i], IMA_STEPS[index]
        move = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(value + np.where(code & 8, -move, move), -32768, 32767)
        index = np.clip(index + IMA_MOVES[code], 0, 88)
        out[:, i + 1] = value
    lost = n * block - len(data)
    flat = out.reshape(-1)
    return flat[: max(0, flat.size - 2 * lost)] if lost else flat


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit samples) of a stored file."""
    tag, rate, block, data = read_wav(media)
    if tag in (MULAW, ALAW):
        return rate, (MULAW_PCM if tag == MULAW else ALAW_PCM)[np.frombuffer(data, np.uint8)]
    if tag == ADPCM:
        return rate, decode_adpcm(data, block)
    if tag == 1:
        return rate, np.frombuffer(data, "<i2")
    raise ValueError(f"format tag {tag} is not a telephony codec")


def decode_many(files: list[bytes]) -> list[tuple[int, np.ndarray]]:
    """``decode`` of each file; the ADPCM blocks of all files of a block size go side by side."""
    read = [read_wav(f) for f in files]
    together: dict[int, list[int]] = {}
    for i, (tag, _, block, data) in enumerate(read):
        if tag == ADPCM and block >= 4 and data and len(data) % block == 0:
            together.setdefault(block, []).append(i)
    out: dict[int, np.ndarray] = {}
    for block, at in together.items():
        pcm = decode_adpcm(b"".join(read[i][3] for i in at), block)
        ends = np.cumsum([len(read[i][3]) // block * (2 * (block - 4) + 1) for i in at])
        out.update(zip(at, np.split(pcm, ends[:-1])))
    return [(read[i][1], out[i]) if i in out else decode(f) for i, f in enumerate(files)]


def low_pass(pcm: np.ndarray, share: float, reach: int = 8) -> np.ndarray:
    """Keep frequencies below ``share`` of the highest: a Hann-windowed sinc, ``reach`` zero crossings a side."""
    half = math.ceil(reach / share)
    at = np.arange(-half, half + 1)
    taps = np.sinc(at * share) * (0.5 + 0.5 * np.cos(np.pi * at / (half + 1)))
    return np.convolve(np.pad(pcm.astype(np.float64), half, "edge"), taps / taps.sum(), "valid")


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation, to a lower rate behind a low-pass filter; doubling the rate stays in integers."""
    if rate == to or not pcm.size:
        return pcm.astype(np.int16)
    if to == 2 * rate:
        out = np.empty(2 * pcm.size, np.int16)
        out[0::2] = pcm
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    signal = low_pass(pcm, to / rate) if to < rate else pcm
    at = np.arange(pcm.size * to // rate) * (rate / to)
    return np.clip(np.round(np.interp(at, np.arange(pcm.size), signal)), -32768, 32767).astype(np.int16)


def to_pcm(media: bytes, to: int = OUT_RATE) -> bytes:
    """The stored form of the decoded signal: 16-bit PCM at ``to`` samples a second in a WAV file."""
    return to_pcm_many([media], to)[0]


def to_pcm_many(files: list[bytes], to: int = OUT_RATE) -> list[bytes]:
    return [wav(resample(pcm, rate, to).astype("<i2").tobytes(), 1, to) for rate, pcm in decode_many(files)]


def features(media: bytes) -> str:
    """Samples, seconds, level, peak and sign changes of a file's signal, and a check of it."""
    to, pcm = decode(media)
    wide = pcm.astype(np.int64)
    level = float(np.sqrt(np.mean(wide * wide))) if pcm.size else 0.0
    crossings = int(np.count_nonzero(np.diff(np.signbit(pcm)))) if pcm.size else 0
    peak = int(np.abs(wide).max()) if pcm.size else 0
    return f"rate={to};samples={pcm.size};seconds={pcm.size / to:.4f};rms={level:.3f};peak={peak};crossings={crossings};pcm_crc={zlib.crc32(pcm.tobytes()):08x}"


def payload_of(text: bytes) -> bytes:
    """The text's bytes and zeros up to a positive multiple of 64."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def codec_of(payload: bytes) -> int:
    """The format tag that a payload is stored under."""
    return (MULAW, ALAW, ADPCM)[zlib.crc32(payload) % 3]


def store(payload: bytes, tag: int) -> bytes:
    """A payload as a file; ADPCM blocks have ``UNIT`` bytes."""
    block = UNIT if tag == ADPCM else 1
    return wav(payload, tag, block=block, samples=len(payload) // UNIT * (2 * (UNIT - 4) + 1) if tag == ADPCM else None)


def store_media(df: DataFrame, payload: str, out: str = "media", tag: int | None = MULAW) -> DataFrame:
    """Add ``out``: the binary column ``payload`` as a lossless telephony file (null: empty); without a tag by ``codec_of``."""
    return _map(df, payload, out, lambda some: [store(b or b"", codec_of(b or b"") if tag is None else tag) for b in some])


def decoded_pcm(df: DataFrame, media: str = "media", out: str = "pcm", rate: int = OUT_RATE) -> DataFrame:
    """Add ``out``: each stored file decoded and resampled, as a PCM WAV file; null stays null."""

    def made(some):
        got = iter(to_pcm_many([b for b in some if b], rate))
        return [next(got) if b else None for b in some]

    return _map(df, media, out, made)


def _map(df: DataFrame, source: str, out: str, fn) -> DataFrame:
    rest = [c for c in df.columns if c != out]
    schema = T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.BinaryType())])

    def run(batches):
        for batch in slices(batches, source, 2 << 20):
            keep = batch.select(rest)
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(fn(batch.column(source).to_pylist()), pa.binary())], names=[*rest, out])

    return df.mapInArrow(run, schema)


def payloads(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, payload): each text's bytes, padded."""
    raw = utf8(docs[text])
    n = F.octet_length(raw)
    zeros = F.greatest(F.lit(UNIT), F.ceil(n / UNIT) * UNIT).cast("int") - n
    return docs.select(docs[key].alias("k"), n.cast("long").alias("n_bytes"), F.concat(raw, F.to_binary(F.repeat(F.lit("00"), zeros), F.lit("hex"))).alias("payload"))


def describe_pcm(df: DataFrame, media: str = "media", pcm: str = "pcm", key: str = "k") -> DataFrame:
    """(key, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, codec), read from the files."""
    schema = f"`{key}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec int"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
    names = [key, *[x.split()[0] for x in schema.split(", ")[1:]]]

    def run(batches):
        for batch in slices(batches, pcm):
            rows = []
            for k, n, stored, signal in zip(*[batch.column(c).to_pylist() for c in (key, "n_bytes", media, pcm)]):
                tag, _, _, data = read_wav(stored)
                rows.append((k, n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), features(signal), tag))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return df.select(key, "n_bytes", media, pcm).mapInArrow(run, schema)


def media_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", tag: int | None = None) -> DataFrame:
    """Store each text's payload as telephony audio in the shared folder, read the files back, decode and describe them."""
    stored = stage(store_media(payloads(docs, key, text), "payload", "media", tag).select("k", "n_bytes", "media"), "media")
    return describe_pcm(decoded_pcm(stored)).withColumnRenamed("k", key)
