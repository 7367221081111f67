"""Telephony audio columns: mu-law and A-law by lookup table, IMA ADPCM blocks, resampled PCM.

A media value is a WAV file in a binary column.  Format 7 (mu-law) and 6 (A-law) hold one byte a sample and
format 17 holds IMA ADPCM blocks; format 1 holds 16-bit PCM.  Spark deals the rows; within an Arrow batch numpy
decodes all blocks of a value together, one sample step for every block at once.

Defined cases: a null text is the empty text, whose payload is 64 zero bytes; equal texts give equal values;
repeated rows are handled each on its own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import id_and_text, parts_of

PCM, ALAW, MULAW, IMA = 1, 6, 7, 17
RATE = 8000
PAD = 64
#: Payloads are decoded so many bytes at a time, a value at least.
PART_BYTES = 2 << 20

# Fixed values of the IMA ADPCM format: step sizes, and the index's change by the code's magnitude.
IMA_STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97,
        107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796,
        876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428,
        4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350,
        22385, 24623, 27086, 29794, 32767,
    ],
    dtype=np.int64,
)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int64)


def mulaw_table() -> np.ndarray:
    """16-bit sample of each mu-law byte: complement, sign, 3-bit exponent, 4-bit mantissa, bias 132."""
    code = ~np.arange(256) & 0xFF
    size = (((code & 15) << 3) + 132 << (code >> 4 & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """16-bit sample of each A-law byte: even bits inverted, segment 0 is linear."""
    code = np.arange(256) ^ 0x55
    mantissa, segment = code & 15, code >> 4 & 7
    size = np.where(segment == 0, (mantissa << 4) + 8, (mantissa << 4) + 264 << np.maximum(segment, 1) - 1)
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW_PCM, ALAW_PCM = mulaw_table(), alaw_table()


def wav(kind: int, data: bytes, rate: int = RATE, block: int = 1, bits: int = 8, samples_per_block: int = 0) -> bytes:
    extra = struct.pack("<HH", 2, samples_per_block) if kind == IMA else b"" if kind == PCM else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", kind, 1, rate, rate * block * 8 // 8 if kind != IMA else rate * block // samples_per_block, block, bits) + extra
    fact = b"" if kind == PCM else b"fact" + struct.pack("<II", 4, len(data) if kind != IMA else len(data) // block * samples_per_block)
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def parse_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """(format, rate, block bytes, data) from the stored chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV value")
    at, kind, rate, block = 12, 0, 0, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            kind, _, rate, _, block = struct.unpack_from("<HHIIH", media, at + 8)
        elif name == b"data":
            return kind, rate, block, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


def decode_ima(data: bytes, block: int) -> np.ndarray:
    """All blocks side by side: the loop runs over a block's samples, numpy over the blocks.

    A block is a 4-byte head (first sample, step index) and two codes a byte, low half first.
    """
    count = len(data) // block
    if not count:
        return np.empty(0, np.int16)
    raw = np.frombuffer(data, np.uint8, count * block).reshape(count, block)
    sample = raw[:, :2].copy().view("<i2").ravel().astype(np.int64)
    index = np.minimum(raw[:, 2].astype(np.int64), 88)
    out = np.empty((count, (block - 4) * 2 + 1), np.int16)
    out[:, 0] = sample
    for k in range((block - 4) * 2):
        code = (raw[:, 4 + k // 2] >> (4 * (k & 1)) & 15).astype(np.int64)
        step = IMA_STEPS[index]
        change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        sample = np.clip(sample + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[code & 7], 0, 88)
        out[:, k + 1] = sample
    return out.ravel()


def encode_ima(pcm: np.ndarray, block: int = 36) -> bytes:
    """The encoder that mirrors decode_ima; the last block is padded with its last sample."""
    per = (block - 4) * 2 + 1
    if not len(pcm):
        return b""
    count = -(-len(pcm) // per)
    grid = np.concatenate([pcm, np.full(count * per - len(pcm), pcm[-1])]).reshape(count, per).astype(np.int64)
    out = np.zeros((count, block), np.uint8)
    # each block starts at the step nearest its own mean change, so that blocks do not wait for each other
    sample = grid[:, 0].copy()
    index = np.minimum(np.searchsorted(IMA_STEPS, np.abs(np.diff(grid, axis=1)).mean(axis=1).astype(np.int64)), 88)
    out[:, :2] = sample.astype("<i2").view(np.uint8).reshape(count, 2)
    out[:, 2] = index
    for k in range(per - 1):
        step, gap = IMA_STEPS[index], grid[:, k + 1] - sample
        code = np.where(gap < 0, 8, 0)
        rest, change = np.abs(gap), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            take = rest >= part
            code |= np.where(take, bit, 0)
            rest = rest - np.where(take, part, 0)
            change = change + np.where(take, part, 0)
        sample = np.clip(sample + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[code & 7], 0, 88)
        out[:, 4 + k // 2] |= (code << 4 * (k & 1)).astype(np.uint8)
    return out.tobytes()


def decode(media: bytes) -> tuple[int, np.ndarray]:
    kind, rate, block, data = parse_wav(media)
    if kind == MULAW:
        return rate, MULAW_PCM[np.frombuffer(data, np.uint8)]
    if kind == ALAW:
        return rate, ALAW_PCM[np.frombuffer(data, np.uint8)]
    if kind == IMA:
        return rate, decode_ima(data, block)
    if kind == PCM:
        return rate, np.frombuffer(data, "<i2", len(data) // 2)
    raise ValueError(f"format {kind}")


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation at the new instants, in integers so that results are the same everywhere."""
    n = len(pcm) * to // rate
    if not n:
        return np.empty(0, np.int16)
    at = np.arange(n, dtype=np.int64) * rate
    low = at // to
    high = np.minimum(low + 1, len(pcm) - 1)
    part = at - low * to
    x = pcm.astype(np.int64)
    return ((x[low] * (to - part) + x[high] * part) // to).astype(np.int16)


def feature(pcm: np.ndarray, wide: np.ndarray, alaw: np.ndarray, ima: np.ndarray) -> str:
    """Level, peak and zero crossings of the samples, and checksums of the resampled PCM and of the payload as A-law and as ADPCM; integers only."""
    x = pcm.astype(np.int64)
    level = int((x * x).sum()) // max(1, len(x))
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    sums = ";".join(f"{name}={zlib.crc32(v.astype('<i2').tobytes())}" for name, v in (("pcm16k", wide), ("alaw", alaw), ("ima", ima)))
    return f"n={len(x)};power={level};peak={int(np.abs(x).max(initial=0))};zc={crossings};{sums}"


def store_payload(text: str | None) -> tuple[int, bytes]:
    """The text's bytes, padded with zeros to a positive multiple of 64, as the samples of a mu-law file."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), wav(MULAW, raw + b"\0" * (-len(raw) % PAD or (0 if raw else PAD)))


def media_columns(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): every whole text stored as one mu-law value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                stored = [store_payload(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([n for n, _ in stored], pa.int64()), pa.array([m for _, m in stored], pa.binary())],
                    ["doc_id", "n_bytes", "media"],
                )

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def decoded_pcm(media: DataFrame, rate: int = 16_000, media_col: str = "media") -> DataFrame:
    """Adds pcm: each value decoded, resampled to the rate and stored as 16-bit PCM WAV; null stays null."""
    schema = T.StructType([*media.schema.fields, T.StructField("pcm", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                out = []
                for m in part.column(part.schema.get_field_index(media_col)).to_pylist():
                    if m is None:
                        out.append(None)
                        continue
                    had, pcm = decode(m)
                    out.append(wav(PCM, resample(pcm, had, rate).astype("<i2").tobytes(), rate, 2, 16))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], [*part.schema.names, "pcm"])

    return media.mapInArrow(run, schema)


def media_digest(media: DataFrame) -> DataFrame:
    """Reads the stored values back: sizes, hashes and features; media: doc_id, n_bytes, media, pcm.

    The payload's bytes are samples of whatever format is asked for, so the feature takes them as mu-law (as stored),
    as A-law and as ADPCM blocks of PAD bytes; the blocks of all values of a slice are decoded side by side.
    """
    schema = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string"
    )
    per = (PAD - 4) * 2 + 1

    def digest(part: pa.RecordBatch) -> pa.RecordBatch:
        doc_ids, sizes, stored, wide = (part.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media", "pcm"))
        payloads = [parse_wav(m)[3] for m in stored]
        blocks = np.concatenate([[0], np.cumsum([len(p) // PAD for p in payloads])])
        samples = np.frombuffer(b"".join(payloads), np.uint8)
        mulaw, alaw, ima = MULAW_PCM[samples], ALAW_PCM[samples], decode_ima(samples.tobytes(), PAD)
        rows = []
        for k, (doc_id, n, m, w, p) in enumerate(zip(doc_ids, sizes, stored, wide, payloads, strict=True)):
            i, j = int(blocks[k]), int(blocks[k + 1])
            told = feature(mulaw[i * PAD : j * PAD], decode(w)[1], alaw[i * PAD : j * PAD], ima[i * per : j * per])
            rows.append((doc_id, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-PAD:]), len(m), hashlib.sha256(m).hexdigest(), told))
        columns = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = [pa.int64()] * 3 + [pa.string()] + [pa.int64()] * 2 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in parts_of(b, b.column("n_bytes").to_numpy(zero_copy_only=False) + PAD, PART_BYTES):
                yield digest(part)

    return media.select("doc_id", "n_bytes", "media", "pcm").mapInArrow(run, schema)
