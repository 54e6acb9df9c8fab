"""Telephony audio columns: G.711 mu-law and A-law by lookup tables, ADPCM with numpy across blocks, resampled PCM.

Samples are stored as WAV files in a binary column. Decoding gives 16-bit PCM; ADPCM blocks (IMA, mono) are
independent, so that all blocks of a file take each of their steps at once. PCM is resampled linearly.

The query stores each text as mu-law and, from that file, as resampled PCM; it also reads the payload as A-law codes and as
ADPCM blocks of ``BLOCK`` bytes, the blocks of many texts at once.

Null text is empty. Rows are kept one for one, with null or repeated ids as they are; equal texts give equal values.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import own_names, python_rows, table
from .textkernel import as_bytes, chunks

#: WAV format tags.
PCM, ALAW, MULAW, IMA = 1, 6, 7, 0x11
RATE, UNIT, PAD = 8000, 576, b"\xff"
#: Bytes of an ADPCM block that a payload is read as; UNIT is a multiple.
BLOCK = 36


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    value = (((code & 0x0F) << 3) + 0x84) << ((code & 0x70) >> 4)
    return np.where(code & 0x80, 0x84 - value, value - 0x84).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment = (code & 0x70) >> 4
    value = ((code & 0x0F) << 4) + 8
    value = np.where(segment > 0, (value + 0x100) << np.maximum(segment - 1, 0), value)
    return np.where(code & 0x80, value, -value).astype(np.int16)


def _steps() -> np.ndarray:
    """IMA's 89 quantiser steps.

    Fixed values.
    """
    return np.array(
        [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209,
         230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749,
         3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623,
         27086, 29794, 32767]
    )


MULAW_PCM, ALAW_PCM, STEPS = _mulaw_table(), _alaw_table(), _steps()
#: How the step's index moves by the code's low three bits.
INDEX_MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)


def encode_g711(pcm: np.ndarray, lookup: np.ndarray) -> np.ndarray:
    """The code of the nearest value; of equal values the least code."""
    order = np.argsort(lookup, kind="stable")
    values = lookup[order].astype(np.int32)
    at = np.searchsorted(values, pcm.astype(np.int32))
    hi, lo = np.minimum(at, 255), np.maximum(at - 1, 0)
    near = np.where(np.abs(values[hi] - pcm) < np.abs(pcm - values[lo]), hi, lo)
    return order[np.searchsorted(values, values[near])].astype(np.uint8)


def _ima_step(predictor, index, code):
    step = STEPS[index]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    predictor = np.clip(predictor + np.where(code & 8, -change, change), -32768, 32767)
    return predictor, np.clip(index + INDEX_MOVES[code], 0, 88)


def decode_ima(data: bytes, block: int) -> np.ndarray:
    """Mono blocks: predictor (int16), step index, zero, then two samples a byte, low nibble first. A last part of a
    block is decoded as far as it goes; one too short for a header is left out."""
    raw = np.frombuffer(data, dtype=np.uint8)
    out = []
    whole = len(raw) // block
    for part, size in ((raw[: whole * block].reshape(whole, block), block), (raw[whole * block :].reshape(1, -1), len(raw) - whole * block)):
        if not len(part) or size < 4:
            continue
        predictor = part[:, :2].copy().view("<i2")[:, 0].astype(np.int64)
        index = np.minimum(part[:, 2].astype(np.int64), 88)
        codes = np.empty((len(part), 2 * (size - 4)), dtype=np.uint8)
        codes[:, 0::2], codes[:, 1::2] = part[:, 4:] & 15, part[:, 4:] >> 4
        pcm = np.empty((len(part), codes.shape[1] + 1), dtype=np.int16)
        pcm[:, 0] = predictor
        for j in range(codes.shape[1]):
            predictor, index = _ima_step(predictor, index, codes[:, j])
            pcm[:, j + 1] = predictor
        out.append(pcm.reshape(-1))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int16)


def encode_ima(pcm: np.ndarray, block: int) -> bytes:
    """Blocks of 2 * block - 7 samples; the last one is padded with its last sample."""
    if not len(pcm):
        return b""
    per = 2 * (block - 4) + 1
    n = -(-len(pcm) // per)
    x = np.concatenate([pcm, np.full(n * per - len(pcm), pcm[-1])]).reshape(n, per).astype(np.int64)
    predictor, index = x[:, 0].copy(), np.zeros(n, dtype=np.int64)
    codes = np.empty((n, per - 1), dtype=np.uint8)
    for j in range(1, per):
        step, diff = STEPS[index], x[:, j] - predictor
        code = np.minimum(np.abs(diff) * 4 // step, 7) | np.where(diff < 0, 8, 0)
        predictor, index = _ima_step(predictor, index, code)
        codes[:, j - 1] = code
    out = np.zeros((n, block), dtype=np.uint8)
    out[:, :2] = x[:, :1].astype("<i2").view(np.uint8)
    out[:, 4:] = codes[:, 0::2] | codes[:, 1::2] << 4
    return out.tobytes()


def wav(data: bytes, tag: int, rate: int = RATE, block: int = 1, bits: int = 8) -> bytes:
    extra = b"" if tag == PCM else struct.pack("<HH", 2, 2 * (block - 4) + 1) if tag == IMA else struct.pack("<H", 0)
    per_second = rate * block if tag != IMA else rate * block // (2 * (block - 4) + 1)
    fmt = struct.pack("<HHIIHH", tag, 1, rate, per_second, block, 4 if tag == IMA else bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(media: bytes) -> tuple[int, int, int, bytes]:
    """Format tag, rate, block size and the data's bytes."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, tag, rate, block = 12, 0, 0, 1
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate, _, block, _ = struct.unpack_from("<HHIIHH", media, at + 8)
            if not rate or not block:
                raise ValueError("a WAV file without a rate or a block size")
        elif name == b"data":
            return tag, rate, block, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAV file without data")


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """Rate and 16-bit samples of a mono WAV file."""
    tag, rate, block, data = read_wav(media)
    if tag in (MULAW, ALAW):
        return rate, (MULAW_PCM if tag == MULAW else ALAW_PCM)[np.frombuffer(data, dtype=np.uint8)]
    if tag == IMA:
        return rate, decode_ima(data, block)
    if tag == PCM and block == 2:
        return rate, np.frombuffer(data, dtype="<i2")
    raise ValueError(f"format {tag} with blocks of {block} is not known")


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear; the result has ceil(len * to / rate) samples."""
    if rate == to or not len(pcm):
        return pcm.astype(np.int16)
    if to % rate == 0:  # whole factors: interpolate between neighbours, without positions
        k = to // rate
        x = pcm.astype(np.int32)
        step = np.diff(x, append=x[-1:])
        out = np.empty((len(x), k), dtype=np.int16)
        for j in range(k):
            out[:, j] = x + (step * j) // k
        return out.reshape(-1)
    at = np.arange(-(-len(pcm) * to // rate)) * (rate / to)
    return np.rint(np.interp(at, np.arange(len(pcm)), pcm)).astype(np.int16)


def levels(pcm: np.ndarray) -> str:
    """Samples, mean magnitude, peak and sign changes."""
    if not len(pcm):
        return "n=0"
    size = np.abs(pcm.astype(np.int32))
    crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
    return f"n={len(pcm)};mean={int(size.sum(dtype=np.int64)) * 1000 // len(pcm)};peak={int(size.max())};crossings={crossings}"


def feature(pcm: np.ndarray) -> str:
    """levels() and a CRC of the stored PCM."""
    return f"{levels(pcm)};pcm={zlib.crc32(pcm.astype('<i2').tobytes()):08x}" if len(pcm) else levels(pcm)


def weighted(pcm: np.ndarray, every: int = 1000) -> str:
    """levels() and the sum of the samples, weighted by their place in each thousand (from 1)."""
    whole = len(pcm) // every * every
    sums = pcm[:whole].reshape(-1, every).sum(axis=0, dtype=np.int64)
    sums[: len(pcm) - whole] += pcm[whole:]
    return f"{levels(pcm)};weighted={int((sums * np.arange(1, every + 1)).sum())}"


def _decoded(rate: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                media = batch.column(1)[i].as_py()
                pcm = error = None
                if media is not None:
                    try:
                        have, samples = decode(media)
                        pcm = wav(resample(samples, have, rate).astype("<i2").tobytes(), PCM, rate, 2, 16)
                    except (ValueError, struct.error) as e:
                        error = str(e)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([pcm], pa.binary()), pa.array([error], pa.string())], ["id", "pcm", "error"])

    return rows


def decode_audio(df: DataFrame, id_column: str, media_column: str, rate: int = 16000) -> DataFrame:
    """id, pcm (a WAV file of 16-bit samples at the given rate) and error: why other bytes have no pcm. Null has neither."""
    kind = dict(df.dtypes)[id_column]
    return python_rows(own_names(df, [id_column, media_column]), _decoded(rate), f"id {kind}, pcm binary, error string")


def store_text(text: bytes) -> bytes:
    """The text's bytes, padded, as the mu-law samples of a WAV file."""
    return wav(text + PAD * ((-len(text)) % UNIT or (0 if text else UNIT)), MULAW)


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_bytes", "alaw_feature", "adpcm_feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        for at, part in chunks(as_bytes(batch.column(1))):
            out, payloads = [], []
            for text in part:
                media = store_text(text)
                payload = read_wav(media)[3]
                rate, samples = decode(media)
                stored = wav(resample(samples, rate, 2 * rate).astype("<i2").tobytes(), PCM, 2 * rate, 2, 16)
                pcm, alaw = decode(stored)[1], ALAW_PCM[np.frombuffer(payload, dtype=np.uint8)]
                out.append((len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(pcm), len(stored), weighted(alaw)))
                payloads.append(payload)
            adpcm = decode_ima(b"".join(payloads), BLOCK)
            ends = np.cumsum([len(p) // BLOCK * (2 * BLOCK - 7) for p in payloads])
            out = [(*r, weighted(pcm)) for r, pcm in zip(out, np.split(adpcm, ends[:-1]), strict=True)]
            columns = [pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), *columns], names)


def op8_telephony_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return python_rows(
        own_names(table(spark, sf_dir, "documents"), ["doc_id", "text"]),
        _stored,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
        "pcm_bytes long, alaw_feature string, adpcm_feature string",
    )
