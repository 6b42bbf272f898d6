"""Media columns: telephony audio as binary columns.

Mu-law and A-law samples expand by lookup tables, IMA ADPCM blocks decode with numpy across blocks (one step of every
block at a time), and results are stored as 16-bit PCM, resampled where asked. Samples live in WAV containers: format
7 is mu-law, 6 A-law, 17 IMA ADPCM, 1 PCM.

A payload is stored in each of the three telephony forms, losslessly: as mu-law samples (the stored form that the query
reports on), as A-law samples, and as the nibbles of IMA ADPCM blocks of one unit after a header of zeros. Each stored file is
read back, decoded (the blocks of all files of a slice together) and stored as 16-bit PCM at 16 kHz.

Cases: a null container gives null; a container of no samples gives empty PCM; one that isn't a WAV of these formats
raises ValueError, so that a corrupt column is noticed. Other columns of the input pass through unchanged.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table, text_slices

PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17
#: Telephony's sample rate, and the unit to which a payload is padded.
RATE, UNIT = 8000, 64
#: Bytes of a mono ADPCM block before its nibbles.
HEADER = 4


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.uint8)
    exponent, mantissa = (code >> 4 & 7).astype(np.int32), (code & 15).astype(np.int32)
    size = ((mantissa << 3) + 0x84 << exponent) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.uint8) ^ 0x55
    exponent, mantissa = (code >> 4 & 7).astype(np.int32), (code & 15).astype(np.int32)
    size = np.where(exponent == 0, (mantissa << 4) + 8, (mantissa << 4) + 0x108 << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MULAW_TABLE, ALAW_TABLE = mulaw_table(), alaw_table()
# Index steps and step sizes of the IMA ADPCM format.
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
IMA_STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def ima_decode(data: bytes, block: int) -> np.ndarray:
    """Mono IMA ADPCM blocks of `block` bytes (header: first sample, index, zero) to PCM. All blocks advance together,
    one nibble a step. A last block that is short is decoded as far as it goes."""
    if not data:
        return np.zeros(0, np.int16)
    if block <= 4:
        raise ValueError("an ADPCM block is longer than its header of 4 bytes")
    n, short = -(-len(data) // block), (len(data) - 1) % block + 1
    if short < 4:
        raise ValueError("an ADPCM block is cut off within its header")
    raw = np.frombuffer(data.ljust(n * block, b"\0"), np.uint8).reshape(n, block)
    value, index = raw[:, :2].copy().view("<i2")[:, 0].astype(np.int32), np.minimum(raw[:, 2], 88).astype(np.int32)
    nibbles = np.empty((n, 2 * (block - 4)), np.uint8)
    nibbles[:, ::2], nibbles[:, 1::2] = raw[:, 4:] & 15, raw[:, 4:] >> 4
    out = np.empty((n, nibbles.shape[1] + 1), np.int16)
    out[:, 0] = value
    for k in range(nibbles.shape[1]):
        code, step = nibbles[:, k], IMA_STEPS[index]
        change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[code], 0, 88)
        out[:, k + 1] = value
    return out.reshape(-1)[: (n - 1) * out.shape[1] + 1 + 2 * (short - 4)]


def ima_encode(samples: np.ndarray, block: int) -> bytes:
    """PCM to mono IMA ADPCM blocks, all blocks together; the last is filled with its last sample."""
    per = 2 * (block - 4) + 1
    if not len(samples):
        return b""
    n = -(-len(samples) // per)
    pcm = np.concatenate([samples, np.repeat(samples[-1:], n * per - len(samples))]).astype(np.int32).reshape(n, per)
    value, index = pcm[:, 0].copy(), np.zeros(n, np.int32)
    raw = np.zeros((n, block), np.uint8)
    raw[:, :2] = value.astype("<i2").view(np.uint8).reshape(n, 2)
    for k in range(1, per):
        step, gap = IMA_STEPS[index], pcm[:, k] - value
        code, rest, change = np.where(gap < 0, 8, 0), np.abs(gap), step >> 3
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            hit = rest >= part
            code, rest, change = code | np.where(hit, bit, 0), rest - np.where(hit, part, 0), change + np.where(hit, part, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[code], 0, 88)
        raw[:, 4 + (k - 1) // 2] |= (code << (4 if (k - 1) % 2 else 0)).astype(np.uint8)
    return raw.tobytes()


def resample(samples: np.ndarray, rate: int, to: int, most: int = 1 << 20) -> np.ndarray:
    """Linear interpolation at the new rate's instants; whole numbers, so that every machine gives the same. Some `most`
    instants are computed at a time, so that a long file needs little memory besides its result."""
    if rate == to or not len(samples):
        return samples.astype(np.int16)
    out = np.empty(len(samples) * to // rate, np.int16)
    for begin in range(0, len(out), most):
        at = np.arange(begin, min(begin + most, len(out)), dtype=np.int64) * rate
        left, part = at // to, at % to
        x, y = samples[left].astype(np.int64), samples[np.minimum(left + 1, len(samples) - 1)].astype(np.int64)
        out[begin : begin + most] = (x * (to - part) + y * part) // to
    return out


def wav(kind: int, data: bytes, rate: int = RATE, block: int = 1, bits: int = 8) -> bytes:
    """A mono WAV file that holds data as it is."""
    head = struct.pack("<HHIIHH", kind, 1, rate, rate * block if kind != IMA_ADPCM else rate // 2, block, bits)
    if kind != PCM:
        head += struct.pack("<H", 0)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(stored: bytes) -> tuple[int, int, int, bytes]:
    """Format, sample rate, block size and data of a mono WAV file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, head, data = 12, None, None
    while at + 8 <= len(stored):
        size = struct.unpack_from("<I", stored, at + 4)[0]
        if stored[at : at + 4] == b"fmt ":
            head = struct.unpack_from("<HHIIHH", stored, at + 8)
        elif stored[at : at + 4] == b"data":
            data = stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if head is None or data is None or head[1] != 1 or head[0] not in (PCM, ALAW, MULAW, IMA_ADPCM):
        raise ValueError("not a mono WAV file of PCM, A-law, mu-law or IMA ADPCM")
    return head[0], head[2], head[4], data


def expand(stored: bytes) -> tuple[np.ndarray, int]:
    """16-bit samples and sample rate of a stored file."""
    kind, rate, block, data = read_wav(stored)
    if kind == IMA_ADPCM:
        return ima_decode(data, block), rate
    if kind == PCM:
        return np.frombuffer(data[: len(data) // 2 * 2], "<i2"), rate
    return (MULAW_TABLE if kind == MULAW else ALAW_TABLE)[np.frombuffer(data, np.uint8)], rate


def stored_pcm(samples: np.ndarray, rate: int, to: int = 2 * RATE) -> bytes:
    """Samples, resampled, as a WAV file of 16-bit PCM."""
    return wav(PCM, resample(samples, rate, to).astype("<i2").tobytes(), to, 2, 16)


def to_pcm(df: DataFrame, column: str, out: str = "pcm", rate: int = 2 * RATE) -> DataFrame:
    """Adds the column `out`: each stored file as 16-bit PCM in a WAV file at `rate`. Null stays null."""

    @F.pandas_udf("binary")
    def convert(stored: pd.Series) -> pd.Series:
        return stored.map(lambda x: stored_pcm(*expand(bytes(x)), rate), na_action="ignore").astype(object)

    return df.withColumn(out, convert(F.col(column)))


def features(samples: np.ndarray, rate: int, pcm: bytes) -> str:
    """Duration, level, peak, sign changes and a checksum of the PCM at 16 kHz, in whole numbers."""
    x = samples.astype(np.int64)
    energy = int((x * x).sum()) // max(1, len(x))
    turns = int(np.count_nonzero(np.diff(x < 0)))
    return f"rate={rate};samples={len(x)};energy={energy};peak={int(np.abs(x).max(initial=0))};mean={int(x.sum()) // max(1, len(x))};turns={turns};pcm16k={zlib.crc32(read_wav(pcm)[3])}"


def adpcm_file(payload: bytes) -> bytes:
    """A payload of whole units as the nibbles of ADPCM blocks, whose headers are zeros."""
    units = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    return wav(IMA_ADPCM, np.pad(units, ((0, 0), (HEADER, 0))).tobytes(), RATE, UNIT + HEADER, 4)


def decoded_blocks(files: list[bytes]) -> list[np.ndarray]:
    """The samples of each adpcm_file, the blocks of all of them decoded together."""
    data = [read_wav(x)[3] for x in files]
    per = 2 * UNIT + 1
    ends = np.cumsum([len(x) // (UNIT + HEADER) * per for x in data])
    return np.split(ima_decode(b"".join(data), UNIT + HEADER), ends[:-1])


#: The columns of telephony_payloads after the id, and those that keep_media adds.
DIGESTS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_bytes long, pcm_sha256 string, alaw_sha256 string, alaw_pcm_sha256 string, adpcm_sha256 string, adpcm_pcm_sha256 string"
FILES = "media binary, pcm binary, alaw binary, alaw_pcm binary, adpcm binary, adpcm_pcm binary"


def telephony_payloads(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_media: bool = False) -> DataFrame:
    """Stores every text's bytes, padded with zeros to a positive multiple of UNIT, as mu-law, A-law and ADPCM files,
    reads them back, decodes each to stored PCM and computes features of the mu-law audio. With `keep_media` the stored
    files come along. A null or empty text is one unit of zeros; a null id stays null; repeated rows give repeated rows."""

    def digest(x: bytes) -> str:
        return hashlib.sha256(x).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_slices(batches, "text", 1 << 18):
            texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            padded = [t.ljust(max(1, -(-len(t) // UNIT)) * UNIT, b"\0") for t in texts]
            blocks = [adpcm_file(p) for p in padded]
            out: list[tuple] = []
            for text, payload, adpcm, decoded in zip(texts, padded, blocks, decoded_blocks(blocks), strict=True):
                media, alaw = wav(MULAW, payload), wav(ALAW, payload)
                back, (samples, rate) = read_wav(media)[3], expand(media)
                pcm, alaw_pcm, adpcm_pcm = stored_pcm(samples, rate), stored_pcm(*expand(alaw)), stored_pcm(decoded, RATE)
                row = (len(text), len(back), digest(back), zlib.crc32(back[-UNIT:]), len(media), digest(media), features(samples, rate, pcm), len(pcm), digest(pcm), digest(alaw), digest(alaw_pcm), digest(adpcm), digest(adpcm_pcm))
                out.append(row + (media, pcm, alaw, alaw_pcm, adpcm, adpcm_pcm) * keep_media)
            columns = [pa.array(x, kinds[t]) for x, (_, t) in zip(zip(*out, strict=True), named, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("id"), *columns], names=["id", *(n for n, _ in named)])

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    columns = DIGESTS + (", " + FILES) * keep_media
    named = [x.split() for x in columns.split(", ")]
    chosen = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(work, f"id {kind}, {columns}").withColumnRenamed("id", id_column)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telephony_payloads(table(spark, sf_dir, "documents"))
