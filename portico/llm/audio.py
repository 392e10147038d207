"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAV, expanded and resampled to PCM.

``store`` wraps payload bytes as a WAV of the codec named beside them; the bytes are the codec's
own unit, so nothing is lost. ``expand`` parses such files, expands mu-law and A-law by lookup
tables, decodes ADPCM with one numpy step per nibble across all blocks of a batch, and resamples.

Defined cases: a null text is an empty one; an empty payload becomes one block of zeros; equal
payloads give equal files; a null or broken file expands to nulls; further columns pass through;
an empty table gives an empty result. Batches are cut by bytes, so long rows bound memory by
their own size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, table

RATE, OUT_RATE, BLOCK = 8000, 16000, 64
#: WAV format tags.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17, "pcm": 1}
#: IMA ADPCM step sizes.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484,
    7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
#: IMA ADPCM index changes by the low three bits of a nibble.
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """PCM of each mu-law code."""
    code = ~np.arange(256, dtype=np.int32) & 255
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """PCM of each A-law code."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, low = (code >> 4) & 7, (code & 15) << 4
    size = np.where(part == 0, low + 8, low + 264 << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


def _nibble_tables() -> tuple[np.ndarray, np.ndarray]:
    """For state index * 16 + nibble: the change of the sample and the next index * 16."""
    step, nib = STEPS[:, None], np.arange(16)[None, :]
    diff = (step >> 3) + np.where(nib & 4, step, 0) + np.where(nib & 2, step >> 1, 0) + np.where(nib & 1, step >> 2, 0)
    diff = np.where(nib & 8, -diff, diff)
    index = np.clip(np.arange(len(STEPS))[:, None] + MOVES[nib & 7], 0, len(STEPS) - 1)
    return diff.astype(np.int32).ravel(), (index * 16).astype(np.int32).ravel()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM rows of IMA ADPCM blocks, one step per nibble over all blocks at once."""
    diff, following = _nibble_tables()
    head = blocks[:, :4].astype(np.int32)
    value = (head[:, 0] | head[:, 1] << 8).astype(np.int16).astype(np.int32)
    state = np.minimum(head[:, 2], len(STEPS) - 1) * 16
    out = np.empty((1 + 2 * (blocks.shape[1] - 4), len(blocks)), dtype=np.int16)
    out[0] = value
    codes = np.ascontiguousarray(blocks[:, 4:].T).astype(np.int32)
    for i, code in enumerate(codes):
        for j, nibble in ((1, code & 15), (2, code >> 4)):
            at = state + nibble
            value += diff[at]
            np.clip(value, -32768, 32767, out=value)
            state = following[at]
            out[2 * i + j] = value
    return np.ascontiguousarray(out.T)


def resample(pcm: np.ndarray, rate: int = RATE, to: int = OUT_RATE) -> np.ndarray:
    """Linear interpolation in whole numbers, the same on every machine."""
    if rate == to or not len(pcm):
        return pcm
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    low, part = at // to, (at % to).astype(np.int32)
    wide = pcm.astype(np.int32)
    high = np.minimum(low + 1, len(pcm) - 1)
    if to <= 65536 // 2:  # products of a sample and a rate fit 32 bits
        return ((wide[low] * (to - part) + wide[high] * part) // to).astype(np.int16)
    return ((wide[low].astype(np.int64) * (to - part) + wide[high].astype(np.int64) * part) // to).astype(np.int16)


def wav(payload: bytes, codec: str, rate: int = RATE, block: int = BLOCK) -> bytes:
    """A mono WAV file around payload."""
    bits = {"adpcm": 4, "pcm": 16}.get(codec, 8)
    align = block if codec == "adpcm" else bits // 8
    per_block = 1 + 2 * (block - 4)
    extra = struct.pack("<HH", 2, per_block) if codec == "adpcm" else b"" if codec == "pcm" else struct.pack("<H", 0)
    speed = rate * block // per_block if codec == "adpcm" else rate * align
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, rate, speed, align, bits) + extra
    samples = len(payload) // block * per_block if codec == "adpcm" else len(payload) // align
    fact = b"" if codec == "pcm" else b"fact" + struct.pack("<II", 4, samples)
    pad = len(payload) % 2
    body = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + fact + b"data" + struct.pack("<I", len(payload))
    return b"RIFF" + struct.pack("<I", len(body) + len(payload) + pad) + body + payload + b"\0" * pad


def parse_wav(data: bytes) -> tuple[str, int, int, bytes]:
    """Codec, rate, block size and payload of a mono WAV file; ValueError if it is not one."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate, align = 12, None, 0, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt ":
            tag, channels, rate, _, align, _ = struct.unpack_from("<HHIIHH", data, at + 8)
            codec = {v: k for k, v in TAGS.items()}.get(tag)
            if codec is None or channels != 1:
                raise ValueError("unknown codec")
        elif name == b"data" and codec:
            return codec, rate, align, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


def _with(schema: T.StructType, *fields: tuple[str, T.DataType]) -> T.StructType:
    new = {n for n, _ in fields}
    return T.StructType([f for f in schema.fields if f.name not in new] + [T.StructField(n, t) for n, t in fields])


def _rebuilt(batch: pa.RecordBatch, i: int, j: int, names: list[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    part = batch.slice(i, j - i)
    return pa.RecordBatch.from_arrays([new[n] if n in new else part.column(part.schema.get_field_index(n)) for n in names], names=names)


def store(df: DataFrame, payload: str = "payload", codec: str = "codec", media: str = "media") -> DataFrame:
    """df with a WAV column in place of the payload column."""
    schema = _with(df.drop(payload).schema, (media, T.BinaryType()))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(batch.schema.get_field_index(payload))
            kinds = batch.column(batch.schema.get_field_index(codec)).to_pylist()
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in data]
            for i, j in slices(batch, sizes):
                files = [None if x is None else wav(x, k) for x, k in zip(data.slice(i, j - i).to_pylist(), kinds[i:j], strict=True)]
                yield _rebuilt(batch, i, j, names, {media: pa.array(files, pa.binary())})

    return df.mapInArrow(run, schema)


def _expanded(files: list[bytes | None], to: int) -> tuple[list, list, list]:
    """Payload, PCM file and feature of each file."""
    tables = {"mulaw": mulaw_table(), "alaw": alaw_table()}
    parsed: list = []
    for data in files:
        try:
            parsed.append(None if data is None else parse_wav(data))
        except ValueError:
            parsed.append(None)
    sizes = {x[2] for x in parsed if x and x[0] == "adpcm" and x[2] > 4}
    decoded: dict[int, np.ndarray] = {}
    for size in sizes:
        own = [(i, len(x[3]) // size) for i, x in enumerate(parsed) if x and x[0] == "adpcm" and x[2] == size]
        rows = np.concatenate([np.frombuffer(parsed[i][3], np.uint8)[: n * size].reshape(n, size) for i, n in own])
        pcm = decode_adpcm(rows)
        at = 0
        for i, n in own:
            decoded[i] = pcm[at : at + n].ravel()
            at += n
    payloads, pcms, features = [], [], []
    for i, x in enumerate(parsed):
        if x is None:
            payloads.append(None), pcms.append(None), features.append(None)
            continue
        codec, rate, _, payload = x
        if codec in tables:
            pcm = tables[codec][np.frombuffer(payload, np.uint8)]
        else:
            pcm = decoded.get(i, np.zeros(0, np.int16)) if codec == "adpcm" else np.frombuffer(payload, "<i2")
        wide = pcm.astype(np.int64)
        peak = int(np.abs(wide).max()) if len(wide) else 0
        crossings = int(np.count_nonzero((pcm[1:] < 0) != (pcm[:-1] < 0)))
        out = resample(pcm, rate, to)
        payloads.append(payload)
        pcms.append(wav(out.astype("<i2").tobytes(), "pcm", to))
        features.append(f"{codec};samples={len(pcm)};sum={int(wide.sum())};energy={int((wide * wide).sum())};peak={peak};crossings={crossings};samples_{to}={len(out)}")
    return payloads, pcms, features


def expand(df: DataFrame, media: str = "media", to: int = OUT_RATE) -> DataFrame:
    """df with ``payload`` (the stored codes), ``pcm`` (a 16-bit WAV at rate to) and ``feature``."""
    schema = _with(df.schema, ("payload", T.BinaryType()), ("pcm", T.BinaryType()), ("feature", T.StringType()))
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column(batch.schema.get_field_index(media))
            sizes = [len(x.as_buffer()) if x.is_valid else 0 for x in data]
            for i, j in slices(batch, sizes, 2 << 20):
                payloads, pcms, features = _expanded(data.slice(i, j - i).to_pylist(), to)
                yield _rebuilt(batch, i, j, names, {"payload": pa.array(payloads, pa.binary()), "pcm": pa.array(pcms, pa.binary()), "feature": pa.array(features, pa.string())})

    return df.mapInArrow(run, schema)


def padded(text: Column) -> Column:
    """UTF-8 bytes of text with zeros up to a positive multiple of 64."""
    data = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    n = F.octet_length(data)
    target = F.greatest(F.lit(BLOCK), F.ceil(n / F.lit(BLOCK)) * F.lit(BLOCK))
    return F.concat(data, F.unhex(F.repeat(F.lit("00"), (target - n).cast("int"))))


def op1_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes as telephony codes; the bytes choose the codec, so equal texts agree."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), padded(F.col("text")).alias("payload"))
    codec = F.element_at(F.array(F.lit("mulaw"), F.lit("alaw"), F.lit("adpcm")), (F.crc32("payload") % 3 + 1).cast("int"))
    read = expand(store(docs.withColumn("codec", codec)))
    tail = F.expr("crc32(substring(payload, greatest(1, octet_length(payload) - 63), 64))")
    return read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        tail.alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        "feature", "codec", F.octet_length("pcm").cast("long").alias("pcm_bytes"), F.sha2("pcm", 256).alias("pcm_sha256"),
    )
