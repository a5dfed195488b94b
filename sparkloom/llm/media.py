"""Telephony audio in binary columns: mu-law and A-law by lookup tables, IMA ADPCM blocks, resampled PCM.

A media value is a WAV file of 8-bit mu-law or A-law samples or of 4-bit ADPCM blocks. It is parsed, expanded to 16-bit PCM and
resampled, by means of samples where the rate is a whole multiple of the new one, else by linear interpolation; ADPCM is decoded sample by
sample for all blocks of a batch at once. Texts are stored as media of the three codecs, by a checksum of their bytes; media and
resampled PCM are written to the shared folder, and features are taken from what is read back.

Nulls and edges: a null or broken media value has null PCM and null features; a WAV without samples has an empty PCM; of a short last ADPCM
block the samples that are there are decoded; a null text is stored as an empty one; rows that repeat are all kept; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialize, slices

#: Fixed values of the WAV format: codec tags.
A_LAW, MU_LAW, IMA_ADPCM = 6, 7, 17
#: Fixed values of IMA ADPCM: change of the step's index by the low three bits of a code, and the steps.
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963]
    + [1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)


def mu_law_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 255
    size = ((((code & 15) << 3) + 132) << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    part, size = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(part > 0, (size + 256) << np.maximum(part - 1, 0), size)
    return np.where(code & 128, size, -size).astype(np.int16)


def wav(samples: bytes, codec: int = MU_LAW, rate: int = 8000, align: int = 1) -> bytes:
    """A mono WAV file; ``align`` is the bytes of a block."""
    bits = 4 if codec == IMA_ADPCM else 8
    extra = struct.pack("<HH", 2, (align - 4) * 2 + 1) if codec == IMA_ADPCM else struct.pack("<H", 0)
    form = struct.pack("<HHIIHH", codec, 1, rate, rate * bits // 8, align, bits) + extra
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(data: bytes) -> tuple[int, int, int, bytes] | None:
    """(codec, rate, bytes of a block, samples), None if it isn't a mono WAV file of a known codec with a rate; samples that a cut file lacks are missing."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, form = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            if size < 16 or at + 24 > len(data):  # broken
                return None
            form = struct.unpack_from("<HHIIHH", data, at + 8)
        if name == b"data" and form:
            known = form[0] in (A_LAW, MU_LAW) or form[0] == IMA_ADPCM and form[4] > 4
            return (form[0], form[2], form[4], data[at + 8 : at + 8 + size]) if known and form[1] == 1 and form[2] else None
        at += 8 + size + size % 2
    return None


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """PCM of IMA ADPCM blocks (rows of bytes: sample, step index, 0, then codes, low half first), all blocks at a time."""
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    codes = np.ascontiguousarray(np.stack([blocks[:, 4:] & 15, blocks[:, 4:] >> 4], axis=2).reshape(len(blocks), 2 * (blocks.shape[1] - 4)).T)
    out = np.empty((codes.shape[0] + 1, len(blocks)), np.int16)
    out[0] = value
    for t, code in enumerate(codes):
        step, low = STEPS[index], code & 7
        change = (step >> 3) + np.where(code & 1, step >> 2, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 4, step, 0)
        value = np.clip(value + np.where(code & 8, -change, change), -32768, 32767)
        index = np.clip(index + INDEX_CHANGE[low], 0, 88)
        out[t + 1] = value
    return out.T.reshape(-1)


def resampled(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    if rate == to or not len(pcm):
        return pcm
    if rate % to == 0:  # means of as many samples as there are to one new one
        m = rate // to
        x = np.append(pcm, np.repeat(pcm[-1], -len(pcm) % m)).reshape(-1, m)
        return (x.sum(axis=1, dtype=np.int32) // m).astype(np.int16)
    if to % rate == 0:  # a whole multiple: in-between samples in integer arithmetic
        m, x = to // rate, pcm.astype(np.int32)
        after = np.append(x[1:], x[-1])
        k = np.arange(m, dtype=np.int32)
        return ((x[:, None] * (m - k) + after[:, None] * k) // m).astype(np.int16).reshape(-1)
    place = np.arange(len(pcm) * to // rate) * (rate / to)
    return np.interp(place, np.arange(len(pcm)), pcm).astype(np.int16)


_TABLES = {A_LAW: a_law_table(), MU_LAW: mu_law_table()}


def expand(values: list[bytes | None], to: int) -> list[np.ndarray | None]:
    """The resampled PCM of each WAV file, None for null and broken ones; ADPCM blocks of one size are decoded together."""
    parts = [None if v is None else read_wav(v) for v in values]
    out: list[np.ndarray | None] = [None] * len(values)
    by_size: dict[int, list[int]] = {}
    for i, p in enumerate(parts):
        if p is not None and p[0] != IMA_ADPCM:
            out[i] = _TABLES[p[0]][np.frombuffer(p[3], np.uint8)]
        elif p is not None:
            by_size.setdefault(p[2], []).append(i)
    for align, rows in by_size.items():
        # a last block is filled up; what it has too many is cut again
        filled = [parts[i][3] + bytes(-len(parts[i][3]) % align) for i in rows]
        each = 2 * align - 7
        pcm, at = adpcm(np.frombuffer(b"".join(filled), np.uint8).reshape(-1, align)), 0
        for i, f in zip(rows, filled, strict=True):
            n, rest = divmod(len(parts[i][3]), align)
            out[i] = pcm[at : at + n * each + (2 * rest - 7 if rest >= 4 else 0)]
            at += len(f) // align * each
    return [None if x is None else resampled(x, p[1], to) for x, p in zip(out, parts, strict=True)]


def to_pcm(media: DataFrame, rate: int = 8000, column: str = "media") -> DataFrame:
    """``media`` with a column ``pcm``: 16-bit little-endian samples at ``rate``."""

    @F.pandas_udf("binary")
    def run(values):
        made = expand([None if x is None else bytes(x) for x in values], rate)
        return type(values)([None if y is None else y.astype("<i2").tobytes() for y in made])

    return media.withColumn("pcm", run(F.col(column)))


def _store(unit: int, rate: int):
    def run(batches):
        for whole in batches:
            for b in slices(whole, "text", 256):
                texts = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
                media = []
                for t in texts:
                    samples = t + b"\xff" * (max(1, -(-len(t) // unit)) * unit - len(t))
                    codec = (A_LAW, MU_LAW, IMA_ADPCM)[zlib.crc32(samples) % 3]
                    media.append(wav(samples, codec, rate, unit if codec == IMA_ADPCM else 1))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return run


def store_texts(docs: DataFrame, unit: int = 576, rate: int = 32000) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes, filled up with 255 to a positive multiple of ``unit``, as samples (or blocks) of a WAV file."""
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(_store(unit, rate), "doc_id long, n_bytes long, media binary")


_FOUND = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "sound": pa.string(), "pcm": pa.binary()}


def _read(rate: int):
    """Digests of the samples and of the file, the resampled PCM, and its codec, samples, peak, mean size and zero crossings; nulls for null and broken media."""

    def run(batches):
        for whole in batches:
            for b in slices(whole, "media", 256):
                media, rows = b.column("media").to_pylist(), []
                for m, pcm in zip(media, expand(media, rate), strict=True):
                    if pcm is None:
                        rows.append([None] * len(_FOUND))
                        continue
                    codec, _, _, p = read_wav(m)
                    loud, crossings = np.abs(pcm.astype(np.int32)), int(((pcm[1:] >= 0) != (pcm[:-1] >= 0)).sum())
                    sound = f"codec={codec};n={len(pcm)};peak={loud.max(initial=0)};mean={int(loud.sum()) // max(1, len(pcm))};crossings={crossings}"
                    rows.append([len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), sound, pcm.astype("<i2").tobytes()])
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _FOUND.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *cols], ["doc_id", "n_bytes", *_FOUND])

    return run


def features(media: DataFrame, rate: int = 8000) -> DataFrame:
    """doc_id, n_bytes, digests and feature of ``media(doc_id, n_bytes, media)``; the resampled PCM is stored, and the feature's checksum is that of what is stored."""
    kinds = {"int64": "long", "string": "string", "binary": "binary"}
    schema = "doc_id long, n_bytes long, " + ", ".join(f"{c} {kinds[str(t)]}" for c, t in _FOUND.items())
    made = materialize(media.mapInArrow(_read(rate), schema), "zstd")
    feature = F.concat(F.col("sound"), F.lit(";pcm="), F.crc32("pcm").cast("string")).alias("feature")
    return made.select("doc_id", "n_bytes", *[c for c in _FOUND if c not in ("sound", "pcm")], feature)


def op5_media(spark, sf_dir: str) -> DataFrame:
    """All documents as stored telephony audio, read back, its PCM stored at 8 kHz."""
    return features(materialize(store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")), "zstd"))
