"""Media columns for telephony audio: 8-bit companded and 4-bit adaptive samples.

Mu-law and A-law bytes are expanded by 256-entry lookup tables. IMA ADPCM blocks are decoded sample by sample in time but across all
blocks of a batch at once, with one table lookup for the step and one for the next state. Expanded samples are resampled from 8 to
16 kHz by linear interpolation and stored as little-endian 16-bit PCM. Files are RIFF WAVE; reading walks the chunks.

Edge cases: a null text is an empty payload, which still fills one block; equal texts give equal files and features; very long texts are
decoded in slices of whole blocks, and their files (one byte and four bytes for a byte of text) are held once each; an empty table gives
an empty result; repeated rows are stored on their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from conceptloom.llm.common import documents

RATE, BLOCK = 8000, 64
PCM, ALAW, MULAW, IMA_ADPCM = 1, 6, 7, 17  # format tags
#: Payload bytes that are decoded together, whole blocks.
SLICE = 1 << 20

# Step sizes and index changes of IMA ADPCM.
STEPS = (
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253,
    279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660,
    4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
)
INDEX_CHANGE = (-1, -1, -1, -1, 2, 4, 6, 8)


def mulaw_table() -> np.ndarray:
    u = ~np.arange(256, dtype=np.int32) & 0xFF
    magnitude = ((((u & 0x0F) << 3) + 0x84) << ((u & 0x70) >> 4)) - 0x84
    return np.where(u & 0x80, -magnitude, magnitude).astype(np.int16)


def alaw_table() -> np.ndarray:
    a = np.arange(256, dtype=np.int32) ^ 0x55
    segment, low = (a & 0x70) >> 4, (a & 0x0F) << 4
    magnitude = np.where(segment == 0, low + 8, (low + 0x108) << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, magnitude, -magnitude).astype(np.int16)


def adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """Change of the sample and next state, by 16 * state + code."""
    step, code = np.array(STEPS, np.int32)[:, None], np.arange(16, dtype=np.int32)[None, :]
    change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
    following = np.clip(np.arange(len(STEPS))[:, None] + np.array(INDEX_CHANGE * 2)[None, :], 0, len(STEPS) - 1)
    return np.where(code & 8, -change, change).astype(np.int32).ravel(), (following * 16).astype(np.int32).ravel()


MULAW_PCM, ALAW_PCM, (ADPCM_CHANGE, ADPCM_NEXT) = mulaw_table(), alaw_table(), adpcm_tables()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, block bytes) uint8 to (blocks, samples) int16: the header's sample, then two for every byte, low half first."""
    n, width = blocks.shape
    sample = np.ascontiguousarray(blocks[:, :2]).view("<i2")[:, 0].astype(np.int32)
    state = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32) * 16
    codes = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * (width - 4), n), np.int16)
    out[0] = sample
    for t, pair in enumerate(codes):
        for half, code in enumerate((pair & 15, pair >> 4)):
            at = state + code
            sample += ADPCM_CHANGE.take(at)
            np.clip(sample, -32768, 32767, out=sample)
            state = ADPCM_NEXT.take(at)
            out[1 + 2 * t + half] = sample
    return out.T


def resample_double(pcm: np.ndarray, after: int | None = None) -> np.ndarray:
    """Twice the rate: each sample, then the mean of it and the next. ``after`` is the sample that follows; without it the last one repeats."""
    out = np.empty(2 * len(pcm), "<i2")
    out[::2] = pcm
    wide = pcm.astype(np.int32)
    out[1::2] = (wide + np.append(wide[1:], wide[-1:] if after is None else after)) >> 1
    return out


def wave(data: bytes | bytearray | memoryview, tag: int = MULAW, rate: int = RATE, bits: int = 8, align: int = 1) -> bytes:
    fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate * align, align, bits, 0)
    head = b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"fact" + struct.pack("<II", 4, len(data) // align) + b"data" + struct.pack("<I", len(data))
    pad = b"\0" * (len(data) & 1)
    return b"".join((b"RIFF", struct.pack("<I", len(head) + len(data) + len(pad)), head, data, pad))


def pcm_file(data: bytes | memoryview) -> bytes:
    """The 16 kHz, 16-bit PCM file of mu-law samples, expanded slice by slice."""
    raw, out = np.frombuffer(data, np.uint8), bytearray(4 * len(data))
    for at in range(0, len(raw), SLICE):
        following = raw[at + SLICE : at + SLICE + 1]
        part = resample_double(MULAW_PCM[raw[at : at + SLICE]], int(MULAW_PCM[following[0]]) if len(following) else None)
        out[4 * at : 4 * at + part.nbytes] = part.data.cast("B")
    return wave(out, PCM, 2 * RATE, 16, 2)


def read_wave(file: bytes | memoryview) -> tuple[int, int, bytes | memoryview]:
    """Format tag, rate and data of a RIFF WAVE file; of a view the data is a view."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(file):
        name, n = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if name == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", file, at + 8)
        elif name == b"data":
            return tag, rate, file[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no data")


def payload_of(text: bytes | memoryview) -> bytes:
    return b"".join((text, b"\0" * (-len(text) % BLOCK or (0 if len(text) else BLOCK))))


class _Sums:
    """Energy, peak and sign changes of the files in a slice; starts are their first samples."""

    def __init__(self, pcm: np.ndarray, starts: np.ndarray):
        wide = pcm.astype(np.int64)
        self.energy = np.add.reduceat(wide * wide, starts)
        self.peak = np.maximum.reduceat(np.abs(wide), starts)
        turn = np.zeros(len(pcm), np.int64)
        turn[1:] = (pcm[1:] < 0) != (pcm[:-1] < 0)
        turn[starts] = 0
        self.turns = np.add.reduceat(turn, starts)
        self.ends = pcm[starts] < 0, pcm[np.append(starts[1:], len(pcm)) - 1] < 0  # signs of first and last samples

    def join(self, after: _Sums) -> None:
        """Go on with the next slice of a single file."""
        self.turns = self.turns + after.turns + (self.ends[1] != after.ends[0])
        self.energy, self.peak, self.ends = self.energy + after.energy, np.maximum(self.peak, after.peak), (self.ends[0], after.ends[1])


KINDS = ("mulaw", "alaw", "adpcm")


def _sums(raw: np.ndarray, starts: np.ndarray) -> list[_Sums]:
    blocks = decode_adpcm(raw.reshape(-1, BLOCK))
    return [_Sums(MULAW_PCM[raw], starts), _Sums(ALAW_PCM[raw], starts), _Sums(np.ascontiguousarray(blocks).ravel(), starts // BLOCK * blocks.shape[1])]


def features_of(datas: list[bytes | memoryview], pcms: list[bytes | memoryview]) -> list[str]:
    """A line of whole numbers for each payload, read as mu-law, A-law and ADPCM, and a checksum of its stored 16 kHz PCM."""
    sizes = np.array([len(d) for d in datas], np.int64)
    if len(datas) == 1:
        raw = np.frombuffer(datas[0], np.uint8)
        sums = _sums(raw[:SLICE], np.zeros(1, np.int64))
        for at in range(SLICE, len(raw), SLICE):
            for own, after in zip(sums, _sums(raw[at : at + SLICE], np.zeros(1, np.int64)), strict=True):
                own.join(after)
    else:
        sums = _sums(np.frombuffer(b"".join(datas), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    samples = [sizes, sizes, sizes // BLOCK * (1 + 2 * (BLOCK - 4))]
    lines = []
    for i, pcm in enumerate(pcms):
        parts = [f"{name}:rms={int((float(x.energy[i]) / m[i]) ** 0.5)},peak={x.peak[i]},turns={x.turns[i]}" for name, x, m in zip(KINDS, sums, samples, strict=True)]
        lines.append(";".join([*parts, f"pcm16k:n={len(pcm) // 2},crc={zlib.crc32(pcm)}"]))
    return lines


def _slices(sizes: list[int]) -> Iterator[slice]:
    """Rows that are decoded together: about SLICE bytes, and a longer text on its own."""
    begin, size = 0, 0
    for i, n in enumerate(sizes):
        if i > begin and size + n > SLICE:
            yield slice(begin, i)
            begin, size = i, 0
        size += n
    if sizes:
        yield slice(begin, len(sizes))


def _views(column: pa.Array) -> list[memoryview]:
    """The values of a binary column without copies; null is empty."""
    return [memoryview(b"") if not x.is_valid else memoryview(x.as_buffer()) for x in column]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of id and text to ones of id, n_bytes, wav and pcm16k, a slice at a time."""
    for batch in batches:
        texts = _views(batch.column(1).cast(pa.large_binary() if pa.types.is_large_string(batch.schema.types[1]) else pa.binary()))
        for part in _slices([len(t) for t in texts]):
            wavs = [wave(payload_of(t)) for t in texts[part]]
            pcm = [pcm_file(read_wave(memoryview(w))[2]) for w in wavs]
            ids = batch.column(0).slice(part.start, len(wavs))
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts[part]], pa.int64()), pa.array(wavs, pa.binary()), pa.array(pcm, pa.binary())], names=["doc_id", "n_bytes", "wav", "pcm16k"])


DIGESTS = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string()}


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of _store() to ones of id, n_bytes, DIGESTS and feature, a slice at a time."""
    for batch in batches:
        wavs, pcms = _views(batch.column(2)), _views(batch.column(3))
        for part in _slices([len(w) for w in wavs]):
            datas = [read_wave(w)[2] for w in wavs[part]]
            rows = [(len(d), hashlib.sha256(d).hexdigest(), zlib.crc32(d[-BLOCK:]), len(w), hashlib.sha256(w).hexdigest()) for d, w in zip(datas, wavs[part], strict=True)]
            features = features_of(datas, [read_wave(p)[2] for p in pcms[part]])
            own = [batch.column(i).slice(part.start, len(datas)) for i in (0, 1)]
            digests = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), DIGESTS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*own, *digests, pa.array(features)], names=["doc_id", "n_bytes", *DIGESTS, "feature"])


_DIGEST_FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def store_audio(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, n_bytes, wav, pcm16k): the stored mu-law file and its resampled 16-bit PCM file."""
    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(_store, f"doc_id {dict(slim.dtypes)['doc_id']}, n_bytes long, wav binary, pcm16k binary")


def digest_audio(stored: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, wav, pcm16k) to the digests of the stored file and of the payload read back from it, and the features of both."""
    slim = stored.select("doc_id", "n_bytes", "wav", "pcm16k")
    return slim.mapInArrow(_digest, f"doc_id {dict(slim.dtypes)['doc_id']}, {_DIGEST_FIELDS}")


def describe_audio(docs: DataFrame) -> DataFrame:
    """digest_audio() of store_audio() slice by slice, so that no batch of media crosses into the JVM."""
    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(lambda batches: _digest(_store(batches)), f"doc_id {dict(slim.dtypes)['doc_id']}, {_DIGEST_FIELDS}")


def op8_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored as mu-law samples, read back and described."""
    return describe_audio(documents(spark, sf_dir))
