"""Media columns: a payload as 8-bit WAV, its spectrum's peaks paired into time-coded fingerprints.

The bytes are stored as unsigned 8-bit mono samples, so nothing is lost. Frames of the samples, each half over the next, go through a
windowed Fourier transform; in each frame the strongest bin of each band is a peak; each peak is paired with the peaks of the next
frames, and a pair (bin, bin, distance) with its frame is one 64-bit entry, the frame in its upper half.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

RATE, BLOCK, FRAME, HOP = 8000, 64, 256, 128
#: Edges of the bands in bins, and how many frames ahead a peak is paired.
BANDS, AHEAD = (1, 8, 16, 32, 64, 129), 2
#: Frames transformed at once.
CHUNK = 4096


def padded(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(max(BLOCK, -(-len(data) // BLOCK) * BLOCK) - len(data))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """(frames, bands): the strongest bin of each band; the first frame begins half a frame early, so that every sample is near
    the middle of some frame, and what lies outside is filled with the middle value."""
    n = -(-len(samples) // HOP) + 1
    x = np.full((n + 1) * HOP, 128, np.uint8)
    x[HOP : HOP + len(samples)] = samples
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    out = np.empty((n, len(BANDS) - 1), np.int64)
    for a in range(0, n, CHUNK):
        f = np.fft.rfft((frames[a : a + CHUNK].astype(np.float32) - 128) * window)
        power = f.real**2 + f.imag**2
        for k in range(len(BANDS) - 1):
            out[a : a + CHUNK, k] = BANDS[k] + power[:, BANDS[k] : BANDS[k + 1]].argmax(1)
    return out


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Time-coded pairs, in order: frame << 32 | bin << 20 | later bin << 8 | distance."""
    p = peaks(samples)
    at = np.arange(len(p), dtype=np.int64)[:, None, None] << 32
    parts = []
    for d in range(1, AHEAD + 1):
        if len(p) > d:
            pair = at[:-d] | (p[:-d, :, None] << 20) | (p[d:, None, :] << 8) | d
            parts.append(pair.reshape(-1))
    if not parts:
        return (p[0] << 20).reshape(-1)  # one frame: its peaks alone
    return np.sort(np.concatenate(parts), kind="stable")


def media(docs: DataFrame, keep: bool = True) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 per row, and with ``keep`` the
    WAV and the fingerprint array; always ``feature``: the array's length and SHA-256.

    Null text is empty: a payload of 64 zero bytes. One pass, no shuffle; a batch's texts are handled one at a time.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
    fields += [("media", pa.binary()), ("pairs", pa.list_(pa.int64()))] if keep else []
    schema = pa.schema(fields)
    rows_at_once = 64 if keep else 10_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                stored = to_wav(padded(data))
                back = from_wav(stored)
                prints = fingerprint(np.frombuffer(back, np.uint8))
                feature = f"{len(prints)}:{hashlib.sha256(prints.astype('<i8').tobytes()).hexdigest()}"
                row = (doc_id, len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(stored), hashlib.sha256(stored).hexdigest(), feature)
                rows.append((*row, stored, prints) if keep else row)
                if len(rows) >= rows_at_once:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    ddl = ", ".join(f"{f.name} {kinds.get(f.type, 'array<long>')}" for f in schema)
    return docs.select("doc_id", "text").mapInArrow(run, ddl)
