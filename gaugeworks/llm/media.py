"""Media columns: WAV bytes, short-time Fourier transforms, spectral-peak fingerprints (operator 5).

A text's UTF-8 bytes, padded to whole blocks of 64, are the samples of an 8-bit mono WAV file. Its
frames, which overlap by half, are transformed, and each frame's strongest bin of every band is a peak.
Each peak is paired with the peaks of its own frame's higher bands and with all bands' peaks of the
frames that follow; a pair codes both frequencies and their distance in frames, and is stored with its
time. So a text of one frame has pairs as well.

Scale: a map over documents with no shuffle. Long payloads are transformed in runs of ``FRAMES``.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugeworks.llm.shared import id_and_text, per_batch

BLOCK = 64
RATE = 8000
WINDOW, HOP = 256, 128
#: Edges of the bands of which each gives a frame's peak (bins of the transform).
BANDS = (2, 12, 32, 64, 129)
#: How many frames ahead a peak is paired.
AHEAD = 2
FRAMES = 4096


def to_wav(data: bytes) -> bytes:
    """A WAV file of 8-bit mono samples; ``data`` is padded by zeros to a positive multiple of 64."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(data + bytes(-len(data) % BLOCK if data else BLOCK))
    return out.getvalue()


def samples(media: bytes) -> bytes:
    """The samples of a WAV file, as stored."""
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def peaks(payload: bytes) -> np.ndarray:
    """The strongest bin of each band, for each frame; the last frame is filled with silence."""
    x = np.frombuffer(payload, np.uint8)
    n = max(1, -(-len(x) // HOP))
    shape = np.hanning(WINDOW).astype(np.float32)
    found = []
    for at in range(0, n, FRAMES):
        part = x[at * HOP : min(at + FRAMES, n) * HOP + WINDOW - HOP]
        frames = np.full((min(at + FRAMES, n) - at) * HOP + WINDOW - HOP, 128, np.float32)
        frames[: len(part)] = part
        frames -= 128
        view = np.lib.stride_tricks.sliding_window_view(frames, WINDOW)[::HOP]
        power = np.abs(np.fft.rfft(view * shape, axis=1)).astype(np.float32)
        found.append(np.stack([lo + power[:, lo:hi].argmax(axis=1) for lo, hi in zip(BANDS, BANDS[1:], strict=False)], axis=1))
    return np.concatenate(found)


def landmarks(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Times (frames) and codes of peak pairs, in order of both.

    A code is first bin << 16 | second bin << 8 | frames between. Pairs join a peak with the higher
    bands' peaks of its own frame and with every band's peak 1 to ``AHEAD`` frames on.
    """
    n, bands = found.shape
    pairs = [(i, j, 0) for i in range(bands) for j in range(i + 1, bands)]
    pairs += [(i, j, d) for d in range(1, AHEAD + 1) for i in range(bands) for j in range(bands)]
    times, codes = [], []
    for i, j, d in pairs:
        if n > d:
            codes.append(found[: n - d, i] << 16 | found[d:, j] << 8 | d)
            times.append(np.arange(n - d))
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media, payload, times, codes): one row for each row of ``docs``.

    media is the WAV file, payload its samples as read back from it, times and codes the fingerprint.
    A null or empty text is one block of zeros; equal texts give equal values; repeated rows and null
    doc_ids keep their rows; an empty table gives an empty one.
    """
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("times", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32()))]

    def run(ids: list, texts: list) -> dict:
        raw = [t.encode() for t in texts]
        media = [to_wav(r) for r in raw]
        read = [samples(m) for m in media]
        pairs = [landmarks(peaks(p)) for p in read]
        return {"doc_id": ids, "n_bytes": [len(r) for r in raw], "media": media, "payload": read, "times": [t for t, _ in pairs], "codes": [c for _, c in pairs]}

    ddl = "doc_id long, n_bytes long, media binary, payload binary, times array<int>, codes array<int>"
    return per_batch(id_and_text(docs, id_col, text_col), run, pa.schema(fields), ddl, rows=64)
