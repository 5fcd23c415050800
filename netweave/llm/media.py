"""Media columns: texts stored as WAV, read back, and fingerprinted by spectral peak pairs.

A payload becomes the 8-bit mono samples of a WAV file. Short-time Fourier transforms of its frames give a
spectrum per time; a frame's strongest bins are its peaks, and each peak is paired with peaks of the next
frames. A pair's hash holds both frequencies and their distance in time; the fingerprint is the array of
(time, hash), ordered by time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.common import id_and_text

#: Samples a frame and a second; bytes of padding make whole frames.
FRAME, RATE, PAD = 576, 8000, 255
#: Peaks of a frame, and the frames ahead in which a peak's partners lie.
PEAKS, AHEAD = 3, 3
#: Frames transformed at once.
CHUNK = 4096
_WINDOW = np.hanning(FRAME).astype(np.float32)


def to_wav(text: str | None) -> bytes:
    """A text's UTF-8 bytes, padded with byte 255 to a positive multiple of FRAME, as the samples of a WAV file."""
    raw = (text or "").encode()
    padded = raw + bytes([PAD]) * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw))
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(padded)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        return file.readframes(file.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """The bins of each frame's strongest peaks, ascending in strength, frames by PEAKS; ties go to the lower bin."""
    frames = np.frombuffer(samples, np.uint8).reshape(-1, FRAME)
    found = []
    for start in range(0, len(frames), CHUNK):
        block = (frames[start : start + CHUNK].astype(np.float32) - 128) * _WINDOW
        power = np.abs(np.fft.rfft(block, axis=1))[:, 1:-1]
        power = np.round(power, 3)
        best = np.argsort(-power, axis=1, kind="stable")[:, :PEAKS] if len(power) < 2 else _top(power)
        found.append(np.sort(best + 1, axis=1))
    return np.concatenate(found)


def _top(power: np.ndarray) -> np.ndarray:
    power = power.copy()
    rows = np.arange(len(power))
    best = []
    for _ in range(PEAKS):
        k = power.argmax(axis=1)
        best.append(k)
        power[rows, k] = -1
    return np.stack(best, axis=1)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, hashes) of all peak pairs, by time and then hash."""
    bins = peaks(samples).astype(np.int64)
    times, hashes = [], []
    for gap in range(1, AHEAD + 1):
        if len(bins) <= gap:
            break
        first, second = bins[:-gap, :, None], bins[gap:, None, :]
        pair = (first << 20 | second << 8 | gap).reshape(len(bins) - gap, -1)
        times.append(np.repeat(np.arange(len(bins) - gap), pair.shape[1]))
        hashes.append(pair.ravel())
    if not times:
        return np.arange(len(bins)).repeat(PEAKS), (bins << 20).ravel()
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, t))
    return t[order], h[order]


def media(text: Column) -> Column:
    """binary: the WAV file of each text; null is stored as the empty text."""

    @F.pandas_udf("binary")
    def wav(texts: pd.Series) -> pd.Series:
        return texts.map(to_wav)

    return wav(text)


def peak_pairs(media_col: Column) -> Column:
    """struct(times, hashes): the fingerprint of each WAV file as arrays in time order."""

    @F.pandas_udf("times array<int>, hashes array<long>")
    def pairs(files: pd.Series) -> pd.DataFrame:
        rows = [fingerprint(from_wav(m)) for m in files]
        return pd.DataFrame({"times": [t.astype(np.int32) for t, _ in rows], "hashes": [h for _, h in rows]})

    return pairs(media_col)


def facts(media_col: Column) -> Column:
    """What the stored files hold, from the files alone: the payload's digests and the fingerprint's."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    def read(files: pd.Series) -> pd.DataFrame:
        rows = []
        for m in files:
            samples = from_wav(m)
            t, h = fingerprint(samples)
            feature = f"{len(t)}:{hashlib.sha256(t.astype('<i4').tobytes() + h.astype('<i8').tobytes()).hexdigest()}"
            rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
        return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return read(media_col)


def media_facts(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, and what its stored WAV file gives back.

    ``feature`` is the number of peak pairs and the SHA-256 of their (time, hash) arrays. Null and empty texts
    are stored as one frame of padding. Equal texts give equal values; repeated rows give a row each. Both steps
    are narrow and work batch by batch.
    """
    rows = id_and_text(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), media(F.col("text")).alias("media"))
    return rows.select("doc_id", "n_bytes", facts(F.col("media")).alias("r")).select("doc_id", "n_bytes", "r.*")
