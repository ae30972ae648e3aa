"""Media columns: bytes stored as WAV sound, read back, and spectral-peak fingerprints.

A payload becomes the samples of a mono 8-bit WAV file, written and read by the wave module. Of the samples read back,
a short-time Fourier transform (Hann window of FRAME samples, centred on every HOP-th sample and on the end; beyond both
ends the samples have their mean) gives a spectrum for each frame. In each band of BANDS the strongest bin is a peak if it
stands above the mean of its spectrum. Each peak is paired with the peaks of all bands in each of the next FAN frames; a
pair is stored as its time (the frame) and its code: both bins and the distance in frames.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm import common

UNIT, RATE, FRAME, HOP, FAN = 192, 8000, 256, 192, 2
#: Bounds of the bands, in bins of FRAME / 2 + 1; the lowest bins, of the mean, are left out.
BANDS = ((2, 32), (32, 129))
#: Frames that are transformed at once.
BLOCK = 4096
SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media binary,"
    " peak_times array<int>, peak_codes array<int>"
)


def payload(text: str | None) -> tuple[int, bytes]:
    data = (text or "").encode("utf-8")
    return len(data), data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


def write_wav(samples: bytes) -> bytes:
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(1)
            w.setframerate(RATE)
            w.writeframes(samples)
        return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def framed(samples: bytes) -> np.ndarray:
    """The frames, as rows. No sample is further than HOP / 2 from the centre of a frame, so the window hides none."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    n = -(-len(x) // HOP) + 1
    x = np.pad(x, (FRAME // 2, (n - 1) * HOP + FRAME // 2 - len(x)), constant_values=x.mean() if len(x) else 0)
    return np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]


def peaks(samples: bytes) -> np.ndarray:
    """The strongest bin of each band in each frame, or -1; a row for each frame."""
    frames = framed(samples)
    window, found = np.hanning(FRAME).astype(np.float32), np.empty((len(frames), len(BANDS)), np.int32)
    for at in range(0, len(frames), BLOCK):
        spectrum = np.abs(np.fft.rfft(frames[at : at + BLOCK] * window, axis=1))
        mean = spectrum[:, BANDS[0][0] :].mean(axis=1)
        for b, (low, high) in enumerate(BANDS):
            best = spectrum[:, low:high].argmax(axis=1)
            height = spectrum[np.arange(len(best)), low + best]
            found[at : at + BLOCK, b] = np.where(height > mean + 1e-3, low + best, -1)
    return found


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times and codes of the peak pairs, by time."""
    p = peaks(samples)
    times, codes = [], []
    for dt in range(1, FAN + 1):
        for b, c in np.ndindex(len(BANDS), len(BANDS)):
            anchor, other = p[:-dt, b], p[dt:, c]
            t = np.flatnonzero((anchor >= 0) & (other >= 0))
            times.append(t)
            codes.append((anchor[t] << 16) | (other[t] << 4) | dt)
    times, codes = np.concatenate(times).astype(np.int32), np.concatenate(codes).astype(np.int32)
    order = np.lexsort((codes, times))
    return times[order], codes[order]


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its WAV file (media), figures of the payload as read back from it, and its fingerprint.

    A null text is an empty one; an empty payload is one unit of spaces. Equal texts give equal values. Rows that repeat
    each get a row, a null id stays null, other columns are not read, and an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = {n: [] for n in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media", "peak_times", "peak_codes")}
            for text in batch.column("text").to_pylist():
                n, data = payload(text)
                media = write_wav(data)
                back = read_wav(media)
                times, codes = fingerprint(back)
                values = n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), media, times, codes
                for column, value in zip(out.values(), values, strict=True):
                    column.append(value)
            return out | {"doc_id": batch.column("doc_id")}

        return work

    return common.map_batches(rows, make, SCHEMA)


def digests(media: DataFrame) -> DataFrame:
    """The digest columns of what media_columns() returns; feature: the number of peak pairs and a digest of them."""
    feature = F.concat(F.size("peak_codes").cast("string"), F.lit(":"), F.sha2(F.concat_ws(";", F.col("peak_times").cast("string"), F.col("peak_codes").cast("string")), 256))
    return media.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature")
    )
