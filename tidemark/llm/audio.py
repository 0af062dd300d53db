"""Media columns: bytes stored as WAV samples, with spectral-peak pair fingerprints.

A clip is 8-bit mono PCM, written and read by the wave module, so each byte of a
payload is one sample and comes back unchanged. Features come from a short-time
Fourier transform (Hann window of WINDOW samples every HOP): in each band a bin
that is larger than the frame's mean by PEAK and than the same bin in the two
frames beside it is a peak, and each peak is paired with the next FAN peaks
within REACH frames. A pair is stored as one long: time (32 bits), distance (8),
first bin (8), second bin (8).
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import as_bytes, read_table, slices

BLOCK = 64
RATE = 8000
WINDOW, HOP = 256, 128
BANDS = (1, 8, 24, 56, 129)
PEAK, FAN, REACH = 3.0, 3, 63
#: Frames that are transformed at once.
FRAMES = 4096
#: Bytes of text whose clips are made at once.
SLICE_BYTES = 1 << 20

_HANN = np.hanning(WINDOW + 1)[:-1]


def pad(data: bytes) -> bytes:
    """Appends zero bytes up to a multiple of BLOCK, at least one block."""
    return data + bytes(-len(data) % BLOCK if data else BLOCK)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as file:
        file.setnchannels(1)
        file.setsampwidth(1)
        file.setframerate(RATE)
        file.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as file:
        if file.getnchannels() != 1 or file.getsampwidth() != 1:
            raise ValueError("not 8-bit mono")
        return file.readframes(file.getnframes())


def spectrum_peaks(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the peaks, by frame and bin."""
    samples = np.frombuffer(payload, np.uint8).astype(np.float64) - 128.0
    count = max(1, -(-max(0, len(samples) - WINDOW) // HOP) + 1)
    samples = np.concatenate([samples, np.zeros((count - 1) * HOP + WINDOW - len(samples))])
    frames = np.lib.stride_tricks.sliding_window_view(samples, WINDOW)[::HOP]
    times, bins = [], []
    for start in range(0, count, FRAMES):
        low, high = max(0, start - 1), min(count, start + FRAMES + 1)  # with a frame on each side
        size = np.abs(np.fft.rfft(frames[low:high] * _HANN, axis=1))
        rows = np.arange(min(FRAMES, count - start)) + start - low
        floor = PEAK * size.mean(axis=1)[rows]
        for first, last in zip(BANDS, BANDS[1:], strict=False):
            best = size[rows, first:last].argmax(axis=1) + first
            value = size[rows, best]
            before = np.where(rows > 0, size[rows - 1, best], -1.0)
            after = np.where(rows + 1 < high - low, size[np.minimum(rows + 1, high - low - 1), best], -1.0)
            keep = (value > floor) & (value > before) & (value >= after)
            times.append(rows[keep] + low)
            bins.append(best[keep])
    time, tone = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((tone, time))
    return time[order], tone[order]


def fingerprints(payload: bytes) -> np.ndarray:
    """Time-coded pairs of peaks as longs, by time."""
    time, tone = spectrum_peaks(payload)
    found = []
    for step in range(1, FAN + 1):
        gap = time[step:] - time[:-step]
        near = gap <= REACH
        found.append((time[:-step][near] << 32) | (gap[near] << 16) | (tone[:-step][near] << 8) | tone[step:][near])
    return np.sort(np.concatenate(found)).astype(np.int64)


def _lists(values: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat, pa.int64()))


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text's bytes as a WAV clip: (id, n_bytes, media). Cases are as for fingerprint_media."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE_BYTES):
            raw = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([to_wav(pad(data)) for data in raw], pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), as_bytes(text_col).alias("__text")).mapInArrow(store, f"`{id_col}` {kind}, n_bytes long, media binary")


def read_media(clips: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads clips back: the columns of store_media, payload, and fingerprints as an array of longs. Equal clips, equal values."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", SLICE_BYTES):
            payloads = [from_wav(media) for media in batch.column(2).to_pylist()]
            arrays = [*batch.columns, pa.array(payloads, pa.binary()), _lists([fingerprints(payload) for payload in payloads])]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_bytes", "media", "payload", "fingerprints"])

    kind = clips.schema[id_col].dataType.simpleString()
    return clips.select(id_col, "n_bytes", "media").mapInArrow(read, f"`{id_col}` {kind}, n_bytes long, media binary, payload binary, fingerprints array<long>")


def fingerprint_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a WAV clip, reads the clip back and fingerprints it, in one Python worker: (id, n_bytes, media, payload, fingerprints).

    A null or empty text is a clip of BLOCK zero samples, which has no peaks. A
    text of any length is one clip; its frames are transformed FRAMES at a time,
    and batches are cut to about SLICE_BYTES of text, so that besides one row
    little is held at once. Ties between equal bins go to the lowest, and of
    equal frames in a row the first is the peak. Rows stay one to one: a null id
    stays null, repeated rows stay repeated, and equal texts have equal values.
    Other columns are left out, so that none can clash. A table without rows
    gives none.
    """

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE_BYTES):
            raw = batch.column(1).to_pylist()
            media = [to_wav(pad(data)) for data in raw]
            payloads = [from_wav(clip) for clip in media]
            prints = _lists([fingerprints(payload) for payload in payloads])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary()), pa.array(payloads, pa.binary()), prints],
                names=[id_col, "n_bytes", "media", "payload", "fingerprints"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col), as_bytes(text_col).alias("__text"))
    return rows.mapInArrow(both, f"`{id_col}` {kind}, n_bytes long, media binary, payload binary, fingerprints array<long>")


def op9_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = fingerprint_media(read_table(spark, sf_dir, "documents"))
    return clips.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr(f"substring(payload, -{BLOCK}, {BLOCK})")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fingerprints").cast("string"), F.sha2(F.array_join(F.col("fingerprints").cast("array<string>"), ","), 256)).alias("feature"),
        "fingerprints",
    )
