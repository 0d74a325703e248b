"""Media columns: 8-bit WAV sounds in a binary column, and spectral-peak fingerprints of them.

Sounds are read and written by the wave module. A sound's short-time Fourier transform (frames of 384 samples, 192
apart, Hann window) gives the strongest bin in each of four bands of every frame; those that are the strongest of
their band for three frames either way are peaks. Each peak is paired with the next ones in up to 24 frames, and a
pair is one long: time << 32 | first bin << 20 | second bin << 8 | time between.
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
from pyspark.sql import functions as F

from quarry.llm.common import blobs, lean, small_batches, steps, with_fields, work_dir

FRAME, HOP, RATE = 384, 192, 8000
#: First bins of the bands, and the end.
BANDS = (2, 12, 36, 90, 193)
#: Frames either way in which a peak is the strongest, later peaks that one is paired with, frames between at most.
REACH, FAN, SPAN = 3, 4, 24
#: Frames that are transformed at once; bytes of sounds that are handed on together.
STEP, HELD = 4096, 4 << 20


def encode_wav(payload: bytes, rate: int = RATE) -> bytes:
    """Bytes as the samples of an 8-bit mono WAV file."""
    with io.BytesIO() as out:
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, rate, 0, "NONE", "not compressed"))
            w.writeframes(payload)
        return out.getvalue()


def decode_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not an 8-bit mono WAV")
        return w.readframes(w.getnframes())


def pad(data: bytes, multiple: int = 192, fill: int = 32) -> bytes:
    """Data with fill bytes up to a positive multiple."""
    return data + bytes([fill]) * (max(1, -(-len(data) // multiple)) * multiple - len(data))


_window = np.hanning(FRAME).astype(np.float32)


def spectrum_peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Frame and bin of each peak, by frame and bin."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    n = max(1, -(-len(x) // HOP))
    x = np.concatenate((x, np.zeros(n * HOP + FRAME - HOP - len(x), np.float32)))
    frames = np.lib.stride_tricks.as_strided(x, (n, FRAME), (4 * HOP, 4))
    best, size = np.empty((n, len(BANDS) - 1), np.int64), np.empty((n, len(BANDS) - 1), np.float32)
    for at in range(0, n, STEP):
        f = np.fft.rfft(frames[at : at + STEP] * _window, axis=1)
        power = f.real**2 + f.imag**2
        for k, (a, b) in enumerate(zip(BANDS, BANDS[1:], strict=False)):
            own = power[:, a:b].argmax(axis=1)
            best[at : at + STEP, k] = own + a
            size[at : at + STEP, k] = power[np.arange(len(own)), own + a]
    top = size.copy()
    for d in range(1, REACH + 1):
        top[d:] = np.maximum(top[d:], size[:-d])
        top[:-d] = np.maximum(top[:-d], size[d:])
    when, band = np.nonzero((size >= top) & (size > 1))
    return when, best[when, band]


def fingerprint(samples: bytes) -> np.ndarray:
    """Time-coded peak pairs, ascending by first peak and then by second."""
    when, where = spectrum_peaks(samples)
    pairs = []
    for k in range(1, FAN + 1):
        gap = when[k:] - when[:-k]
        ok = gap <= SPAN
        pairs.append((np.flatnonzero(ok), ((when[:-k] << 32) | (where[:-k] << 20) | (where[k:] << 8) | gap)[ok]))
    order = np.argsort(np.concatenate([p[0] for p in pairs]), kind="stable")
    return np.concatenate([p[1] for p in pairs])[order]


def to_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text column by `n_bytes` and `media`: its UTF-8 bytes, padded with spaces, as a WAV file.

    A null text counts as empty, and an empty one gives one block of 192 samples. Other columns pass through unchanged,
    own ones named n_bytes or media are replaced; repeated rows stay; an empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in (text, "n_bytes", "media")]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [t or b"" for t in blobs(batch.column("text"))]
            for i, j in steps(data, HELD):
                own = data[i:j]
                yield pa.RecordBatch.from_arrays([batch.column("rest").slice(i, j - i), pa.array([len(d) for d in own], pa.int64()), pa.array([encode_wav(pad(d)) for d in own], pa.binary())], ["rest", "n_bytes", "media"])

    laid = docs.select(F.col(text).alias("text"), F.struct(*others).alias("rest") if others else F.lit(0).alias("rest"))
    done = laid.mapInArrow(lean(make), with_fields([laid.schema["rest"]], "n_bytes long, media binary"))
    return done.select(*[F.col(f"rest.`{c}`").alias(c) for c in others], "n_bytes", "media")


def store_media(sounds: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes a table with a media column as Parquet, in a folder that all machines share, and returns what is read from it.

    Nulls, repeated rows and all columns stay as they are; an empty table is stored as an empty one.
    """
    folder = folder or work_dir(sounds.sparkSession, "media")
    sounds.write.option("compression", "zstd").parquet(folder)
    return sounds.sparkSession.read.schema(sounds.schema).parquet(folder)


def analyse_media(sounds: DataFrame, media: str = "media") -> DataFrame:
    """Replaces a WAV column by what is read back from it and its fingerprint.

    Adds `payload_bytes`, `payload_sha256`, `tail_crc32` (last 16 bytes), `media_bytes`, `media_sha256`, `prints`
    (array of longs) and `feature`, a digest of them. A null sound gives nulls; equal sounds give equal values; other
    columns pass through, own ones with these names are replaced; an empty table gives an empty one.
    """
    small_batches(sounds.sparkSession)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "prints", "feature"]
    others = [c for c in sounds.columns if c not in (media, *names)]

    def one(m: bytes | None) -> tuple:
        if m is None:
            return (None,) * 7
        payload = decode_wav(m)
        prints = fingerprint(payload)
        feature = f"{len(payload) // HOP}:{len(prints)}:{hashlib.sha1(prints.astype('<i8').tobytes()).hexdigest()}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), prints, feature

    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sounds = blobs(batch.column("media"))
            for i, j in steps(sounds, HELD):
                columns = list(zip(*map(one, sounds[i:j]), strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("rest").slice(i, j - i), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], ["rest", *names])

    laid = sounds.select(F.col(media).alias("media"), F.struct(*others).alias("rest") if others else F.lit(0).alias("rest"))
    schema = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, prints array<long>, feature string"
    done = laid.mapInArrow(lean(look), with_fields([laid.schema["rest"]], schema))
    return done.select(*[F.col(f"rest.`{c}`").alias(c) for c in others], *names)
