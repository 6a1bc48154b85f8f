"""Audio features of media columns (operator 5).

A payload is kept as 8-bit PCM in a WAV container (``media_column``), which is
written to the shared folder. The features are computed from the stored bytes,
read back: polyphase resampling to ``TARGET`` Hz, overlapped log-mel filterbanks,
and segments of energy with hysteresis (``audio_features``). Frames are kept in
patches of ``PATCH`` x ``MELS`` values as an Arrow fixed-shape tensor column, each
with its time span, in an Arrow stream per row, so that any Arrow reader gets
tensors of one shape whatever the length of the audio. ``digests`` describes such
rows from their own media, tensors and segments.

Defined cases: a null text is an empty text; a payload is padded with bytes 255
to a positive multiple of ``UNIT``; the last patch is padded with the silence
floor; equal payloads give equal values; repeated rows give repeated results; an
empty table gives an empty one; other columns are not read, whatever their names.
Rows are taken by about ``SLICE_BYTES`` at a time and frames in blocks, so memory is
in proportion to the longest sound's samples, tensors included.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache
from math import gcd

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .session import stored, table
from .textbytes import release, row_slices

UNIT = 576
SOURCE, TARGET = 16_000, 12_000
FRAME, HOP, FFT = 300, 120, 512
MELS, PATCH = 32, 32
FLOOR = -10.0
#: Hysteresis about the mean log energy: a segment starts above the first and ends below the second.
ENTER, LEAVE = 0.25, -0.25
_BLOCK = 4096


def payload(text: bytes) -> bytes:
    """The text's bytes with bytes 255 up to a positive multiple of ``UNIT``."""
    return text + b"\xff" * (-len(text) % UNIT or (UNIT if not text else 0))


def to_wav(samples: bytes, rate: int = SOURCE) -> bytes:
    """Unsigned 8-bit mono PCM in a WAV container, losslessly."""
    pad = b"\0" * (len(samples) % 2)
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples + pad


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate of a WAV container with 8-bit mono PCM."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV container")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (kind, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif name == b"data":
            return media[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@cache
def resampling_filter(up: int, down: int, half: int = 8) -> np.ndarray:
    """A Kaiser-windowed low-pass filter with ``2 * half * max(up, down) + 1`` taps."""
    span = half * max(up, down)
    n = np.arange(-span, span + 1)
    h = np.sinc(n / max(up, down)) * np.kaiser(2 * span + 1, 6.0)
    return (h / h.sum() * up).astype(np.float32)


def resample(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Polyphase resampling: each output phase has its own part of the filter, and no zero is multiplied."""
    up, down = target // gcd(source, target), source // gcd(source, target)
    if up == down:
        return x.astype(np.float32)
    h = resampling_filter(up, down)
    span = len(h) // 2
    n_out = -(-len(x) * up // down)
    side = span // up + 1
    padded = np.concatenate([np.zeros(side, np.float32), x.astype(np.float32), np.zeros(side + down + 1, np.float32)])
    out = np.zeros(n_out, np.float32)
    for r in range(min(up, n_out)):
        # Output r + up * t is centred on position (r + up * t) * down of the signal with zeros put in.
        count = len(range(r, n_out, up))
        centre = r * down
        first = -(-(centre - span) // up)
        total = np.zeros(count, np.float32)
        for i in range(first, (centre + span) // up + 1):
            weight = h[centre - i * up + span]
            start = i + side
            total += weight * padded[start : start + down * (count - 1) + 1 : down]
        out[r::up] = total
    return out


@cache
def mel_filters(rate: int = TARGET) -> np.ndarray:
    """Triangular filters of equal width on the mel scale, one column each."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edges = (700 * (10 ** (mel / 2595) - 1)) / rate * FFT
    bins = np.arange(FFT // 2 + 1)[:, None]
    rise = (bins - edges[:-2]) / np.maximum(edges[1:-1] - edges[:-2], 1e-9)
    fall = (edges[2:] - bins) / np.maximum(edges[2:] - edges[1:-1], 1e-9)
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_HANN = np.hanning(FRAME).astype(np.float32)


def log_mel(x: np.ndarray) -> np.ndarray:
    """Log-mel energies of overlapped frames; the last frame is padded with silence."""
    n = max(1, -(-(len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)]) if len(x) < (n - 1) * HOP + FRAME else x
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    parts = []
    for a in range(0, n, _BLOCK):
        spectrum = np.fft.rfft(frames[a : min(n, a + _BLOCK)] * _HANN, FFT)
        power = spectrum.real**2 + spectrum.imag**2
        parts.append(np.log(np.maximum(power @ mel_filters(), np.float32(np.exp(FLOOR)))))
    return np.concatenate(parts).astype(np.float32)


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges that rise above the mean by ``ENTER`` and have not yet fallen below it by ``LEAVE``."""
    centred = energy - energy.mean()
    mark = np.where(centred > ENTER, 1, np.where(centred < LEAVE, 0, -1))
    last = np.maximum.accumulate(np.where(mark >= 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last], 0) == 1
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


_TENSOR = pa.fixed_shape_tensor(pa.float32(), [PATCH, MELS])
_STREAM = pa.schema([("tensor", _TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64())])


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream of fixed-shape tensors with time spans."""
    n = -(-len(mel) // PATCH)
    filled = np.full((n * PATCH, MELS), FLOOR, np.float32)
    filled[: len(mel)] = mel
    start = np.arange(n) * PATCH * HOP / TARGET
    end = (np.minimum(np.arange(1, n + 1) * PATCH, len(mel)) - 1) * HOP / TARGET + FRAME / TARGET
    column = pa.FixedShapeTensorArray.from_storage(_TENSOR, pa.FixedSizeListArray.from_arrays(pa.array(filled.ravel()), PATCH * MELS))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _STREAM) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([column, pa.array(start), pa.array(end)], schema=_STREAM))
    return sink.getvalue().to_pybytes()


def read_tensors(stream: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tensors ``(n, PATCH, MELS)`` and their starts and ends, from the stored stream."""
    found = pa.ipc.open_stream(stream).read_all().combine_chunks()
    column = found["tensor"].chunk(0)
    return column.to_numpy_ndarray(), found["start_s"].to_numpy(), found["end_s"].to_numpy()


def analyse(media: bytes) -> dict:
    """Tensors, segments with time spans, and the number of frames of a stored sound."""
    samples, rate = from_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    mel = log_mel(resample(x, rate, TARGET))
    found = segments(mel.mean(axis=1))
    return {"frames": len(mel), "tensors": tensors(mel), "segments": [{"start_s": a * HOP / TARGET, "end_s": ((b - 1) * HOP + FRAME) / TARGET} for a, b in found]}


_SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))


def _mapped(rows: DataFrame, body: str, schema: pa.Schema, columns: str, made) -> DataFrame:
    """``made`` of every row (a dictionary of its other columns, ``body`` as bytes), a bounded number of bytes at a time; the first column stays."""
    first = rows.schema.fields[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.names.index(body)
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
            for a, b in row_slices(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])):
                part = batch.slice(a, b - a)
                found = pa.Table.from_pylist([made(x) for x in part.drop_columns([first.name]).to_pylist()], schema).combine_chunks()
                yield pa.RecordBatch.from_arrays([part.column(0), *(c.chunk(0) for c in found.columns)], names=[first.name, *schema.names])
        release()

    return rows.mapInArrow(run, f"`{first.name}` {first.dataType.simpleString()}, {columns}")


def media_column(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_bytes, media)``: every text's payload as sound."""

    def row(x: dict) -> dict:
        text = x["__text"] or b""
        return {"n_bytes": len(text), "media": to_wav(payload(text))}

    source = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("__text"))
    return _mapped(source, "__text", pa.schema([("n_bytes", pa.int64()), ("media", pa.binary())]), "n_bytes long, media binary", row)


def audio_features(media: DataFrame) -> DataFrame:
    """``(id, n_bytes, media, frames, tensors, segments)`` of rows ``(id, n_bytes, media)``."""
    schema = pa.schema([("n_bytes", pa.int64()), ("media", pa.binary()), ("frames", pa.int64()), ("tensors", pa.binary()), ("segments", _SPANS)])
    columns = "n_bytes long, media binary, frames long, tensors binary, segments array<struct<start_s: double, end_s: double>>"
    return _mapped(media, "media", schema, columns, lambda x: x | analyse(x["media"]))


def describe(row: dict) -> dict:
    """The digest columns of one row of features."""
    back, _ = from_wav(row["media"])
    values, starts, ends = read_tensors(row["tensors"])
    mean = values.reshape(-1, MELS)[: row["frames"]].mean(axis=0, dtype=np.float64)
    active = sum(s["end_s"] - s["start_s"] for s in row["segments"])
    return {
        "n_bytes": row["n_bytes"],
        "payload_bytes": len(back),
        "payload_sha256": hashlib.sha256(back).hexdigest(),
        "tail_crc32": zlib.crc32(back[-32:]),
        "media_bytes": len(row["media"]),
        "media_sha256": hashlib.sha256(row["media"]).hexdigest(),
        "feature": f"frames={row['frames']} tensors={len(values)} span={starts[0]:.3f}-{ends[-1]:.3f} segments={len(row['segments'])} active={active:.3f} mel=" + ",".join(f"{v:.3f}" for v in mean[::4]),
    }


def digests(features: DataFrame) -> DataFrame:
    """The digest columns of rows of features."""
    schema = pa.schema([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    return _mapped(features, "media", schema, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", describe)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(media_column(table(spark, sf_dir, "documents")), "media")
    return digests(audio_features(media))
