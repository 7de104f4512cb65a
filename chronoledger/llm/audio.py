"""Audio features of media columns: polyphase resampling, log-mel filterbanks, energy segments, fixed-shape tensors.

Media are WAV files of 8-bit mono PCM in a binary column. Features are computed from what is read back from them: the
samples are resampled 3/4 by a polyphase filter, cut into overlapping Hann windows, and their power spectra summed by
mel-spaced triangles; frames of high energy open a segment that stays open until the energy falls below a lower
threshold. Log-mel frames are stored as Arrow fixed-shape tensors of PATCH frames, each with its time span.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import buffers, slices

RATE, UP, DOWN, TAPS = 8000, 3, 4, 8
FRAME, HOP, MELS, PATCH = 256, 128, 24, 32
#: A payload is padded to a positive multiple of UNIT bytes by PAD.
UNIT, PAD = 576, b"\xff"


def _resampler() -> np.ndarray:
    """The prototype low-pass filter's phases as a matrix: from DOWN + TAPS inputs to UP outputs."""
    n = TAPS * UP
    t = np.arange(n) - (n - 1) / 2
    proto = np.sinc(t / max(UP, DOWN)) * np.hamming(n)
    proto *= UP / proto.sum()
    out = np.zeros((DOWN + TAPS, UP), np.float32)
    for y in range(UP):
        x0, phase = divmod(y * DOWN, UP)
        for j in range(TAPS):
            out[x0 + TAPS - 1 - j, y] = proto[phase + j * UP]
    return out


def _mel_bank() -> np.ndarray:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edge = 700 * (10 ** (np.linspace(mel(30), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FRAME // 2 + 1) * rate / FRAME
    up = (f[:, None] - edge[:-2]) / (edge[1:-1] - edge[:-2])
    down = (edge[2:] - f[:, None]) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


_FILTER, _BANK = _resampler(), _mel_bank()
_HANN = np.hanning(FRAME).astype(np.float32)


def wav(payload: bytes) -> bytes:
    """A WAV file of unsigned 8-bit mono samples."""
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 4 + len(fmt) + 8 + len(payload), b"WAVE") + fmt + struct.pack("<4sI", b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The bytes of a WAV file's data chunk."""
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return b""


def resampled(x: np.ndarray) -> np.ndarray:
    padded = np.concatenate((np.zeros(TAPS - 1, np.float32), x, np.zeros(DOWN + TAPS, np.float32)))
    steps = -(-len(x) // DOWN)
    view = np.lib.stride_tricks.sliding_window_view(padded, DOWN + TAPS)[: steps * DOWN : DOWN]
    return (view @ _FILTER).ravel()


def log_mel(x: np.ndarray) -> np.ndarray:
    """Frames x MELS; at least one frame, and every sample is in a frame (the last is padded by silence)."""
    x = np.pad(x, (0, max(FRAME - len(x), (FRAME - len(x)) % HOP)))
    view = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    parts = []
    for i in range(0, len(view), 4096):
        power = np.abs(np.fft.rfft(view[i : i + 4096] * _HANN, axis=1)).astype(np.float32) ** 2
        parts.append(np.log(power @ _BANK + 1e-6))
    return np.concatenate(parts)


def segments(mel: np.ndarray) -> np.ndarray:
    """(first frame, frame after the last) of each run that opens above the higher and closes below the lower threshold."""
    energy = mel.mean(1, dtype=np.float64)
    mid, dev = energy.mean(), energy.std()
    state = np.where(energy > mid + 0.5 * dev, 1, np.where(energy < mid - 0.25 * dev, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(known >= 0, state[known], 0)
    edge = np.diff(np.r_[0, on, 0])
    return np.column_stack((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))


def seconds(frame: np.ndarray) -> np.ndarray:
    return frame * (HOP * DOWN / (RATE * UP))


def tensors(mel: np.ndarray) -> bytes:
    """An Arrow stream: fixed-shape tensors (PATCH x MELS) with start_s and end_s; the last is padded by its least value."""
    n = -(-len(mel) // PATCH)
    full = np.full((n * PATCH, MELS), mel.min(), np.float32)
    full[: len(mel)] = mel
    start = np.arange(n) * PATCH
    batch = pa.record_batch(
        {
            "log_mel": pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, PATCH, MELS)),
            "start_s": pa.array(seconds(start)),
            "end_s": pa.array(seconds(np.minimum(start + PATCH, len(mel)))),
        }
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _encode(batches):
    for batch in slices(batches):
        data, off = buffers(batch["text"])
        raw = data.tobytes()
        out = []
        for a, b in zip(off, off[1:]):
            n = max(1, -(-(b - a) // UNIT)) * UNIT
            out.append(wav(raw[a:b] + PAD * int(n - (b - a))))
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].cast(pa.int64()), "n_bytes": pa.array(np.diff(off).astype(np.int64)), "media": pa.array(out, pa.binary())})


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's UTF-8 bytes, padded, as 8-bit samples of a WAV file."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


_FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, spans array<double>, tensors binary"


def _analyse(schema: pa.Schema):
    def run(batches):
        for batch in slices(batches, "media", 8 << 20):
            rows = []
            for media in batch["media"].to_pylist():
                media = media or b""
                payload = samples(media)
                mel = log_mel(resampled((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128))
                cut = segments(mel)
                coarse = np.round(mel * 16).astype(np.int16)
                levels = ",".join(map(str, np.round(mel.mean(0, dtype=np.float64) * 16).astype(int)))
                rows.append(
                    (
                        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(),
                        f"frames={len(mel)};segments={len(cut)};active={int((cut[:, 1] - cut[:, 0]).sum())};levels={levels};crc={zlib.crc32(coarse.tobytes()):08x}",
                        seconds(cut).ravel().tolist(), tensors(mel),
                    )
                )
            new = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)]
            kept = [batch[c] for c in batch.schema.names if c != "media"]
            yield pa.RecordBatch.from_arrays(kept + new, names=[c for c in batch.schema.names if c != "media"] + schema.names)

    return run


def audio_features(media: DataFrame) -> DataFrame:
    """Features of every WAV file in ``media`` (doc_id, n_bytes, media).

    payload_bytes, payload_sha256, tail_crc32 (of the last 32 payload bytes) and the features come from the bytes
    that the file holds. ``spans`` lists start and end seconds of the energy segments, ``tensors`` the log-mel
    patches. An empty or null text is one unit of padding; a null or foreign file has an empty payload and the
    features of silence. Repeated rows give repeated results, an empty table an empty result.
    """
    base = media.select("doc_id", "n_bytes", "media")
    kinds = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("spans", pa.list_(pa.float64())), ("tensors", pa.binary())])
    return base.mapInArrow(_analyse(kinds), "doc_id long, n_bytes long, " + _FEATURES)


def op9_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' texts as media: sizes, digests of what is read back, features, and the digest of the tensors."""
    found = audio_features(text_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.withColumn("tensors_sha256", F.sha2("tensors", 256)).withColumn("tensors_bytes", F.octet_length("tensors").cast("long")).drop("tensors")
