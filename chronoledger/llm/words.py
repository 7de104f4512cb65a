"""Words, shingles and hashes of whole texts as numpy arrays over Arrow buffers.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, which equals ``[^\\x20\\x09-\\x0D]+`` on the text,
since in UTF-8 these bytes stand for nothing else. A word's hash is a chain of bijective mixes over its eight-byte
pieces or, of words over LONG bytes, a BLAKE2b digest; two independent halves give 128 bits.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard

U = np.uint64
LONG = 64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_MASK = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], np.uint64)
#: Factors of a window's hash, by half.
_FACTORS = (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective 64-bit mixer (the finaliser of splitmix64)."""
    x = x + U((0x9E3779B97F4A7C15 * (salt + 1)) & (2**64 - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary array; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_string() if "string" in str(column.type) else pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def release() -> None:
    """Gives memory that is free in this process back to the machine."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``limit`` bytes of text, or one longer row.

    After each batch the worker hands freed memory back: it outlives its task and serves other stages.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffers(batch[column])
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
            yield batch.slice(lo, min(hi, batch.num_rows) - lo)
            lo = hi
        batch = None
        release()


def ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and null mask of an integer column; null sorts after every value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    null = np.asarray(column.is_null())
    return np.asarray(column.cast(pa.int64()).fill_null(2**63 - 1)), null


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``data`` and, by document, the offsets (n + 1) into these."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    before = np.empty_like(solid)
    before[:1] = False
    before[1:] = solid[:-1]
    after = np.empty_like(solid)
    after[-1:] = False
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False, half: int = 0) -> np.ndarray:
    """One half (0 or 1) of each word's 128-bit hash; ``fold`` lower-cases A-Z."""
    out, size, step = np.empty(len(starts), np.uint64), ends - starts, 1 << 18
    padded = np.append(_FOLD[data] if fold else data, np.zeros(8, np.uint8))
    lanes = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    for lo in range(0, len(starts), step):
        s, n = starts[lo : lo + step], size[lo : lo + step]
        h, on, at = mix(n.astype(np.uint64), 3 + half), np.arange(len(s)), 0
        while len(on):
            h[on] = mix(h[on] ^ (lanes[s[on] + at] & _MASK[np.minimum(n[on] - at, 8)]), 5 + half)
            at += 8
            on = np.flatnonzero((n > at) & (n <= LONG))
        out[lo : lo + step] = h
    for i in np.flatnonzero(size > LONG).tolist():
        digest = hashlib.blake2b(padded[starts[i] : ends[i]], digest_size=16).digest()
        out[i] = int.from_bytes(digest[8 * half : 8 * half + 8], "little")
    return out


def windows(hashes: np.ndarray, k: int, half: int = 0) -> np.ndarray:
    """A hash of each run of ``k`` hashes, without regard to documents; halves from halves."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, factor = np.zeros(n, np.uint64), 1
    for j in range(k):
        out += hashes[j : n + j] * U(factor)
        factor = factor * _FACTORS[half] % 2**64
    return mix(out, 7 + half)


def within(word_off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and document of each window of ``k`` words that lies in one document."""
    counts = np.maximum(np.diff(word_off) - k + 1, 0)
    doc = np.repeat(np.arange(len(counts)), counts)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    return np.arange(len(doc)) - np.repeat(first - word_off[:-1], counts), doc


_zip, _unzip = None, None


def pack(values: np.ndarray) -> bytes:
    """Ascending unsigned numbers as differences, byte plane by byte plane, compressed."""
    global _zip
    _zip = _zip or zstandard.ZstdCompressor(level=1)
    v = np.asarray(values, np.uint64)
    step = np.diff(v, prepend=U(0)).view(np.uint8).reshape(-1, 8)
    return _zip.compress(np.ascontiguousarray(step.T).tobytes())


def unpack(data: bytes) -> np.ndarray:
    global _unzip
    _unzip = _unzip or zstandard.ZstdDecompressor()
    planes = np.frombuffer(_unzip.decompress(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def pack_plain(values: np.ndarray) -> bytes:
    """Any int64 values, byte plane by byte plane, compressed."""
    global _zip
    _zip = _zip or zstandard.ZstdCompressor(level=1)
    return _zip.compress(np.ascontiguousarray(np.asarray(values, np.int64).view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_plain(data: bytes) -> np.ndarray:
    global _unzip
    _unzip = _unzip or zstandard.ZstdDecompressor()
    return np.ascontiguousarray(np.frombuffer(_unzip.decompress(data), np.uint8).reshape(8, -1).T).view(np.int64).ravel()
