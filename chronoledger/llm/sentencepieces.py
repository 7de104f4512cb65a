"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here (pieces with scores and types, trainer and normaliser settings) and rebuilt as a
tokenizers pipeline: the precompiled normaliser, the metaspace marker, a unigram model with its scores or a BPE model
with merges ranked by them, and byte fallback. A probe set is encoded by the sentencepiece library too and must agree.
Pieces that no text may match (control, unknown, unused, bytes) stand in a unigram vocabulary under names that hold a
space, which the normaliser leaves in no text; what no piece covers falls back to bytes after the model.

No piece joins a non-marker to a following marker, so a text falls into chunks (a run of spaces and what follows)
that are encoded independently; each batch encodes its distinct chunks once, multithreaded, and puts the ids together.
"""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import U, buffers, hashed, release, slices

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Values of the model format: piece types and model types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: The text that stands for an unknown piece when decoding.
UNKNOWN_TEXT = " ⁇ "
#: Distinct chunks that a worker remembers before it starts afresh.
REMEMBERED = 600_000


def _fields(data: bytes):
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack_from("<f" if n == 4 else "<d", data, at)[0]
            at += n


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    @property
    def unk_id(self) -> int:
        return self.types.index(UNKNOWN)


def parse(data: bytes) -> Model:
    """A model from the bytes of its protobuf."""
    out = Model()
    for number, value in _fields(data):
        if number == 1:
            piece = dict(_fields(value))
            out.pieces.append(piece.get(1, b"").decode())
            out.scores.append(piece.get(2, 0.0))
            out.types.append(piece.get(3, NORMAL))
        elif number == 2:
            spec = dict(_fields(value))
            out.model_type, out.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
        elif number == 3:
            spec = dict(_fields(value))
            out.charsmap, out.dummy_prefix = spec.get(2, b""), bool(spec.get(3, 1))
            out.remove_extra, out.escape = bool(spec.get(4, 1)), bool(spec.get(5, 1))
    return out


def build(model: Model):
    """The tokenizers pipeline of a model."""
    from tokenizers import Regex, Tokenizer, models, normalizers

    if USER_DEFINED in model.types:
        raise ValueError("models with user-defined pieces are not supported")
    if model.model_type == UNIGRAM:
        if not model.escape:
            raise ValueError("unigram models that keep spaces are not supported")
        # A score of 0 leaves alone the least score, from which that of an unknown character derives.
        vocab = [(p, x) if t == NORMAL else (f"{i} {p}", 0.0) for i, (p, x, t) in enumerate(zip(model.pieces, model.scores, model.types))]
        core = models.Unigram(vocab, model.unk_id, False)
    elif model.model_type == BPE:
        vocab = {p: i for i, p in enumerate(model.pieces)}
        usable = {p for p, t in zip(model.pieces, model.types) if t in (NORMAL, USER_DEFINED, UNUSED)}
        merges = []
        for p, score, kind in zip(model.pieces, model.scores, model.types):
            if kind == NORMAL:
                ways = [(p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]
                merges += [(-score, vocab[a], vocab[b], a, b) for a, b in ways]
        merges.sort()
        core = models.BPE(vocab=vocab, merges=[(a, b) for *_, a, b in merges], unk_token=model.pieces[model.unk_id], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.model_type} is neither unigram nor BPE")
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra:
        steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out = Tokenizer(core)
    if steps:
        out.normalizer = normalizers.Sequence(steps)
    return out


PROBES = ("", " ", "Hello world", "  two  spaces ", "line\nline\n\n", "café naïve 中文 \U0001f600", "<s> </s> <unk> <0x0A>", "a▁b", "tab\there 12,345.67", "é́̀ x́")


def check_parity(data: bytes, texts: tuple[str, ...] = PROBES) -> None:
    """Raises where the rebuilt pipeline and the sentencepiece library disagree on ids."""
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = Codec(data)
    for text, ours in zip(texts, codec.encode(pa.array(texts, pa.string())).to_pylist()):
        if ours != (want := theirs.encode(text)):
            raise ValueError(f"ids of {text!r} differ: {ours} and {want}")


class Codec:
    """Encodes and decodes columns of texts."""

    def __init__(self, data: bytes):
        self.model = parse(data)
        self.pipeline = build(self.model)
        m = self.model
        # Chunks need: no normaliser but the marker, and no piece with a marker (or newline) behind something else.
        inner = any(MARK in p.lstrip(MARK) for p, t in zip(m.pieces, m.types) if t == NORMAL)
        plain = {p for p, t in zip(m.pieces, m.types) if t == NORMAL}
        self.chunked = MARK in plain and not inner and not m.charsmap and not m.remove_extra and m.dummy_prefix and m.escape
        self.fallback = {int(p[3:5], 16): i for i, (p, t) in enumerate(zip(m.pieces, m.types)) if t == BYTE} if m.model_type == UNIGRAM and m.byte_fallback else {}
        # A newline is a chunk's edge if it is known: unknown characters in a row are one unknown piece.
        self.newline = (m.byte_fallback or "\n" in plain) and not any("\n" in p and len(p) > 1 for p in m.pieces)
        out = []
        for p, t in zip(m.pieces, m.types):
            out.append(bytes([int(p[3:5], 16)]) if t == BYTE else UNKNOWN_TEXT.encode() if t == UNKNOWN else b"" if t == CONTROL else p.replace(MARK, " ").encode())
        self._size = np.array([len(x) for x in out], np.int64)
        self._at = np.cumsum(self._size) - self._size
        self._bytes = np.frombuffer(b"".join(out), np.uint8)
        self._forget()

    def _ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # The fast form keeps no surfaces, which bytes are made from.
        encode = self.pipeline.encode_batch if self.fallback else self.pipeline.encode_batch_fast
        encodings = encode(texts, add_special_tokens=False)
        found = [x.ids for x in encodings]
        if self.fallback:
            unknown = self.model.unk_id
            found = [self._with_bytes(x) if unknown in ids else ids for x, ids in zip(encodings, found)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(size.sum())), size

    def _with_bytes(self, encoding) -> list[int]:
        """Ids with what no piece covers as bytes."""
        out: list[int] = []
        for i, token in zip(encoding.ids, encoding.tokens):
            out += [self.fallback[b] for b in token.encode()] if i == self.model.unk_id else [i]
        return out

    def _look_up(self, keys: np.ndarray, other: np.ndarray, chunks) -> tuple[np.ndarray, np.ndarray] | None:
        """Where in ``_flat`` each distinct chunk's ids are and how many; ``chunks`` gives (bytes, leads a text) of new ones.
        None if a key is known with another second half."""
        if len(self._known) > REMEMBERED:
            self._forget()
        at = np.searchsorted(self._known, keys)
        new = np.flatnonzero(self._known[np.minimum(at, len(self._known) - 1)] != keys) if len(self._known) else np.arange(len(keys))
        if len(new):
            begin, size = self._chunk_ids(chunks(new))
            known = np.concatenate((self._known, keys[new]))
            order = np.argsort(known, kind="stable")
            self._known, self._other = known[order], np.concatenate((self._other, other[new]))[order]
            self._begin, self._count = np.concatenate((self._begin, begin))[order], np.concatenate((self._count, size))[order]
            at = np.searchsorted(self._known, keys)
        return (self._begin[at], self._count[at]) if (self._other[at] == other).all() else None

    def _forget(self) -> None:
        self._known, self._other, self._begin, self._count = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._flat = np.array([self.model.pieces.index(MARK) if self.chunked else self.model.unk_id], np.int32)

    def _chunk_ids(self, chunks: list[tuple[bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """Encodes chunks into ``_flat``. The pipeline sets a marker before each: before a text's first chunk as it
        should; elsewhere it is the chunk's own first space, or (behind a newline) has to be kept away."""
        pick, cut, lone = [], [], []
        for i, (chunk, lead) in enumerate(chunks):
            if lead:
                pick.append(chunk.decode())
            elif chunk[0] == 32:
                pick.append(chunk[1:].decode() or "\n")
                if len(chunk) == 1:
                    lone.append(i)
            else:
                pick.append("\n" + chunk.decode())
                cut.append(i)
        prefix = len(self._ids(["\n"])[0])
        flat, size = self._ids(pick)
        begin = np.cumsum(size) - size + len(self._flat)
        begin[cut] += prefix
        size[cut] -= prefix
        begin[lone], size[lone] = 0, 1
        self._flat = np.append(self._flat, flat)
        return begin, size

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """Ids of each text; null and empty texts have none."""
        data, off = buffers(texts)
        raw = data.tobytes()
        if not self.chunked or MARK.encode() in raw:
            return self._whole(raw, off)
        space = data == 32
        start = space.copy()
        start[1:] &= ~space[:-1]
        if self.newline:
            line = data == 10
            start |= line
            start[1:] |= line[:-1]
        first = off[:-1][np.diff(off) > 0]
        start[first] = True
        at = np.flatnonzero(start)
        end = np.append(at[1:], len(data))
        lead = np.zeros(len(at), bool)
        lead[np.searchsorted(at, first)] = True
        key = hashed(data, at, end) ^ np.where(lead, U(0x5851F42D4C957F2D), U(0))
        other = hashed(data, at, end, half=1)
        distinct, which, inverse = np.unique(key, return_index=True, return_inverse=True)
        found = None
        if (other[which][inverse] == other).all():
            found = self._look_up(distinct, other[which], lambda m: [(raw[a:b], c) for a, b, c in zip(at[which[m]].tolist(), end[which[m]].tolist(), lead[which[m]].tolist())])
        if found is None:  # chunks that differ share half a key
            return self._whole(raw, off)
        begin, size = found
        flat = self._flat
        n = size[inverse]
        total = np.cumsum(n)
        ids = flat[np.repeat(begin[inverse] - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)]
        cut = np.concatenate(([0], total))[np.searchsorted(at, off)]
        return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(ids))

    def _whole(self, raw: bytes, off: np.ndarray) -> pa.ListArray:
        flat, size = self._ids([raw[a:b].decode() for a, b in zip(off, off[1:])])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(flat))

    def decode(self, ids: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of the texts of each list of ids."""
        flat, off = np.asarray(ids.flatten()), np.asarray(ids.offsets).astype(np.int64)
        off = off - off[0]
        n = self._size[flat]
        total = np.cumsum(n)
        data = self._bytes[np.repeat(self._at[flat] - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)]
        cut = np.concatenate(([0], total))[off]
        if self.model.dummy_prefix:  # the marker that was set before each text goes
            lead = cut[:-1][np.diff(cut) > 0]
            lead = lead[data[lead] == 32]
            keep = np.ones(len(data), bool)
            keep[lead] = False
            cut = cut - np.searchsorted(lead, cut)
            data = data[keep]
        return data, cut


_codecs: dict[bytes, Codec] = {}


def _codec(data: bytes) -> Codec:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
    if data not in _codecs:
        _codecs[data] = Codec(data)
    return _codecs[data]


def encoded(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip (the ids decode to the text) of every row.

    Takes doc_id and text; other columns are ignored. Null and empty texts have no ids and round-trip. Repeated rows
    give repeated results; an empty table gives an empty result. The model's bytes travel with the function.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    check_parity(data)

    def run(batches):
        codec = _codec(data)
        for batch in slices(batches, limit=1 << 20):
            ids = codec.encode(batch["text"])
            raw, off = buffers(batch["text"])
            back, cut = codec.decode(ids)
            same = [np.array_equal(raw[a:b], back[c:d]) for a, b, c, d in zip(off, off[1:], cut, cut[1:])]
            size = np.diff(np.asarray(ids.offsets)).astype(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].cast(pa.int64()), "n_tokens": pa.array(size), "ids": ids, "round_trip": pa.array(same, pa.bool_())})
        codec._forget()
        release()

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decoded(tokens: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id and text of rows that hold ids; other columns are ignored.

    Null and empty ids give the empty text, bytes that are not UTF-8 the replacement character. Repeated rows give
    repeated results, an empty table an empty result; an id beyond the vocabulary or null within a list is an error.
    """
    with open(model_path, "rb") as f:
        data = f.read()

    def run(batches):
        codec = _codec(data)
        for batch in batches:
            ids = batch["ids"].fill_null([]) if batch["ids"].null_count else batch["ids"]
            raw, cut = codec.decode(ids)
            whole = raw.tobytes()
            texts = [whole[a:b].decode(errors="replace") for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].cast(pa.int64()), "text": pa.array(texts, pa.string())})

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_tokens, ids, round_trip."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"))
