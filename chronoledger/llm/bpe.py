"""Byte-level BPE by longest matches and backtracking: the merges' own result in time linear in a text's bytes.

Two tokens are compatible if merging their joined bytes gives these two again, that is, if no merge ever crosses the
border between them. A sequence is what the merges give if each two neighbours are compatible. So a pre-token is encoded from
left to right: the longest token that an Aho-Corasick automaton finds at a place, else a shorter one that is a prefix
of it, must be compatible with the token before; where none is, the place is closed and the token before is shortened.
A place is closed at most once. Decoding copies runs of one table of all tokens' bytes by offsets.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator, Sequence

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from .words import release, slices

MODEL = public_tokenizers.path("byte_bpe_50k.json")
#: Distinct pre-tokens and pairs that a worker remembers before it starts anew, and code points of a text that are cut at once.
REMEMBERED, PIECE = 400_000, 1 << 19


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself where it is printable, else the next one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, other = [], 256
    for b in range(256):
        out.append(chr(b if b in shown else other))
        other += b not in shown
    return out


class Pairs(dict):
    """The pair-compatibility table, filled as pairs are asked for."""

    def __init__(self, left: Sequence[int], right: Sequence[int], order: Sequence[int], merged: dict[tuple[int, int], int]):
        super().__init__()
        self.parts = left, right, order, merged

    def __missing__(self, pair: tuple[int, int]) -> bool:
        left, right, order, merged = self.parts
        a, b = pair
        below, found = len(order) + 1, None
        while found is None:
            # a and b touch the border from when they were made until the merge of order ``below``
            made = merged.get((a, b))
            if made is not None and order[made] < below:
                found = False
            elif order[a] > order[b]:
                below, a = order[a], right[a]
            elif order[b]:
                below, b = order[b] + 1, left[b]  # of equal merges the left one comes first
            else:
                found = True
        if len(self) >= REMEMBERED:
            self.clear()
        self[pair] = found
        return found


class Known(dict):
    """Ids of pre-tokens as int32 bytes, encoded as they are asked for; what was not asked for since the last turn goes."""

    def __init__(self, encode):
        super().__init__()
        self.encode, self.before = encode, {}

    def __missing__(self, piece: str) -> bytes:
        found = self.before.get(piece)
        if found is None:
            found = array("i", self.encode(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[piece] = found
        return found


class Codec:
    """Encoder and decoder of one vocabulary file of the tokenizers library.

    Byte-level BPE without normaliser, with the pattern of words, numbers and other runs, and special tokens taken as they
    stand in a text; anything else in the file is an error.
    """

    def __init__(self, data: bytes):
        file = json.loads(data)
        model, cut = file["model"], file["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or file["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex") or (file["decoder"] or {}).get("type") != "ByteLevel" or odd:
            raise ValueError("not a plain byte-level BPE file")
        self._special = {}
        for t in file["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"]:
                raise ValueError(f"the added token {t['content']} takes more than itself")
            self._special[t["content"]] = t["id"]
        self._tables(model)
        self._split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self._special, key=len, reverse=True)) + ")") if self._special else None
        self._pattern = regex.compile(public_tokenizers.PATTERN)
        self._library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self._seen, self._foreign = {chr(i) for i in range(128)}, set()
        self._known = Known(self.encode_bytes)

    def _tables(self, model: dict) -> None:
        letters = {c: b for b, c in enumerate(byte_letters())}
        vocab = model["vocab"]
        size = 1 + max([*vocab.values(), *self._special.values()])
        raw = [b""] * size
        for token, i in vocab.items():
            raw[i] = bytes(letters[c] for c in token)
        left, right, order, merged = [-1] * size, [-1] * size, [0] * size, {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            made = vocab[a + b]
            if order[made] or not order[vocab[a]] < rank + 1 > order[vocab[b]]:
                raise ValueError(f"the token {a + b} is not made by one merge of earlier tokens")
            left[made], right[made], order[made], merged[vocab[a], vocab[b]] = vocab[a], vocab[b], rank + 1, made
        if sum(len(raw[i]) == 1 for i in vocab.values()) != 256:
            raise ValueError("a byte has no token")
        self._pairs = Pairs(left, right, order, merged)
        # A token that the merges of its own bytes do not give never stands in a result.
        fit = [i for i in vocab.values() if len(raw[i]) == 1 or (order[i] and self._pairs[left[i], right[i]] is False and self._reached(i))]
        self._ids = {raw[i]: i for i in fit}
        self._long = [len(x) for x in raw]
        self._shorter = [-1] * size
        for x, i in self._ids.items():
            self._shorter[i] = next((self._ids[x[:n]] for n in range(len(x) - 1, 0, -1) if x[:n] in self._ids), -1)
        # Reversed tokens: of all that end at a place of the reversed text, the first that is told is the longest.
        self._find = ahocorasick.Automaton()
        for x, i in self._ids.items():
            self._find.add_word(x[::-1].decode("latin-1"), i)
        self._find.make_automaton()
        for s, i in self._special.items():
            raw[i] = s.encode()
        self._bytes = np.frombuffer(b"".join(raw), np.uint8)
        self._size = np.array([len(x) for x in raw], np.int64)
        self._at = np.concatenate(([0], np.cumsum(self._size)))[:-1]

    def _reached(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token: at each of its merges nothing earlier crosses the border."""
        left, right, order, merged = self._pairs.parts
        todo = [token]
        while todo:
            t = todo.pop()
            if not order[t]:
                continue
            a, b, below = left[t], right[t], order[t]
            while True:
                if order[a] > order[b]:
                    below, a = order[a], right[a]
                elif order[b]:
                    below, b = order[b] + 1, left[b]
                else:
                    break
                made = merged.get((a, b))
                if made is not None and order[made] < below:
                    return False
            todo += [left[t], right[t]]
        return True

    def encode_bytes(self, text: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self._ids.get(text)
        if whole is not None or not text:
            return [] if whole is None else [whole]
        n, pairs, size, shorter = len(text), self._pairs, self._long, self._shorter
        longest, last = [0] * n, -1
        for end, token in self._find.iter(text[::-1].decode("latin-1")):
            if end != last:
                longest[n - 1 - end], last = token, end
        open_, out, at = bytearray(b"\1" * (n + 1)), [], 0
        token = longest[0]
        while at < n:
            if out:
                last = out[-1]
                while token >= 0 and not (open_[at + size[token]] and pairs[last, token]):
                    token = shorter[token]
            if token >= 0:
                out.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
            else:
                open_[at] = 0
                last = out.pop()
                at -= size[last]
                token = shorter[last]
        return out

    def _words(self, text: str) -> list[str]:
        """Pre-tokens of a text without special tokens. A text with letters that the library's older Unicode tables class
        otherwise is cut by the library."""
        letters = set(text)
        for c in letters - self._seen:
            probe = f"a{c}1{c} {c}!{c}"
            if [m.span() for m in self._pattern.finditer(probe)] != [at for _, at in self._library.pre_tokenize_str(probe)]:
                self._foreign.add(c)
            self._seen.add(c)
        if self._foreign.isdisjoint(letters):
            return self._pattern.findall(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def _pieces(self, text: str) -> Iterator[str]:
        """Parts of a text that join where a blank follows something else, as pre-tokens always do."""
        at = 0
        while len(text) - at > PIECE:
            gap = regex.compile(r"(?<=\S) ").search(text, at + PIECE)
            if gap is None:
                break
            yield text[at : gap.start()]
            at = gap.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, as the library gives them without added special tokens."""
        found, known = [], self._known.__getitem__
        for part in self._split.split(text) if self._split else [text]:
            if part in self._special:
                found.append(np.array([self._special[part]], np.int32))
                continue
            for piece in self._pieces(part) if part else ():
                found.append(np.frombuffer(b"".join(map(known, self._words(piece))), np.int32))
        return np.concatenate(found) if found else np.zeros(0, np.int32)

    def decode(self, ids: np.ndarray, off: np.ndarray) -> list[str]:
        """Texts of runs of ids; as in the library, ids beyond the vocabulary say nothing and bytes that are not UTF-8 become U+FFFD."""
        some = (ids >= 0) & (ids < len(self._size))
        off = np.concatenate(([0], np.cumsum(some)))[off]
        ids = ids[some]
        n = self._size[ids]
        ends = np.cumsum(n)
        data = self._bytes[np.repeat(self._at[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cut = np.concatenate(([0], ends))[off]
        return [data[a:b].decode(errors="replace") for a, b in zip(cut, cut[1:])]


_codecs: dict[bytes, Codec] = {}


def _codec(data: bytes) -> Codec:
    if data not in _codecs:
        _codecs[data] = Codec(data)
    return _codecs[data]


def encoded(docs: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id and ids of every row's whole text; other columns are ignored.

    Null and empty texts have no ids. Repeated rows give repeated results, an empty table an empty one, null doc_ids stay.
    A long text is cut at blanks into pieces of some PIECE code points; the file's bytes travel with the function.
    """
    with open(model_path, "rb") as f:
        data = f.read()

    def run(batches):
        codec = _codec(data)
        for batch in slices(batches, limit=1 << 20):
            found = [codec.encode(t or "") for t in batch["text"].to_pylist()]
            off = np.concatenate(([0], np.cumsum([len(x) for x in found])))
            ids = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(found), pa.int32()))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "ids": ids})
        release()

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, model_path: str = MODEL) -> DataFrame:
    """doc_id, ids and the text that they stand for, special tokens included; other columns are ignored.

    Null and empty ids give the empty text; ids that are null or beyond the vocabulary say nothing, bytes that are not UTF-8
    become the replacement character. Repeated rows give repeated results, an empty table an empty one.
    """
    with open(model_path, "rb") as f:
        data = f.read()

    def run(batches):
        codec = _codec(data)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                ids = part["ids"]
                flat = np.asarray(ids.flatten().fill_null(-1), np.int64)
                off = np.concatenate(([0], np.cumsum(np.asarray(ids.value_lengths().fill_null(0), np.int64))))
                yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"], "ids": ids, "text": pa.array(codec.decode(flat, off), pa.string())})

    return tokens.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def op11_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded: number of ids, digest of the ids and of the text that they give back."""
    found = decoded(encoded(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
