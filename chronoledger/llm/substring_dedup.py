"""Substring dedup: a Count-min prefilter, then exact grouping of the windows that it estimates repeated.

Documents are dealt into chunks by a hash and written once as a bucketed table, so later passes read their chunk
without another shuffle. Every chunk sketches its windows: for each shard of the hash space the cells that they hit
in each row of a Count-min sketch. A shard merges the sketches of all chunks and answers each chunk with those of
its cells that hold two or more. Windows with such a cell in every row are estimated repeated (never too low, so
none is lost); only these are grouped exactly, by their 128-bit hash, once per chunk and window.

Nothing is sized by a group of copies: a window counts once per chunk in the exact pass, whatever its copies.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch, partitions, written
from .words import U, buffers, hashed, ids, mix, pack, pack_plain, spans, unpack, unpack_plain, windows, within

#: Rows of the Count-min sketch and its cells per window (of one row).
DEPTH, CELLS_PER_WINDOW = 2, 4


class _Plan:
    """The sizes of one run: chunks, shards of the hash space, log2 of a shard's cells in one row."""

    def __init__(self, total_bytes: int, k: int, parts: int, chunk_bytes: int):
        expected = max(total_bytes // 6, 1)
        self.k = k
        self.chunks = max(parts, -(-total_bytes // chunk_bytes))
        self.shards = max(parts, -(-expected >> 22))
        self.log_cells = max(10, int(np.ceil(np.log2(CELLS_PER_WINDOW * expected / self.shards + 1))))

    def shard(self, h: np.ndarray) -> np.ndarray:
        return (mix(h, 11) >> U(32)) % U(self.shards)

    def cell(self, h: np.ndarray, row: int) -> np.ndarray:
        return mix(h, 20 + row) >> U(64 - self.log_cells)


def _grams(plan: _Plan, table: pa.Table):
    data, off = buffers(table["text"])
    starts, ends, word_off = spans(data, off)
    at, doc = within(word_off, plan.k)
    h = windows(hashed(data, starts, ends), plan.k)[at]
    return data, off, starts, ends, word_off, at, doc, h


def _other_half(plan: _Plan, grams: tuple, chosen: np.ndarray) -> np.ndarray:
    data, _, starts, ends, _, at, *_ = grams
    return windows(hashed(data, starts, ends, half=1), plan.k, 1)[at[chosen]]


def _runs(keys: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of each run of equal values."""
    cut = np.flatnonzero(np.diff(keys)) + 1
    return [(int(keys[a]), a, b) for a, b in zip(np.r_[0, cut], np.r_[cut, len(keys)])] if len(keys) else []


_MAIL = "shard long, p long, a binary, b binary, c binary"


def _mail(rows: list[tuple]) -> pa.Table:
    rows = [(*r, *[None] * (5 - len(r))) for r in rows]
    cols = list(zip(*rows)) if rows else [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("shard", "p", "a", "b", "c"), cols, kinds)})


def _sketch(plan: _Plan):
    def run(key, table):
        h = _grams(plan, table)[-1]
        shard, out = plan.shard(h), {}
        for row in range(DEPTH):
            both = np.sort(shard << U(plan.log_cells) | plan.cell(h, row))
            for s, a, b in _runs(both >> U(plan.log_cells)):
                out.setdefault(s, []).append(pack(both[a:b] & U((1 << plan.log_cells) - 1)))
        return _mail([(s, key[0].as_py(), *v) for s, v in out.items()])

    return run


def _merge(plan: _Plan):
    def run(key, table):
        answers = [[] for _ in range(table.num_rows)]
        for row in ("a", "b"):
            cells, hit = np.zeros(1 << plan.log_cells, np.uint8), []
            for raw in table[row].to_pylist():
                cell, count = np.unique(unpack(raw), return_counts=True)
                cell = cell.astype(np.int64)
                cells[cell] = np.minimum(cells[cell] + np.minimum(count, 2), 2)
                hit.append(cell)
            for answer, cell in zip(answers, hit):
                answer.append(pack(cell[cells[cell] >= 2]))
        return _mail([(key[0].as_py(), p, *x) for p, x in zip(table["p"].to_pylist(), answers)])

    return run


def _candidates(plan: _Plan, table: pa.Table, mail: pa.Table):
    """The chunk's windows that the merged sketch estimates repeated."""
    grams = _grams(plan, table)
    h = grams[-1]
    shard, keep = plan.shard(h), np.ones(len(h), bool)
    for row, name in enumerate(("a", "b")):
        got = sorted(zip(mail["shard"].to_pylist(), mail[name].to_pylist()))
        flagged = np.concatenate([np.zeros(0, np.uint64), *(unpack(x) | U(s) << U(plan.log_cells) for s, x in got)])
        mine = shard << U(plan.log_cells) | plan.cell(h, row)
        at = np.searchsorted(flagged, mine)
        keep &= flagged[np.minimum(at, max(len(flagged) - 1, 0))] == mine if len(flagged) else False
    return grams, np.flatnonzero(keep)


def _local(plan: _Plan, table: pa.Table, mail: pa.Table):
    """Candidates by shard and hash, and the smallest document that each starts in within the chunk."""
    grams, chosen = _candidates(plan, table, mail)
    doc_id = ids(table["doc_id"])[0]
    h, other, owner = grams[-1][chosen], _other_half(plan, grams, chosen), doc_id[grams[-2][chosen]]
    order = np.lexsort((owner, other, h, plan.shard(h)))
    first = _firsts(h[order], other[order])
    return grams, chosen, doc_id, h, other, owner, order, first


def _firsts(h: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Where a new window begins in an ordered list."""
    return np.flatnonzero(np.r_[True, (np.diff(h) != 0) | (np.diff(other) != 0)]) if len(h) else np.zeros(0, np.int64)


def _ask(plan: _Plan):
    def run(key, table, mail):
        *_, h, other, owner, order, first = _local(plan, table, mail)
        lead = order[first]
        shard = plan.shard(h[lead])
        other = other.view(np.int64)
        return _mail([(s, key[0].as_py(), pack(h[lead[a:b]]), pack_plain(owner[lead[a:b]]), pack_plain(other[lead[a:b]])) for s, a, b in _runs(shard)])

    return run


def _decide(key, table):
    """For each chunk and window: is there a smaller document in another chunk?"""
    asked = [unpack(x) for x in table["a"].to_pylist()]
    owner = np.concatenate([unpack_plain(x) for x in table["b"].to_pylist()])
    h, other = np.concatenate(asked), np.concatenate([unpack_plain(x) for x in table["c"].to_pylist()])
    order = np.lexsort((owner, other, h))
    first = _firsts(h[order], other[order])
    least = np.empty(len(h), np.int64)
    least[order] = np.repeat(owner[order][first], np.diff(np.append(first, len(h))))
    bits, cut = least < owner, np.cumsum([0, *map(len, asked)])
    return _mail([(key[0].as_py(), p, None, np.packbits(bits[a:b]).tobytes()) for p, a, b in zip(table["p"].to_pylist(), cut, cut[1:])])


_OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _apply(plan: _Plan, with_text: bool):
    def run(key, table, mail):
        import pyarrow.compute as pc

        exact = mail.filter(pc.is_null(mail["a"]))
        grams, chosen, doc_id, h, _, owner, order, first = _local(plan, table, mail.filter(pc.is_valid(mail["a"])))
        data, off, starts, ends, word_off, at, doc, _ = grams
        smaller = np.zeros(len(first), bool)
        bits = dict(zip(exact["shard"].to_pylist(), exact["b"].to_pylist()))
        for s, a, b in _runs(plan.shard(h[order[first]])):
            smaller[a:b] = np.unpackbits(np.frombuffer(bits[s], np.uint8), count=b - a).astype(bool)
        group = np.cumsum(np.bincount(first, minlength=len(order))) - 1 if len(order) else np.zeros(0, np.int64)
        gone = smaller[group] | (owner[order] > owner[order[first]][group]) if len(order) else np.zeros(0, bool)
        begin = at[chosen[order[gone]]]
        depth = np.bincount(begin, minlength=len(starts) + plan.k + 1) - np.bincount(begin + plan.k, minlength=len(starts) + plan.k + 1)
        removed = np.cumsum(depth)[: len(starts)] > 0
        # The kept bytes: each kept word and the byte behind it, as a space.
        last = np.searchsorted(off, starts, "right")
        tail = np.minimum(ends + 1, off[last]) if len(starts) else ends
        kept = ~removed
        mark = np.bincount(starts[kept], minlength=len(data) + 2) - np.bincount(tail[kept], minlength=len(data) + 2)
        mask = np.cumsum(mark)[: len(data)] > 0
        solid = np.zeros(len(data) + 1, np.int8)
        solid[starts] += 1
        np.subtract.at(solid, ends, 1)
        text = np.where(np.cumsum(solid)[: len(data)] > 0, data, 32).astype(np.uint8)[mask]
        cut = np.concatenate(([0], np.cumsum(mask)))[off]
        whole = text.tobytes()
        texts = [whole[a:b].removesuffix(b" ") for a, b in zip(cut, cut[1:])]
        gone_by_doc = np.concatenate(([0], np.cumsum(removed)))[word_off]
        return pa.table(
            {
                "doc_id": table["doc_id"].cast(pa.int64()),
                "n_words": pa.array(np.diff(word_off).astype(np.int64)),
                "n_removed": pa.array(np.diff(gone_by_doc).astype(np.int64)),
                "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string()),
                "kept_text": pa.array([x.decode() for x in texts] if with_text else [None] * len(texts), pa.string()),
            }
        )

    return run


def substring_dedup(spark: SparkSession, docs: DataFrame, k: int = 13, with_text: bool = True, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Removes each word that a window of ``k`` words covers which also starts in a document with a smaller doc_id.

    Takes doc_id and text; other columns, whatever their names, are ignored. Returns one row per input row: doc_id,
    n_words, n_removed, kept_sha256 and (``with_text``) kept_text, the kept words joined by one space. A null or
    empty text has no words and the digest of the empty string. A null doc_id counts as larger than every other.
    Rows with the same doc_id are separate documents, neither of which is smaller. A window that repeats only
    within its document stays. An empty table gives an empty result.

    ``chunk_bytes`` is the memory knob: a task holds one chunk of texts and about ten times that in arrays. A chunk
    sends a message to each shard that its windows hit, so larger chunks mean fewer and fuller messages.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = int(base.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    plan = _Plan(total, k, partitions(spark), chunk_bytes)
    # Rows without doc_id may repeat at will: their place deals them apart.
    dealt = F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()), "text"), F.lit(plan.chunks))
    with Scratch(spark) as scratch:
        chunks = scratch.bucketed(base.withColumn("p", dealt), "chunks", "p").groupBy("p")
        merged = scratch.written(chunks.applyInArrow(_sketch(plan), _MAIL).groupBy("shard").applyInArrow(_merge(plan), _MAIL), "repeated")
        asked = chunks.cogroup(merged.groupBy("p")).applyInArrow(_ask(plan), _MAIL)
        exact = asked.groupBy("shard").applyInArrow(_decide, _MAIL)
        out = chunks.cogroup(merged.unionByName(exact).groupBy("p")).applyInArrow(_apply(plan, with_text), _OUT)
        return written(out if with_text else out.drop("kept_text"), "deduplicated")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words over all documents: doc_id, n_words, n_removed, kept_sha256."""
    return substring_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), 13, with_text=False)
