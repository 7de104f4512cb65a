"""LM scoring with an n-gram trie of Elias-Fano levels, in shards.

Model: interpolated absolute discounting, P(w|h) = (c(hw) - D) / c(h) + left(h) P(w|h'), over add-0.5 unigrams. Kept are
all words, and all bigrams and trigrams that occur twice or more in training, at every corpus size.

Documents are dealt into chunks, written once and bucketed. Level by level each chunk asks the shards of the key space
for its distinct words, then for its bigrams of repeated words, then for its trigrams of kept bigrams; an ask carries
its training counts too, so a shard first adds up what it is asked, builds its part of the level from that, and then
answers from it. A context belongs to one shard, and a frequent one to several buckets by child, whose left-over masses
add up; so no shard grows with a frequent word. Nothing but sums reaches the driver and nothing is broadcast.

A shard's part of a level: its contexts, the pointers from contexts to children and the children (made monotone by adding
the last child of the context before) in Elias-Fano form, and discounted probabilities of one byte. It is memory-mapped
and searched in place: a child is found by successor search relative to its context.
"""

from __future__ import annotations

import json
import math
import mmap
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch, partitions, written
from .quality import remainder
from .words import U, buffers, hashed, mix, pack, pack_plain, spans, unpack, unpack_plain

#: Discounts of bigrams and trigrams, and occurrences from which an n-gram is kept.
DISCOUNT, LEAST = (1.0, 0.75), 2
#: Training tokens of a shard and of a bucket of a context.
SHARD_TOKENS, BUCKET = 1 << 21, 1 << 21
#: The hash that stands for the end of a text; ids of no kept word and of the begin of a text; bits of a child's id and of a bucket.
END, NONE, BEGIN, CHILD_BITS, BUCKET_BITS = U(0x0E0D0E0D0E0D0E0D), 0, 1, 38, 22
#: A probability's byte is its place on a logarithmic scale of this step; 0: not kept.
STEP = 0.04
BOOK = np.append(0.0, 10 ** (-STEP * np.arange(255)))

_POPULATION = np.array([bin(i).count("1") for i in range(256)], np.int64)
_PLACES = np.zeros((256, 8), np.int64)
for _i in range(256):
    _on = [j for j in range(8) if _i >> j & 1]
    _PLACES[_i, : len(_on)] = _on


#: Entries that are searched at once.
_BLOCK = 1 << 16


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary with the ones before each word, all read in place."""

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits = int(head[0]), int(head[1])
        self._low, self._high, self._ones = np.ndarray((max(0, len(low) - 7),), "<u8", low, strides=(1,)), high, ones
        self._zeros = 64 * np.arange(len(ones)) - ones

    @staticmethod
    def build(values: np.ndarray) -> dict[str, np.ndarray]:
        v = np.asarray(values, np.uint64)
        n, universe = len(v), int(v[-1]) + 1 if len(v) else 1
        bits = max(0, int(math.floor(math.log2(universe / n)))) if n and universe > n else 0
        high = (v >> U(bits)).astype(np.int64)
        unary = np.zeros(-(-(n + (int(high[-1]) if n else 0) + 1) // 64) * 64, np.uint8)
        unary[high + np.arange(n)] = 1
        words = np.packbits(unary, bitorder="little").view(np.uint64)
        ones = np.cumsum(_POPULATION[words.view(np.uint8)].reshape(-1, 8).sum(1))
        low = np.zeros(0, np.uint8)
        if bits and n:
            each = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & U(1)).astype(np.uint8)
            low = np.packbits(each.ravel(), bitorder="little")
        return {"head": np.array([n, bits], np.int64), "low": np.append(low, np.zeros(8, np.uint8)), "high": words, "ones": ones - np.diff(ones, prepend=0)}

    def _select(self, before: np.ndarray, i: np.ndarray, flip: int) -> np.ndarray:
        """Where the i-th one (or, flipped, zero) is, given those before each word."""
        at = np.searchsorted(before, i, "right") - 1
        left = i - before[at]
        parts = (self._high[at] ^ U(flip)).view(np.uint8).reshape(-1, 8)
        upto = np.cumsum(_POPULATION[parts], 1)
        byte = (upto <= left[:, None]).sum(1)
        row = np.arange(len(i))
        left = left - np.where(byte > 0, upto[row, np.maximum(byte - 1, 0)], 0)
        return at * 64 + byte * 8 + _PLACES[parts[row, byte], left]

    def _below(self, high: np.ndarray) -> np.ndarray:
        """Entries whose high bits are less."""
        out = np.full(len(high), self.n, np.int64)
        out[high <= 0] = 0
        last = int(self._select(self._ones, np.array([self.n - 1]), 0)[0]) - self.n + 1 if self.n else -1
        on = np.flatnonzero((high > 0) & (high <= last))
        out[on] = self._select(self._zeros, high[on] - 1, -1 % 2**64) - (high[on] - 1)
        return out

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        return (self._low[at >> 3] >> (at & 7).astype(np.uint64)) & U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        high = self._select(self._ones, i, 0) - i
        return (high.astype(np.uint64) << U(self.bits)) | self.lows(i)

    def find(self, x: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> np.ndarray:
        """Where each x is (within [lo, hi)); -1 if it is not there."""
        x = x.astype(np.uint64)
        high = (x >> U(self.bits)).astype(np.int64)
        a, b = self._below(high), self._below(high + 1)
        if lo is not None:
            a, b = np.maximum(a, lo), np.minimum(b, hi)
        want, end = x & U((1 << self.bits) - 1), b.copy()
        on = np.flatnonzero(a < b)
        while len(on):  # successor in the bucket, by halves
            mid = (a[on] + b[on]) >> 1
            less = self.lows(mid) < want[on]
            a[on] = np.where(less, mid + 1, a[on])
            b[on] = np.where(less, b[on], mid)
            on = on[a[on] < b[on]]
        found = np.full(len(x), -1, np.int64)
        ok = np.flatnonzero(a < end)
        ok = ok[self.lows(a[ok]) == want[ok]]
        found[ok] = a[ok]
        return found


def quantised(p: np.ndarray) -> np.ndarray:
    """The byte of each probability above 0."""
    return np.clip(np.round(-np.log10(p) / STEP) + 1, 1, 255).astype(np.uint8)


class Level:
    """A shard's part of a level, mapped into memory: ``build`` makes its bytes."""

    _SEQUENCES = ("contexts", "points", "children")

    def __init__(self, data: bytes):
        with os.fdopen(os.memfd_create("level"), "r+b") as f:  # a file in memory, no folder of the machine
            f.write(data)
            f.flush()
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        size = int.from_bytes(self._map[:8], "little")
        head = json.loads(self._map[8 : 8 + size])
        a = {k: np.frombuffer(self._map, np.dtype(t), n, 8 + size + at) for k, (t, n, at) in head.items()}
        self.codes, self.totals, self.lefts = a["codes"], a["totals"], a["lefts"]
        self.contexts, self.points, self.children = (EliasFano(*(a[f"{s}.{k}"] for k in ("head", "low", "high", "ones"))) for s in self._SEQUENCES)

    @staticmethod
    def build(contexts: np.ndarray, totals: np.ndarray, owner: np.ndarray, child: np.ndarray, count: np.ndarray, discount: float) -> bytes:
        """From ascending contexts with their occurrences, and counts of children in order of (place of its context, child)."""
        keep = count >= LEAST
        owner, child, count = owner[keep], child[keep], count[keep]
        own = (count - discount) / totals[owner]
        # What discounting leaves to the lower order, in quarters of an occurrence.
        lefts = 4 * totals - np.bincount(owner, np.round(4 * (count - discount)), minlength=len(totals)).astype(np.int64)
        points = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(contexts)))))
        top = np.zeros(len(contexts) + 1, np.uint64)
        some = np.flatnonzero(np.diff(points))
        top[some + 1] = child[points[some + 1] - 1]
        monotone = child.astype(np.uint64) + np.cumsum(top, dtype=np.uint64)[owner]
        out = {"codes": quantised(own), "totals": totals, "lefts": lefts}
        for name, x in zip(Level._SEQUENCES, (contexts, points, monotone)):
            out |= {f"{name}.{k}": v for k, v in EliasFano.build(x).items()}
        head, at, body = {}, 0, []
        for k, v in out.items():
            raw = np.ascontiguousarray(v).tobytes()
            head[k] = (v.dtype.str, len(v), at)
            raw += b"\0" * (-len(raw) % 8)
            at += len(raw)
            body.append(raw)
        text = json.dumps(head).encode()
        text += b" " * (-(len(text) + 8) % 8)
        return len(text).to_bytes(8, "little") + text + b"".join(body)

    def find(self, context: np.ndarray, child: np.ndarray) -> np.ndarray:
        """The entry of each child under the context at that place; -1 where none is kept."""
        out = np.full(len(context), -1, np.int64)
        distinct, inverse = np.unique(context, return_inverse=True)
        lo, hi = self.points.get(distinct).astype(np.int64), self.points.get(distinct + 1).astype(np.int64)
        base = np.zeros(len(distinct), np.uint64)
        some = np.flatnonzero((lo > 0) & (hi > lo))
        base[some] = self.children.get(lo[some] - 1)
        lo, hi, base = lo[inverse], hi[inverse], base[inverse]
        on = np.flatnonzero(hi > lo)
        out[on] = self.children.find(child[on].astype(np.uint64) + base[on], lo[on], hi[on])
        return out


class _Plan:
    """The sizes of one run, which every task knows."""

    def __init__(self, total_bytes: int, docs: int, parts: int, chunk_bytes: int, bucket: int):
        self.docs, self.bucket = docs, bucket
        self.chunks = max(parts, -(-total_bytes // chunk_bytes))
        self.shards = max(parts, -(-total_bytes // 6 // SHARD_TOKENS))

    def shard(self, keys: np.ndarray) -> np.ndarray:
        return ((mix(keys, 61) >> U(32)) % U(self.shards)).astype(np.int64)


_MAIL = "shard long, p long, a binary, b binary, c binary, d binary, total long, distinct long"
_NAMES = ("shard", "p", "a", "b", "c", "d", "total", "distinct")
_KINDS = (pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64())


def _mail(rows: list[tuple]) -> pa.Table:
    rows = [(*r, *[None] * (8 - len(r))) for r in rows]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(_NAMES, list(zip(*rows)) if rows else [()] * 8, _KINDS)})


def _spread(shard: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, from, to) of ascending shards."""
    first = np.flatnonzero(np.r_[True, np.diff(shard) != 0]) if len(shard) else []
    return [(int(shard[a]), int(a), int(b)) for a, b in zip(first, [*first[1:], len(shard)])]


def _by_shard(shard: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The order by shard, then key."""
    order = np.argsort(key)
    small = shard.astype(np.uint16) if len(shard) and shard.max() < 1 << 16 else shard
    return order[np.argsort(small[order], kind="stable")]


class _Words:
    """A chunk's tokens (words, then the end of each text) and its distinct words in the order in which it asks for them."""

    def __init__(self, plan: _Plan, table: pa.Table):
        data, off = buffers(table["text"])
        starts, ends, word_off = spans(data, off)
        put = lambda x, end: np.insert(x, word_off[1:], end)
        one = put(hashed(data, starts, ends, fold=True), END)
        two = put(hashed(data, starts, ends, fold=True, half=1) & U(0xFFFFFFFF), U(0))
        self.off = word_off + np.arange(len(word_off))
        self.doc = np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))
        self.train = ~np.asarray(table["held_out"].combine_chunks())[self.doc]
        found = pa.array(one).dictionary_encode()
        at, one_of = np.asarray(found.indices).astype(np.int64), np.asarray(found.dictionary)
        two_of = np.zeros(len(one_of), np.uint64)
        two_of[at] = two
        if (two_of[at] != two).any():  # words that share the first half
            order = np.lexsort((two, one))
            new = np.r_[True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)]
            at[order] = np.cumsum(new) - 1
            one_of, two_of = one[order][new], two[order][new]
            order = np.lexsort((two_of, one_of, plan.shard(one_of)))
        else:
            order = _by_shard(plan.shard(one_of), one_of)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.inverse, self.one, self.two = place[at], one_of[order], two_of[order]
        self.count = np.bincount(self.inverse, self.train, minlength=len(self.one)).astype(np.int64)
        self.runs = _spread(plan.shard(self.one))

    def asks(self, p: int) -> list[tuple]:
        return [(s, p, pack(self.one[a:b]), pack_plain(self.two[a:b].view(np.int64)), pack_plain(self.count[a:b])) for s, a, b in self.runs]

    def answered(self, plan: _Plan, mail: pa.Table) -> None:
        """Ids (0: not kept) and training counts of the tokens."""
        ids, counts = np.zeros(len(self.one), np.int64), np.zeros(len(self.one), np.int64)
        rows = {s: r for s, *r in zip(*(mail[c].to_pylist() for c in ("shard", "a", "b", "c")))}
        for s, a, b in self.runs:
            kept, ranks, n = rows[s]
            kept = np.unpackbits(np.frombuffer(kept, np.uint8), count=b - a).astype(bool)
            ids[a:b][kept] = unpack(ranks).astype(np.int64) * plan.shards + s + BEGIN + 1
            counts[a:b] = unpack_plain(n)
        self.ids, self.word, self.occurs = ids, ids[self.inverse], counts[self.inverse]


def _count_words(plan: _Plan):
    def run(key, table):
        """A shard of words: training counts, and ranks among those kept as ids."""
        shard = key[0].as_py()
        asked = [unpack(x) for x in table["a"].to_pylist()]
        one, two = np.concatenate(asked), np.concatenate([unpack_plain(x) for x in table["b"].to_pylist()])
        count = np.concatenate([unpack_plain(x) for x in table["c"].to_pylist()])
        order = np.lexsort((two, one))
        new = np.r_[True, (np.diff(one[order]) != 0) | (np.diff(two[order]) != 0)]
        at = np.empty(len(order), np.int64)
        at[order] = np.cumsum(new) - 1
        sums = np.bincount(at, count).astype(np.int64)
        kept = sums >= LEAST
        rank = np.cumsum(kept) - 1
        out, cut = [(shard, -1, None, None, None, None, int(sums.sum()), int((sums > 0).sum()))], np.cumsum([0, *map(len, asked)])
        for p, a, b in zip(table["p"].to_pylist(), cut, cut[1:]):
            i = at[a:b]
            out.append((shard, p, np.packbits(kept[i]).tobytes(), pack(rank[i[kept[i]]]), pack_plain(sums[i])))
        return _mail(out)

    return run


class _Grams:
    """A chunk's distinct (context, child) pairs in the order in which it asks for them.

    Every context is asked for, with its training occurrences, in all its buckets: their left-over masses add up.
    """

    def __init__(self, plan: _Plan, context: np.ndarray, ids: np.ndarray, child: np.ndarray, train: np.ndarray, occurs: np.ndarray):
        """``context`` is each token's place among ``ids``; places of NONE are no context."""
        self._on = at = np.flatnonzero(ids[context] != NONE)
        context = context[at]
        total = np.bincount(context, train[at], minlength=len(ids)).astype(np.int64)
        buckets = np.zeros(len(ids), np.int64)
        buckets[context] = 1 + occurs[at].astype(np.int64) // plan.bucket
        there = np.flatnonzero(buckets)
        self._which = (np.cumsum(buckets > 0) - 1)[context]
        distinct, total, self._buckets = ids[there], total[there], buckets[there]
        self._first = np.cumsum(self._buckets) - self._buckets
        owner = np.repeat(np.arange(len(distinct)), self._buckets)
        key = distinct[owner].astype(np.uint64) << U(BUCKET_BITS) | (np.arange(len(owner)) - self._first[owner]).astype(np.uint64)
        shard = plan.shard(key)
        order = _by_shard(shard, key)
        self._place = np.empty(len(order), np.int64)
        self._place[order] = np.arange(len(order))
        self._key, self._total, self._runs = key[order], total[owner[order]], _spread(shard[order])
        self._has = np.flatnonzero(child[at] != NONE)
        which, c = self._which[self._has], child[at][self._has].astype(np.uint64)
        entry = self._place[self._first[which] + (mix(c, 71) % self._buckets[which].astype(np.uint64)).astype(np.int64)]
        self._pair, self._inverse = np.unique(entry.astype(np.uint64) << U(CHILD_BITS) | c, return_inverse=True)
        self._count = np.bincount(self._inverse, train[at][self._has], minlength=len(self._pair)).astype(np.int64)
        self._cut = np.searchsorted(self._pair >> U(CHILD_BITS), np.arange(len(order) + 1, dtype=np.uint64))

    def asks(self, p: int) -> list[tuple]:
        out = []
        for s, a, b in self._runs:
            x, y = self._cut[a], self._cut[b]
            pairs = self._pair[x:y] - (U(a) << U(CHILD_BITS))
            out.append((s, p, pack(self._key[a:b]), pack(pairs), pack_plain(self._total[a:b]), pack_plain(self._count[x:y])))
        return out

    def answered(self, plan: _Plan, mail: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By token: the discounted probability (0: not kept), the mass left to the lower order (1: no context) and the pair's place in ``ids``."""
        rows = {s: r for s, *r in zip(*(mail[c].to_pylist() for c in ("shard", "a", "b", "c", "d")))}
        codes, ids = np.zeros(len(self._pair), np.uint8), np.zeros(len(self._pair), np.int64)
        used, total = np.zeros(len(self._key)), np.ones(len(self._key))
        for s, a, b in self._runs:
            x, y = self._cut[a], self._cut[b]
            code, rank, sums, left = rows[s]
            codes[x:y] = unpack_plain(code)
            kept = np.flatnonzero(codes[x:y])
            ids[x:y][kept] = unpack(rank).astype(np.int64) * plan.shards + s + 1
            sums = unpack_plain(sums)
            used[a:b], total[a:b] = 4 * sums - unpack_plain(left), np.maximum(4 * sums, 1)
        mass = np.add.reduceat((used / total)[self._place], self._first) if len(self._first) else np.zeros(0)
        own, left, pair = np.zeros(n), np.ones(n), np.zeros(n, np.int64)
        left[self._on] = (1 - mass)[self._which]
        own[self._on[self._has]] = BOOK[codes[self._inverse]]
        pair[self._on[self._has]] = self._inverse + 1
        self.ids = np.append(NONE, ids)
        return own, left, pair


def _count_grams(plan: _Plan, discount: float):
    def run(key, table):
        """A shard of a level: built from all that is asked, then asked."""
        shard, asked = key[0].as_py(), [unpack(x) for x in table["a"].to_pylist()]
        keys, totals = np.concatenate(asked), np.concatenate([unpack_plain(x) for x in table["c"].to_pylist()])
        contexts, at = np.unique(keys, return_inverse=True)
        totals = np.bincount(at, totals, minlength=len(contexts)).astype(np.int64)
        pairs, cut, sizes = [], np.cumsum([0, *map(len, asked)]), []
        for i, raw in enumerate(table["b"].to_pylist()):
            got = unpack(raw)
            place = at[cut[i] + (got >> U(CHILD_BITS)).astype(np.int64)]
            pairs.append(place.astype(np.uint64) << U(CHILD_BITS) | got & U((1 << CHILD_BITS) - 1))
            sizes.append(len(got))
        pairs = np.concatenate(pairs)
        count = np.concatenate([unpack_plain(x) for x in table["d"].to_pylist()])
        distinct, which = np.unique(pairs, return_inverse=True)
        count = np.bincount(which, count, minlength=len(distinct)).astype(np.int64)
        place, child = (distinct >> U(CHILD_BITS)).astype(np.int64), distinct & U((1 << CHILD_BITS) - 1)
        raw = Level.build(contexts, totals, place, child, count, discount)
        level, out = Level(raw), [(shard, -1, raw)]
        here = level.contexts.find(contexts)
        codes, found = np.zeros(len(distinct), np.int64), np.full(len(distinct), -1, np.int64)
        for i in range(0, len(distinct), _BLOCK):
            part = slice(i, i + _BLOCK)
            found[part] = level.find(here[place[part]], child[part])
        codes[found >= 0] = level.codes[found[found >= 0]]
        ends = np.cumsum([0, *sizes])
        for p, a, b, x, y in zip(table["p"].to_pylist(), cut, cut[1:], ends, ends[1:]):
            mine, asker = which[x:y], here[at[a:b]]
            rank = found[mine]
            out.append((shard, p, pack_plain(codes[mine]), pack(rank[rank >= 0]), pack_plain(level.totals[asker]), pack_plain(level.lefts[asker])))
        return _mail(out)

    return run


class _Chunk:
    """A chunk with the answers that it has so far."""

    def __init__(self, plan: _Plan, table: pa.Table, mail: pa.Table | None = None):
        import pyarrow.compute as pc

        self.plan, self.words = plan, _Words(plan, table)
        if mail is None:
            return
        part = lambda level: mail.filter(pc.equal(mail["level"], level))
        w = self.words
        w.answered(plan, part(1))
        n, first = len(w.word), w.off[:-1]

        def previous(x: np.ndarray, begin) -> np.ndarray:
            out = np.empty_like(x)
            out[1:] = x[:-1]
            out[first] = begin
            return out

        # Occurrences of the token before, exact, deal its pairs into buckets.
        occurs, ids = previous(w.occurs, plan.docs), np.append(w.ids, BEGIN)
        self.two = _Grams(plan, previous(w.inverse, len(w.ids)), ids, w.word, w.train, occurs)
        answers = part(2)
        if not answers.num_rows:
            return
        self.own2, self.left1, pair = self.two.answered(plan, answers, n)
        often = previous(self.own2 * occurs + DISCOUNT[0], 0)
        # A trigram is as rare as either of its bigrams: only where both are kept can it be kept.
        self.three = _Grams(plan, previous(pair, 0), self.two.ids, np.where(self.own2 > 0, w.word, NONE), w.train, often)
        answers = part(3)
        if answers.num_rows:
            self.own3, self.left2, _ = self.three.answered(plan, answers, n)
        else:
            self.own3, self.left2 = np.zeros(n), np.ones(n)


_RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(plan: _Plan, total: int, distinct: int):
    z = total + 0.5 * (distinct + 1)

    def run(key, table, mail):
        chunk = _Chunk(plan, table, mail)
        w, n = chunk.words, table.num_rows
        p1 = (w.occurs + 0.5) / z
        score = np.log10(np.minimum(chunk.own3 + chunk.left2 * (chunk.own2 + chunk.left1 * p1), 1))
        add = lambda x: np.bincount(w.doc, x, minlength=n)
        new = [np.diff(w.off).astype(np.int64), add(w.occurs > 0).astype(np.int64), add(np.log10(p1)), add(score)]
        return pa.table([table["doc_id"], table["held_out"], *map(pa.array, new)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, chunk_bytes: int = 8 << 20, bucket: int = BUCKET, model_path: str | None = None) -> DataFrame:
    """Fits on documents whose crc32(doc_id) mod 5 is not 1 and scores all.

    Takes doc_id and text; other columns are ignored. Returns doc_id, held_out, n_tokens (words and one end), n_known,
    train_tokens, base_score and score. Null and empty texts have one token, the end. A null doc_id is trained on.
    Repeated rows are counted as often as they occur and scored alike. An empty table gives an empty result.

    ``chunk_bytes`` is the memory knob: a task holds one chunk of texts and some thirty times that in arrays; larger
    chunks send fewer and fuller messages. A context is dealt into one bucket more for every ``bucket`` occurrences,
    which bounds what one shard has to hold of it. ``model_path`` keeps the trie: rows (level, shard, data), see ``Level``.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("held_out", F.coalesce(remainder(F.col("doc_id"), 5) == 1, F.lit(False)))
    size = base.agg(F.sum(F.octet_length("text") + 6).alias("bytes"), F.count_if(~F.col("held_out")).alias("docs")).first()
    plan = _Plan(int(size.bytes or 0), size.docs, partitions(spark), chunk_bytes, bucket)
    dealt = F.pmod(F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()), "text"), F.lit(plan.chunks))
    asks = lambda grams: lambda key, table, mail: _mail(getattr(_Chunk(plan, table, mail), grams).asks(key[0].as_py()))
    with Scratch(spark) as scratch:
        chunks = scratch.bucketed(base.withColumn("p", dealt), "chunks", "p").groupBy("p")
        words = chunks.applyInArrow(lambda key, table: _mail(_Words(plan, table).asks(key[0].as_py())), _MAIL)
        level1 = scratch.written(words.groupBy("shard").applyInArrow(_count_words(plan), _MAIL).withColumn("level", F.lit(1)), "words")
        sums = level1.where("p = -1").agg(F.sum("total").alias("total"), F.sum("distinct").alias("distinct")).first()
        total, distinct = int(sums.total or 0), int(sums.distinct or 0)
        columns = ["shard", "p", "a", "b", "c", "d", "level"]
        known, kept = level1.where("p >= 0").select(*columns), []
        for level, grams, discount in ((2, "two", DISCOUNT[0]), (3, "three", DISCOUNT[1])):
            asked = chunks.cogroup(known.groupBy("p")).applyInArrow(asks(grams), _MAIL)
            found = asked.groupBy("shard").applyInArrow(_count_grams(plan, discount), _MAIL).withColumn("level", F.lit(level))
            found = scratch.written(found, grams)
            kept.append(found.where("p = -1").select("level", "shard", F.col("a").alias("data")))
            known = known.unionByName(found.where("p >= 0").select(*columns))
        if model_path:
            kept[0].unionByName(kept[1]).write.parquet(model_path)
        out = chunks.cogroup(known.groupBy("p")).applyInArrow(_score(plan, total, distinct), _RESULT)
        out = out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
        return written(out, "scores")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
