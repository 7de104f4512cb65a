"""MinHash near-dedup by SuperMinHash: signatures, bands, verification on full sets, components.

SuperMinHash gives each element a random permutation of the m components and, at its rank j in that permutation, a
value in [j, j+1); a component keeps its least value. Ranks are generated level by level for all elements of a batch:
once every component of a document has a value, no later rank can lower one, so its elements stop there. Long
documents stop after rank 0 or 1.

Words and shingles have two independent 64-bit hashes. Signatures take the first; equal sets and links must be so by both.
Documents with equal sets, by a digest of both halves, are one class (node). Within a bucket (equal values in all components of a band) each class
is first paired with that of the smallest doc_id; pairs whose signatures leave the threshold in
reach are confirmed on their full shingle sets and joined into components. What remains are buckets that hold several
components: there, every member outside the bucket's largest component is compared by signature with all members of the others, in
blocks: the likeliest partners are confirmed first, then, for what is still apart, all that are in reach. So two linked classes that share a bucket always
end in one component, while a bucket of near copies costs one comparison a member instead of all pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import Scratch, partitions, release_shuffles, written
from .components import components
from .skew import joined
from .words import U, buffers, hashed, ids, mix, slices, spans, windows, within

#: Components of a signature, bands (of COMPONENTS / BANDS components) and words of a shingle. A link at 0.75 misses
#: all 32 bands of 4 with probability 5e-6 at independent components; those of SuperMinHash spread less.
COMPONENTS, BANDS, SHINGLE, NEAR = 128, 32, 5, (75, 100)
#: Signatures with fewer equal components are out of reach of the threshold: 6 deviations below 0.75 of 128.
REACH = 66
#: Rows and bytes of text of one block, of members or of strays, in the comparison within a bucket.
BLOCK, BLOCK_BYTES = 2048, 8 << 20
#: Parts that the partners of a class are dealt over, for each shuffle partition.
SALTS = 4


def shingles(data, off, half: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document (sorted within it) and their offsets (n + 1), by one half of 128 bits."""
    starts, ends, word_off = spans(data, off)
    h = hashed(data, starts, ends, fold=True, half=half)
    at, doc = within(word_off, SHINGLE)
    full = windows(h, SHINGLE, half)[at]
    counts = np.diff(word_off)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    whole = np.array([windows(h[word_off[d] : word_off[d + 1]], int(counts[d]), half)[0] ^ U(counts[d]) for d in short], np.uint64)
    sizes = np.where(counts >= SHINGLE, counts - SHINGLE + 1, counts > 0).astype(np.int64)
    cut = np.concatenate(([0], np.cumsum(sizes)))
    held = np.empty(cut[-1], np.uint64)
    held[cut[short]] = whole
    held[np.repeat(cut[:-1], np.maximum(counts - SHINGLE + 1, 0)) + at - word_off[doc]] = full
    full, doc = held, np.repeat(np.arange(len(sizes)), sizes)
    for a, b in zip(cut, cut[1:]):
        full[a:b].sort()
    new = np.r_[True, (np.diff(doc) != 0) | (np.diff(full) != 0)] if len(doc) else np.zeros(0, bool)
    return full[new], np.searchsorted(doc[new], np.arange(len(off)))


def super_minhash(sets: np.ndarray, set_off: np.ndarray, m: int = COMPONENTS, block: int = 1 << 17) -> np.ndarray:
    """Signatures (documents x m); 2**64-1 throughout for an empty set."""
    n = len(set_off) - 1
    sig = np.full((n, m), U(2**64 - 1))
    flat = sig.ravel()
    doc = np.repeat(np.arange(n), np.diff(set_off))
    draw = mix(sets, 31)
    k = ((draw & U(0xFFFFFFFF)) * U(m) >> U(32)).astype(np.int64)
    np.minimum.at(flat, doc * m + k, draw >> U(32))
    open_doc = (sig == U(2**64 - 1)).any(1) & (np.diff(set_off) > 0)
    left = np.flatnonzero(open_doc[doc])
    # The few elements that go on, by blocks of whole documents.
    lo = 0
    while lo < len(left):
        hi = min(lo + block, len(left))
        while hi < len(left) and doc[left[hi]] == doc[left[hi - 1]]:
            hi += 1
        e = left[lo:hi]
        lo = hi
        perm = np.tile(np.arange(m, dtype=np.uint8), (len(e), 1))
        row = np.arange(len(e))
        perm[row, k[e]], perm[row, 0] = 0, k[e]
        for j in range(1, m):
            draw_j = mix(sets[e], 31 + j)
            at = j + ((draw_j & U(0xFFFFFFFF)) * U(m - j) >> U(32)).astype(np.int64)
            chosen = perm[row, at].astype(np.int64)
            perm[row, at] = perm[row, j]
            perm[row, j] = chosen
            np.minimum.at(flat, doc[e] * m + chosen, U(j << 32) | draw_j >> U(32))
            on = (sig[doc[e]] == U(2**64 - 1)).any(1)
            if not on.any():
                break
            if on.sum() < 0.7 * len(e):
                e, perm = e[on], perm[on]
                row = np.arange(len(e))
    return sig


_SIGNED = "doc_id long, tid long, n_shingles long, digest binary, low binary, keys array<long>"


def _sign(batches):
    for batch in slices(batches):
        data, off = buffers(batch["text"])
        doc_id, null = ids(batch["doc_id"])
        sets, cut = shingles(data, off)
        other, other_cut = shingles(data, off, 1)
        sig = super_minhash(sets, cut)
        bands = np.zeros((len(doc_id), BANDS), np.uint64)
        for i in range(COMPONENTS // BANDS):
            bands = mix(bands ^ sig[:, i::COMPONENTS // BANDS], 40)
        bands = mix(bands + np.arange(BANDS, dtype=np.uint64), 41).view(np.int64)
        low = (mix(sig, 50) >> U(56)).astype(np.uint8)
        raw, more = sets.tobytes(), other.tobytes()
        whole = zip(cut, cut[1:], other_cut, other_cut[1:])
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(doc_id, pa.int64(), mask=null),
                "tid": batch["tid"],
                "n_shingles": pa.array(np.maximum(np.diff(cut), np.diff(other_cut)).astype(np.int64)),
                "digest": pa.array([hashlib.blake2b(raw[8 * a : 8 * b] + more[8 * c : 8 * d], digest_size=16).digest() for a, b, c, d in whole], pa.binary()),
                "low": pa.array([x.tobytes() for x in low], pa.binary()),
                "keys": pa.ListArray.from_arrays(pa.array(np.arange(len(doc_id) + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel())),
            }
        )


def _near(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return NEAR[1] * both >= NEAR[0] * (len(x) + len(y) - both)


def _confirm(batches):
    """Rows ordered by (a, salt, b), each pivot's own text (b null) before its partners; keeps one pivot at a time.

    A pair is linked if both halves of the hashes say so.
    """
    have, pivot = None, None
    for batch in slices(batches):
        halves = [shingles(*buffers(batch["text"]), half) for half in (0, 1)]
        a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
        out = []
        for i in range(len(a)):
            mine = [sets[cut[i] : cut[i + 1]] for sets, cut in halves]
            if b[i] is None:
                have, pivot = mine, a[i]
            elif a[i] == pivot and all(map(_near, have, mine)):
                out.append((a[i], b[i]))
        yield pa.RecordBatch.from_pydict({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) linked on their full sets. A pivot with many partners is dealt over salts, each with its text."""
    n = partitions(pairs.sparkSession)
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS * n)).alias("salt"))
    partners = salted.join(texts, F.col("b") == F.col("node")).select("a", "salt", "b", "text")
    pivots = salted.select("a", "salt").distinct().join(texts, F.col("a") == F.col("node")).select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    return pivots.union(partners).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first()).mapInArrow(_confirm, "a long, b long")


def _in_reach(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    return (NEAR[1] * np.minimum(nx, ny) >= NEAR[0] * np.maximum(nx, ny)) & ((x == y).sum(-1) >= REACH)


def _stars(batches):
    """(member, least member of its bucket) pairs whose signatures are in reach."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint8).reshape(-1, COMPONENTS) for c in ("low", "low_a"))
        ok = _in_reach(x, y, batch["n_shingles"].to_numpy(), batch["n_a"].to_numpy())
        yield pa.RecordBatch.from_pydict({"a": batch["a"], "b": batch["node"]}).filter(pa.array(ok))


def _across(exact: bool):
    """Pairs between one block of the strays of a bucket and one of its members, of different components and in reach: each
    stray's likeliest one or, ``exact``, all that are linked on their full sets. A pair that shares several buckets is
    looked at in that of its first common band only."""

    def run(key, table):
        stray, bucket = np.asarray(table["stray"]), key[0].as_py()
        sig = np.frombuffer(b"".join(table["low"].to_pylist()), np.uint8).reshape(-1, COMPONENTS)
        n, node, comp, copied = (np.asarray(table[c]) for c in ("n_shingles", "node", "component", "copied"))
        bands = np.asarray(table["keys"].combine_chunks().flatten()).reshape(-1, BANDS)
        halves = [shingles(*buffers(table["text"]), half) for half in (0, 1)] if exact else []
        a, b = [], []
        members = np.flatnonzero(~copied)
        for i in np.flatnonzero(stray & copied):
            js = members[(comp[members] != comp[i]) & (~stray[members] | (node[members] > node[i]))]
            js = js[bands[js, (bands[js] == bands[i]).argmax(1)] == bucket]
            js = js[_in_reach(sig[js], sig[i], n[js], n[i])]
            if exact:
                js = js[np.array([all(_near(sets[cut[i] : cut[i + 1]], sets[cut[j] : cut[j + 1]]) for sets, cut in halves) for j in js], bool)]
            elif len(js):
                js = js[[np.argmax((sig[js] == sig[i]).sum(1))]]
            a.append(np.minimum(node[js], node[i]))
            b.append(np.maximum(node[js], node[i]))
        return pa.table({"a": np.concatenate([np.zeros(0, np.int64), *a]), "b": np.concatenate([np.zeros(0, np.int64), *b])})

    return run


def _mixed(crowded: DataFrame, mine: DataFrame, found: DataFrame, exact: bool, written=written) -> DataFrame:
    """What ``_across`` finds in the buckets that hold several components."""
    tagged = crowded.select("key", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = tagged.groupBy("key", "component").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.count("*").alias("parts"), F.max_by("component", F.struct("c", "component")).alias("main")).where("parts > 1")
    rest = written(tagged.join(mixed, "key").withColumn("stray", F.col("component") != F.col("main")), "mixed")
    # Members and strays are dealt into blocks of so many rows and bytes; each block of strays meets each of members.
    sized = rest.select("key", "node", "stray").join(mine.select("node", "n_bytes"), "node")
    deal = lambda rows, size: F.greatest(F.lit(1).cast("long"), F.ceil(F.greatest(rows / BLOCK, size / BLOCK_BYTES)))
    strays = deal(F.count_if("stray"), F.sum(F.when(F.col("stray"), F.col("n_bytes")).otherwise(0)))
    weighed = sized.groupBy("key").agg(deal(F.count("*"), F.sum("n_bytes")).alias("blocks"), strays.alias("stray_blocks"))
    kept = ["node", "n_shingles", "low", "keys", "component", *(["text"] if exact else [])]
    full = rest.join(weighed, "key").join(mine, "node")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    here = full.select("key", own("blocks").alias("block"), each("stray_blocks").alias("strays"), *kept, "stray", F.lit(False).alias("copied"))
    along = full.where("stray").select("key", each("blocks").alias("block"), own("stray_blocks").alias("strays"), *kept, "stray", F.lit(True).alias("copied"))
    return here.unionByName(along).groupBy("key", "block", "strays").applyInArrow(_across(exact), "a long, b long").distinct()


def near_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Links documents whose sets of lower-cased 5-word shingles have a Jaccard similarity of 0.75 or more.

    Takes doc_id and text; other columns are ignored. Returns one row per input row: doc_id, n_shingles,
    component_id (the smallest doc_id reachable over links, itself included), kept (doc_id = component_id). A text
    with fewer than five words is one shingle; without words (or null) the set is empty and linked with nothing. A
    null doc_id takes no part in links: its component_id is null and it is kept. Repeated rows of a doc_id share a
    component when linked. An empty table gives an empty result.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("tid", F.xxhash64("text"))
    with Scratch(spark) as scratch:
        out = written(_linked(base, scratch.written), "near_duplicates")
    release_shuffles(spark)
    return out


def _linked(base: DataFrame, written) -> DataFrame:
    signed = written(base.mapInArrow(_sign, _SIGNED), "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    # Its first document (and which of its texts) stands for a class; its number is that of its row, which is written.
    heads = some.groupBy("digest").agg(F.min(F.struct("doc_id", "tid", "n_shingles", "low", "keys")).alias("h"))
    heads = written(heads.select("digest", "h.*", F.monotonically_increasing_id().alias("node")), "classes")
    banded = heads.select("node", "doc_id", F.explode("keys").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("doc_id", "node")).alias("least")).where("size > 1")
    buckets = written(buckets.select("key", "size", F.col("least.node").alias("a")), "sizes")
    crowded = written(joined(banded.select("key", "node"), buckets, "key", "size").select("key", "node", "a"), "buckets")
    release_shuffles(base.sparkSession)
    # Signatures of what shares a bucket; bands carry none.
    near = written(heads.drop("digest").join(crowded.select("node").distinct(), "node", "left_semi"), "near")
    mine = near.select("node", "n_shingles", "low", "keys")
    pivot = near.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a"), F.col("low").alias("low_a"))
    once = written(crowded.where("node <> a").select("a", "node").distinct(), "once")
    often = written(once.groupBy("a").agg(F.count("*").alias("n")).join(pivot, "a"), "pivots")
    pairs = joined(once.join(mine.drop("keys"), "node"), often, "a", "n").drop("n")
    pairs = written(pairs.mapInArrow(_stars, "a long, b long"), "pairs")
    # Only what shares a bucket is read again for verification.
    texts = written(base.join(near.select("node", "doc_id", "tid").hint("merge"), ["doc_id", "tid"]).dropDuplicates(["node"]).select("node", "text"), "texts")
    release_shuffles(base.sparkSession)
    links = written(_confirmed(pairs, texts), "links")
    release_shuffles(base.sparkSession)
    final = written(components(links), "components")
    release_shuffles(base.sparkSession)
    # Buckets that hold several components: first each stray with its likeliest partner, then with all in reach.
    mine = mine.join(texts.withColumn("n_bytes", F.octet_length("text")), "node")
    more = written(_mixed(crowded, mine, final, False, written).join(pairs, ["a", "b"], "left_anti"), "pairs")
    if more.take(1):
        links = links.unionByName(written(_confirmed(more, texts), "links"))
        final = written(components(links), "components")
    release_shuffles(base.sparkSession)
    more = written(_mixed(crowded, mine, final, True, written), "links")
    release_shuffles(base.sparkSession)
    if more.take(1):
        final = written(components(links.unionByName(more)), "components")
    # The smallest doc_id of each class's component, brought to the rows of the class.
    grouped = heads.select("digest", "doc_id", "node").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("smallest"), F.count("*").alias("classes"))
    least = joined(grouped.select("digest", "component"), written(least, "least"), "component", "classes").select("digest", "smallest")
    copies = some.groupBy("digest").agg(F.count("*").alias("copies")).join(least, "digest")
    ranked = signed.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("digest")).alias("digest"))
    alone = ranked.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("smallest"))
    out = alone.unionByName(joined(ranked.where("digest is not null"), written(copies, "copies"), "digest", "copies").select("doc_id", "n_shingles", "smallest"))
    out = out.withColumnRenamed("smallest", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, n_shingles, component_id, kept."""
    return near_duplicates(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stand for their group: those of its smallest doc_id.

    Rows that repeat the smallest doc_id of their group (or have none) all stay.
    """
    spark = docs.sparkSession
    found = near_duplicates(spark, docs)
    gone = found.where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
