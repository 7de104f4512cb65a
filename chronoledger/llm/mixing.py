"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall, by a keyed hash of their content, into blocks of a bounded number of documents; the order
of blocks is the source's permutation. A source's quota is exact: the blocks of whole passes and those that its target
reaches in the last pass. A binary tree over the output shards splits the quotas of all sources, each node drawing the
left half's counts from the multivariate hypergeometric distribution. A shard then draws as many blocks of a source as
the tree gave it, the next ones in permuted order, so draws are disjoint; of the block that a target ends in, documents
are taken up to a cut in permuted order. Each shard is ordered by a keyed hash.

Sums of sources are tables; only totals over all sources reach the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch, partitions, written

#: Documents of a block and blocks of an output shard, on average; parts that the rows of a source are dealt over.
DOCS_PER_BLOCK, BLOCKS_PER_SHARD, SALTS = 64, 128, 16
#: Binary levels of the tree that one task splits at once.
LEVELS = 6
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good: one uniform number, inverted from the mode, at any size."""
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    spread = math.sqrt(n * (good / total) * (bad / total) * ((total - n) / max(1, total - 1)))
    reach = int(12 * spread) + 32  # beyond lies less than 1e-30
    a, b = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    log_p = np.append(0.0, np.cumsum(np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))))
    upto = np.cumsum(np.exp(log_p - log_p.max()))
    return a + min(int(np.searchsorted(upto, rng.random() * upto[-1], "right")), b - a)


def split_tree(counts: np.ndarray, lo: int, hi: int, seed: int, levels: int = 64) -> list[tuple[int, int, np.ndarray]]:
    """The nodes ``levels`` below [lo, hi): (from, to, counts). Sizes of halves are in proportion to their shards."""
    have = np.asarray(counts, np.int64)
    if hi - lo == 1 or not levels:
        return [(lo, hi, have)]
    mid = (lo + hi) // 2
    rng = np.random.Generator(np.random.PCG64([seed, lo, hi]))
    total = int(have.sum())
    n, left = total * (mid - lo) // (hi - lo), np.zeros_like(have)
    for i, c in enumerate(have.tolist()):  # the multivariate draw, one source after another
        total -= c
        left[i] = hypergeometric(rng, c, total, n)
        n -= int(left[i])
    return split_tree(left, lo, mid, seed, levels - 1) + split_tree(have - left, mid, hi, seed, levels - 1)


def _split(seed: int):
    def run(key, table):
        table = table.sort_by("rank")
        rank, counts = np.asarray(table["rank"]), np.asarray(table["count"])
        rows = [(lo, hi, rank[some], left[some]) for lo, hi, left in split_tree(counts, key[0].as_py(), key[1].as_py(), seed, LEVELS) if len(some := np.flatnonzero(left))]
        size = [len(r[2]) for r in rows]
        join = lambda i: np.concatenate([np.zeros(0, np.int64), *(r[i] for r in rows)])
        return pa.table({"lo": np.repeat(np.array([r[0] for r in rows], np.int64), size), "hi": np.repeat(np.array([r[1] for r in rows], np.int64), size), "rank": join(2), "count": join(3)})

    return run


def _earlier(df: DataFrame, value: str, place: str, width: Column) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over the rows of its rank at smaller places.

    In two steps, over stretches of ``width`` places and within each, so a rank with many rows is no one task's.
    """
    df = df.withColumn("stretch", F.floor(F.col(place) / width))
    sums = df.groupBy("rank", "stretch").agg(F.sum(value).alias("sum"))
    up = lambda w, by: F.coalesce(F.sum(by).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("start", up(Window.partitionBy("rank").orderBy("stretch"), "sum")).drop("sum")
    inner = df.withColumn("inner", up(Window.partitionBy("rank", "stretch").orderBy(place), value))
    return inner.join(sums, ["rank", "stretch"]).withColumn("before", F.col("start") + F.col("inner")).drop("stretch", "start", "inner")


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """``sources`` with ``rank``, their place in code-point order, null last."""
    n = partitions(sources.sparkSession)
    by = [F.col("source").isNull(), F.col("source")]
    order = sources.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    order = scratch.written(order.withColumn("part", F.shiftright("at", 33)), "sources")
    parts = order.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # one row per partition
    start = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return order.join(parts.withColumn("start", start), "part").withColumn("rank", F.col("start") + F.col("at") - F.col("first")).drop("part", "n", "first", "start", "at")


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """``sources`` (rank, size) with ``target``: ``share`` times all sizes by weight, and what exceeds ``most`` times a
    source's size reshared by weight. All that is below its bound gets one and the same measure times its weight; the
    measure only grows, so it is found by a few sums over all sources."""
    weight = F.element_at(F.lit([float(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    measure, bound = 0.0, -1
    while True:
        over = F.lit(measure) * weight > F.lit(float(most)) * F.col("size")
        sums = sources.groupBy((F.col("rank") % len(weights)).alias("r")).agg(
            F.sum("size").alias("size"), F.sum(F.when(over, F.col("size")).otherwise(0)).alias("bound"), F.count_if(over).alias("n"), F.count_if(~over).alias("free")
        ).collect()
        free, now = sum(weights[r.r] * r.free for r in sums), sum(r.n for r in sums)
        if not free or now == bound:
            break
        bound, measure = now, (share * sum(r["size"] for r in sums) - most * sum(r["bound"] for r in sums)) / free
    return sources.withColumn("target", F.least(F.lit(measure) * weight, F.lit(float(most)) * F.col("size")) if sums else F.lit(0.0))


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, tid and u (the permutation) of each row, and ``row``: all its columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    base = docs.select(row, F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tid"))
    return base.withColumn("u", F.xxhash64(F.lit(seed), "doc_id", "tid"))


def _placed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """``rows`` with what is known of their source and with their block. A source may hold a third of all rows: they are salted."""
    salted = sources.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")).withColumnRenamed("source", "s")
    known = rows.withColumn("salt", F.pmod("u", F.lit(SALTS)).cast("int")).join(salted, "salt").where(F.col("source").eqNullSafe(F.col("s"))).drop("s", "salt")
    return known.withColumn("block", F.pmod(F.shiftright("u", 20), F.col("blocks")))


def _order() -> Column:
    """The permuted order of documents."""
    return F.struct("u", F.coalesce("doc_id", F.lit(2**63 - 1)).alias("id"), "tid")


def _slots(sizes: DataFrame, scratch: Scratch, weights, share, most, blocks_per_shard, docs_per_block, seed) -> tuple[DataFrame, DataFrame]:
    """The sources, and the draws: (rank, block, copy, shard) and, where a target ends in the block, its cut."""
    spark = sizes.sparkSession
    found = scratch.written(sizes.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")), "sources")
    sources = source_targets(scratch.written(_ranked(found, scratch), "sources"), weights, share, most)
    passes = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(0).cast("long")
    sources = sources.withColumn("passes", passes).withColumn("blocks", F.ceil(F.col("docs") / docs_per_block))
    sources = scratch.written(sources.withColumnRenamed("size", "source_size").drop("docs"), "sources")
    known = _placed(sizes, sources)
    blocks = scratch.written(known.groupBy("rank", "block").agg(F.sum("size").alias("words"), *[F.first(c).alias(c) for c in ("blocks", "passes", "source_size", "target")]), "blocks")
    state = _earlier(blocks, "words", "block", F.ceil(F.sqrt("blocks"))).withColumn("room", F.col("target") - F.col("passes") * F.col("source_size") - F.col("before"))
    state = scratch.written(state.where("room > 0").select("rank", "block", "room", "words"), "reached")
    # The quota: blocks of whole passes and those up to the last that the target reaches.
    reach = state.groupBy("rank").agg((F.max("block") + 1).alias("reach"))
    quota = sources.join(reach, "rank", "left").select("rank", (F.col("passes") * F.col("blocks") + F.coalesce("reach", F.lit(0))).alias("count")).where("count > 0")
    quota = scratch.written(quota, "quota")
    total = quota.agg(F.sum("count")).first()[0] or 0
    shards = max(1, -(-total // blocks_per_shard))
    nodes = quota.select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "rank", "count")
    for _ in range(-(-max(1, (shards - 1).bit_length()) // LEVELS)):
        nodes = nodes.groupBy("lo", "hi").applyInArrow(_split(seed), "lo long, hi long, rank long, count long")
    leaves = scratch.written(nodes.select("rank", F.col("lo").alias("shard"), "count"), "leaves")
    drawn = _earlier(leaves, "count", "shard", F.lit(math.isqrt(shards - 1) + 1)).join(sources.select("rank", "blocks", "passes"), "rank")
    slot = F.explode(F.sequence("before", F.col("before") + F.col("count") - 1)).alias("slot")
    drawn = drawn.select("rank", "shard", "blocks", "passes", slot)
    drawn = drawn.select("rank", (F.col("slot") % F.col("blocks")).alias("block"), F.floor(F.col("slot") / F.col("blocks")).alias("copy"), "shard", "passes")
    # Where a target ends inside a block, documents are taken up to a cut.
    part = known.join(state.where("room < words"), ["rank", "block"]).select("rank", "block", "size", "room", _order().alias("order"))
    run = F.sum("size").over(Window.partitionBy("rank", "block").orderBy("order").rowsBetween(Window.unboundedPreceding, 0))
    part = part.withColumn("run", run).groupBy("rank", "block").agg(F.max(F.when(F.col("run") - F.col("size") / 2 <= F.col("room"), F.col("order"))).alias("cut"))
    part = part.select("rank", "block", "cut", F.lit(True).alias("ends"))
    drawn = drawn.join(part, ["rank", "block"], "left")
    last = F.coalesce(F.col("ends"), F.lit(False)) & (F.col("copy") == F.col("passes"))
    return sources, scratch.written(drawn.select("rank", "block", "copy", "shard", last.alias("ends"), F.when(last, F.col("cut")).alias("cut")), "slots")


def _draw(rows: DataFrame, sources: DataFrame, slots: DataFrame, seed: int) -> DataFrame:
    """``rows`` as often as their blocks are drawn; a row that is never taken once, without copy."""
    out = _placed(rows, sources).join(slots, ["rank", "block"], "left")
    taken = (F.col("size") > 0) & F.col("copy").isNotNull() & (~F.col("ends") | F.coalesce(_order() <= F.col("cut"), F.lit(False)))
    out = out.withColumn("taken", F.coalesce(taken, F.lit(False))).where("taken or copy is null or copy = 0")
    out = out.withColumn("copy", F.when(F.col("taken"), F.col("copy"))).withColumn("shard", F.when(F.col("taken"), F.col("shard")))
    return out.withColumn("place", F.xxhash64(F.lit(seed + 1), "u", "copy"))


def _mixed(docs: DataFrame, scratch: Scratch, whole: bool, weights, share, most, blocks_per_shard, docs_per_block, seed) -> DataFrame:
    rows = _keyed(docs, seed)
    sizes = scratch.written(rows.drop("row").withColumn("row", F.monotonically_increasing_id()), "sizes")  # texts are read once
    sources, slots = _slots(sizes, scratch, weights, share, most, blocks_per_shard, docs_per_block, seed)
    return _draw(rows if whole else sizes, sources, slots, seed)


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    blocks_per_shard: int = BLOCKS_PER_SHARD, docs_per_block: int = DOCS_PER_BLOCK, seed: int = 7,
) -> DataFrame:
    """The mix: one row per document and time that it is taken.

    Takes doc_id, text and source; other columns are ignored. ``weights`` repeat over the sources in code-point
    order, null last; an empty string is a source of its own. Returns row (a number of the input row), doc_id, tid
    (of the text), size, source, source_size, target, copy (from 0; null: not taken), shard and place (a key that
    orders the shard). Documents without words are never taken. Equal rows share a block, and where a target ends among
    them they are taken together. Equal input gives equal output but for ``row``, in any partitioning; an empty table an
    empty one. One task holds one number per source.
    """
    with Scratch(docs.sparkSession) as scratch:
        out = _mixed(docs.select("doc_id", "text", "source"), scratch, False, weights, share, most, blocks_per_shard, docs_per_block, seed)
        return written(out.select("row", "doc_id", "tid", "size", "source", "source_size", "target", "copy", "shard", "place"), "mix")


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents: doc_id, size, source_size, target, taken (and the shards that hold its copies)."""
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return mixed.groupBy("row", "doc_id", "size", "source_size", "target").agg(
        F.sum(F.when(F.col("copy").isNotNull(), F.col("size")).otherwise(0)).alias("taken"), F.sort_array(F.collect_list("shard")).alias("shards")
    ).drop("row")


def mixed_documents(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
    blocks_per_shard: int = BLOCKS_PER_SHARD, docs_per_block: int = DOCS_PER_BLOCK, seed: int = 7,
) -> DataFrame:
    """The rows of ``docs``, with all their columns, as often as the mix takes them.

    Rows are dealt over partitions by output shard and, within each, ordered by shard and then by the shard's shuffled
    order, so files that are written from this hold whole shards; small tables of the plan stay in the shared folder. Columns of any names pass through. Null and empty texts
    have no words and are not taken; see ``mix_sources`` for ties, nulls and repeated rows.
    """
    spark, order = docs.sparkSession, docs.columns
    out = _mixed(docs, Scratch(spark), True, weights, share, most, blocks_per_shard, docs_per_block, seed).where("taken")
    out = out.select("row", "shard", "place").repartition(partitions(spark), "shard").sortWithinPartitions("shard", "place")
    return out.select(*[F.col("row").getField(c).alias(c) for c in order])
