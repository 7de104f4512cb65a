"""Exact top-k search by multi-resolution segment statistics.

A vector's segments keep their mean and deviation. By Cauchy's inequality, segment by segment, the squared distance of
two vectors is at least the sum of L * ((mean - mean')^2 + (dev - dev')^2). As a vector's squared norm is the sum of
L * (mean^2 + dev^2), that bounds the inner product from above by the sum of L * (mean * mean' + dev * dev'), itself an
inner product of statistics. Bounds are taken at 1, 4 and 16 segments, coarse to fine; each raises the query's floor by the
exact scores of the likeliest rows and leaves only rows that reach it; exact scores are computed for the survivors.
Queries and rows meet in blocks, as matrices; a block passes on its best k a query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RESOLUTIONS = (1, 4, 16)

TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _matrix(lists: pa.Array) -> np.ndarray:
    """floor(256 x) of each component as float64, short vectors padded by zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    n = np.diff(np.asarray(lists.offsets))
    flat = np.floor(256.0 * np.asarray(lists.flatten(), np.float64))
    out = np.zeros((len(n), int(n.max()) if len(n) else 0))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """Means and deviations of each row's segments, times the root of their length."""
    s = x.reshape(len(x), parts, -1)
    return np.concatenate((s.mean(2), s.std(2)), 1) * np.sqrt(s.shape[2])


#: Queries of a block that are searched at once.
_AT_ONCE = 64


def _search(k: int):
    def run(key, left, right):
        """One block of queries against one block of rows."""
        q_ids, c_ids = np.asarray(left["vec_id"]), np.asarray(right["vec_id"])
        if not len(q_ids) or not len(c_ids):
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        q, c = _matrix(left["embedding"]), _matrix(right["embedding"])
        width = max(q.shape[1], c.shape[1], 1)
        width = -(-width // RESOLUTIONS[-1]) * RESOLUTIONS[-1]
        q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
        # Whole numbers below 2**53 are exact in float64; else int64, which has to hold every partial sum.
        most = width * np.abs(q).max(initial=0) * np.abs(c).max(initial=0)
        if most >= 2**63:
            raise OverflowError("components too large: an inner product may exceed a long")
        if most >= 2**53:
            whole_q, whole_c = q.astype(np.int64), c.astype(np.int64)
        else:
            whole_q, whole_c = q, c
        levels = [(_statistics(q, r), _statistics(c, r)) for r in RESOLUTIONS]
        norms, out, few = np.sqrt((c * c).sum(1)), [], min(2 * k, len(c))
        for lo in range(0, len(q), _AT_ONCE):
            own, ids = whole_q[lo : lo + _AT_ONCE], q_ids[lo : lo + _AT_ONCE]
            live, floor = c_ids[None] != ids[:, None], np.full(len(own), -np.inf)
            # What rounding may take from a bound.
            slack = 1e-9 * (1 + np.sqrt((q[lo : lo + _AT_ONCE] ** 2).sum(1))[:, None] * norms[None])
            for sq, sc in levels:
                if len(c) <= 4 * k:
                    break
                bound = np.where(live, sq[lo : lo + _AT_ONCE] @ sc.T + slack, -np.inf)
                best = np.argpartition(-bound, few - 1, axis=1)[:, :few]
                score = np.where(np.take_along_axis(live, best, 1), np.einsum("ij,ikj->ik", own, whole_c[best]), -np.inf)
                floor = np.maximum(floor, np.partition(score, few - k, axis=1)[:, few - k])
                live &= bound >= floor[:, None]
            there = np.flatnonzero(live.any(0))
            score = own @ whole_c[there].T
            row, col = np.nonzero(live[:, there])
            score, row_id = score[row, col].astype(np.int64), c_ids[there][col]
            order = np.lexsort((row_id, -score, row))
            row = row[order]
            first = np.searchsorted(row, np.arange(len(own)))
            top = np.arange(len(row)) - first[row] < k
            out.append((ids[row[top]], row_id[order][top], score[order][top]))
        a, b, s = (np.concatenate([x[j] for x in out]) for j in range(3))
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    return run


def exact_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, query_block: int = 8192, row_block: int = 16384) -> DataFrame:
    """Each query's ``k`` rows of highest inner product of floor(256 x), ties to the smaller vec_id.

    Both take vec_id and embedding; other columns are ignored. Vectors that are null or hold null or non-finite
    components, and rows without vec_id, take no part; shorter vectors count as padded with zeros. A query never
    meets rows of its own vec_id. Of rows that repeat a vec_id, each counts. Returns query_id, rank, vec_id, score;
    fewer than ``k`` rows where fewer exist, none for an empty table. Components so large that an inner product may
    exceed a long are an error, as such a score has no value to return.

    A task holds one block of each side; vectors travel once per block of the other side, so larger blocks shuffle less.
    """
    whole = F.expr("embedding is not null and vec_id is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")
    kept = ["vec_id", "embedding"]
    v = vectors.select(F.col("vec_id").cast("long"), "embedding").where(whole)
    q = queries.select(F.col("vec_id").cast("long"), "embedding").where(whole)
    n_q, n_v = q.count(), v.count()
    if not n_q or not n_v:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    q_blocks, v_blocks = -(-n_q // query_block), -(-n_v // row_block)
    # Block pairs; the smaller side of each block travels: queries, a fiftieth of the rows in the query below.
    def pair(x, y):
        return (F.col(x) * F.lit(v_blocks) + F.col(y)).alias("pair")

    q = q.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks))).withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(v_blocks - 1))))
    v = v.withColumn("vb", F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(v_blocks))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    met = q.select(pair("qb", "vb"), *kept).groupBy("pair").cogroup(v.select(pair("qb", "vb"), *kept).groupBy("pair"))
    found = met.applyInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vec_id divisible by 50 against all embeddings."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_topk(v, v.where("vec_id % 50 = 0"))
