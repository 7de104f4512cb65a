"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the text alone (lengths, shares of character classes, repetition) are standardised and mapped to
cos(Wx + b), whose inner products approximate a Gaussian kernel. Normal equations are summed by partition and solved
on the driver (their size depends on the number of features only); scores are calibrated by isotonic regression on a
histogram of fixed size, over labelled rows that the ridge was not fitted on.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import written
from .words import buffers, hashed, ids, slices, spans, windows

#: Random features, ridge penalty per row, bins of the calibration, and the bound on labelled rows that are fitted.
FEATURES, RIDGE, BINS, MAX_LABELLED = 256, 1e-4, 1000, 1_000_000
KEEP_FROM = 0.7
#: Parts of the labelled rows, and every which of them calibrates.
_PARTS, CALIBRATE = 16, 5

_CLASS = np.full(256, 9, np.uint8)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"-()", b"!?", b"|", b"#$%&*@^~=+_<>{}[]\\/")):
    _CLASS[list(_set)] = _i
_CLASS[128:] = 10


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of statistics per document, finite for every text."""
    n = len(off) - 1
    classes = _CLASS[data]
    chars = np.array([np.bincount(classes[a:b], minlength=11) for a, b in zip(off, off[1:])], np.float64).reshape(n, 11)
    starts, ends, word_off = spans(data, off)
    h, size = hashed(data, starts, ends, fold=True), (ends - starts).astype(np.float64)
    words = np.diff(word_off).astype(np.float64)
    some = np.maximum(words, 1)

    def total(x):
        c = np.concatenate(([0.0], np.cumsum(x)))
        return c[word_off[1:]] - c[word_off[:-1]]

    mean = total(size) / some
    spread = np.sqrt(np.maximum(total(size**2) / some - mean**2, 0))
    first = data[starts] if len(starts) else np.zeros(0, np.uint8)
    last = data[ends - 1] if len(starts) else first
    same = np.r_[False, h[1:] == h[:-1]] if len(h) else np.zeros(0, bool)
    five = windows(h, 5)
    distinct, fresh = np.ones(n), np.ones(n)
    for i, (a, b) in enumerate(zip(word_off, word_off[1:])):
        if b - a > 1:
            distinct[i] = len(np.unique(h[a:b])) / (b - a)
        if b - a > 5:
            fresh[i] = len(np.unique(five[a : b - 4])) / (b - a - 4)
    shares = chars / np.maximum(chars.sum(1), 1)[:, None]
    return np.column_stack(
        (
            np.log1p(np.diff(off)), np.log1p(words), shares, np.log1p(mean), np.log1p(spread), total(same) / some, distinct * np.log1p(words), distinct, fresh,
            total(size <= 3) / some, total((first >= 65) & (first <= 90)) / some, total(_CLASS[last] == 8) / some, total((first == 124) & (size == 1)) / some, np.log1p(chars[:, 4]),
        )
    )


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _fourier((np.asarray(x) - self.mean) / self.scale, self.weights, self.phase) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.levels), 0, 1) if len(x) else np.zeros(0)


def _fourier(x: np.ndarray, weights: np.ndarray, phase: np.ndarray) -> np.ndarray:
    z = np.cos(np.clip(x, -8, 8) @ weights + phase) * np.sqrt(2 / len(phase))
    return np.column_stack((z, np.ones(len(x))))


def _isotonic(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators."""
    pools: list[list[float]] = []
    for v, w in zip(value, weight):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v1, w1, c1 = pools.pop()
            v0, w0, c0 = pools.pop()
            pools.append([(v0 * w0 + v1 * w1) / (w0 + w1), w0 + w1, c0 + c1])
    return np.concatenate([np.full(int(c), v) for v, _, c in pools])


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % by


_STATS = "doc_id long, x array<double>"


def _measure(batches):
    for batch in slices(batches):
        x = statistics(*buffers(batch["text"]))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].cast(pa.int64()), "x": flat})


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of every document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_measure, _STATS)


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch["x"].flatten()).reshape(batch.num_rows, -1)


def _summed(rows: DataFrame, moments) -> np.ndarray | None:
    """The sum over all rows of an array of fixed shape, first by partition (of which there are ``_PARTS``)."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                now = moments(_rows(batch), np.asarray(batch["quality"], np.float64))
                total = now if total is None else total + now
        if total is not None:
            yield pa.RecordBatch.from_pydict({"s": pa.array([np.ascontiguousarray(total, np.float64).tobytes()], pa.binary())})

    parts = [np.frombuffer(r.s) for r in rows.mapInArrow(run, "s binary").collect()]
    return sum(parts[1:], parts[0].copy()) if parts else None


def fit_quality(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> QualityModel | None:
    """Fits on labelled rows whose crc32(doc_id) mod 4 is not 2; None without any. Null labels are no labels.

    At most about ``max_labelled`` rows, drawn by a hash of the id, are used, so their ids can be broadcast; only texts
    that have one are measured. One row in ``CALIBRATE``, by a hash of the id, calibrates and is not fitted; where
    there is none of either kind, all rows do both.
    """
    use = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    use = use.where(F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), 4) != 2))
    n = use.count()
    if n > max_labelled:
        use = use.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_labelled / n))
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(use.select("doc_id").distinct()), "doc_id", "left_semi")
    side = (F.pmod(F.xxhash64(F.lit(6), "doc_id"), F.lit(CALIBRATE)) == 0).alias("calibrates")
    whole = written(measured(some).join(F.broadcast(use), "doc_id").select("x", "quality", side).repartition(_PARTS), "labelled")
    fits, calibrates = whole.where("not calibrates"), whole.where("calibrates")
    rows, checked = (fits, calibrates) if fits.take(1) and calibrates.take(1) else (whole, whole)
    first = _summed(rows, lambda x, y: np.concatenate((x.sum(0), (x**2).sum(0), [len(x), y.sum()])))
    if first is None:
        return None
    count, d = first[-2], (len(first) - 2) // 2
    mean = first[:d] / count
    scale = np.sqrt(np.maximum(first[d : 2 * d] / count - mean**2, 0))
    scale[scale < 1e-9] = 1
    rng = np.random.Generator(np.random.PCG64(6))
    weights, phase = rng.normal(0, 1 / np.sqrt(d), (d, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    m = FEATURES + 1

    def normal(x, y):
        z = _fourier((x - mean) / scale, weights, phase)
        return np.concatenate(((z.T @ z).ravel(), z.T @ y))

    sums = _summed(rows, normal)
    beta = np.linalg.solve(sums[: m * m].reshape(m, m) + RIDGE * count * np.eye(m), sums[m * m :])
    model = QualityModel(mean, scale, weights, phase, beta, np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def histogram(x, y):
        at = np.clip(((model.raw(x) + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at, y, minlength=BINS)))

    h = _summed(checked, histogram)
    there = np.flatnonzero(h[:BINS])
    level = _isotonic(h[BINS:][there] / h[:BINS][there], h[:BINS][there])
    model.knots, model.levels = (there + 0.5) / BINS * 2 - 0.5, level
    return model


def _scored(model):
    def run(batches):
        for batch in batches:
            x = _rows(batch)
            score = model.score(x) if model else np.ones(len(x))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": pa.array(score, pa.float64())})

    return run


def quality_scores(stats: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``stats``; score 1 without a model."""
    out = stats.mapInArrow(_scored(model), "doc_id long, score double")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP_FROM).cast("int").alias("predicted"))


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on ``labels`` (doc_id, quality) and scores every row of ``docs`` (doc_id, text; others are ignored).

    Null and empty texts have the statistics of an empty text. Repeated doc_ids are scored row by row; each label row
    counts. A null doc_id has no label and is not held out. Without labelled rows every score is 1. An empty table
    gives an empty result.
    """
    return quality_scores(measured(docs), fit_quality(docs, labels))


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does not reject.

    Null and empty texts are judged as empty ones; repeated rows alike; without labelled rows all stay. An empty table stays empty.
    """
    model = fit_quality(docs, labels)
    if model is None:
        return docs

    def run(batches):
        for batch in slices(batches, text):
            yield batch.filter(pa.array(model.score(statistics(*buffers(batch[text]))) >= KEEP_FROM))

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names with dots cannot be handed over
    text = f"c{docs.columns.index('text')}"
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: doc_id, held_out, score, predicted."""
    return classify_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
