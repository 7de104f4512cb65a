"""Targets, features and scores that decide which tasks to audit, from predictions made without the task's own fold."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .models import feature_view
from .selection import average_ranks


def _log_gap(a: str, b: str, least: float = 1e-9) -> Column:
    """How far two positive measures are apart as logarithms."""
    return F.abs(F.log(F.greatest(F.col(a), F.lit(least))) - F.log(F.greatest(F.col(b), F.lit(least))))


def _ranked(rows: DataFrame, key: str, by: Sequence[str], **values: str) -> DataFrame:
    """``rows`` with the average rank of each value in its group, as a share of the group; null values have none."""
    for name, value in values.items():
        found = average_ranks(rows.where(F.col(value).isNotNull()), by, value, key).select(key, F.col("share").alias(name))
        rows = written(rows.join(found, key, "left"), "ranked")
    return rows


def gate_targets(rows: DataFrame, key: str, workflow: str, process: str, peak: str, consumed: str, request: str, point: str, plain: str, informed: str, c_hat: str, top: float = 0.90) -> DataFrame:
    """What the outcome tells of each row: shortfall, under, surprise (of ``point``), gain (of ``informed`` over the ``plain`` point),
    ranks within workflow and process, and ``heavy``, the label of rows that are worth an audit.

    Heavy are rows of a tail (peak or surprise among the ``top``, or under) whose consumption surprises or whose history helped. Ranks
    come from range sorts. These columns are labels: none of them may be a feature.
    """
    t = rows.withColumn("shortfall", F.greatest(F.col(peak) - F.col(request), F.lit(0.0))).withColumn("under", F.col(peak) > F.col(request))
    t = t.withColumn("surprise", _log_gap(peak, point)).withColumn("gain", _log_gap(peak, plain) - _log_gap(peak, informed))
    t = t.withColumn("consumed_error", F.when(F.col(consumed).isNotNull(), _log_gap(consumed, c_hat, 1.0)))
    for c in ("surprise", "gain", "consumed_error"):
        t = t.withColumn(c, F.round(c, 9))
    t = _ranked(t, key, [workflow, process], peak_rank=peak, surprise_rank="surprise", consumed_rank="consumed_error")
    tail = (F.col("peak_rank") >= top) | (F.col("surprise_rank") >= top) | F.col("under")
    return t.withColumn("heavy", tail & (F.coalesce(F.col("consumed_rank") >= top, F.lit(False)) | (F.col("gain") > 0)))


def gate_features(rows: DataFrame, plain: Sequence[str], quantiles: Sequence[str], low: str, high: str, broad: str, labels: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """``rows`` with logarithms of ``plain`` and ``quantiles``, the width of the predicted tail and how far the local and the ``broad``
    tail are apart; and the names of these features. A label among the sources is an error.
    """
    feature_view("all", {"all": [*plain, *quantiles, low, high, broad]}, labels)
    logs = {f"log_{c}": F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0))) for c in [*plain, *quantiles]}
    gap = F.log(F.greatest(F.col(high), F.lit(1e-9))) - F.log(F.greatest(F.col(low), F.lit(1e-9)))
    more = {"tail_interval": F.greatest(gap, F.lit(0.0)), "local_global": _log_gap(high, broad)}
    return rows.withColumns(logs | more), [*logs, *more]


def gate_lanes(rows: DataFrame, key: str, workflow: str, risk: str, shortfall: str, information: str, interval: str, spread: str, distance: str, confidence: str) -> DataFrame:
    """key, risk, information and discovery scores of each row, from ranks within its workflow.

    Fixed values: the weights of the parts of a score.
    """
    parts = {"r_risk": risk, "r_shortfall": shortfall, "r_information": information, "r_interval": interval, "r_spread": spread, "r_distance": distance}
    t = _ranked(rows.select(key, workflow, confidence, *dict.fromkeys(parts.values())), key, [workflow], **parts)
    weighed = lambda **w: reduce(lambda a, b: a + b, [F.lit(x) * F.col(f"r_{c}") for c, x in w.items()])
    discovery = weighed(interval=0.35, spread=0.25, distance=0.20) + 0.20 * (1 - F.col(confidence))
    return t.select(key, weighed(risk=0.70, shortfall=0.30).alias("risk"), F.col("r_information").alias("information"), discovery.alias("discovery"))
