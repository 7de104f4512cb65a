"""Joins with keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than one HEAVY-th of all rows is heavy; so there are fewer than HEAVY of them, which bounds the broadcast.
HEAVY = 10_000


def joined(rows: DataFrame, small: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """``rows`` with ``small`` (one row per key; ``weight``: the rows that have it), ``inner`` or ``left``.

    Rows of heavy keys stay where they are and meet a broadcast table; all others are shuffled by key.
    """
    total = small.agg(F.sum(weight)).first()[0] or 0
    heavy = F.broadcast(small.where(F.col(weight) * HEAVY > total))
    rest = rows.join(heavy.select(key), key, "left_anti").join(small.where(F.col(weight) * HEAVY <= total), key, how)
    return rows.join(heavy, key).unionByName(rest)
