"""Groups of rows linked by shared tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written


def components(tokens: DataFrame, key: str, token: str, cap: int = 100) -> DataFrame:
    """``key`` and ``component_id``, the smallest key reachable over tokens that at most ``cap`` rows share.

    Labels go from keys to tokens and back, then each label takes its label's label, so rounds grow with the
    logarithm of a chain's length. Every round is a written table; only a count of changes reaches the driver.
    """
    clean = tokens.select(F.col(key).alias("k"), F.col(token).alias("t")).where("k is not null").distinct()
    used = clean.where("t is not null").groupBy("t").count().where(F.col("count").between(2, cap)).select("t")
    links = written(clean.join(used, "t"), "links")
    labels = written(clean.select("k", F.col("k").alias("label")).distinct(), "labels")
    while True:
        least = links.join(labels, "k").groupBy("t").agg(F.min("label").alias("label"))
        offered = links.join(least, "t").groupBy("k").agg(F.min("label").alias("offer"))
        step = labels.join(offered, "k", "left").select("k", F.col("label").alias("old"), F.least("label", F.coalesce("offer", "label")).alias("label"))
        step = written(step, "step")
        if step.where("label <> old").limit(1).count() == 0:
            return step.select(F.col("k").alias(key), F.col("label").alias("component_id"))
        jump = step.select(F.col("k").alias("label"), F.col("label").alias("further"))
        labels = written(step.join(jump, "label", "left").select("k", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
