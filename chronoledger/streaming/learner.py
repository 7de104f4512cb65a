"""Models that are fitted anew inside the stream of outcomes.

Every micro-batch is first scored by the models published before it, without its labels, and then joins the log. When enough
outcomes are new, all views are fitted again on the log without its newest ones; the models just fitted predict these, and
what they miss is the calibration of their version. A version is a folder of its own; a pointer is written when it is whole, and
the next batch loads what the pointer names.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .feedback import refresh_due, rows_of

_POINTER = "version int, eligible long, batch long"
_COUNT = "eligible long, batch long"


@dataclass(frozen=True)
class Learner:
    """``views`` make the models to be fitted side by side (``fit``, ``predict``, ``save``, ``load``); a model's first prediction
    and ``bound`` (columns of its predictions) give a request, the larger of both.

    The first version is fitted at ``first`` outcomes, then one every ``every``; the ``window`` newest by ``order`` calibrate.
    """

    root: str
    views: Mapping[str, Callable[[], object]]
    key: str
    target: str
    labels: Sequence[str]
    order: Sequence[str]
    bound: Sequence[str]
    first: int = 32
    every: int = 64
    window: int = 128

    def _path(self, version: int, view: str = "") -> str:
        return f"{self.root}/versions/version={version}" + (f"/{view}" if view else "")

    def pointer(self, spark: SparkSession, before: int | None = None) -> tuple[int, int]:
        """The newest published version and the outcomes it knows of; (0, 0) if there is none."""
        found = rows_of(spark, f"{self.root}/pointer", _POINTER, before).agg(F.max(F.struct("version", "eligible")).alias("p")).first().p
        return (found.version, found.eligible) if found else (0, 0)

    def _requests(self, model: object, rows: DataFrame, view: str, version: int) -> DataFrame:
        got = model.predict(rows, self.key)
        return got.select(self.key, F.lit(view).alias("view"), F.lit(version).alias("version"), F.greatest(*self.bound).alias("request"))

    def score(self, spark: SparkSession, rows: DataFrame, version: int) -> DataFrame:
        """key, view, version and request of ``rows`` by a published version; a version whose calibration is another's is an error."""
        found = []
        if version and self.calibration(spark, version).where(F.col("model_version") != version).limit(1).count():
            raise ValueError(f"the calibration of version {version} belongs to another one")
        for view, make in self.views.items():
            if version:
                found.append(self._requests(make().load(spark, self._path(version, view)), rows, view, version))
            else:
                found.append(rows.select(self.key, F.lit(view).alias("view"), F.lit(0).alias("version"), F.lit(None).cast("double").alias("request")))
        return reduce(DataFrame.unionByName, found)

    def calibration(self, spark: SparkSession, version: int) -> DataFrame:
        """key, view, model_version, request and residual (logarithm of target by request) of what a version was calibrated on."""
        return spark.read.parquet(self._path(version, "calibration"))

    def fit(self, spark: SparkSession, log: DataFrame, version: int) -> None:
        """Fits all views on ``log`` without its newest ``window`` outcomes, and calibrates them on these."""
        newest = log.orderBy(*[F.desc(c) for c in self.order]).limit(self.window)  # at most ``window`` rows
        newest.write.mode("overwrite").parquet(self._path(version, "block"))
        block = spark.read.schema(log.schema).parquet(self._path(version, "block"))
        train = log.join(F.broadcast(block.select(self.key)), self.key, "left_anti")
        for view, make in self.views.items():
            make().fit(train).save(self._path(version, view))
        blind = block.drop(*self.labels)
        # what is published predicts its block, not what is still in memory
        parts = [self._requests(make().load(spark, self._path(version, view)), blind, view, version) for view, make in self.views.items()]
        held = reduce(DataFrame.unionByName, parts).join(block.select(self.key, self.target), self.key)
        held = held.select(self.key, "view", F.col("version").alias("model_version"), "request", F.log(F.col(self.target) / F.col("request")).alias("residual"))
        held.write.mode("overwrite").parquet(self._path(version, "calibration"))

    def step(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch: score, log, and fit if due. Run again, it overwrites what it wrote and publishes the same version."""
        spark = batch.sparkSession
        version, fitted = self.pointer(spark, batch_id)
        log = f"{self.root}/log"
        batch.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        mine = spark.read.schema(batch.schema).parquet(f"{log}/batch={batch_id}")
        self.score(spark, mine.drop(*self.labels), version).write.mode("overwrite").parquet(f"{self.root}/scored/batch={batch_id}")
        known = rows_of(spark, f"{self.root}/counts", _COUNT, batch_id).agg(F.max("eligible")).first()[0] or 0
        eligible = known + mine.count()
        spark.createDataFrame([(eligible,)], "eligible long").write.mode("overwrite").parquet(f"{self.root}/counts/batch={batch_id}")
        if refresh_due(eligible, fitted, self.first, self.every) and eligible > self.window:
            whole = rows_of(spark, log, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema) + ", batch long", batch_id + 1).drop("batch")
            self.fit(spark, whole, version + 1)
            spark.createDataFrame([(version + 1, eligible)], "version int, eligible long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/pointer/batch={batch_id}")

    def learn(self, outcomes: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs ``step`` for every micro-batch of the stream ``outcomes`` that is at hand."""
        return outcomes.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
