"""The feedback loop as Structured Streaming: outcomes arrive as files, join history once, and trigger refits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import positions, same_keys
from ..storage import Scratch, remove

OUTCOME = "task_id string, workflow string, process string, exit_status int, completion_us long, peak_bytes long, consumed_bytes long"


def route(outcomes: DataFrame) -> DataFrame:
    """``route``: training (success with both measures), history (success or out of memory) or skipped."""
    ok, oom = F.col("exit_status") == 0, F.col("exit_status") == 137
    return outcomes.withColumn("route", F.when(ok & F.col("peak_bytes").isNotNull() & F.col("consumed_bytes").isNotNull(), "training").when(ok | oom, "history").otherwise("skipped"))


_APPLIED = OUTCOME + ", route string, digest long, status string, seq long, batch long"
_STATE = "workflow string, base long, arrived long, batch long"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rows_of(spark: SparkSession, table: str, schema: str, before: int | None = None) -> DataFrame:
    """Rows of a folder by batch, also of one that holds no file yet; a batch that is run again does not see itself."""
    root = spark._jvm.org.apache.hadoop.fs.Path(table)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], schema)
    found = spark.read.schema(schema).parquet(table)
    return found if before is None else found.where(F.col("batch") < before)


def applied(spark: SparkSession, table: str) -> DataFrame:
    """What ``ingest`` has taken in."""
    return rows_of(spark, table, _APPLIED)


def _apply(batch: DataFrame, batch_id: int, table: str, strict: bool) -> None:
    spark, root = batch.sparkSession, table.rstrip("/")
    # The last sequences are a small table of their own: each batch carries on all workflows', so one is read.
    past = rows_of(spark, f"{root}-state", _STATE, batch_id)
    newest = past.agg(F.max("batch")).first()[0]
    carried = past.where(F.col("batch") == newest).drop("batch")
    base = carried.drop("arrived")
    with Scratch(spark) as scratch:
        both = scratch.written(batch, "arrivals")  # once: reading it anew would ask the state anew
        now = both.agg(F.max("arrived")).first()[0]
        last = carried.agg(F.max("arrived")).first()[0]
        if now is not None and last is not None and now <= last:
            raise ValueError(f"the clock went back during batch {batch_id}; start again")
        rows = both.where("first is null").drop("first", "arrived")
        known = both.where("first is not null").select("first", F.col("task_id").alias("__o_task_id"))
        held = rows.join(known, same_keys(rows, known, ["task_id"], "__o_"))
        mine = (F.col("digest") == F.col("first.digest")) & F.col("completion_us").eqNullSafe(F.col("first.completion_us"))
        applied = held.where(mine & (F.col("first.arrived") == F.lit(now))).select(*rows.columns, F.lit("applied").alias("status")).dropDuplicates(["task_id"])
        conflict = held.where(F.col("digest") != F.col("first.digest")).select(*rows.columns, F.lit("conflict").alias("status"))
        placed = positions(applied.unionByName(conflict), ["workflow"], ["completion_us", "task_id", "digest"], F.col("status") == "applied", write=scratch.written)
        placed = placed.join(F.broadcast(base), "workflow", "left").fillna({"base": 0})
        out = placed.withColumn("seq", F.when(F.col("status") == "applied", F.col("base") + F.col("place") + 1)).drop("base", "place")
        out.write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
    done = spark.read.schema(_APPLIED).parquet(f"{root}/batch={batch_id}")
    if strict:
        changed = done.where("status = 'conflict'").select("task_id").take(1)
        if changed:
            remove(spark, f"{root}/batch={batch_id}")
            raise ValueError(f"the outcome of {changed[0].task_id} has changed")
    ends = done.where("seq is not null").select("workflow", F.col("seq").alias("base")).unionByName(base).groupBy("workflow").agg(F.max("base").alias("base"))
    ends.withColumn("arrived", F.lit(last if now is None else now).cast("long")).write.mode("overwrite").parquet(f"{root}-state/batch={batch_id}")


def ingest(spark: SparkSession, source: str, table: str, checkpoint: str, strict: bool = False) -> StreamingQuery:
    """Reads each new file of ``source`` once and appends its outcomes to ``table``.

    Applied outcomes get a sequence per workflow without gaps; the same outcome again is ignored; changed content of a known task
    becomes a row with status ``conflict`` or, if ``strict``, an error that stops the stream before the batch counts. What was
    applied is keyed state (of each task the smallest arrival, and content within it), so a batch costs its own tasks, however many
    came before. A batch overwrites its own folder, so a rerun is idempotent.
    """
    rows = route(spark.readStream.schema(OUTCOME).json(source)).where("route <> 'skipped'")
    fields = [f.name for f in rows.schema]
    # A batch's time is logged with it; beyond the last one's, so that a clock that was set back does not turn batches around.
    last = rows_of(spark, f"{table.rstrip('/')}-state", _STATE).agg(F.max("arrived")).first()[0] or 0
    arrived = F.greatest(F.unix_micros(F.current_timestamp()), F.lit(last + 1))
    rows = rows.withColumns({"digest": F.xxhash64(*[F.col(c) for c in sorted(fields) if c != "route"]), "arrived": arrived})
    first = rows.groupBy("task_id").agg(F.min(F.struct("arrived", "completion_us", "digest")).alias("first"))
    found = rows.unionByName(first, allowMissingColumns=True)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, _ROCKSDB)  # a query keeps the settings that it was started under
    try:
        return found.writeStream.outputMode("update").foreachBatch(lambda b, i: _apply(b, i, table, strict)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def matched(decisions: DataFrame, outcomes: DataFrame, late: str = "1 hour", longest: str = "7 days") -> DataFrame:
    """Streams of decisions and outcomes joined by ``attempt``; state is dropped after ``longest``.

    Decisions have ``decided_at``, outcomes ``completed_at`` (timestamps); a decision comes before its outcome.
    """
    d = decisions.withWatermark("decided_at", late).alias("d")
    o = outcomes.withWatermark("completed_at", late).alias("o")
    within = F.expr(f"d.attempt = o.attempt and o.completed_at >= d.decided_at and o.completed_at <= d.decided_at + interval {longest}")
    return d.join(o, within).select("d.*", *[f"o.{c}" for c in outcomes.columns if c not in decisions.columns])


def refresh_due(eligible: int, fitted: int, first: int = 32, every: int = 64) -> bool:
    """Whether a model fitted on ``fitted`` outcomes (0: none) is to be fitted anew on ``eligible``."""
    return eligible >= first if not fitted else eligible - fitted >= every


def fit_and_block(outcomes: DataFrame, newest: int) -> DataFrame:
    """``block``: the ``newest`` outcomes of each workflow calibrate, the others fit."""
    by = Window.partitionBy("workflow").orderBy(F.desc("completion_us"), F.desc("task_id"))
    return outcomes.withColumn("block", F.when(F.row_number().over(by) <= newest, "calibration").otherwise("fit"))


def publish(df: DataFrame, root: str, version: int) -> None:
    """Writes a version, then a pointer of its own name; a reader sees a version only when it is whole."""
    df.write.mode("overwrite").parquet(f"{root}/version={version}")
    df.sparkSession.range(1).select(F.lit(version).alias("current")).write.mode("append").parquet(f"{root}-pointer")


def current(spark: SparkSession, root: str) -> DataFrame:
    """The newest published version."""
    version = spark.read.parquet(f"{root}-pointer").agg(F.max("current")).first()[0]
    return spark.read.parquet(f"{root}/version={version}")
