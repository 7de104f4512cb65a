"""Where jobs put what has to outlive a stage: the shared folder that the cluster names."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, a temporary folder on a local master, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            found = current.get()
        elif spark.sparkContext.master.startswith("local"):
            found = tempfile.mkdtemp(prefix="spark-shared-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


_made: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    _made.append(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def sweep(spark: SparkSession) -> int:
    """Removes every folder that this driver has made in the shared folder so far; results that read them end with it."""
    done = len(_made)
    while _made:
        remove(spark, _made.pop())
    return done


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the shared folder: lineage ends there, any executor can read it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one job. On leaving the block they are removed, so its result must be ``written`` before."""

    def __init__(self, spark: SparkSession):
        self.spark, self._paths, self._tables = spark, [], []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for table in self._tables:
            self.spark.sql(f"drop table if exists {table}")
        for path in self._paths:
            remove(self.spark, path)

    def written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        self._paths.append(path)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """A table dealt by ``key``: grouping by it reads without another shuffle."""
        table = f"{name}_{uuid.uuid4().hex}"
        path = scratch_path(self.spark, name)
        self._tables.append(table)
        self._paths.append(path)
        n = partitions(self.spark)
        df.repartition(n, key).write.bucketBy(n, key).option("compression", "zstd").option("path", path).saveAsTable(table)
        return self.spark.table(table)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this package wrote."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of jobs that are over: it learns of them when the driver collects garbage,
    which in a long job of small plans may be late."""
    gc.collect()
    spark._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
