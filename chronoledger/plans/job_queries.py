"""Queries of operators that take several jobs; where SQL has no counterpart, tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..operators.models import Ensemble, QuantileForest, cold_start, derived_memory, feature_view, gate_scores, out_of_fold, replay, score_views
from ..sources.tables import fingerprint, key_fingerprint
from .history_queries import task_table
from .sqltext import Engine, tasks


def jn16_component_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks linked by an input or an instance that at most 100 rows share."""
    t = task_table(spark, sf_dir)
    tokens = t.select("task_id", F.explode(F.array(F.concat(F.lit("i:"), "input_identity"), F.concat_ws(":", F.lit("t"), "workflow", "process", "task_instance"))).alias("token"))
    return components(tokens, "task_id", "token")


#: What is known of a task before it starts (A) and by its place in the sequence (P), and what only its outcome tells.
PARTS, LABELS = {"A": ("input_bytes", "instance"), "P": ("decision_us",)}, ("peak_bytes", "consumed_bytes", "runtime_seconds", "value", "completion_us")


def _fold():
    return F.col("task_id") % 5


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return task_table(spark, sf_dir).withColumn("instance", F.col("task_instance").cast("long"))


def _learned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the forests read of a task."""
    return _features(spark, sf_dir).select("task_id", "workflow", "process", "peak_bytes", "consumed_bytes", *feature_view("A+P", PARTS, LABELS))


def _forest(**settings) -> QuantileForest:
    return QuantileForest(feature_view("A+P", PARTS, LABELS), ["workflow", "process"], "peak_bytes", **settings)


def md03_quantile_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of every task's peak, learned from the other folds: the median of three forests of different seeds."""
    return out_of_fold(lambda: Ensemble(lambda s: _forest(seed=s, trees=4)), _learned(spark, sf_dir), "task_id", _fold(), 5)


def md06_process_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with leaves that know each workflow and process apart."""
    return out_of_fold(lambda: _forest(by=["workflow", "process"]), _learned(spark, sf_dir), "task_id", _fold(), 5)


def md07_derived_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted consumption of every task and the memory that follows from it."""
    return derived_memory(_learned(spark, sf_dir), "task_id", feature_view("A+P", PARTS, LABELS), ["workflow", "process"], "consumed_bytes", "peak_bytes", _fold(), 5)


def md17_cold_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for every task as if its workflow had never run."""
    make = lambda: QuantileForest(feature_view("A+P", PARTS, LABELS), ["process"], "peak_bytes")
    return cold_start(_learned(spark, sf_dir), "task_id", "workflow", make, "peak_bytes")


def md20_gate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely every task outgrows its workflow's usual request or is large, and by how much, learned from four of five."""
    t = _features(spark, sf_dir)
    t = t.join(t.groupBy("workflow").agg((F.avg("peak_bytes") * 1.2).alias("request")), "workflow")
    t = t.withColumns({"under": (F.col("request") < F.col("peak_bytes")).cast("int"), "large": (F.col("peak_bytes") > 2 * F.col("request")).cast("int"), "surprise": F.abs(F.log(F.col("peak_bytes") / F.col("request")))})
    return gate_scores(t.where(_fold() != 0), t, "task_id", feature_view("A+P", PARTS, LABELS), ["under", "large"], "surprise")


def md24_three_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half of all tasks, by task number, scored by three views that were fitted on the earlier half."""
    t = _learned(spark, sf_dir)
    middle = t.agg(F.min("task_id") + F.floor((F.max("task_id") - F.min("task_id")) / 2)).first()[0] or 0
    views = {"A": feature_view("A", PARTS, LABELS), "AP": feature_view("A+P", PARTS, LABELS), "APC": [*feature_view("A+P", PARTS, LABELS), "c_hat"]}
    later = t.where(F.col("task_id") > middle).drop(*LABELS)
    return score_views(t.where(F.col("task_id") <= middle), later, "task_id", views, ["workflow", "process"], "consumed_bytes", "peak_bytes")


def st11_batched_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests over the later four of five batches by decision time, each from what was revealed before it."""
    t = _learned(spark, sf_dir)
    ends = t.agg(F.min("decision_us").alias("lo"), F.max("decision_us").alias("hi")).first()
    width = max(1, ((ends.hi or 0) - (ends.lo or 0)) // 5 + 1)
    t = t.withColumn("batch", F.floor((F.col("decision_us") - (ends.lo or 0)) / width).cast("int"))
    return replay(t, "task_id", "batch", 5, ["peak_bytes", "consumed_bytes"], _forest).select("task_id", "batch", "request", (F.col("request") < F.col("peak_bytes")).alias("under"))


def snk04_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def snk04_key_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of the line items' keys and flags."""
    return key_fingerprint(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), _KEYS)


_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", "l_linestatus")

QUERIES = {f.__name__: f for f in (
    jn16_component_join, md03_quantile_forest, md06_process_tails, md07_derived_memory, md17_cold_start, md20_gate_models, md24_three_views, st11_batched_replay, snk04_fingerprint, snk04_key_fingerprint,
)}
SQL = {
    "jn16_component_join": f"with recursive {tasks(Engine(False))}".replace("@", "") + """, tok as (select task_id as k, 'i:' || input_identity as t from tasks union all select task_id, concat_ws(':', 't', workflow, process, task_instance) from tasks),
 used as (select t from (select distinct k, t from tok) d group by t having count(*) between 2 and 100), links as (select distinct k, t from tok where t in (select t from used)),
 cc(id, label) using key (id) as (select k, k from (select distinct k from tok) s
  union select l.k as id, min(c.label) as label from cc c join links m on m.k = c.id join links l on l.t = m.t join recurring.cc o on o.id = l.k where c.label < o.label group by l.k)
 select id as task_id, label as component_id from cc""",
    "snk04_key_fingerprint": "select count(*) as n, cast(coalesce(sum(cast(cast('0x' || substr(sha256(" + " || '|' || ".join(f"coalesce(cast({c} as varchar), '')" for c in _KEYS) + "), 1, 12) as bigint) as hugeint)), 0) as varchar) as digest from lineitem",
}
