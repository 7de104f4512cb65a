"""Queries of the audit gates with their DuckDB statements: predictions of every task come from the other half of the tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.gates import gate_features, gate_lanes, gate_targets
from ..operators.models import GroupQuantiles, out_of_fold
from ..storage import written
from .history_queries import task_table
from .sqltext import Engine, tasks

_T = f"with {tasks(Engine(False))} ".replace("@", "")
_FOLDS = 2
_CLASS = "case when input_bytes >= 52428800 then 'large' else 'small' end"
#: What predicts: grouping, target, quantiles and what they are called.
_MODELS = {
    "ap": (["workflow", "process"], "peak_bytes", {"ap_q50": 0.5, "ap_q90": 0.9, "ap_q95": 0.95, "ap_q995": 0.995}),
    "apc": (["workflow", "process", "size_class"], "peak_bytes", {"apc_q50": 0.5}),
    "c": (["workflow", "process"], "consumed_bytes", {"c_hat": 0.5}),
    "all": ([], "peak_bytes", {"all_q995": 0.995}),
}
LABELS = ("peak_bytes", "consumed_bytes", "runtime_seconds", "completion_us", "shortfall", "under", "surprise", "gain", "consumed_error", "heavy")
_QUANTILES = ("ap_q50", "ap_q90", "ap_q95", "ap_q995")


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = written(task_table(spark, sf_dir).withColumn("size_class", F.expr(_CLASS)), "tasks")
    for by, target, asked in _MODELS.values():
        make = lambda by=by, target=target, asked=asked: GroupQuantiles(by, target, tuple(asked.values()))
        got = out_of_fold(make, t, "task_id", F.col("task_id") % _FOLDS, _FOLDS)
        names = make().names
        t = written(t.join(got.select("task_id", *[F.round(n, 6).alias(a) for n, a in zip(names, asked)]), "task_id"), "predicted")
    return t


def md18_gate_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each task's outcome says of its request, and whether the task was worth an audit."""
    t = gate_targets(_predicted(spark, sf_dir), "task_id", "workflow", "process", "peak_bytes", "consumed_bytes", "ap_q95", "ap_q50", "ap_q50", "apc_q50", "c_hat")
    return t.select("task_id", F.round("shortfall", 3).alias("shortfall"), "under", "surprise", "gain", "consumed_error", *[F.round(c, 9).alias(c) for c in ("peak_rank", "surprise_rank", "consumed_rank")], "heavy")


def md19_gate_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each task before it runs, for the gates."""
    t, names = gate_features(_predicted(spark, sf_dir), ["input_bytes", "c_hat"], _QUANTILES, "ap_q90", "ap_q995", "all_q995", LABELS)
    return t.select("task_id", *[F.round(c, 9).alias(c) for c in names])


def md21_gate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every task's lane scores: the predicted tail stands for risk and shortfall, what the informed model says otherwise for
    information, and how far the task's size is from its process's usual one for distance."""
    t, _ = gate_features(_predicted(spark, sf_dir), ["input_bytes", "c_hat"], _QUANTILES, "ap_q90", "ap_q995", "all_q995", LABELS)
    t = t.withColumn("tail", F.col("ap_q995") - F.col("ap_q95")).withColumn("told", F.round(F.abs(F.log(F.col("apc_q50") / F.col("ap_q50"))), 9))
    t = t.withColumn("far", F.abs(F.col("input_bytes") - F.col("c_hat"))).withColumn("trust", F.lit(1.0) / (1 + F.round("tail_interval", 9)))
    t = t.withColumn("tail_interval", F.round("tail_interval", 9)).withColumn("local_global", F.round("local_global", 9))
    found = gate_lanes(t, "task_id", "workflow", "ap_q95", "tail", "told", "tail_interval", "local_global", "far", "trust")
    return found.select("task_id", *[F.round(c, 9).alias(c) for c in ("risk", "information", "discovery")])


def _predicted_sql() -> str:
    out = f", t0 as (select *, {_CLASS} as size_class, task_id % {_FOLDS} as fold from tasks), ff as (select unnest(range({_FOLDS})) as f)"
    last = "t0"
    for name, (by, target, asked) in _MODELS.items():
        marks = lambda tag: ", ".join(f"quantile_cont({target}, {q}) as {tag}_{a}" for a, q in asked.items())
        keys = "".join(f", {c}" for c in by)
        out += f", w_{name} as (select f, {marks('w')} from t0 join ff on fold <> f group by f), g_{name} as (select f{keys}, {marks('g')} from t0 join ff on fold <> f group by f{keys} having count({target}) >= 20)"
        out += f", p_{name} as (select a.*, {', '.join(f'round(coalesce(g_{a}, w_{a}), 6) as {a}' for a in asked)} from {last} a left join w_{name} w on w.f = a.fold left join g_{name} g on g.f = a.fold {''.join(f' and g.{c} = a.{c}' for c in by)})"
        last = f"p_{name}"
    return out + f", pr as (select * from {last})"


def _share(value: str, by: str) -> str:
    return f"case when {value} is not null then (rank() over (partition by {by}, {value} is null order by {value}) + (count(*) over (partition by {by}, {value}) - 1) / 2.0) / count({value}) over (partition by {by}) end"


_GAP = "abs(ln(greatest({}, {l})) - ln(greatest({}, {l})))"
_FEATURES = _T + _predicted_sql() + f""", ft as (select *, {", ".join(f"ln(1 + greatest(cast({c} as double), 0)) as log_{c}" for c in ("input_bytes", "c_hat", *_QUANTILES))}, greatest(ln(greatest(ap_q995, 1e-9)) - ln(greatest(ap_q90, 1e-9)), 0) as tail_interval, {_GAP.format("ap_q995", "all_q995", l="1e-9")} as local_global from pr)"""
QUERIES = {f.__name__: f for f in (md18_gate_targets, md19_gate_features, md21_gate_scores)}
SQL = {
    "md18_gate_targets": _T + _predicted_sql() + f""", x as (select *, greatest(peak_bytes - ap_q95, 0) as shortfall, peak_bytes > ap_q95 as under, round({_GAP.format("peak_bytes", "ap_q50", l="1e-9")}, 9) as surprise, round({_GAP.format("peak_bytes", "ap_q50", l="1e-9")} - {_GAP.format("peak_bytes", "apc_q50", l="1e-9")}, 9) as gain,
  case when consumed_bytes is not null then round({_GAP.format("consumed_bytes", "c_hat", l="1.0")}, 9) end as consumed_error from pr),
 y as (select *, {_share("peak_bytes", "workflow, process")} as peak_rank, {_share("surprise", "workflow, process")} as surprise_rank, {_share("consumed_error", "workflow, process")} as consumed_rank from x)
 select task_id, round(shortfall, 3) as shortfall, under, surprise, gain, consumed_error, round(peak_rank, 9) as peak_rank, round(surprise_rank, 9) as surprise_rank, round(consumed_rank, 9) as consumed_rank,
  (peak_rank >= 0.9 or surprise_rank >= 0.9 or under) and (coalesce(consumed_rank >= 0.9, false) or gain > 0) as heavy from y""",
    "md19_gate_features": _FEATURES + " select task_id, " + ", ".join(f"round({c}, 9) as {c}" for c in (*[f"log_{c}" for c in ("input_bytes", "c_hat", *_QUANTILES)], "tail_interval", "local_global")) + " from ft",
    "md21_gate_scores": _FEATURES + f""", z as (select *, ap_q995 - ap_q95 as tail, round(abs(ln(apc_q50 / ap_q50)), 9) as told, abs(input_bytes - c_hat) as far, round(tail_interval, 9) as ti, round(local_global, 9) as lg from ft),
 s as (select *, {", ".join(f"{_share(c, 'workflow')} as r_{c}" for c in ("ap_q95", "tail", "told", "ti", "lg", "far"))} from z)
 select task_id, round(0.70 * r_ap_q95 + 0.30 * r_tail, 9) as risk, round(r_told, 9) as information, round(0.35 * r_ti + 0.25 * r_lg + 0.20 * r_far + 0.20 * (1 - 1 / (1 + ti)), 9) as discovery from s""",
}
