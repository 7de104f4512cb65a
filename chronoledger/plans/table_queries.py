"""Sources, sinks and streams over files that Spark derives from the given tables, with DuckDB statements of what comes back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.models import GroupQuantiles
from ..sources import tables as S
from ..storage import partitions, scratch_path, written
from ..streaming import feedback as B
from ..streaming.learner import Learner
from .history_queries import task_table
from .sqltext import Engine, tasks

_T = f"with {tasks(Engine(False))} ".replace("@", "")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _delimited(df: DataFrame, name: str, **options) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.options(sep="\t", header=True, **options).csv(path)
    return path


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")


def src01_delimited_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns in any order; one that the file lacks is null."""
    return S.read_delimited(spark, _delimited(_orders(spark, sf_dir), "scan"), ["o_orderstatus", "o_orderkey", "absent"])


def src02_gzip_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gzipped text, dealt over partitions and kept as Parquet."""
    path = _delimited(_orders(spark, sf_dir), "gzip", compression="gzip")
    return S.materialise(spark, path, ["o_orderkey", "o_custkey"], scratch_path(spark, "materialised"))


def src03_manifest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by order status, one of which has an older name for a column."""
    o = _orders(spark, sf_dir)
    old = _delimited(o.where("o_orderstatus = 'O'").select("o_orderkey", F.col("o_custkey").alias("replay_position")), "manifest")
    new = _delimited(o.where("o_orderstatus <> 'O'").select("o_orderkey", F.col("o_custkey").alias("position")), "manifest")
    return S.read_manifests(spark, [old, new], ["o_orderkey", "position"], {"replay_position": "position"})


def _by_file(df: DataFrame, name: str, form: str) -> str:
    """One file for each row, all in one folder: it is listed once, and tasks commit their own files."""
    path = scratch_path(df.sparkSession, name)
    out = df.repartition(partitions(df.sparkSession)).write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    out.format(form).save(path)
    return path


def src04_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier").select(F.struct(F.col("s_name").alias("name"), F.struct(F.col("s_nationkey").alias("key")).alias("nation")).alias("h"), F.lit(4).alias("n"))
    schema = T.StructType.fromDDL("h struct<name: string, nation: struct<key: int>, missing: string>, n int")
    return S.read_records(spark, _by_file(s, "records", "json"), schema, {"name": "h.name", "nation": "h.nation.key", "missing": "h.missing", "n": "n"}).drop("attempt")


def src05_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with process and task from their folders."""
    path = scratch_path(spark, "logs")
    t = task_table(spark, sf_dir).select("process", "workflow", F.concat(F.lit("task "), F.col("task_id").cast("string")).alias("value"))
    t.write.partitionBy("process", "workflow").text(path)
    found = S.read_log_lines(spark, path + "/*/*")
    return found.select(F.substring_index("process", "=", -1).alias("process"), F.substring_index("task", "=", -1).alias("workflow"), "line")


def _fields(spark: SparkSession, sf_dir: str, sep: str) -> DataFrame:
    one = lambda name, c: F.concat(F.lit(name + sep), F.col(c).cast("string"))
    return _read(spark, sf_dir, "supplier").select(F.concat_ws("\n", one("key", "s_suppkey"), one("nation", "s_nationkey"), F.lit("other" + sep + "1"), one("key", "s_nationkey")).alias("value"))


def src06_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a repeated key the first counts."""
    found = S.read_key_values(spark, _by_file(_fields(spark, sf_dir, "="), "pairs", "text"))
    return found.select(*[F.col("fields")[k].cast("long").alias(k) for k in ("key", "nation", "other", "missing")])


def src07_field_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = S.read_field_tables(spark, _by_file(_fields(spark, sf_dir, "\t").withColumn("value", F.substring_index("value", "\n", 3)), "fields", "text"), ["key", "nation", "missing"])
    return found.select(*[F.col(c).cast("long").alias(c) for c in ("key", "nation", "missing")])


def src08_schema_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Older names, defaults for what is absent, the present order."""
    o = _orders(spark, sf_dir).withColumn("customer", F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")))
    return S.evolve(o, {"o_custkey": "customer", "o_orderkey": "id"}, {"version": 2}, ["id", "customer", "version"])


def src09_task_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("task"), F.col("p_size").alias("memory"))
    return S.read_plan(spark, _delimited(p, "plan"), ["task", "memory"], ["task"])


def src10_outcome_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes that keep every rule, and the others with the rules that they break."""
    t = task_table(spark, sf_dir)
    good, bad = S.split_valid(t, {"measured": F.col("consumed_bytes").isNotNull(), "small": F.col("peak_bytes") < 400000000})
    return good.select("task_id", F.lit("").alias("broken")).unionByName(bad.select("task_id", F.array_join("broken", ",").alias("broken")))


def snk01_projected_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "projected")
    S.write_projected(_read(spark, sf_dir, "orders"), path, ["o_orderstatus", "o_orderkey"])
    return spark.read.parquet(path)


def snk02_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as found in folders by workflow and process."""
    path = scratch_path(spark, "fan-out")
    S.write_by(task_table(spark, sf_dir).select("task_id", "workflow", "process", "peak_bytes"), path, "workflow", "process")
    return spark.read.parquet(path).groupBy("workflow", "process").agg(F.count("*").alias("n"), F.sum("peak_bytes").alias("bytes"))


def snk03_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known before a launch beside what only its outcome tells, each from its own table."""
    before, after = S.decompose(task_table(spark, sf_dir), "task_id", ["task_id", "workflow", "input_bytes"], ["task_id", "peak_bytes"])
    return written(before, "prelaunch").join(written(after, "outcomes"), "task_id")


def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("task_id") % 17 == 0, 137).when(F.col("task_id") % 13 == 0, 1).otherwise(0)
    return task_table(spark, sf_dir).select(F.col("task_id").cast("string").alias("task_id"), "workflow", "process", code.alias("exit_status"), "completion_us", "peak_bytes", "consumed_bytes")


def st01_ingested_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes that arrive in two batches, the second of which repeats some and changes others."""
    source, table, at = (scratch_path(spark, n) for n in ("arrivals", "applied", "progress"))
    o = _outcomes(spark, sf_dir)
    early = F.col("task_id").cast("long") % 3 != 0
    again = o.where(early & (F.col("task_id").cast("long") % 5 == 0)).withColumn("peak_bytes", F.when(F.col("task_id").cast("long") % 10 == 0, F.col("peak_bytes") + 1).otherwise(F.col("peak_bytes")))
    for part in (o.where(early), o.where(~early).unionByName(again)):
        part.write.mode("append").json(source)
        B.ingest(spark, source, table, at).awaitTermination()
    return B.applied(spark, table).select("task_id", "status", "route", "seq")


def st02_matched_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions joined with their outcomes as two streams."""
    t = task_table(spark, sf_dir)
    sides = {"decisions": t.select(F.col("task_id").alias("attempt"), F.timestamp_micros("decision_us").alias("decided_at")), "outcomes": t.select(F.col("task_id").alias("attempt"), F.timestamp_micros("completion_us").alias("completed_at"), "peak_bytes")}
    streams = {}
    for name, df in sides.items():
        path = scratch_path(spark, name)
        df.write.parquet(path)
        streams[name] = spark.readStream.schema(df.schema).parquet(path)
    out = scratch_path(spark, "matched")
    joined = B.matched(streams["decisions"], streams["outcomes"], late="1 hour", longest="1 hour").select("attempt", "peak_bytes")
    joined.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(joined.schema).parquet(out)


def st06_refits_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At which of its outcomes each workflow is fitted: the first 32, then every 64."""
    t = _outcomes(spark, sf_dir).where("exit_status = 0 and consumed_bytes is not null")
    due = F.sequence(F.lit(32).cast("long"), F.greatest("n", F.lit(32)), F.lit(64).cast("long"))
    return t.groupBy("workflow").agg(F.count("*").alias("n")).where("n >= 32").select("workflow", F.explode(due).alias("fitted_at"))


#: The live replay: batches by decision time, the first fit, outcomes between fits, and how many calibrate.
_BATCHES, _FIRST, _EVERY, _WINDOW = 6, 128, 256, 64
_LIVE = {"A": ["workflow"], "AP": ["workflow", "process"]}


def st06_live_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible tasks as a stream of six batches: each task's request under both views by the version of its time, and each
    version's calibration block with its residuals."""
    t = task_table(spark, sf_dir)
    code = F.when(F.col("task_id") % 17 == 0, 137).when(F.col("task_id") % 13 == 0, 1).otherwise(0)
    ends = t.agg(F.min("decision_us").alias("lo"), F.max("decision_us").alias("hi")).first()
    width = ((ends.hi or 0) - (ends.lo or 0)) // _BATCHES + 1
    t = t.where((code == 0) & F.col("consumed_bytes").isNotNull())
    t = written(t.withColumn("part", F.floor((F.col("decision_us") - (ends.lo or 0)) / width)).select("task_id", "workflow", "process", "completion_us", "peak_bytes", "part"), "eligible")
    source, root, at = (scratch_path(spark, n) for n in ("outcomes", "learner", "progress"))
    make = lambda by: lambda: GroupQuantiles(by, "peak_bytes")
    live = Learner(root, {v: make(by) for v, by in _LIVE.items()}, "task_id", "peak_bytes", ["peak_bytes", "completion_us"], ["completion_us", "task_id"], ["q50", "q99_5"], _FIRST, _EVERY, _WINDOW)
    for part in range(_BATCHES):
        t.where(F.col("part") == part).drop("part").write.mode("append").parquet(source)
        live.learn(spark.readStream.schema(t.drop("part").schema).parquet(source), at).awaitTermination()
    scored = spark.read.parquet(f"{root}/scored").select("task_id", "view", F.lit("scored").alias("block"), "version", F.round("request", 6).alias("request"), F.lit(None).cast("double").alias("residual"))
    last = live.pointer(spark)[0]
    for version in range(1, last + 1):
        held = live.calibration(spark, version)
        scored = scored.unionByName(held.select("task_id", "view", F.lit("calibration").alias("block"), F.col("model_version").alias("version"), F.round("request", 6).alias("request"), F.round("residual", 9).alias("residual")))
    return scored


def st07_fit_and_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.fit_and_block(task_table(spark, sf_dir), 128).groupBy("workflow", "block").agg(F.count("*").alias("n"), F.min("completion_us").alias("first_us"))


def st08_published_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two published versions the newer is read; a third that is written but not published is not."""
    root = scratch_path(spark, "versions")
    t = task_table(spark, sf_dir).select("task_id", "workflow")
    B.publish(t.where("task_id % 2 = 0"), root, 1)
    B.publish(t.where("task_id % 2 = 1"), root, 2)
    t.write.parquet(f"{root}/version=3")
    return B.current(spark, root)


_EXIT = "case when task_id % 17 = 0 then 137 when task_id % 13 = 0 then 1 else 0 end"
_ROUTED = _T + f""", o as (select *, case when {_EXIT} = 0 and consumed_bytes is not null then 'training' when {_EXIT} in (0, 137) then 'history' else 'skipped' end as route from tasks),
 a as (select cast(task_id as varchar) as task_id, workflow, route, completion_us, case when task_id % 3 <> 0 then 0 else 1 end as batch from o where route <> 'skipped')
 select task_id, 'applied' as status, route, row_number() over (partition by workflow order by batch, completion_us, task_id) as seq from a
 union all select cast(task_id as varchar), 'conflict', route, null from o where route <> 'skipped' and task_id % 3 <> 0 and task_id % 10 = 0"""

_BY = {v: ", ".join(by) for v, by in _LIVE.items()}
_LIVE_SQL = _T.replace("with ", "with recursive ", 1) + f""", el as (select task_id, workflow, process, completion_us, peak_bytes, decision_us from tasks where {_EXIT} = 0 and consumed_bytes is not null),
 en as (select min(decision_us) as lo, (max(decision_us) - min(decision_us)) // {_BATCHES} + 1 as width from tasks), ev as (select el.*, (decision_us - lo) // width as part from el cross join en),
 cn as (select p.part, count(ev.task_id) as e from (select unnest(range({_BATCHES})) as part) p left join ev on ev.part <= p.part group by p.part),
 wk as (select -1 as part, cast(0 as bigint) as fitted, 0 as version, false as due union all
  select cn.part, case when d then e else fitted end, case when d then version + 1 else version end, d from (select wk.fitted, wk.version, cn.part, cn.e, e > {_WINDOW} and case when fitted = 0 then e >= {_FIRST} else e - fitted >= {_EVERY} end as d from wk join cn on cn.part = wk.part + 1) cn),
 vs as (select part, version from wk where due),
 lg as (select v.version, ev.*, row_number() over (partition by v.version order by completion_us desc, task_id desc) <= {_WINDOW} as held from vs v join ev on ev.part <= v.part),
 al as (select version, quantile_cont(peak_bytes, 0.5) as m, quantile_cont(peak_bytes, 0.995) as b from lg where not held group by version),
 """ + ", ".join(f"g{v} as (select version, {by}, quantile_cont(peak_bytes, 0.5) as m, quantile_cont(peak_bytes, 0.995) as b from lg where not held group by version, {by} having count(*) >= 20)" for v, by in _BY.items()) + """,
 asks as (select task_id, workflow, process, peak_bytes, 'scored' as block, (select max(w.version) from wk w where w.part < ev.part) as version from ev union all select task_id, workflow, process, peak_bytes, 'calibration', version from lg where held),
 rq as (""" + " union all ".join(f"select a.*, '{v}' as view, greatest(coalesce(g.m, al.m), coalesce(g.b, al.b)) as request from asks a left join al on al.version = a.version left join g{v} g on g.version = a.version and " + " and ".join(f"g.{c} = a.{c}" for c in by) for v, by in _LIVE.items()) + """)
 select task_id, view, block, version, round(request, 6) as request, case when block = 'calibration' then round(ln(peak_bytes / request), 9) end as residual from rq"""

QUERIES = {
    f.__name__: f
    for f in (
        src01_delimited_scan, src02_gzip_tables, src03_manifest_union, src04_json_records, src05_log_lines, src06_key_values, src07_field_tables, src08_schema_evolution,
        src09_task_plan, src10_outcome_rules, snk01_projected_write, snk02_fan_out, snk03_decomposition, st01_ingested_outcomes, st02_matched_streams, st06_refits_due, st06_live_versions,
        st07_fit_and_calibrate, st08_published_version,
    )
}
SQL = {
    "src01_delimited_scan": "select o_orderstatus, cast(o_orderkey as varchar) as o_orderkey, cast(null as varchar) as absent from orders",
    "src02_gzip_tables": "select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as o_custkey from orders",
    "src03_manifest_union": "select cast(o_orderkey as varchar) as o_orderkey, cast(o_custkey as varchar) as position from orders",
    "src04_json_records": "select s_name as name, cast(s_nationkey as integer) as nation, cast(null as varchar) as missing, 4 as n from supplier",
    "src05_log_lines": _T + "select process, workflow, 'task ' || cast(task_id as varchar) as line from tasks",
    "src06_key_values": "select cast(s_suppkey as bigint) as key, cast(s_nationkey as bigint) as nation, cast(1 as bigint) as other, cast(null as bigint) as missing from supplier",
    "src07_field_tables": "select cast(s_suppkey as bigint) as key, cast(s_nationkey as bigint) as nation, cast(null as bigint) as missing from supplier",
    "src08_schema_evolution": "select o_orderkey as id, o_custkey as customer, 2 as version from orders",
    "src09_task_plan": "select cast(p_partkey as varchar) as task, cast(p_size as varchar) as memory from part",
    "src10_outcome_rules": _T + "select task_id, concat_ws(',', case when consumed_bytes is null then 'measured' end, case when peak_bytes >= 400000000 then 'small' end) as broken from tasks",
    "snk01_projected_write": "select o_orderstatus, o_orderkey from orders",
    "snk02_fan_out": _T + "select workflow, process, count(*) as n, cast(sum(peak_bytes) as bigint) as bytes from tasks group by workflow, process",
    "snk03_decomposition": _T + "select task_id, workflow, input_bytes, peak_bytes from tasks",
    "st01_ingested_outcomes": _ROUTED,
    "st02_matched_streams": _T + "select task_id as attempt, peak_bytes from tasks where completion_us - decision_us <= 3600000000",
    "st06_refits_due": _T + f", n as (select workflow, count(*) as n from tasks where {_EXIT} = 0 and consumed_bytes is not null group by workflow having count(*) >= 32) select workflow, unnest(range(32, greatest(n, 32) + 1, 64)) as fitted_at from n",
    "st06_live_versions": _LIVE_SQL,
    "st07_fit_and_calibrate": _T + ", b as (select *, case when row_number() over (partition by workflow order by completion_us desc, task_id desc) <= 128 then 'calibration' else 'fit' end as block from tasks) select workflow, block, count(*) as n, min(completion_us) as first_us from b group by workflow, block",
    "st08_published_version": _T + "select task_id, workflow from tasks where task_id % 2 = 1",
}
