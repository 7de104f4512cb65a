"""One statement for two engines: tables are written @name, dialect differences come from an Engine."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Engine:
    """The functions that Spark and DuckDB spell differently."""

    def __init__(self, spark: bool):
        self.spark = spark
        self.us = "unix_micros(cast(ts as timestamp))" if spark else "epoch_us(ts)"

    def sha(self, x: str) -> str:
        return f"sha2({x}, 256)" if self.spark else f"sha256({x})"

    def hex_to_int(self, x: str) -> str:
        return f"cast(conv({x}, 16, 10) as bigint)" if self.spark else f"cast('0x' || {x} as bigint)"

    def pct(self, x: str, q: float) -> str:
        return f"percentile({x}, {q})" if self.spark else f"quantile_cont({x}, {q})"

    def disc(self, x: str, q: float) -> str:
        return f"percentile_disc({q}) within group (order by {x})"

    def like(self, x: str, pattern: str) -> str:
        return f"{x} rlike '{pattern}'" if self.spark else f"regexp_matches({x}, '{pattern}')"

    def replace_all(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{by}')" if self.spark else f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def steps(self, lo: str, hi: str) -> str:
        return f"explode(sequence({lo}, {hi}))" if self.spark else f"unnest(range({lo}, {hi} + 1))"

    def rows(self, structs: list[dict[str, str]]) -> str:
        """Each of ``structs`` (column to expression) as a row."""
        if self.spark:
            return "inline(array(" + ", ".join("named_struct(" + ", ".join(f"'{k}', {v}" for k, v in s.items()) + ")" for s in structs) + "))"
        return "unnest([" + ", ".join("{" + ", ".join(f"'{k}': {v}" for k, v in s.items()) + "}" for s in structs) + "], recursive := true)"

    def top(self, x: str, by: str) -> str:
        return f"max_by({x}, {by})"


def tasks(e: Engine) -> str:
    """``events`` read as finished tasks."""
    return f"""tasks as (
  select cast(event_id as bigint) as task_id, event_type as workflow, concat('p', cast(user_id % 3 as string)) as process,
    cast(user_id as string) as task_instance, concat('in', regexp_extract(props, '([0-9]+)', 1)) as input_identity,
    (cast(regexp_extract(props, '([0-9]+)', 1) as bigint) + 1) * 1048576 as input_bytes,
    cast(floor(value * 1000000) as bigint) + 1 as peak_bytes,
    case when event_id % 7 = 0 then null else cast(floor(value * 700000) as bigint) end as consumed_bytes,
    {e.us} as decision_us, {e.us} + cast(floor(value * 60000000) as bigint) as completion_us,
    case when event_id % 11 = 0 then null else value end as runtime_seconds, value
  from @events)"""


Statement = Callable[[Engine], str]


def spark_query(statement: Statement) -> Callable[[SparkSession, str], DataFrame]:
    text = statement(Engine(True))
    tables = sorted(set(re.findall(r"@(\w+)", text)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
        return spark.sql(re.sub(r"@(\w+)", r"{\1}", text), **found)

    return run


def duckdb_text(statement: Statement) -> str:
    return re.sub(r"@(\w+)", r"\1", statement(Engine(False)))
