"""Reading traces, manifests, records and logs, and writing tables; schemas are explicit, so a source is read once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import partitions


def read_delimited(spark: SparkSession, path: str | list[str], columns: Sequence[str], sep: str = "\t") -> DataFrame:
    """A table with a header row; every column is text and optional, in any order in the file. Gzip is read as it is."""
    found = spark.read.option("sep", sep).option("header", True).option("inferSchema", False).csv(path)
    return found.select(*[F.col(f"`{c}`") if c in found.columns else F.lit(None).cast("string").alias(c) for c in columns])


def materialise(spark: SparkSession, path: str, columns: Sequence[str], out: str) -> DataFrame:
    """Gzipped text as a Parquet table. A gzip file is one task's to read, so rows are dealt over partitions behind it."""
    read_delimited(spark, path, columns).repartition(partitions(spark)).write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def read_manifests(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], aliases: Mapping[str, str]) -> DataFrame:
    """One table of several files whose columns differ; ``aliases`` maps an old name to the present one."""
    whole = None
    for path in paths:
        part = evolve(spark.read.option("sep", "\t").option("header", True).csv(path), aliases, {}, columns)
        whole = part if whole is None else whole.unionByName(part)
    return whole


def read_records(spark: SparkSession, path: str, schema: T.StructType, fields: Mapping[str, str]) -> DataFrame:
    """Nested JSON, one record a file: ``fields`` maps a column to its path; ``attempt`` is the file's name."""
    records = spark.read.schema(schema).option("multiLine", True).json(path)
    return records.select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("attempt"), *[F.col(at).alias(name) for name, at in fields.items()])


def read_log_lines(spark: SparkSession, path: str, keys: str = r"([^/]+)/([^/]+)/[^/]+$") -> DataFrame:
    """Lines of text logs; process and task come from the last two folders of the path."""
    at = F.col("_metadata.file_path")
    return spark.read.text(path).select(F.regexp_extract(at, keys, 1).alias("process"), F.regexp_extract(at, keys, 2).alias("task"), F.col("value").alias("line"))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """``key=value`` files as maps, one row a file. A file is small: the trace of one task."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.map_from_entries(_pairs(F.col("value"))).alias("fields"))


def _pairs(text: Column) -> Column:
    lines = F.filter(F.split(text, "\r?\n"), lambda x: x.contains("="))
    by_key = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.regexp_replace(x, "^[^=]*=", "")).alias("v")))
    keys = F.transform(by_key, lambda p: p["k"])
    return F.filter(by_key, lambda p, i: F.array_position(keys, p["k"]) == i + 1)  # the first of a repeated key counts


def read_field_tables(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """Files of (field, value) lines as one wide row each; unknown fields are ignored."""
    schema = T.StructType([T.StructField("field", T.StringType()), T.StructField("value", T.StringType())])
    rows = spark.read.schema(schema).option("sep", "\t").csv(path).select(F.col("_metadata.file_path").alias("path"), "field", "value")
    return rows.groupBy("path").agg(*[F.first(F.when(F.col("field") == f, F.col("value")), ignorenulls=True).alias(f) for f in fields])


def evolve(df: DataFrame, renames: Mapping[str, str], defaults: Mapping[str, object], order: Sequence[str]) -> DataFrame:
    """Older tables in the present schema: the new name's value, else an old name's, else the default."""
    out = []
    for c in order:
        found = [F.col(f"`{n}`") for n in [c, *[old for old, new in renames.items() if new == c]] if n in df.columns]
        given = [F.lit(defaults[c])] if c in defaults else []
        out.append((F.coalesce(*found, *given) if found or given else F.lit(None).cast("string")).alias(c))
    return df.select(*out)


def read_plan(spark: SparkSession, path: str, required: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """A task plan, separated by commas or tabs by its extension; a missing column or a repeated key is an error."""
    plan = spark.read.option("header", True).option("sep", "," if path.endswith(".csv") else "\t").csv(path)
    missing = [c for c in required if c not in plan.columns]
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    repeated = plan.groupBy(*keys).count().where("count > 1").limit(1).count()
    if repeated:
        raise ValueError(f"repeated keys in {', '.join(keys)}")
    return plan


def split_valid(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep every rule, and the others with ``broken``, the names of the rules that they break (null counts)."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def write_projected(df: DataFrame, path: str, columns: Sequence[str], form: str = "parquet") -> None:
    """The given columns in their order; others are left out."""
    df.select(*columns).write.mode("overwrite").format(form).options(**({"header": True, "sep": "\t"} if form == "csv" else {})).save(path)


def write_by(df: DataFrame, path: str, *keys: str) -> None:
    """Folders by key. Rows are rebalanced by key first: few files, and a hot key is split among tasks."""
    df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def decompose(master: DataFrame, key: str, prelaunch: Sequence[str], outcomes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """What is known before a launch, and what only its outcome tells; a column in both is an error."""
    both = set(prelaunch) & set(outcomes) - {key}
    if both:
        raise ValueError(f"not known before the launch: {', '.join(sorted(both))}")
    return master.select(key, *[c for c in prelaunch if c != key]), master.select(key, *[c for c in outcomes if c != key])


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows and an order-free sum of row hashes; equal tables have equal fingerprints, repeated rows count."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(20,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(h), F.lit(0)).cast("string").alias("digest"))


def key_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and an order-free sum of SHA-256 prefixes over the given columns as text (null: empty), which any engine can repeat."""
    text = F.concat_ws("|", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns])
    prefix = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(prefix), F.lit(0)).cast("string").alias("digest"))
