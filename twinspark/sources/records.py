"""Readers for benchmark and log files; schemas are given, not inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of files that others write.
DISPATCH = "backend string, trial bigint, `order` bigint, size bigint, block bigint, workers bigint, repeats bigint, init_ms double, steady_ms double, aggregate_mib_s double, verified_digests bigint, worker_jobs array<bigint>, cpu_jobs bigint, cuda_jobs bigint"
STORE_CSV = "variant string, paired_trial bigint, shape string, phase string, rows bigint, cache_bytes bigint, operations bigint, elapsed_ms double, verified boolean"
TELEMETRY_CSV = (
    "campaign string, trial bigint, arm string, phase string, process_ms double, pipeline_ms double, elapsed_ms double, drain_ms double, accepted bigint, persisted bigint, dropped bigint, errors bigint, truncated bigint, verified boolean, binary_sha256 string"
)


def read_jsonl(spark: SparkSession, path: str, schema: str = DISPATCH, kind: str | None = None) -> DataFrame:
    """Typed records, one a line; a malformed line is an error. kind: only records with this `kind`."""
    df = spark.read.schema(schema + (", kind string" if kind else "")).option("mode", "FAILFAST").json(path)
    return df.where(F.col("kind") == kind).drop("kind") if kind else df


def read_csv(spark: SparkSession, path: str, schema: str = STORE_CSV) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def key_values(line: Column) -> Column:
    """array<struct<key, value>> of all key=number pairs in a log line."""
    keys = F.regexp_extract_all(line, F.lit(r"([\w.]+)=(\d+(?:\.\d+)?)"), F.lit(1))
    values = F.regexp_extract_all(line, F.lit(r"([\w.]+)=(\d+(?:\.\d+)?)"), F.lit(2))
    return F.transform(F.arrays_zip(keys.alias("key"), values.alias("value")), lambda x: F.struct(x["key"].alias("key"), x["value"].cast("double").alias("value")))


def read_groups(spark: SparkSession, path: str) -> DataFrame:
    """group and its set of paths from a TSV report; group 0 holds what has no copy."""
    parts = F.split(F.col("value"), "\t", 2)
    rows = spark.read.text(path).select(parts[0].cast("long").alias("group"), F.get_json_object(F.concat(F.lit('{"p":'), parts[1], F.lit("}")), "$.p").alias("path"))
    return rows.groupBy("group").agg(F.sort_array(F.collect_set("path")).alias("paths"))
