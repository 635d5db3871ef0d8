"""Run histories as folders of Parquet tables; a folder is an immutable snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from twinspark.operators.archive import CHILDREN, History
from twinspark.operators.cache import fail_if_any
from twinspark.operators.telemetry import orphans
from twinspark.schema import EVENTS, METRICS, PARAMETERS, RUNS, assert_schema

SCHEMAS = {"runs": RUNS, "events": EVENTS, "metrics": METRICS, "parameters": PARAMETERS}


def read_history(spark: SparkSession, path: str) -> History:
    """A validated history: exact columns, no child row without its run. Foreign tables are refused before any use."""
    tables = {name: assert_schema(spark.read.parquet(f"{path}/{name}"), schema, f"{path}/{name}") for name, schema in SCHEMAS.items()}
    for name in CHILDREN:
        fail_if_any(orphans(tables[name], tables["runs"]), f"orphans in {path}/{name}")
    return History(*(tables[n] for n in ("runs", *CHILDREN)))


def at_most(df: DataFrame, n: int, message: str) -> DataFrame:
    """df, if it has no more than n rows; counts n + 1 rows at most."""
    if df.limit(n + 1).count() > n:
        raise ValueError(f"{message}: more than {n} rows")
    return df
