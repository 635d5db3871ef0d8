"""Fixed schemas of the stored tables; schemas are asserted, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

_KINDS = {"string": StringType(), "bigint": LongType(), "int": IntegerType(), "double": DoubleType(), "binary": BinaryType(), "array<double>": ArrayType(DoubleType())}


def _schema(text: str) -> StructType:
    """From "name kind [not null], ..."; needs no session, unlike Spark's own parser."""
    return StructType([StructField(name, _KINDS[kind], not rest) for name, kind, *rest in (x.split() for x in text.split(", "))])


FILES = _schema("path string not null, size bigint not null, identity string, modified string, changed string, digest string not null, content string")
RUNS = _schema(
    "run_id string not null, started_unix_ns bigint not null, ended_unix_ns bigint, status string not null, version string, command string, root string, config_json string, error string, "
    "accepted bigint, persisted bigint, dropped bigint, errors bigint, truncated bigint, queue_high_water bigint"
)
EVENTS = _schema(
    "event_id bigint not null, run_id string not null, type string, name string, severity string, message string, backend string, worker bigint, span_id bigint, parent_span_id bigint, "
    "time_ns bigint, duration_ns bigint, bytes bigint, value double, unit string, truncated bigint"
)
METRICS = _schema("run_id string not null, name string not null, value double, unit string")
PARAMETERS = _schema("run_id string not null, category string not null, name string not null, value string")
MERGE_SOURCES = _schema(
    "source_id bigint not null, path string not null, application_id bigint not null, schema_version bigint not null, snapshot_unix_ns bigint not null, runs_added bigint not null, runs_duplicate bigint not null, runs_running bigint not null"
)
RUN_SOURCES = _schema("run_id string not null, source_id bigint not null")
MODEL_PARTS = _schema(
    "source binary not null, key binary not null, revision bigint not null, attenuation double not null, backend int, "
    "xtx array<double>, xty array<double>, minimum array<double>, maximum array<double>, yty double, weight double, samples bigint"
)
SETUP_PARTS = _schema("source binary not null, key binary not null, revision bigint not null, last_ms double, mean_ms double, max_ms double, samples bigint")
STAMP = ("size", "identity", "modified", "changed")


def assert_schema(df: DataFrame, expected: StructType, name: str) -> DataFrame:
    """df, if it has exactly the expected columns in order and of the expected types; else ValueError before any write."""
    have = [(f.name, f.dataType.simpleString()) for f in df.schema]
    want = [(f.name, f.dataType.simpleString()) for f in expected]
    if have != want:
        raise ValueError(f"{name}: foreign schema {have}; expected {want}")
    return df
