"""The driver's tables in the engine's shapes: a file inventory and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as an inventory with digests; doc_id comes along to build other snapshots from."""
    text = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length(text).cast("long").alias("size"), F.concat(F.lit("0:"), F.col("doc_id").cast("string")).alias("identity"),
        F.lit("1:0").alias("modified"), F.lit("1:0").alias("changed"), F.sha2(text, 256).alias("digest"), text.alias("content"), "doc_id",
    )


def prev_v(files: DataFrame) -> DataFrame:
    """An earlier snapshot: some files not there yet, some with another stamp."""
    return files.where("doc_id % 11 <> 0").withColumn("modified", F.when(F.col("doc_id") % 7 == 0, F.lit("0:0")).otherwise(F.col("modified"))).drop("content", "doc_id")


def tele_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as telemetry: a run for each user, a name for each type, durations in milliseconds."""
    kind = F.when(F.col("event_type").isin("error", "signup"), F.lit("log")).otherwise(F.lit("span"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").cast("string").alias("run_id"), kind.alias("type"), F.col("event_type").alias("name"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("info")).alias("severity"), F.col("value").alias("duration_ms"),
        F.floor(F.col("value") * 1000).cast("long").alias("bytes"), F.col("event_id").alias("time_ns"), F.pmod("event_id", F.lit(4)).alias("worker"), "props",
    )


def runs_v(tele: DataFrame) -> DataFrame:
    """One run for each run_id of the events, started when its first event came."""
    status = F.when(F.pmod(F.max("event_id"), F.lit(5)) == 0, F.lit("running")).otherwise(F.lit("complete"))
    return tele.groupBy("run_id").agg(F.min("time_ns").alias("started_unix_ns"), status.alias("status"), F.count(F.lit(1)).alias("accepted"))
