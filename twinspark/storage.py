"""Where intermediate tables live: the shared folder of the cluster."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


ROOT = str(Path(__file__).resolve().parents[1])


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


#: Of local sessions without spark.checkpoint.dir, by application.
_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is not set a local master takes a temporary folder of its
    own; on a cluster it is an error, as no such folder is shared there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        key = spark.sparkContext.applicationId
        base = _LOCAL.get(key) or _LOCAL.setdefault(key, "file://" + tempfile.mkdtemp(prefix="twinspark-"))
    return f"{base.rstrip('/')}/twinspark-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes all scratch tables of this application; what reads them fails from then on."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(os.path.dirname(scratch(spark)))
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes the files of scratch tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for folder in {os.path.dirname(f) for t in tables for f in t.inputFiles()}:
        there = jvm.org.apache.hadoop.fs.Path(folder)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def materialized(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written as a table and read again: steps that use it twice compute it once, and survive a lost executor."""
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of up to this many rows go to every task; joining by a shuffle would bring all rows of a key to one task.
FEW = 200_000


def lookup(df: DataFrame, few: int = FEW, stored: bool = False) -> DataFrame:
    """df stored (unless it is) as the smaller side of a join: broadcast if it has up to `few` rows, so that the other
    side stays where it lies, else as it is."""
    df = df if stored else materialized(df)
    return F.broadcast(df) if df.count() <= few else df
