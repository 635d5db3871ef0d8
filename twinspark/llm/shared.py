"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.operators.dedup import filter_words

ROOT = str(Path(__file__).resolve().parents[2])
BATCH_ROWS = 1_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Of local sessions without spark.checkpoint.dir, by application.
_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent a local master (tests, a laptop) takes one temporary folder a session; a cluster has no
    folder that all machines see, so it is an error there."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        key = spark.sparkContext.applicationId
        base = _LOCAL.get(key) or _LOCAL.setdefault(key, "file://" + tempfile.mkdtemp(prefix="twinspark-"))
    return f"{base.rstrip('/')}/twinspark-{uuid.uuid4().hex}"


#: Of narrow rows that are counted, a task writes about this many, see stored.
ROWS_A_TASK = 50_000


def stored(df: DataFrame, path: str, rows: int | None = None) -> DataFrame:
    """df as a table written to the shared folder: cuts the lineage, and a lost executor costs no recomputation.

    rows: about how many it has at most, given where df ends in a grouping of narrow rows. A small table is then not
    written by as many tasks, and to as many files, as a shuffle has partitions; a large one is written as it is."""
    (df if rows is None else df.coalesce(max(8, -(-rows // ROWS_A_TASK)))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables that no later step reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        there = jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def release(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch tables, and lets Spark's cleaner drop the shuffle files behind tables that are written: it does
    so when the driver's garbage is collected."""
    remove(spark, *paths)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package where it is not installed, and bounds what they get at once: whole texts
    come in batches of BATCH_ROWS rows where the session has Spark's default, ten times as many."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


#: Identifiers of rows to drop are broadcast up to this many (about 20 MB); beyond it rows are joined by a shuffle.
MAX_BROADCAST_IDS = 200_000


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column_of(df: DataFrame, name: str) -> str:
    """The column of df that is called so, in the same case if there is one, else in any case."""
    found = [c for c in df.columns if c == name] or [c for c in df.columns if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are called {name}: {df.columns}")
    return found[0]


def picked(df: DataFrame, **wanted: str) -> DataFrame:
    """The columns of df that wanted names, by the new names that it gives; names may hold dots, other columns clash."""
    at = {new: df.columns.index(column_of(df, old)) for new, old in wanted.items()}
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{i}").alias(new) for new, i in at.items()))


def positional(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[str]]:
    """df with its columns called c0, c1 and so on, and which of them the wanted ones are. toDF(*df.columns) undoes it."""
    at = [f"c{df.columns.index(column_of(df, name))}" for name in wanted]
    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))), at


def full_text(name: str = "text") -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def kind_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about `most` bytes of the column at most (one row at least), so that what a task makes
    of whole texts stays bounded whatever their length."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes + 64), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def with_spans(rows: DataFrame, spans: DataFrame, keys: list[str], name: str) -> DataFrame:
    """rows with the column `name` of spans (a stored table, unique by keys), null where there is none: a left join that
    shuffles only the rows whose keys may be in spans, by a filter that grows with it. Rows are read twice."""
    bit = F.pmod(F.xxhash64(*keys), F.lit(64 * (words := filter_words(spans.count()))))
    marks = spans.select(bit.alias("_bit")).groupBy((F.col("_bit") / 64).cast("long").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_bit % 64 as int)))").alias("_bits"))
    placed = rows.withColumn("_bit", bit).withColumn("_word", (F.col("_bit") / 64).cast("long")).join(F.broadcast(marks), "_word", "left")  # at most `words` rows
    may = F.coalesce(F.expr("shiftrightunsigned(_bits, cast(_bit % 64 as int)) & 1 = 1"), F.lit(False))
    found = placed.where(may).select(rows.columns).join(spans.select(*keys, name), keys, "left").select(*rows.columns, name)
    return found.unionByName(placed.where(~may).select(*rows.columns, F.lit(None).cast(spans.schema[name].dataType).alias(name)))


def without(docs: DataFrame, dropped: DataFrame, keys: list[str], most: int = MAX_BROADCAST_IDS) -> DataFrame:
    """docs without the rows whose keys are in dropped (a stored table); rows with a null key stay."""
    few = dropped.limit(most + 1).count() <= most
    return docs.join(F.broadcast(dropped) if few else dropped, keys, "left_anti")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)
