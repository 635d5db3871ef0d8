"""Telemetry as a stream: each run's events up to a cap, by state that Spark keeps a run, and the newest runs at reading."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from twinspark.operators.telemetry import retained
from twinspark.storage import ship

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUN_STATE = StructType([StructField(name, LongType()) for name in ("accepted", "dropped", "started")])
RUN = StructType([StructField("run_id", StringType()), *RUN_STATE.fields])


def events_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """Backpressure is the number of files a micro-batch takes."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


class RunCap(StatefulProcessor):
    """A run's first `cap` events go through, by event_id within a batch; the others are counted.

    Its state is three numbers a run: accepted and dropped events, and the start, which is the smallest time of the
    run's first batch. Of a batch only as many events are held as may still go through."""

    def __init__(self, names: list[str], start: str | None, cap: int):
        self.names, self.start, self.cap = names, start, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.run = handle.getValueState("run", RUN_STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        known = self.run.get() if self.run.exists() else (0, 0, None)
        met, first = 0, None

        def counted() -> Iterator[Row]:
            nonlocal met, first
            for row in rows:
                met += 1
                if self.start is not None and row[self.start] is not None:
                    first = row[self.start] if first is None else min(first, row[self.start])
                yield row

        room = max(0, self.cap - known[0])
        kept = heapq.nsmallest(room, counted(), key=lambda r: (r["event_id"] is None, r["event_id"])) if room else deque(counted(), 0)
        now = (known[0] + len(kept), known[1] + met - len(kept), known[2] if known[2] is not None else first)
        self.run.update(now)
        for row in kept:
            yield Row(event=Row(**{name: row[name] for name in self.names}), run=None)
        yield Row(event=None, run=Row(run_id=key[0], accepted=now[0], dropped=now[1], started=now[2]))

    def close(self) -> None:
        pass


def _written(schema: StructType) -> StructType:
    """A row is an event that was accepted, or the counts of a run up to a batch that had events of it."""
    return StructType([StructField("event", schema), StructField("run", RUN)])


def write_events(events: DataFrame, target: str, checkpoint: str, cap: int, start: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Appends micro-batches to target, each run's events beyond `cap` dropped and counted; see read_events, read_runs.

    What a run has had is keyed state in Spark's state store (RocksDB), so a batch reads and writes the state of its own
    runs and nothing of earlier batches. A batch is written under its own number and replaced when it is run again, so a
    restart adds nothing twice. The state keeps three numbers a run for ever. start: the column whose smallest value in a run's first batch is when the run began;
    without it runs are ordered by arrival."""
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    capped = events.groupBy("run_id").transformWithState(RunCap(events.columns, start, cap), _written(events.schema), "append", "none")

    def batch(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = capped.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="250 milliseconds")).start()


def read_runs(spark: SparkSession, target: str) -> DataFrame:
    """run_id, accepted, dropped, started_unix_ns and row_id (the arrival) of each run."""
    rows = spark.read.schema(StructType([StructField("run", RUN), StructField("batch", LongType())])).parquet(target).where("run is not null").select("run.*", "batch")
    runs = rows.groupBy("run_id").agg(F.max_by(F.struct("accepted", "dropped"), "batch").alias("x"), F.min_by("started", "batch").alias("started_unix_ns"), F.min("batch").alias("first"))
    return runs.select("run_id", "x.*", "started_unix_ns", F.struct("first", "run_id").alias("row_id"))


def kept_runs(runs: DataFrame, keep: int) -> DataFrame:
    """The newest `keep` runs by (start, arrival); the one that arrived last is the current run and stays, whatever its
    clock says."""
    current = runs.agg(F.max("row_id.first").alias("first")).join(runs, F.col("first") == F.col("row_id.first")).agg(F.max("run_id")).first()[0]
    return runs.limit(0) if current is None else retained(runs, keep, current)


def read_events(spark: SparkSession, target: str, schema: StructType, keep: int | None = None) -> DataFrame:
    """The events that were accepted, of the newest `keep` runs if that is given, see kept_runs."""
    rows = spark.read.schema(_written(schema)).parquet(target).where("event is not null").select("event.*")
    return rows if keep is None else rows.join(kept_runs(read_runs(spark, target), keep).select("run_id"), "run_id", "left_semi").select(*(f.name for f in schema))


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """An extension: counts by event-time window and name, late rows up to the watermark included."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))
