"""Snapshots as a stream: a streaming source whose offsets are a state table's generations and whose rows are changes."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from twinspark.plans.scan import CACHED, CHANGES
from twinspark.storage import ship


class ChangeFile(InputPartition):
    def __init__(self, path: str, generation: int):
        self.path, self.generation = path, generation


class ChangeReader(DataSourceStreamReader):
    """A micro-batch is the files of changes of the generations that came since the last one, a task each."""

    def __init__(self, folder: str, schema: StructType, since: int):
        self.folder, self.schema, self.since = Path(folder), schema, since

    def initialOffset(self) -> dict:
        return {"generation": self.since}

    def latestOffset(self) -> dict:
        manifest = self.folder / "current.json"
        return {"generation": max(self.since, json.loads(manifest.read_text())["generation"] if manifest.exists() else 0)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        files = []
        for n in range(start["generation"] + 1, end["generation"] + 1):
            folder = self.folder / CHANGES / f"gen={n}"
            if not (folder / "_SUCCESS").exists():
                if (self.folder / f"gen={n}").exists():
                    raise ValueError(f"generation {n} was committed without its changes")
                continue  # a number that was taken and never became a generation
            files += [ChangeFile(str(p), n) for p in sorted(folder.glob("*.parquet"))]
        return files

    def read(self, partition: ChangeFile) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema if f.name != "generation"]
        for batch in pq.ParquetFile(partition.path).iter_batches(10_000, columns=names):
            number = pa.array([partition.generation] * batch.num_rows, pa.int64())
            columns = {**dict(zip(batch.schema.names, batch.columns, strict=True)), "generation": number}
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in self.schema], names=[f.name for f in self.schema])

    def commit(self, end: dict) -> None:
        pass


class ChangeSource(DataSource):
    """spark.readStream.format("generations").load(folder of a state table)"""

    @classmethod
    def name(cls) -> str:
        return "generations"

    def schema(self) -> str:
        return f"{CACHED}, change string, generation long"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return ChangeReader(self.options["path"], schema, int(self.options.get("since", "0")))


def changes_stream(spark: SparkSession, folder: str, schema: str | None = None, since: int = 0) -> DataFrame:
    """The changes of each generation after `since`: the table's columns, change (added, changed or gone, the last with
    the row as it was) and generation. folder is on a file system that driver and executors share. schema: of tables
    other than the digest cache, with change and generation."""
    ship(spark)
    spark.dataSource.register(ChangeSource)
    reader = spark.readStream.format("generations").option("since", str(since))
    return (reader.schema(schema) if schema else reader).load(folder)
