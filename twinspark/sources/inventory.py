"""Directory inventory: (path, size, identity, modified, changed[, content]) of regular files, links left out.

spark.read's binaryFile gives paths, sizes and contents of any store that Spark reads. Where inode and change time are
wanted, tasks walk a file system that driver and executors share: folders are rows, a task lists what its folders hold
and goes down into it until it has met enough, and what it has not opened are the folders of the next round. Names are
rows from the start and never come to the driver. Any error ends the walk, nothing is skipped.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.functions.ignore import Rule, automaton
from twinspark.storage import dropped, materialized, scratch, ship

#: Entries after which a task leaves further folders to the next round, and rows that it hands over at once.
ENOUGH, ROWS = 20_000, 2_000
STAMPED = "path string, size bigint, identity string, modified string, changed string"


def stamp(path: str) -> tuple[int, str, str, str]:
    """size, device:inode, and modification and change times as seconds:nanoseconds; opaque, only ever compared."""
    s = os.stat(path, follow_symlinks=False)
    nano = lambda t: f"{t // 10**9}:{t % 10**9}"
    return s.st_size, f"{s.st_dev}:{s.st_ino}", nano(s.st_mtime_ns), nano(s.st_ctime_ns)


def tasks_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def names_below(spark: SparkSession, root: str, recursive: bool = True, rules: list[Rule] | None = None, enough: int = ENOUGH) -> DataFrame:
    """path of each regular file below root that the rules do not ignore; ignored folders are not opened. A stored table.

    One round lists the folders that are left, dealt out anew, so a folder of any size is one task's stream and trees of
    many folders spread over all tasks. There are as many rounds as it takes with `enough` entries a task and round."""
    ship(spark)
    shipped, home = None if rules is None else tuple(rules), scratch(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = automaton(shipped).ignored if shipped is not None else lambda path, is_dir: False
        met, rows = 0, []
        for batch in batches:
            pending = batch.column("path").to_pylist()
            while pending:
                folder = pending.pop()
                if met > enough:
                    rows.append((folder, True))
                    continue
                with os.scandir(os.path.join(root, folder)) as found:
                    for entry in found:
                        met += 1
                        path = f"{folder}/{entry.name}" if folder else entry.name
                        if entry.is_dir(follow_symlinks=False):
                            if recursive and not judge(path, True):
                                (rows if met > enough else pending).append((path, True) if met > enough else path)
                        elif entry.is_file(follow_symlinks=False) and not judge(path, False):
                            rows.append((path, False))
                        if len(rows) >= ROWS:
                            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["path", "folder"])
                            rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["path", "folder"])

    left, number, rounds = spark.createDataFrame([("",)], "path string"), 0, []
    while True:
        rounds.append(materialized(left.mapInArrow(run, "path string, folder boolean"), f"{home}/round-{number}"))
        left = rounds[-1].where("folder").select("path")
        if left.isEmpty():
            break
        left, number = left.repartition(tasks_of(spark), "path"), number + 1
    return spark.read.schema("path string, folder boolean").parquet(*(f"{home}/round-{i}" for i in range(number + 1))).where("not folder").select("path")


def stamped(paths: DataFrame, root: str) -> DataFrame:
    """The stamps of the files that `path` names, from root; paths are dealt out anew, a file that is gone is an error."""
    ship(paths.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [stamp(os.path.join(root, p)) for p in batch.column("path").to_pylist()]
            columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.int64(), *[pa.string()] * 3))]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *columns], names=["path", "size", "identity", "modified", "changed"])

    return paths.select("path").repartition(tasks_of(paths.sparkSession), "path").mapInArrow(run, STAMPED)


def stamped_inventory(spark: SparkSession, root: str, recursive: bool = True, rules: list[Rule] | None = None) -> DataFrame:
    """The regular files below root, without those that the rules ignore, with their stamps. A stored table."""
    names = names_below(spark, root, recursive, rules)
    out = materialized(stamped(names, root))
    dropped(spark, names)
    return out


def binary_inventory(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """With content, from any store that Spark reads; the stamp has the modification time alone."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(base)
    relative = F.regexp_replace(F.col("path"), "^[a-z0-9+.-]+:/*", "/")
    if base.startswith("/") or base.startswith("file:"):
        relative = F.substring(relative, len("/" + base.removeprefix("file:").lstrip("/")) + 2, 1 << 30)
    return raw.select(relative.alias("path"), F.col("length").alias("size"), F.lit("").alias("identity"), F.col("modificationTime").cast("string").alias("modified"), F.lit("").alias("changed"), "content")


def discover_workspaces(root: str, recursive: bool = False, skip: str | None = None) -> list[str]:
    """Folders with a state folder below root, sorted, once each, without `skip`; none is an error."""
    top = Path(root)
    found = {str(p.parent.resolve()) for p in (top.rglob(".twinspark") if recursive else [*top.glob(".twinspark"), *top.glob("*/.twinspark")]) if p.is_dir()}
    found.discard(skip and str(Path(skip).resolve()))
    if not found:
        raise ValueError(f"no workspace under {root}")
    return sorted(found)


def overlapping_roots(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Pairs of corpus roots of which one holds the other or both are the same; must be empty.

    Each root is split into its ancestors, which are joined to the roots by equality."""
    df = spark.createDataFrame([(i, r.rstrip("/")) for i, r in enumerate(roots)], "i int, root string")
    parts = F.split("root", "/")
    ancestors = df.select(F.col("i").alias("j"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).alias("root"))
    return df.join(ancestors, "root").where("i <> j").select("i", "j", "root")
