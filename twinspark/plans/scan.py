"""The scan: inventory, cached digests, duplicates, validation, report."""

from __future__ import annotations

import json
import os
import shutil
import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from twinspark.functions.scalars import human_bytes
from twinspark.functions.scalars import run_id as new_run_id
from twinspark.operators import cache, dedup
from twinspark.operators.telemetry import cascade, retained
from twinspark.schema import METRICS, RUNS, STAMP
from twinspark.sources.config import Config, load_ignore
from twinspark.sources.blocks import equal_files, with_digest
from twinspark.sources.inventory import stamped, stamped_inventory
from twinspark.storage import materialized, scratch

CHANGES = "changes"
CACHED = f"path string, {', '.join(f'{c} {"bigint" if c == "size" else "string"}' for c in STAMP)}, digest string"


@dataclass
class Scan:
    files: DataFrame
    groups: DataFrame
    counters: dict


def regular_state(path: Path) -> bool:
    """Whether the file is there; a link, a special file or one with a second name is no state file and an error."""
    if not path.exists() and not path.is_symlink():
        return False
    if path.is_symlink() or not path.is_file() or path.stat().st_nlink != 1:
        raise ValueError(f"unsafe state file: {path}")
    return True


class StateTable:
    """A table by generation: generation N is a Parquet folder; a manifest renamed into place names the current one, so a
    crash leaves the old one whole."""

    def __init__(self, spark: SparkSession, root: str, name: str = "state", schema: str | StructType = CACHED):
        self.spark, self.folder, self.schema = spark, Path(root) / ".twinspark" / name, schema

    def generation(self) -> int:
        manifest = self.folder / "current.json"
        if any(p.is_symlink() for p in (self.folder.parent, self.folder)):
            raise ValueError(f"unsafe state folder: {self.folder}")
        return json.loads(manifest.read_text())["generation"] if regular_state(manifest) else 0

    def read(self) -> DataFrame:
        n = self.generation()
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(f"file://{self.folder.resolve()}/gen={n}") if n else self.spark.createDataFrame([], self.schema)

    def commit(self, rows: DataFrame, key: str | None = None) -> int:
        """The next generation; what rows do not hold is gone with the old one. key: the column that tells rows apart;
        with it the changes are written as well, for streaming.snapshot_stream.

        Its number is taken by making its folder, so two writers never share one; the manifest only moves forward. The
        generation before stays for those who read it, older ones are removed."""
        before = self.generation()
        self.folder.mkdir(parents=True, exist_ok=True)
        n = 1 + max((int(p.name.removeprefix("gen=")) for p in self.folder.glob("gen=*")), default=before)
        while True:
            try:
                (self.folder / f"gen={n}").mkdir()
                break
            except FileExistsError:
                n += 1
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        target = f"file://{self.folder.resolve()}"
        old = self.read() if key else None
        rows.select(*names).write.mode("append").parquet(f"{target}/gen={n}")
        if key:
            new = self.spark.read.schema(self.schema).parquet(f"{target}/gen={n}")
            changed_rows(old, new, key).write.mode("overwrite").parquet(f"{target}/{CHANGES}/gen={n}")
        if self.generation() < n:
            temporary = self.folder / f"current.json.{n}"
            temporary.write_text(json.dumps({"generation": n}))
            os.replace(temporary, self.folder / "current.json")
        for old in self.folder.glob("gen=*"):  # those that are being written have no mark of success yet
            if int(old.name.removeprefix("gen=")) < before and (old / "_SUCCESS").exists():
                shutil.rmtree(old, ignore_errors=True)
        return n


def changed_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows that are added, changed or gone (then as they were), with `change`; rows that are alike are left out."""
    both = old.select(key, F.struct(*old.columns).alias("_old")).join(new.select(key, F.struct(*old.columns).alias("_new")), key, "full_outer")
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "gone").otherwise("changed")
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(F.coalesce("_new", "_old").alias("_row"), change.alias("change")).select("_row.*", "change")


def archived(spark: SparkSession, root: str) -> DataFrame:
    """The digests that merges have brought to the workspace, of the files below it, by their paths from it."""
    base = str(Path(root).resolve()).rstrip("/") + "/"
    rows = StateTable(spark, root, "absolute").read()
    return rows.where(F.col("path").startswith(base)).withColumn("path", F.substring("path", len(base) + 1, 1 << 30))


def scan(spark: SparkSession, root: str, config: Config | None = None, rehash: bool = False) -> Scan:
    """Scans a workspace on a file system that driver and executors share.

    A digest comes from the last scan, or else from the merged archive, if all of a file's stamp is equal; only the other
    files are opened and hashed, all of them with rehash. The cache commits before groups are compared, for which the
    candidates alone are read; a member that changed meanwhile fails the scan."""
    config = config or Config.load(Path(root) / ".twinspark" / "config.toml")
    inventory = stamped_inventory(spark, root, config.recursive, load_ignore(root))
    state = StateTable(spark, root)
    hits, misses = inventory.limit(0).withColumn("digest", F.lit("")), inventory
    for known in () if rehash else (state.read(), archived(spark, root)):
        known = known.where(F.length("digest") == 64)
        hits = hits.unionByName(cache.cache_hits(misses, known).select("path", *STAMP, F.col("cached_digest").alias("digest")))
        misses = materialized(cache.cache_misses(misses, known))
    hits = materialized(hits)
    hashed = with_digest(misses, root, config.digest).select("path", *STAMP, "digest")
    files = materialized(hits.unionByName(hashed), f"{scratch(spark)}/files")
    state.commit(files, key="path")

    candidates = dedup.dup_candidates(files).select("path", "size", "digest")
    groups = equal_files(candidates, root)
    members = files.join(groups.select(F.col("member").alias("path")), "path", "left_semi")
    cache.fail_if_any(cache.changed_members(members, stamped(members, root)), "a member changed during the scan")
    counters = dedup.scan_counters(inventory, hits, groups).first().asDict()
    return Scan(files, groups, counters)


def record_run(spark: SparkSession, root: str, counters: dict, started_ns: int, config: Config) -> str:
    """Puts a finished scan into the workspace's telemetry as a run with its counters as metrics, and keeps the newest
    `history_runs` runs, this one among them. Returns its id."""
    tables = {name: StateTable(spark, root, f"telemetry/{name}", schema) for name, schema in (("metrics", METRICS), ("runs", RUNS))}
    run_id = spark.range(1).select(new_run_id().alias("id")).first().id
    values = {"run_id": run_id, "started_unix_ns": started_ns, "ended_unix_ns": time.time_ns(), "status": "complete", "command": "scan", "root": str(Path(root).resolve()), "accepted": 0, "persisted": 0, "dropped": 0, "errors": 0, "truncated": 0, "queue_high_water": 0}
    row = spark.createDataFrame([tuple(values.get(f.name) for f in RUNS)], RUNS)
    runs = materialized(retained(tables["runs"].read().unionByName(row), config.history_runs, run_id))
    units = {k: "bytes" if k.endswith("_bytes") else "count" for k in counters}
    metrics = tables["metrics"].read().unionByName(spark.createDataFrame([(run_id, k, float(v), units[k]) for k, v in counters.items()], METRICS))
    tables["metrics"].commit(cascade(metrics, runs))
    tables["runs"].commit(runs)
    return run_id


def summary(spark: SparkSession, counters: dict) -> str:
    """key=value line of a scan."""
    text = {k: v for k, v in counters.items()}
    row = spark.range(1).select(*(human_bytes(F.lit(v)).alias(k) for k, v in text.items() if k.endswith("_bytes"))).first()
    return " ".join(f"{k}={v}" for k, v in text.items()) + "".join(f" {k}_text={row[k]!r}" for k in row.asDict())
