"""Training: a bounded stratified choice of files, their costs measured by tasks, one aggregation, one solution a backend."""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.functions.blake3 import Blake3
from twinspark.operators import model, training
from twinspark.operators.cache import fail_if_any
from twinspark.plans.scan import StateTable
from twinspark.sources.blocks import BLOCK, blocks
from twinspark.sources.config import Config, load_ignore
from twinspark.sources.inventory import overlapping_roots, stamped_inventory, tasks_of
from twinspark.storage import materialized, ship

#: How a file's cost is measured: what each backend makes of its blocks.
BACKENDS = {"sha256": hashlib.sha256, "sha512": hashlib.sha512, "blake3": Blake3}
OBSERVED = "backend string, path string, bytes long, batch_bytes long, contention double, ms double"
#: A workspace's regression state: sums, weight, samples and ranges a backend.
COSTS = ", ".join(["backend string", *(f"{c} double" for c in model.MOMENTS), "samples long", *(f"{n}{i} double" for n in ("min", "max") for i in range(4))])


def select(files: DataFrame, config: Config, root: str = "root") -> DataFrame:
    chosen = training.stratified(training.eligible(files, config.training_bytes), config.training_per_band, root)
    return training.budgeted(chosen, config.training_files, config.training_bytes)


def measured(files: DataFrame, root: str, backends: tuple[str, ...] = tuple(BACKENDS)) -> DataFrame:
    """Observations (OBSERVED): the milliseconds that each backend takes for each file of files (path, size), read block
    by block in a task. Files are dealt out by path; a file that cannot be read fails the job."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                for name in backends:
                    state, size, began = BACKENDS[name](), 0, time.perf_counter()
                    for block in blocks(os.path.join(root, path)):
                        state.update(block)
                        size += len(block)
                    (state.value if name == "blake3" else state.digest)()
                    rows.append((name, path, size, BLOCK, 0.0, (time.perf_counter() - began) * 1000))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=[c.split()[0] for c in OBSERVED.split(", ")])

    return files.select("path").repartition(tasks_of(files.sparkSession), "path").mapInArrow(run, OBSERVED)


def learn(observations: DataFrame, prior: DataFrame | None = None, decay: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(state, fits) a backend, from observations and an older state whose sums decay."""
    ship(observations.sparkSession)
    state = model.moments(observations)
    if prior is not None:
        state = model.merged(state.unionByName(model.decayed(prior, decay)))
    return state, model.fit(state)


def train_corpora(spark: SparkSession, workspace: str, corpora: list[str], config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """(state, fits) after training a workspace on folders, none of which may hold another.

    Of each corpus the files that select() takes are measured, and what the workspace knew decays and is merged in; the
    new state is committed. Ignore rules are the workspace's."""
    config = config or Config.load(os.path.join(workspace, ".twinspark", "config.toml"))
    roots = [os.path.abspath(c) for c in corpora]
    fail_if_any(overlapping_roots(spark, roots), "corpora overlap")
    table, observed = StateTable(spark, workspace, "costs", COSTS), None
    for root in roots:
        chosen = materialized(select(stamped_inventory(spark, root, True, load_ignore(workspace)).select("path", "size"), config, root))
        rows = measured(chosen, root)
        observed = rows if observed is None else observed.unionByName(rows)
    observed = materialized(observed)  # times are never measured again
    known = table.read()
    state, _ = learn(observed, known, config.decay)
    table.commit(state.select(*known.columns))
    state = table.read()
    return state, model.fit(state)


def estimated(spark: SparkSession, workspace: str, files: DataFrame) -> DataFrame:
    """files (path, size) with the milliseconds that each backend known to the workspace would take; see model.predict."""
    fits = model.fit(StateTable(spark, workspace, "costs", COSTS).read())
    rows = files.select("path", F.explode(F.array(*map(F.lit, BACKENDS))).alias("backend"), F.col("size").alias("bytes"), F.lit(BLOCK).cast("long").alias("batch_bytes"), F.lit(0.0).alias("contention"))
    return model.predict(rows, fits).where("residual is not null")
