"""Unions of run histories: the runtime's, which skips known runs, and the archive's, which fails on any conflict."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.operators.cache import fail_if_any
from twinspark.operators.ordered import row_positions, running_sums
from twinspark.storage import materialized

CHILDREN = ("events", "metrics", "parameters")


@dataclass
class History:
    runs: DataFrame
    events: DataFrame
    metrics: DataFrame
    parameters: DataFrame


def merge_by_run(target: History, source: History) -> History:
    """target with source's runs that it does not have; equal run ids are skipped, whatever their content."""
    new = source.runs.join(target.runs.select("run_id"), "run_id", "left_anti")
    child = lambda name: getattr(target, name).unionByName(getattr(source, name).join(new.select("run_id"), "run_id", "left_semi"))
    return History(target.runs.unionByName(new.select(target.runs.columns)), *(child(c) for c in CHILDREN))


def ordinal(events: DataFrame) -> DataFrame:
    """Position of each event in its run; event ids are local to a database and are no content. A run with very many
    events is dealt to many tasks."""
    return row_positions(events, ["run_id"], ["event_id"], "pos").drop("event_id")


def conflicts(known: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of runs in both that are absent or different on one side: keys and which side has them."""
    shared = known.select("run_id").distinct().join(incoming.select("run_id").distinct(), "run_id")
    others = [c for c in known.columns if c not in keys]
    side = lambda df, name: df.join(shared, "run_id", "left_semi").select(*keys, F.struct(*others).alias(name))
    return side(known, "a").join(side(incoming, "b"), keys, "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(*keys, F.col("a").isNotNull().alias("in_target"), F.col("b").isNotNull().alias("in_source"))


def run_prints(events: DataFrame) -> DataFrame:
    """run_id, whether its event ids have no gap, the number of events, and two 64-bit prints of their content in order.

    Event ids tell a run's events apart. Without gaps an event's position is its distance from the first, so a print is
    made of the hashes of (position, content), which meet in every task and need no order; two runs of equal prints are
    the same but for a chance of 2^-128."""
    ends = materialized(events.groupBy("run_id").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count(F.lit(1)).alias("n")))
    content = [c for c in events.columns if c not in ("run_id", "event_id")]
    nulls = F.concat(F.lit(""), *(F.col(c).isNull().cast("string") for c in content))
    at = F.col("event_id") - F.col("first")
    prints = [F.bit_xor(F.xxhash64(F.lit(i), at, nulls, *content)).alias(f"print{i}") for i in (1, 2)]
    distances = F.sum(at.cast("decimal(38,0)"))
    dense = (F.max("last") - F.max("first") + 1 == F.max("n")) & (distances * 2 == F.max("n").cast("decimal(38,0)") * (F.max("n") - 1))
    return events.join(ends, "run_id").groupBy("run_id").agg(F.max("n").alias("n"), dense.alias("dense"), *prints)


def event_conflicts(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """conflicts of the events of runs in both. Events are put in order and compared one by one only in runs whose prints
    differ, or whose ids have gaps."""
    a, b = run_prints(known), run_prints(incoming)
    odd = a.join(b.select("run_id", *(F.col(c).alias(f"other_{c}") for c in ("dense", "n", "print1", "print2"))), "run_id")
    same = F.col("dense") & F.col("other_dense") & (F.col("n") == F.col("other_n")) & (F.col("print1") == F.col("other_print1")) & (F.col("print2") == F.col("other_print2"))
    odd = materialized(odd.where(~same).select("run_id"))
    mine, theirs = (ordinal(df.join(odd, "run_id", "left_semi")) for df in (known, incoming))
    return conflicts(mine, theirs, ["run_id", "pos"])


def history_conflicts(target: History, source: History) -> DataFrame:
    """table, run_id of every difference between two histories of the same runs."""
    parts = [
        conflicts(target.runs, source.runs, ["run_id"]), event_conflicts(target.events, source.events),
        conflicts(target.metrics, source.metrics, ["run_id", "name"]), conflicts(target.parameters, source.parameters, ["run_id", "category", "name"]),
    ]
    out = None
    for name, part in zip(("runs", *CHILDREN), parts, strict=True):
        rows = part.select(F.lit(name).alias("table"), "run_id")
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def import_order(runs: DataFrame, events: DataFrame) -> DataFrame:
    """events in the order an archive takes them, by (run's start, run, event): a prefix sum over runs and the position in
    the run give the new ids, so no task numbers all events."""
    sizes = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).join(runs.select("run_id", "started_unix_ns"), "run_id")
    summed = running_sums(sizes.withColumn("all", F.lit(0)), ["all"], ["started_unix_ns", "run_id"], "n", "upto")
    before = materialized(summed.select("run_id", (F.col("upto") - F.col("n")).alias("before")))
    return ordinal(events).join(before, "run_id").withColumn("event_id", F.col("before") + F.col("pos")).drop("before", "pos")


def archive_union(sources: list[tuple[int, History]]) -> tuple[History, DataFrame, DataFrame]:
    """(union, run_sources, totals of each source). Any difference in a shared run, or a child row without a run, fails
    the whole union before anything is written. Totals count a source's added and duplicate runs, and its running ones."""
    union, bridge, totals = None, None, None
    for source_id, h in sources:
        for name in CHILDREN:
            fail_if_any(getattr(h, name).join(h.runs.select("run_id"), "run_id", "left_anti"), f"orphans in {name} of source {source_id}")
        known = h.runs.limit(0).select("run_id") if union is None else union.runs.select("run_id")
        if union is not None:
            fail_if_any(history_conflicts(union, h), "conflicting runs")
        row = source_totals(h.runs, known, source_id)
        link = h.runs.select("run_id", F.lit(source_id).cast("long").alias("source_id")).distinct()
        union, bridge, totals = (h, link, row) if union is None else (merge_by_run(union, h), bridge.unionByName(link), totals.unionByName(row))
    return union, bridge, totals


def source_totals(runs: DataFrame, known: DataFrame, source_id: int) -> DataFrame:
    """One row: how many of the runs are new, in `known` already, and still running."""
    flagged = runs.join(known.select("run_id").distinct().withColumn("known", F.lit(True)), "run_id", "left")
    return flagged.agg(F.count_if(F.col("known").isNull()).alias("runs_added"), F.count_if(F.col("known")).alias("runs_duplicate"), F.count_if(F.col("status") == "running").alias("runs_running")).select(
        F.lit(source_id).cast("long").alias("source_id"), "*"
    )


def totals_json(totals: DataFrame) -> DataFrame:
    """One JSON text a source."""
    return totals.select("source_id", F.to_json(F.struct("source_id", "runs_added", "runs_duplicate", "runs_running")).alias("totals"))


def publish(history: History, path: str) -> None:
    """Writes an archive where none is; an existing one is never overwritten. The tables are written beside it and
    renamed in one step, so a crash leaves no half archive."""
    spark = history.runs.sparkSession
    jvm = spark.sparkContext._jvm
    target, beside = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"))
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise ValueError(f"{path} exists")
    try:
        for name in ("runs", *CHILDREN):
            getattr(history, name).write.parquet(f"{beside.toString()}/{name}")
    except Exception:
        fs.delete(beside, True)
        raise
    if fs.exists(target) or not fs.rename(beside, target):
        fs.delete(beside, True)
        raise ValueError(f"{path} exists")
