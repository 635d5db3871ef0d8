"""Views, retention, caps and recovery over the telemetry tables (runs, events, metrics, parameters)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.operators.ordered import lagged, row_positions


def logs(events: DataFrame) -> DataFrame:
    return events.where("type = 'log'")


def spans(events: DataFrame) -> DataFrame:
    return events.where("type = 'span'")


def latest_run(runs: DataFrame, by_start: bool = True) -> DataFrame:
    """The archive's latest run is by (started, run_id); the runtime's by arrival, column `row_id`."""
    order = F.struct("started_unix_ns", "run_id") if by_start else F.col("row_id")
    return runs.agg(F.max_by(F.struct(*runs.columns), order).alias("x")).where("x is not null").select("x.*")


def recent_errors(events: DataFrame, n: int = 100) -> DataFrame:
    """The newest warnings and errors: a top-k without a full sort."""
    return events.where(F.col("severity").isin("warn", "error")).orderBy(F.desc("event_id")).limit(n)


def timeline(events: DataFrame) -> DataFrame:
    """Spans of each run with the gap to the one before in order of time and event; a run may be of any length."""
    found = lagged(spans(events), ["run_id"], ["time_ns", "event_id"], {"_before": "time_ns"})
    return found.withColumn("gap_ns", F.col("time_ns") - F.col("_before")).drop("_before")


def events_per_run(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id").agg(F.count(F.lit(1)).alias("events"))


def span_children(events: DataFrame) -> DataFrame:
    """parent and child spans of the same run."""
    child = spans(events).alias("c")
    parent = spans(events).select("run_id", F.col("span_id").alias("parent_span_id"), F.col("event_id").alias("parent_event_id"), F.col("duration_ns").alias("parent_duration_ns"))
    return child.join(parent, ["run_id", "parent_span_id"])


def retained(runs: DataFrame, keep: int, current: str | None = None) -> DataFrame:
    """The newest `keep` runs by (started, arrival or id) descending; the current run counts and always stays.

    The rows are found by a top-k, so no task holds all runs."""
    tie = "row_id" if "row_id" in runs.columns else "run_id"
    others = runs if current is None else runs.where(F.col("run_id") != current)
    newest = others.orderBy(F.desc("started_unix_ns"), F.desc(tie)).limit(keep - (current is not None))
    return newest if current is None else newest.unionByName(runs.where(F.col("run_id") == current))


def cascade(children: DataFrame, kept_runs: DataFrame) -> DataFrame:
    """Child rows of runs that stay."""
    return children.join(kept_runs.select("run_id").distinct(), "run_id", "left_semi")


def orphans(children: DataFrame, runs: DataFrame) -> DataFrame:
    return children.join(runs.select("run_id"), "run_id", "left_anti")


def capped_events(events: DataFrame, cap: int) -> DataFrame:
    """The first `cap` events of each run by event_id."""
    return row_positions(events, ["run_id"], ["event_id"], "n").where(F.col("n") <= cap).drop("n")


def cap_counts(events: DataFrame, cap: int) -> DataFrame:
    """run_id, accepted and dropped under the cap: counts alone, nothing is ordered."""
    counts = events.groupBy("run_id").agg(F.count(F.lit(1)).alias("emitted"))
    return counts.select("run_id", F.least("emitted", F.lit(cap)).cast("long").alias("accepted"), F.greatest(F.col("emitted") - cap, F.lit(0)).cast("long").alias("dropped"))


def recovered(runs: DataFrame) -> DataFrame:
    """Runs that a crash left running are interrupted."""
    return runs.withColumn("status", F.when(F.col("status") == "running", F.lit("interrupted")).otherwise(F.col("status")))


def matching(df: DataFrame, column: str, like: str) -> DataFrame:
    return df.where(F.col(column).like(like))


def final_metrics(events: DataFrame) -> DataFrame:
    """worker (null: all workers), count, total and largest duration, errors: one rollup."""
    out = events.rollup("worker").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("bytes").alias("bytes"), F.max("duration_ms").alias("max_ms"), F.count_if(F.col("severity") == "error").alias("errors"), F.grouping("worker").alias("g"),
    )
    return out.withColumn("scope", F.when(F.col("g") == 1, F.lit("all")).otherwise(F.concat(F.lit("worker."), F.col("worker").cast("string")))).drop("g", "worker")


def as_metrics(totals: DataFrame) -> DataFrame:
    """final_metrics as (name, value) rows."""
    return totals.select("scope", F.expr("stack(4, 'tasks', cast(tasks as double), 'bytes', cast(bytes as double), 'max_ms', max_ms, 'errors', cast(errors as double)) as (metric, value)")).select(
        F.concat_ws(".", "scope", "metric").alias("name"), "value"
    )


#: Measures that add up over workers and names, and their units; the others are derived or extremes.
ADDITIVE = {"tasks": "count", "logs": "count", "spans": "count", "errors": "count", "infos": "count", "bytes": "bytes", "total_ms": "ms", "empty_tasks": "count", "large_tasks": "count", "over_second": "count"}
DERIVED = {"max_ms": "ms", "min_ms": "ms", "mean_ms": "ms", "max_bytes": "bytes", "mean_bytes": "bytes", "mib_s": "MiB/s", "error_share": "share", "first_ns": "ns", "last_ns": "ns", "elapsed_ns": "ns"}


def measures(events: DataFrame) -> DataFrame:
    """worker, name (null: over all of them) and every measure: grouping sets over one pass, a row for each worker, each
    name, each worker's name and the whole."""
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    sums = [
        F.count(F.lit(1)).alias("tasks"), is_("type", "log").alias("logs"), is_("type", "span").alias("spans"), is_("severity", "error").alias("errors"), is_("severity", "info").alias("infos"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.sum("duration_ms"), F.lit(0.0)).alias("total_ms"), F.count_if(F.col("bytes") == 0).alias("empty_tasks"),
        F.count_if(F.col("bytes") >= 65536).alias("large_tasks"), F.count_if(F.col("duration_ms") >= 1000).alias("over_second"),
        F.max("duration_ms").alias("max_ms"), F.min("duration_ms").alias("min_ms"), F.max("bytes").alias("max_bytes"), F.min("time_ns").alias("first_ns"), F.max("time_ns").alias("last_ns"),
        F.grouping("worker").alias("all_workers"), F.grouping("name").alias("all_names"),
    ]
    w, n = F.col("worker"), F.col("name")
    rows = events.groupingSets([[], [w], [n], [w, n]], w, n).agg(*sums)
    rate = F.when(F.col("total_ms") > 0, F.col("bytes") / 1048576.0 / (F.col("total_ms") / 1000.0))
    return rows.withColumns({"mean_ms": F.col("total_ms") / F.col("tasks"), "mean_bytes": F.col("bytes") / F.col("tasks"), "mib_s": rate, "error_share": F.col("errors") / F.col("tasks"), "elapsed_ns": F.col("last_ns") - F.col("first_ns")})


def metric_rows(found: DataFrame) -> DataFrame:
    """measures as (name, value, unit): all.tasks, worker.3.tasks, name.click.tasks, worker.3.name.click.tasks and so on."""
    worker = F.when(F.col("all_workers") == 0, F.concat(F.lit("worker."), F.coalesce(F.col("worker").cast("string"), F.lit("null"))))
    name = F.when(F.col("all_names") == 0, F.concat(F.lit("name."), F.coalesce("name", F.lit("null"))))
    scope = F.when((F.col("all_workers") == 1) & (F.col("all_names") == 1), F.lit("all")).otherwise(F.concat_ws(".", worker, name))
    units = ADDITIVE | DERIVED
    parts = F.array(*(F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("value"), F.lit(u).alias("unit")) for m, u in units.items()))
    return found.select(scope.alias("scope"), F.explode(parts).alias("x")).select(F.concat_ws(".", "scope", "x.m").alias("name"), "x.value", "x.unit")


def inconsistent_measures(found: DataFrame) -> DataFrame:
    """measure, side: additive measures whose sum over workers, names or both is not the whole's (times to 1 part in
    10^9). Empty when all agree."""
    kinds = {"all": (1, 1), "workers": (0, 1), "names": (1, 0), "both": (0, 0)}
    at = lambda kind: (F.col("all_workers") == kinds[kind][0]) & (F.col("all_names") == kinds[kind][1])
    sums = found.agg(*(F.sum(F.when(at(kind), F.col(m).cast("double"))).alias(f"{kind}_{m}") for kind in kinds for m in ADDITIVE))
    rows = [F.struct(F.lit(m).alias("measure"), F.lit(kind).alias("side"), (F.abs(F.col(f"{kind}_{m}") - F.col(f"all_{m}")) <= F.abs(F.col(f"all_{m}")) * 1e-9).alias("same")) for kind in kinds if kind != "all" for m in ADDITIVE]
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("not same").drop("same")


def totals_check(totals: DataFrame) -> DataFrame:
    """One row: the workers' sums beside the global ones, and whether all of them agree."""
    sums = [F.sum(F.when(F.col("scope") == "all", F.col(c))).alias(f"all_{c}") for c in ("tasks", "bytes", "errors")]
    sums += [F.sum(F.when(F.col("scope") != "all", F.col(c))).alias(f"worker_{c}") for c in ("tasks", "bytes", "errors")]
    same = F.lit(True)
    for c in ("tasks", "bytes", "errors"):
        same = same & F.col(f"all_{c}").eqNullSafe(F.col(f"worker_{c}"))
    return totals.agg(*sums).withColumn("consistent", same)


def inconsistent_totals(totals: DataFrame) -> DataFrame:
    """Empty if the workers' sums equal the global ones."""
    parts = totals.where("scope <> 'all'").agg(F.sum("tasks").alias("tasks"), F.sum("bytes").alias("bytes"), F.sum("errors").alias("errors"))
    return totals.where("scope = 'all'").select("tasks", "bytes", "errors").exceptAll(parts)


def last_per_name(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """INSERT OR REPLACE: the last value of each key."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("x")).select(*keys, "x.*")


def sampled(tasks: DataFrame, every: int = 64) -> DataFrame:
    """Every `every`-th task of each worker by event_id."""
    return row_positions(tasks, ["worker"], ["event_id"], "turn").where(F.col("turn") % every == 0)


def finished(runs: DataFrame, run_id: str, status: str, ended_unix_ns: int, error: str | None = None) -> DataFrame:
    """The run table with the terminal record of one run, which does not pass the event queue."""
    mine = F.col("run_id") == run_id
    return runs.withColumns({"status": F.when(mine, F.lit(status)).otherwise(F.col("status")), "ended_unix_ns": F.when(mine, F.lit(ended_unix_ns)).otherwise(F.col("ended_unix_ns")), "error": F.when(mine, F.lit(error)).otherwise(F.col("error"))})


def tail(rows: DataFrame, skip: int, order: list) -> DataFrame:
    """All rows behind the first `skip` in order: an anti join with a top-k, where OFFSET would sort everything into one task."""
    first = rows.orderBy(*order).limit(skip)
    return rows.join(first.select("run_id"), "run_id", "left_anti")


def profile_snapshot(events: DataFrame) -> DataFrame:
    """Sums over all workers a name."""
    return events.groupBy("name").agg(F.count_distinct("worker").alias("workers"), F.count(F.lit(1)).alias("tasks"), F.sum("bytes").alias("bytes"))
