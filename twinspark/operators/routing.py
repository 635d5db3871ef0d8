"""Backend choice as a query: sizes, policies, exploration turns and predicted costs decide in this order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspark.functions.scalars import size_band
from twinspark.operators.ordered import row_positions, running_sums

BACKENDS = ("cpu", "cuda", "igpu")
LARGE_BYTES = 64 << 20
EXPLORE_EVERY = 64
MOST_PROBES = 2
CPU_FACTOR = 0.95
CREDIT_SHARE = 0.05


def with_arrivals(tasks: DataFrame, order: str = "event_id") -> DataFrame:
    """arrival: how many tasks of the same worker and size band came before."""
    banded = tasks.withColumn("band", F.when(F.col("bytes") > 0, size_band(F.col("bytes"))).otherwise(F.lit(-1)))
    return row_positions(banded, ["worker", "band"], [order], "arrival").withColumn("arrival", F.col("arrival") - 1)


def _rotating(arrival: Column, available: dict[str, Column]) -> Column:
    """The first available backend from this turn's start on."""
    start = F.floor(arrival / EXPLORE_EVERY).cast("int") % 3
    order = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: (start + i) % 3)
    slots = F.array(*(F.when(available[b], F.lit(b)) for b in BACKENDS))
    return F.element_at(F.filter(F.transform(order, lambda i: F.get(slots, i)), lambda b: b.isNotNull()), 1)


def choose_backend(tasks: DataFrame, policy: str = "automatic", learning: bool = True, floor_bytes: int = 4096, large_bytes: int = LARGE_BYTES) -> DataFrame:
    """tasks with backend and reason.

    tasks: bytes, arrival, and for each backend b: b_available, b_known (a prediction inside its domain), b_ms, b_error,
    b_probes."""
    col = F.col
    available = {b: col(f"{b}_available") for b in BACKENDS}
    known = {b: available[b] & col(f"{b}_known") for b in BACKENDS}
    choice = lambda b, r: F.struct(b.alias("backend"), F.lit(r).alias("reason"))
    large = col("bytes") >= large_bytes
    preferred = F.when(large & available["cuda"], F.lit("cuda")).when(large & available["igpu"], F.lit("igpu")).otherwise(F.lit("cpu"))
    out = F.when((col("bytes") == 0) | (col("bytes") < floor_bytes), choice(F.lit("cpu"), "size"))
    if policy != "automatic":
        return tasks.withColumn("x", out.otherwise(choice(F.when(available[policy], F.lit(policy)).otherwise(F.lit("cpu")), "fixed"))).select("*", "x.backend", "x.reason").drop("x")
    if not learning:
        return tasks.withColumn("x", out.otherwise(choice(preferred, "fixed"))).select("*", "x.backend", "x.reason").drop("x")
    turn = _rotating(col("arrival"), available)
    out = out.when((col("arrival") > 0) & (col("arrival") % EXPLORE_EVERY == 0) & turn.isNotNull(), choice(turn, "explore"))

    def probe(order: tuple[str, ...]) -> Column:
        """The backend without a usable prediction that was probed the least, the first of equals in order."""
        slots = F.array_compact(F.array(*(F.when(available[b] & ~known[b] & (col(f"{b}_probes") < MOST_PROBES), F.struct(col(f"{b}_probes").cast("int").alias("n"), F.lit(i).alias("i"), F.lit(b).alias("b"))) for i, b in enumerate(order))))
        return F.try_element_at(F.array_sort(slots), F.lit(1))["b"]

    wanted = F.when(large, probe(("cuda", "cpu", "igpu"))).otherwise(probe(("cpu", "cuda", "igpu")))
    out = out.when(wanted.isNotNull(), choice(wanted, "explore"))
    score = {b: F.when(known[b], CPU_FACTOR * col("cpu_ms") - col("cpu_error") if b == "cpu" else col(f"{b}_ms") + col(f"{b}_error")) for b in BACKENDS}
    scored = F.array_sort(F.array_compact(F.array(*(F.when(score[b].isNotNull(), F.struct(score[b].alias("s"), F.lit(i).alias("i"), F.lit(b).alias("b"))) for i, b in enumerate(BACKENDS)))))
    best = F.try_element_at(scored, F.lit(1))["b"]
    out = out.when(best.isNotNull(), choice(best, "model")).otherwise(choice(preferred, "fixed"))
    return tasks.withColumn("x", out).select("*", "x.backend", "x.reason").drop("x")


def classify_hash(size: Column, floor: int, block: int, evidence: dict) -> Column:
    """Static route: cpu_only under the floor; gpu_preferred where calibration covers the shape and shows a win."""
    stream = (size >= 64 << 20) & (F.floor(size / max(block, 1)) >= 4)
    complete = F.lit(bool(evidence.get("calibration_complete"))) | F.when(stream, F.lit(bool(evidence.get("stream_complete")))).otherwise(F.lit(bool(evidence.get("block_complete"))))
    wins = complete & F.when(stream, F.lit(bool(evidence.get("stream_gpu_preferred")))).otherwise(F.lit(bool(evidence.get("block_gpu_preferred"))))
    failed = F.lit(evidence.get("decision") == "failed" or not block)
    return F.when((size < floor) | (size == 0), F.lit("cpu_only")).when(failed, F.lit("cpu_preferred")).when(wins & (size >= block), F.lit("gpu_preferred")).otherwise(F.lit("cpu_preferred"))


def cold_credit(tasks: DataFrame, workers: int, order: str = "event_id", keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Running credit of each run: a share of the CPU time of its tasks so far, over the workers."""
    return running_sums(tasks.withColumn("_share", F.col("cpu_ms") * CREDIT_SHARE / workers), list(keys), [order], "_share", "credit_ms").drop("_share")


def admitted(credited: DataFrame) -> DataFrame:
    return credited.withColumn("admitted", (F.col("estimate_ms") == 0) | (F.col("credit_ms") - F.col("spent_ms") >= F.col("estimate_ms")))


def small_route(size: Column, gpu_min: int, floor: int) -> Column:
    return size < max(gpu_min, floor)
