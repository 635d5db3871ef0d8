"""Summaries for people, from one row of counters."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from twinspark.functions.scalars import human_bytes, human_duration, throughput_mib

SECTIONS = {"files": ("scanned", "hashed", "cached", "unique_files"), "duplicates": ("groups", "matches"), "bytes": ("scanned_bytes", "cached_bytes", "matched_bytes")}
BOLD, PLAIN = "\033[1m", "\033[0m"  # fixed values: terminal codes


def pretty(spark: SparkSession, counters: dict, seconds: float, color: bool = False) -> str:
    """Sections of counters, bytes in units, the elapsed time and the throughput."""
    units = {k: human_bytes(F.lit(counters[k])) for k in SECTIONS["bytes"] if k in counters}
    row = spark.range(1).select(*(v.alias(k) for k, v in units.items()), human_duration(F.lit(seconds * 1000.0)).alias("elapsed"), throughput_mib(F.lit(counters.get("scanned_bytes", 0)), F.lit(float(seconds))).alias("rate")).first()
    lines = []
    for name, keys in SECTIONS.items():
        lines.append(f"{BOLD}{name}{PLAIN}" if color else name)
        lines += [f"  {k}: {row[k] if k in units else counters[k]}" for k in keys if k in counters]
    return "\n".join([*lines, f"elapsed: {row.elapsed}, {row.rate:.2f} MiB/s"])
