"""Positions and running sums inside ordered groups of any size.

A window function would bring a whole group into one task. Here rows are range-partitioned by group and order, so a hot
group spreads over many tasks; each part counts from its own start, and the parts' totals, one row for each part and group
in it, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from twinspark.storage import lookup, materialized

_LOW_BITS = (1 << 33) - 1  # monotonically_increasing_id counts rows of a partition in these


def in_parts(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df sorted by keys and order over range partitions, with `_part` and the place in it, `_at`; a stored table."""
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    return materialized(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW_BITS))))


def _before(parts: DataFrame, keys: list[str], value, start) -> DataFrame:
    """keys, _part, _start (the group's first place there) and _before, what earlier parts of the group hold."""
    totals = parts.groupBy(*keys, "_part").agg(start.alias("_start"), value.alias("_total"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn("_before", F.coalesce(F.sum("_total").over(w), F.lit(0))).drop("_total")


def row_positions(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """df with `name`: the row's number in its group, from 1. order must be unique inside a group; keys are not null."""
    parts = in_parts(df, keys, order)
    offsets = _before(parts, keys, F.count(F.lit(1)), F.min("_at"))
    out = parts.join(lookup(offsets), [*keys, "_part"]).withColumn(name, F.col("_at") - F.col("_start") + 1 + F.col("_before"))
    return out.select(*df.columns, name)


#: How the parts of a running value come together, and what it is called here.
_RUNNING = {"sum": (F.sum, lambda own, before: own + F.coalesce(before, F.lit(0))), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, str]]) -> DataFrame:
    """df with, for each name of values, the (sum, min or max) of (a column) over the group's rows up to this one."""
    parts = in_parts(df, keys, order)
    totals = parts.groupBy(*keys, "_part").agg(*(_RUNNING[how][0](column).alias(f"_t{i}") for i, (how, column) in enumerate(values.values())))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_part", *(_RUNNING[how][0](f"_t{i}").over(earlier).alias(f"_b{i}") for i, (how, _) in enumerate(values.values())))
    here = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    own = parts.select("*", *(_RUNNING[how][0](column).over(here).alias(f"_o{i}") for i, (how, column) in enumerate(values.values())))
    made = [_RUNNING[how][1](F.col(f"_o{i}"), F.col(f"_b{i}")).alias(name) for i, (name, (how, _)) in enumerate(values.items())]
    return own.join(lookup(before), [*keys, "_part"]).select(*(c for c in df.columns if c not in values), *made)


def running_sums(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with `name`: the sum of `value` over the group's rows up to this one."""
    return running(df, keys, order, {name: ("sum", value)}).select(*df.columns, name)


def lagged(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str]) -> DataFrame:
    """df with, for each name of values, a column of the row before in the group; null for the first. The last row of
    each part is carried to the next part that the group has."""
    parts = in_parts(df, keys, order)
    last = F.max_by(F.struct(*(F.col(c).alias(n) for n, c in values.items())), "_at").alias("_last")
    ends = parts.groupBy(*keys, "_part").agg(last)
    earlier = Window.partitionBy(*keys).orderBy("_part")
    before = ends.select(*keys, "_part", F.lag("_last").over(earlier).alias("_before"))
    here = Window.partitionBy("_part", *keys).orderBy("_at")
    first = F.row_number().over(here) == 1
    own = parts.select("*", first.alias("_first"), *(F.lag(c).over(here).alias(f"_l_{n}") for n, c in values.items()))
    made = [F.when(F.col("_first"), F.col(f"_before.{n}")).otherwise(F.col(f"_l_{n}")).alias(n) for n in values]
    return own.join(lookup(before), [*keys, "_part"]).select(*df.columns, *made)
