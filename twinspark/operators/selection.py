"""Exact order statistics of groups of any size.

Built-in medians keep all values of a group in one task. Here a large group's values are counted by the bits of their
order instead, sixteen at a time: a histogram of at most 65,536 rows a group tells in which of its cells the wanted rank
lies, and the next round looks at that cell alone. Four rounds of partial aggregation find any value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from twinspark.storage import materialized, ship

#: Groups of up to this many rows take the built-in function, which holds their values (some 20 MB).
SMALL = 200_000
DIGIT = 16


@F.arrow_udf(LongType())
def _ordered(values: pa.Array) -> pa.Array:
    """Long integers in the order of the doubles: negative ones count down. Both zeros are one, NaN comes last."""
    raw = values.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0
    raw = np.where(np.isnan(raw), np.nan, raw)
    bits = np.ascontiguousarray(raw).view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits), mask=values.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(DoubleType())
def _double(bits: pa.Array) -> pa.Array:
    raw = bits.to_numpy(zero_copy_only=False)
    return pa.array(np.ascontiguousarray(np.where(raw < 0, raw ^ np.int64(0x7FFFFFFFFFFFFFFF), raw)).view(np.float64))


def ranked_values(rows: DataFrame, keys: list[str], value: str, wanted: DataFrame) -> DataFrame:
    """keys, rank, value: the values at the ranks (from 1, nulls are not counted) that wanted asks for by key. A rank
    beyond a group's size gives no row. Keys are not null."""
    ship(rows.sparkSession)
    bits = materialized(rows.where(F.col(value).isNotNull()).join(wanted.select(*keys).distinct(), keys, "left_semi").select(*keys, _ordered(F.col(value).cast("double")).alias("_bits")))
    state = materialized(wanted.select(*keys, "rank").distinct().withColumn("_left", F.col("rank")).withColumn("_high", F.lit(0).cast("long")))
    for shift in (3 * DIGIT, 2 * DIGIT, DIGIT, 0):
        top = shift == 3 * DIGIT
        high = F.lit(0).cast("long") if top else F.shiftright("_bits", shift + DIGIT)
        digit = F.shiftright("_bits", shift) if top else F.shiftright("_bits", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        cells = bits.select(*keys, high.alias("_high"), digit.alias("_digit"))
        if not top:
            cells = cells.join(state.select(*keys, "_high").distinct(), [*keys, "_high"], "left_semi")
        counts = cells.groupBy(*keys, "_high", "_digit").agg(F.count(F.lit(1)).alias("_n"))
        before = F.sum("_n").over(Window.partitionBy(*keys, "_high").orderBy("_digit").rowsBetween(Window.unboundedPreceding, -1))
        counts = materialized(counts.withColumn("_before", F.coalesce(before, F.lit(0))))
        found = state.join(counts, [*keys, "_high"]).where("_left > _before and _left <= _before + _n")
        deeper = F.col("_digit") if top else F.col("_high") * (1 << DIGIT) + F.col("_digit")
        state = materialized(found.select(*keys, "rank", (F.col("_left") - F.col("_before")).alias("_left"), deeper.alias("_high")))
    return state.select(*keys, "rank", _double("_high").alias("value"))


def medians(rows: DataFrame, keys: list[str], values: dict[str, str], small: int = SMALL) -> DataFrame:
    """keys and, for each name of values, the median of a column: the mean of the two middle values where their number is
    even, null without any. Groups of up to `small` rows are aggregated at once, larger ones by ranked_values."""
    counts = materialized(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *(F.count(c).alias(f"_n_{n}") for n, c in values.items())))
    large = counts.where(F.col("_rows") > small)
    plain = lambda df: df.groupBy(*keys).agg(*(F.median(c).alias(n) for n, c in values.items()))
    if large.isEmpty():
        return plain(rows)
    out = large.select(*keys)
    for name, column in values.items():
        n = F.col(f"_n_{name}")
        middle: list[Column] = [((n + 1) / 2).cast("long"), ((n + 2) / 2).cast("long")]
        wanted = large.where(n > 0).select(*keys, F.explode(F.array(*middle)).alias("rank"))
        found = ranked_values(rows, keys, column, wanted).groupBy(*keys).agg(F.when(F.min("value") == F.max("value"), F.min("value")).otherwise(F.min("value") * 0.5 + F.max("value") * 0.5).alias(name))
        out = out.join(found, keys, "left")
    return plain(rows.join(large.select(*keys), keys, "left_anti")).unionByName(out)
