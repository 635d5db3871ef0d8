"""Statistics of paired benchmark trials."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.operators import selection
from twinspark.operators.ordered import row_positions
from twinspark.storage import lookup, materialized, ship

RESAMPLES, GATE, LEAST_TRIALS = 10_000, 1.02, 7
#: Pairs that are drawn from together; a power of two.
DRAWN = 1024
#: Draws that are summed at once, blocks that a task walks through, and tasks that smaller tables are dealt to.
AT_ONCE, BLOCKS, TASKS = 1 << 16, 64, 96


def medians(trials: DataFrame, keys: list[str], value: str, trial: str, expected: list[int]) -> DataFrame:
    """count, median, min, max a key, and whether exactly the expected trials are there. keys are not null."""
    once = F.count(F.lit(1)) == len(expected)
    for t in expected:
        once = once & (F.count_if(F.col(trial) == t) == 1)
    rest = trials.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), once.alias("complete"))
    return rest.join(selection.medians(trials, keys, {"median": value}), keys).select(*keys, "n", "median", "low", "high", "complete")


def paired(trials: DataFrame, keys: list[str], trial: str, arm: str, value: str, treatment: str, control: str) -> DataFrame:
    """keys, trial, treated, untreated, ratio, delta of trials that have both arms."""
    one = lambda name: F.max(F.when(F.col(arm) == name, F.col(value)))
    rows = trials.groupBy(*keys, trial).agg(one(treatment).alias("treated"), one(control).alias("untreated")).where("treated is not null and untreated is not null")
    return rows.withColumn("ratio", F.col("treated") / F.col("untreated")).withColumn("delta", F.col("treated") - F.col("untreated"))


def paired_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    means = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.avg("ratio").alias("mean_ratio"), F.avg("delta").alias("mean_delta"))
    middle = selection.medians(pairs, keys, {"median_ratio": "ratio", "median_delta": "delta"})
    return means.join(middle, keys).select(*keys, "pairs", "mean_ratio", "median_ratio", "mean_delta", "median_delta")


def draws_of_block(n: int, block: int, resamples: int, seed: int) -> np.ndarray:
    """How many of each resample's n draws from n pairs fall to one block of DRAWN pairs (the last may be shorter).

    A range of blocks is halved again and again; how many of its draws go left is a binomial draw by a generator of that
    range, which is the same for whoever asks, so all blocks agree and each walks down to its own."""
    held, low, high = np.full(resamples, n), 0, -(-n // DRAWN)
    while high - low > 1:
        middle = (low + high) // 2
        size, left = min(n, high * DRAWN) - low * DRAWN, (middle - low) * DRAWN
        to_left = np.random.default_rng([seed, low, high]).binomial(held, left / size)
        held, low, high = (to_left, low, middle) if block < middle else (held - to_left, middle, high)
    return held


def bootstrap_upper(pairs: DataFrame, keys: list[str], seed: int = 1, resamples: int = RESAMPLES) -> DataFrame:
    """keys, pairs, upper (one-sided 95 % bound of the mean ratio over `resamples` draws with replacement), gate.

    A group may have any number of pairs. They are numbered in the order of their ratios and drawn from in blocks of
    DRAWN; generators go by block and range of blocks, see draws_of_block, so the result depends on the pairs and the
    seed alone and not on how rows lie in partitions. Each block gives `resamples` sums, which meet in each task before
    they are shuffled. A block is 8 KB but millions of draws, so tasks are dealt by number of blocks; adaptive execution
    would merge them by size. keys are not null."""
    spark = pairs.sparkSession
    ship(spark)
    rows = row_positions(pairs.select(*keys, "ratio").where("ratio is not null"), keys, ["ratio"], "_rank").withColumn("_block", F.expr(f"(_rank - 1) div {DRAWN}"))
    rows = materialized(rows.select(*keys, "ratio", "_block"))
    sizes = lookup(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs")))
    blocks = sizes.agg(F.sum(F.ceil(F.col("pairs") / DRAWN))).first()[0] or 1
    tasks = min(blocks, max(TASKS, blocks // BLOCKS))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        block, ratios = int(key[-1]), np.sort(frame["ratio"].to_numpy())
        share, own, sums = draws_of_block(int(frame["pairs"].iloc[0]), block, resamples, seed), np.random.default_rng([seed, block]), np.zeros(resamples)
        most = max(1, AT_ONCE // len(ratios))
        for at in range(0, resamples, most):
            part = share[at : at + most]
            drawn, some = ratios.take(own.integers(0, len(ratios), int(part.sum()))), np.flatnonzero(part)
            if len(some):
                sums[at + some] = np.add.reduceat(drawn, (np.cumsum(part) - part)[some])
        return pd.DataFrame({**dict(zip(keys, key, strict=False)), "resample": np.arange(resamples), "total": sums})

    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    drawn = rows.join(sizes, keys).repartition(tasks, *keys, "_block").groupBy(*keys, "_block").applyInPandas(run, f"{kinds}, resample int, total double")
    means = drawn.groupBy(*keys, "resample").agg(F.sum("total").alias("total")).join(sizes, keys).withColumn("mean", F.col("total") / F.col("pairs"))
    found = means.groupBy(*keys, "pairs").agg(F.sort_array(F.collect_list("mean"))[int(0.95 * (resamples - 1))].alias("upper"))  # `resamples` numbers a group
    gate = F.when(F.col("pairs") < LEAST_TRIALS, "insufficient_trials").when(F.col("upper") <= GATE, "pass").otherwise("not_demonstrated")
    return found.select(*keys, "pairs", "upper", gate.alias("gate"))


def stable_win(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the treatment wins every pair by a fifth and its worst beats the control's best by a fifth."""
    return pairs.groupBy(*keys).agg((F.bool_and(F.col("treated") <= 0.8 * F.col("untreated")) & (F.max("treated") <= 0.8 * F.min("untreated"))).alias("stable_win"))
