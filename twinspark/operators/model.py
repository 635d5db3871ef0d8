"""The cost model: banded moving averages, and a ridge regression from mergeable sufficient statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from twinspark.functions.scalars import bucket_range, features, latency_bucket, size_band, valid_observation
from twinspark.operators.cache import fail_if_any
from twinspark.operators.ordered import in_parts, row_positions, running
from twinspark.storage import lookup, materialized, ship

ALPHA = 0.125
RIDGE = 1e-8
MOMENTS = [*(f"xtx{i}{j}" for i in range(4) for j in range(i, 4)), *(f"xty{i}" for i in range(4)), "yty", "weight"]


def latency_histogram(ms: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    return ms.groupBy(*keys, latency_bucket(F.col(value)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def histogram_quantiles(histogram: DataFrame, percents: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """Nearest rank in integers: the first bucket whose cumulative count reaches ceil(n p / 100). A histogram has at most 32 rows."""
    running = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    rows = histogram.withColumn("cum", F.sum("n").over(running)).withColumn("total", F.sum("n").over(whole))
    rows = rows.withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    rank = F.expr("total div 100 * percent + (total % 100 * percent + 99) div 100")
    first = rows.where(F.col("cum") >= rank).groupBy(*keys, "percent").agg(F.min("bucket").alias("bucket"))
    return first.withColumn("range_us", bucket_range(F.col("bucket")))


def _folds(frames: Iterator[pd.DataFrame], keys: list[str], errors: bool) -> Iterator[pd.DataFrame]:
    """One row for each group in a sorted part: keys, samples, and what the part adds to a moving average that begins
    with zero. errors: of the residuals, for which the rows carry the cost before the part (null: there is none)."""
    group, cost, total, n = None, None, 0.0, 0

    def row() -> pd.DataFrame:
        return pd.DataFrame([(*group, n, total)], columns=[*keys, "samples", "added"])

    def smoothed(start: float, values: np.ndarray) -> np.ndarray:
        return pd.Series(np.append(start, values)).ewm(alpha=ALPHA, adjust=False).mean().to_numpy()

    for frame in frames:
        marks = frame[keys].ne(frame[keys].shift()).any(axis=1).to_numpy()
        starts = np.flatnonzero(marks) if len(frame) else []
        for a, b in zip(starts, [*starts[1:], len(frame)], strict=True):
            one = frame.iloc[a:b]
            key = tuple(one.iloc[0][keys])
            if key != group:
                if n:
                    yield row()
                group, total, n = key, 0.0, 0
                cost = one["cost"].iloc[0] if errors and not pd.isna(one["cost"].iloc[0]) else None
            values = one["x"].to_numpy()
            if errors:
                if cost is None:  # the first observation of all sets the cost and has no error
                    before, cost = np.append(values[0], smoothed(values[0], values[1:])[:-1]), None
                    after = smoothed(values[0], values[1:])
                else:
                    after = smoothed(cost, values)
                    before = after[:-1]
                cost, values = float(after[-1]), np.abs(one["ms"].to_numpy() - before * one["bytes"].to_numpy()) / one["bytes"].to_numpy()
            total, n = float(smoothed(total, values)[-1]), n + len(values)
    if n:
        yield row()


def band_model(observations: DataFrame, order: str, keys: tuple[str, ...] = ("backend",), seed: DataFrame | None = None) -> DataFrame:
    """keys, band, cost and error in ms a byte, samples: the state after all valid observations (bytes, ms) in order.

    The first observation sets the cost; the error is smoothed from the second one on, with the cost before it. seed: an
    earlier state (the same columns) that the observations follow; its bands without new ones stay. A moving average
    maps the value before some rows to the one behind by a factor and a sum, so range partitions in order are folded on
    their own, and one row a group and part carries the value through; no group meets in one task. order must tell the
    rows of a group apart; keys are not null."""
    spark = observations.sparkSession
    ship(spark)
    group = [*keys, "band"]
    ok = observations.where(valid_observation(F.col("bytes"), F.col("ms"))).withColumn("band", size_band(F.col("bytes")))
    ok = ok.select(*group, F.col(order).alias("_order"), F.col("bytes").cast("double").alias("bytes"), F.col("ms").cast("double").alias("ms")).withColumn("x", F.col("ms") / F.col("bytes"))
    parts = in_parts(ok, group, ["_order"]).drop("_at")
    whole = [*group, "_part"]
    kind = ", ".join(f"{c} {parts.schema[c].dataType.simpleString()}" for c in whole) + ", samples long, added double"
    given = seed.select(*group, F.col("cost").alias("seed_cost"), F.col("error").alias("seed_error"), F.col("samples").alias("seed_samples")) if seed is not None else None
    keep = F.lit(1 - ALPHA)

    def carried(sums: DataFrame, start: Column, first: Column) -> DataFrame:
        """sums with the value before each part: one row a group and part, so the window stays small."""
        steps = F.collect_list(F.struct("samples", "added")).over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        return sums.withColumn("before", F.aggregate(steps, start, lambda v, s: F.when(v.isNull(), first).otherwise(v * F.pow(keep, s["samples"])) + s["added"]))

    # Costs: in the group's first part without a seed the first observation is the value before, so it counts as one.
    sums = materialized(parts.mapInPandas(lambda frames: _folds(frames, whole, False), kind))
    opening = parts.groupBy(*group).agg(F.min_by("x", "_order").alias("opening"))
    sums = sums.join(opening, group) if given is None else sums.join(opening, group).join(given, group, "left")
    seeded = F.col("seed_cost") if given is not None else F.lit(None).cast("double")
    costs = carried(sums, F.coalesce(seeded, F.col("opening")), F.lit(0.0))
    last = costs.groupBy(*group).agg(F.max_by(F.col("before") * F.pow(keep, F.col("samples")) + F.col("added"), "_part").alias("cost"), F.sum("samples").alias("samples"))

    # Errors, with each part's cost before it; none where the group begins.
    begins = F.row_number().over(Window.partitionBy(*group).orderBy("_part")) == 1
    before = costs.withColumn("cost", F.when(begins, seeded).otherwise(F.col("before"))).select(*whole, "cost")
    rows = parts.join(before, whole).repartition(*whole).sortWithinPartitions(*whole, "_order")
    errors = rows.mapInPandas(lambda frames: _folds(frames, whole, True), kind)
    errors = errors if given is None else errors.join(given, group, "left")
    seeded_error = F.coalesce(F.col("seed_error"), F.lit(0.0)) if given is not None else F.lit(0.0)
    ends = carried(errors, seeded_error, F.lit(0.0))
    error = ends.groupBy(*group).agg(F.max_by(F.col("before") * F.pow(keep, F.col("samples")) + F.col("added"), "_part").alias("error"))
    found = last.join(error, group)
    if given is None:
        return found.select(*group, "cost", "error", "samples")
    both = found.join(given, group, "full_outer")
    return both.select(*group, F.coalesce("cost", "seed_cost").alias("cost"), F.coalesce("error", "seed_error").alias("error"), (F.coalesce("samples", F.lit(0)) + F.coalesce("seed_samples", F.lit(0))).alias("samples"))


def with_seeds(state: DataFrame, measured: DataFrame, keys: tuple[str, ...] = ("backend",)) -> DataFrame:
    """state with a cost, and no sample, for each band that it does not know and that measured (keys, bytes, ms) has one
    valid row for; of several rows the one with the fewest bytes. band_model takes it as its seed."""
    ok = measured.where(valid_observation(F.col("bytes"), F.col("ms"))).withColumn("band", size_band(F.col("bytes")))
    one = ok.groupBy(*keys, "band").agg(F.min_by(F.col("ms") / F.col("bytes"), F.struct("bytes", "ms")).alias("cost"))
    new = one.join(state.select(*keys, "band"), [*keys, "band"], "left_anti")
    return state.unionByName(new.select(*keys, "band", "cost", F.lit(0.0).alias("error"), F.lit(0).cast("long").alias("samples")))


def predict_band(tasks: DataFrame, model: DataFrame, keys: tuple[str, ...] = ("backend",)) -> DataFrame:
    """tasks (keys, bytes) with predicted ms and error of their band; null where it is unknown."""
    rows = tasks.withColumn("band", size_band(F.col("bytes"))).join(lookup(model.select(*keys, "band", "cost", "error", "samples")), [*keys, "band"], "left")
    return rows.withColumn("predicted_ms", F.col("cost") * F.col("bytes")).withColumn("predicted_error_ms", F.col("error") * F.col("bytes")).drop("cost", "error")


def known_bands(model: DataFrame) -> DataFrame:
    return model.groupBy("backend").agg(F.count_if(F.col("samples") > 0).alias("known_bands"))


def valid_contexts(observations: DataFrame) -> DataFrame:
    """Valid observations (bytes, batch_bytes, contention, ms)."""
    x = features(F.col("bytes"), F.col("batch_bytes"), F.col("contention").cast("double"))
    return observations.withColumn("ms", F.col("ms").cast("double")).where(x.isNotNull() & (F.col("ms") > 0) & (F.col("ms") <= 1e9))


def with_features(observations: DataFrame) -> DataFrame:
    """Valid observations with x0..x3."""
    x = features(F.col("bytes"), F.col("batch_bytes"), F.col("contention").cast("double"))
    return valid_contexts(observations).select("*", *(x[i].alias(f"x{i}") for i in range(4)))


def _sums(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sufficient statistics of rows with x0..x3 and ms."""
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"xtx{i}{j}") for i in range(4) for j in range(i, 4)] + [F.sum(F.col(f"x{i}") * F.col("ms")).alias(f"xty{i}") for i in range(4)]
    spread = [f(f"x{i}").alias(f"{n}{i}") for n, f in (("min", F.min), ("max", F.max)) for i in range(4)]
    return rows.groupBy(*keys).agg(*sums, F.sum(F.col("ms") * F.col("ms")).alias("yty"), F.sum(F.lit(1.0)).alias("weight"), F.count(F.lit(1)).alias("samples"), *spread)


def moments(observations: DataFrame, keys: tuple[str, ...] = ("backend",)) -> DataFrame:
    """Sufficient statistics a key, one partial row a task: upper triangle of XtX, Xty, yty, weight, samples, min and max."""
    return _sums(with_features(observations), keys)


def decayed(parts: DataFrame, factor: Column | float) -> DataFrame:
    """Sums and weight scaled; samples and ranges stay."""
    factor = F.lit(factor) if isinstance(factor, float) else factor
    return parts.withColumns({c: F.col(c) * factor for c in MOMENTS})


def merged(parts: DataFrame, keys: tuple[str, ...] = ("backend",)) -> DataFrame:
    """The sum of states; parts without samples do not widen the ranges."""
    live = F.col("samples") > 0
    spread = [f(F.when(live, F.col(f"{n}{i}"))).alias(f"{n}{i}") for n, f in (("min", F.min), ("max", F.max)) for i in range(4)]
    return parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in MOMENTS), F.sum("samples").alias("samples"), *spread)


def materialized_model(ledger: DataFrame, keys: tuple[str, ...] = ("key", "backend")) -> DataFrame:
    """Each key's model: its sources' states scaled by their attenuation, summed."""
    return merged(decayed(ledger, F.col("attenuation")), keys)


def run_delta(ledger: DataFrame, delta: DataFrame, local: str, decay: float = 0.9) -> DataFrame:
    """The ledger after a run: every attenuation decays; the local part takes the run's statistics in, with attenuation 1
    and the next revision. delta: key, backend and moments of the run."""
    state = [*MOMENTS, "samples", *(f"{n}{i}" for n in ("min", "max") for i in range(4))]
    older = ledger.withColumn("attenuation", F.col("attenuation") * decay)
    mine = decayed(older.where(F.col("source") == local), F.col("attenuation")).select("key", "backend", "revision", *state)
    fresh = delta.select("key", "backend", F.lit(0).cast("long").alias("revision"), *state)
    both = mine.unionByName(fresh)
    revision = both.groupBy("key", "backend").agg((F.max("revision") + 1).alias("revision"))
    folded = merged(both, ("key", "backend")).join(revision, ["key", "backend"]).withColumn("source", F.lit(local)).withColumn("attenuation", F.lit(1.0))
    return older.where(F.col("source") != local).unionByName(folded.select(older.columns))


def _matrices(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """XtX (n, 4, 4) and Xty (n, 4) of all rows."""
    a = np.stack([frame[f"xtx{min(i, j)}{max(i, j)}"].to_numpy(float) for i in range(4) for j in range(4)], 1).reshape(-1, 4, 4)
    return a, np.stack([frame[f"xty{i}"].to_numpy(float) for i in range(4)], 1)


def _scaled(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The matrices on a diagonal of one with the ridge added, the scales, and which of them are positive definite."""
    scale = np.sqrt(np.maximum(np.diagonal(a, axis1=1, axis2=2), 1e-24))
    with np.errstate(all="ignore"):
        whole = a / (scale[:, :, None] * scale[:, None, :]) + RIDGE * np.eye(a.shape[1])
    finite = np.isfinite(whole).all((1, 2))
    whole[~finite] = -np.eye(a.shape[1])
    return whole, scale, finite & (np.linalg.eigvalsh(whole)[:, 0] > 0)


def solved(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(valid, beta (n, 4), residual): ridge solutions on the diagonally scaled normal equations, all rows at once."""
    a, b = _matrices(frame)
    weight, yty = frame["weight"].to_numpy(float), frame["yty"].to_numpy(float)
    whole, scale, valid = _scaled(a)
    whole[~valid] = np.eye(4)
    with np.errstate(all="ignore"):
        beta = np.linalg.solve(whole, (b / scale)[:, :, None])[:, :, 0] / scale
        sse = yty - 2 * np.einsum("ni,ni->n", beta, b) + np.einsum("ni,nij,nj->n", beta, a, beta)
        valid = valid & (weight > 0) & np.isfinite(beta).all(1) & np.isfinite(sse) & (sse >= -1e-6 * np.maximum(1.0, yty))
        return valid, beta, np.sqrt(np.maximum(0.0, sse) / np.where(weight > 0, weight, 1))


def fit(states: DataFrame, keys: tuple[str, ...] = ("backend",)) -> DataFrame:
    """keys, beta0..beta3, residual, samples, ranges: one 4 by 4 solution a state; invalid states give no row."""
    carried = [*keys, "samples", *(f"{n}{i}" for n in ("min", "max") for i in range(4))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            valid, beta, residual = solved(frame)
            out = frame[carried].assign(**{f"beta{i}": beta[:, i] for i in range(4)}, residual=residual)
            yield out[valid]

    ship(states.sparkSession)
    kinds = ", ".join(f"{c} {states.schema[c].dataType.simpleString()}" for c in carried)
    return states.mapInPandas(run, f"{kinds}, beta0 double, beta1 double, beta2 double, beta3 double, residual double")


def predict(contexts: DataFrame, fits: DataFrame, keys: tuple[str, ...] = ("backend",), stored: bool = False) -> DataFrame:
    """contexts with predicted_ms, residual and out_of_domain; null prediction where it is not positive and finite.

    fits (stored: as a table) has one row a key and joins by it, where the contexts lie if there are few."""
    rows = contexts.withColumn("x", features(F.col("bytes"), F.col("batch_bytes"), F.col("contention"))).join(lookup(fits, stored=stored), list(keys), "left")
    ms = sum((F.col(f"beta{i}") * F.col("x")[i] for i in range(1, 4)), F.col("beta0") * F.col("x")[0])
    outside = F.lit(False)
    for i in range(4):
        outside = outside | (F.col("x")[i] < F.col(f"min{i}")) | (F.col("x")[i] > F.col(f"max{i}"))
    return rows.select(*contexts.columns, F.when((ms > 0) & (ms <= 1e9), ms).alias("predicted_ms"), "residual", outside.alias("out_of_domain"))


#: A model is solved anew after each of its first FIRST observations, and after each EVERY-th.
FIRST, EVERY = 4, 16


def prequential(observations: DataFrame, order: list[str], keys: tuple[str, ...] = ("backend",), prior: DataFrame | None = None) -> DataFrame:
    """The valid observations with n (their number in the key's order) and the prediction that was made before each of
    them: predicted_ms (null where there was none), residual and out_of_domain, see predict.

    Observations between two solutions are summed first, and the running sums of these, a row for up to EVERY
    observations, are the states that are solved; each observation joins the last solution before it. A state that
    cannot be solved leaves the solution before it in place. prior: states (keys and moments) that count from the start
    and give the first solution. order tells the rows of a key apart; keys are not null."""
    ship(observations.sparkSession)
    stop, last = f"if(n <= {FIRST}, n, (n + {EVERY - 1}) div {EVERY} * {EVERY})", f"if(n <= {EVERY}, least(n - 1, {FIRST}L), (n - 1) div {EVERY} * {EVERY})"
    placed = row_positions(valid_contexts(observations), list(keys), order, "n")  # a stored table and a narrow step
    state = [*MOMENTS, "samples", *(f"{n}{i}" for n in ("min", "max") for i in range(4))]
    steps = _sums(with_features(placed.withColumn("stop", F.expr(stop))), (*keys, "stop"))
    sums = running(steps, list(keys), ["stop"], {c: ("sum" if c in MOMENTS or c == "samples" else c[:3], c) for c in state}).where(F.col("samples") == F.col("stop"))
    if prior is not None:
        sums = merged_into(sums, prior.select(*keys, *state), [*keys, "stop"], keys)
        sums = sums.unionByName(prior.select(*keys, F.lit(0).cast("long").alias("stop"), *state))
    sums = materialized(sums)
    fits = materialized(fit(sums, (*keys, "stop")))
    asked = placed.withColumn("stop", F.expr(last))
    if fits.count() < sums.count():  # some have no solution: the last one before them stays
        valid = fits.select(*keys, "stop", F.col("stop").alias("solved"))
        known = running(sums.select(*keys, "stop").join(valid, [*keys, "stop"], "left"), list(keys), ["stop"], {"solved": ("max", "solved")})
        asked = asked.join(known, [*keys, "stop"], "left").drop("stop").withColumnRenamed("solved", "stop")
    return predict(asked, fits, (*keys, "stop"), stored=True).drop("stop")


def merged_into(states: DataFrame, addition: DataFrame, keys: list[str], on: tuple[str, ...]) -> DataFrame:
    """states, each with the addition of the same `on` summed in; both have moments, keys tell the states apart."""
    both = states.select(*keys, *addition.drop(*on).columns).unionByName(states.select(*keys).join(addition, list(on)).select(*keys, *addition.drop(*on).columns))
    return merged(both, tuple(keys))


def prediction_error(predicted: DataFrame, keys: tuple[str, ...] = ("backend",)) -> DataFrame:
    """n, sum |e|, sum e^2, mean |e|, out of domain count of rows with ms and predicted_ms."""
    e = F.col("ms") - F.col("predicted_ms")
    return predicted.where("predicted_ms is not null").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.abs(e)).alias("abs_error"), F.sum(e * e).alias("sq_error"), F.avg(F.abs(e)).alias("mae"), F.count_if(F.col("out_of_domain")).alias("out_of_domain")
    )


#: The bounds of a stored state.
MOST_SUM, MOST_WEIGHT, MOST_FEATURE, MEAN_SLACK = 1e32, 1e12, 1e9, 1e-10


def validity(frame: pd.DataFrame) -> np.ndarray:
    """Which rows are states that observations can have given: bounded numbers, means inside the ranges, and the Gram
    matrix with the response positive semidefinite; a state without weight holds nothing at all."""
    a, b = _matrices(frame)
    weight, samples, yty = (frame[c].to_numpy(float) for c in ("weight", "samples", "yty"))
    low, high = (np.stack([frame[f"{n}{i}"].to_numpy(float) for i in range(4)], 1) for n in ("min", "max"))
    numbers = np.concatenate([a.reshape(-1, 16), b, low, high, yty[:, None], weight[:, None]], 1)
    with np.errstate(all="ignore"):
        bounded = np.isfinite(numbers).all(1) & (numbers >= 0).all(1) & (numbers <= MOST_SUM).all(1) & (weight <= MOST_WEIGHT) & (high <= MOST_FEATURE).all(1) & (low <= high).all(1)
        counted = ((weight == 0) == (samples == 0)) & (a[:, 0, 0] == weight)
        mean = a[:, 0] / weight[:, None]
        slack = MEAN_SLACK * np.maximum(1.0, np.abs(mean))
        inside = (low[:, 0] == 1) & (high[:, 0] == 1) & (mean >= low - slack).all(1) & (mean <= high + slack).all(1)
        single = (samples != 1) | (np.maximum(np.abs(low - mean), np.abs(high - mean)) <= slack).all(1)
    whole = np.concatenate([np.concatenate([a, b[:, :, None]], 2), np.concatenate([b, yty[:, None]], 1)[:, None]], 1)
    return bounded & counted & np.where(weight == 0, ~numbers.any(1), inside & single & _scaled(whole)[2])


def valid_states(states: DataFrame) -> DataFrame:
    """states with `valid`, see validity."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(valid=validity(frame))

    ship(states.sparkSession)
    return states.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in states.schema) + ", valid boolean")


def loaded_ledger(ledger: DataFrame, most: int = 32, current: str | None = None) -> DataFrame:
    """A stored ledger as it may be used: every state valid, or the load fails; of the keys the current one and the first
    others in key order, `most` in sum, and the parts of these."""
    ship(ledger.sparkSession)
    fail_if_any(valid_states(ledger.where("samples > 0")).where(~F.col("valid")).select("source", "key"), "an invalid model state")
    keys = ledger.select("key").distinct()
    chosen = keys.orderBy("key").limit(most) if current is None else kept_keys(keys, current, most)
    return pruned_ledger(ledger, chosen)


def setup_history(parts: DataFrame) -> DataFrame:
    """A key's setup times over its sources: weighted mean, largest, count, and the last of the last source in key order."""
    return parts.groupBy("key").agg(
        F.max_by("last_ms", "source").alias("last_ms"), (F.sum(F.col("mean_ms") * F.col("samples")) / F.sum("samples")).alias("mean_ms"), F.max("max_ms").alias("max_ms"), F.sum("samples").alias("samples")
    )


def newest_revisions(target: DataFrame, source: DataFrame, local: str) -> DataFrame:
    """target's ledger with source's parts of a strictly greater revision; parts of the own local source are never taken."""
    incoming = source.where(F.col("source") != local).withColumn("from_target", F.lit(0))
    both = target.withColumn("from_target", F.lit(1)).unionByName(incoming)
    rest = [c for c in target.columns if c not in ("source", "key")]
    return both.groupBy("source", "key").agg(F.max_by(F.struct(*rest), F.struct("revision", "from_target")).alias("x")).select(*(c if c in ("source", "key") else F.col(f"x.{c}").alias(c) for c in target.columns))


def kept_keys(models: DataFrame, current: str, most: int = 32) -> DataFrame:
    """The current key and the first most - 1 others in key order."""
    others = models.where(F.col("key") != current).orderBy("key").limit(most - 1)
    return others.unionByName(models.where(F.col("key") == current))


def pruned_ledger(ledger: DataFrame, models: DataFrame) -> DataFrame:
    return ledger.join(models.select("key").distinct(), "key", "left_semi")


def valid_setup(parts: DataFrame) -> DataFrame:
    """Setup rows with samples, and finite times of which none is negative and the mean is no more than the largest."""
    times = [F.col(c) for c in ("last_ms", "mean_ms", "max_ms")]
    ok = F.col("samples") > 0
    for t in times:
        ok = ok & (t >= 0) & ~F.isnan(t) & (t < float("inf"))
    return parts.where(ok & (F.col("mean_ms") <= F.col("max_ms")) & (F.col("last_ms") <= F.col("max_ms")))
