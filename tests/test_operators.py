import pytest
from pyspark.sql import functions as F

from twinspark.operators import archive, cache, dedup, model, routing, telemetry, training
from twinspark.schema import METRICS, assert_schema

FILES = "path string, size long, identity string, modified string, changed string, digest string, content string"


def files(spark, rows):
    return spark.createDataFrame([(p, len(c), "i", "m", "c", d, c) for p, d, c in rows], FILES)


def test_bytes_decide_over_digests(spark):
    df = files(spark, [("a1", "0", "AAAA"), ("a2", "0", "AAAA"), ("b1", "0", "BBBB"), ("b2", "0", "BBBB"), ("c", "0", "CCCC")])
    assert {(r.representative, r.member) for r in dedup.matches(df).collect()} == {("a1", "a1"), ("a1", "a2"), ("b1", "b1"), ("b1", "b2")}
    assert [r.path for r in dedup.unique_files(df).collect()] == ["c"]
    lines = sorted(r.line for r in dedup.report_lines(df, True).collect())
    assert lines == ['0\t"c"', '1\t"a1"', '1\t"a2"', '2\t"b1"', '2\t"b2"']
    empty = df.limit(0)
    assert dedup.matches(empty).count() == 0 and dedup.report_lines(empty).count() == 0


def test_boundaries(spark):
    rows = []
    for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 3073):
        rows += [(f"x{n}", "x" * n), (f"y{n}", "x" * n)] + [(f"z{n}", "x" * (n - 1) + "y")] * (n > 0)
    df = files(spark, [(p, str(hash(c)), c) for p, c in rows])
    counters = dedup.scan_counters(df, df.limit(0), dedup.matches(df)).first()
    assert (counters.scanned, counters.hashed, counters.cached, counters.groups, counters.matches, counters.unique_files) == (29, 29, 0, 10, 20, 9)


@pytest.mark.parametrize("field", ["size", "identity", "modified", "changed"])
def test_any_stamp_field_misses(spark, field):
    now = files(spark, [("a", "d", "text")])
    old = now.withColumn(field, F.lit(99 if field == "size" else "other").cast(now.schema[field].dataType))
    assert cache.cache_hits(now, now).count() == 1 and cache.cache_hits(now, old).count() == 0 and cache.cache_misses(now, old).count() == 1
    assert cache.refreshed(now.drop("digest"), old).first().origin == "hashed"
    assert cache.refreshed(now.drop("digest"), old, now).first().origin == "archive"


def test_fail_if_any(spark):
    cache.fail_if_any(spark.range(0), "none")
    with pytest.raises(RuntimeError):
        cache.fail_if_any(spark.range(1), "one")
    with pytest.raises(ValueError):
        assert_schema(spark.range(1), METRICS, "metrics")


def history(spark, runs, shift=0, bytes_=1):
    r = spark.createDataFrame([(i, n, "complete") for n, i in enumerate(runs)], "run_id string, started_unix_ns long, status string")
    e = spark.createDataFrame([(2 * n + k + shift, i, "log" if k else "span", bytes_) for n, i in enumerate(runs) for k in (0, 1)], "event_id long, run_id string, type string, bytes int")
    m = spark.createDataFrame([(i, "n", 1.0) for i in runs], "run_id string, name string, value double")
    p = spark.createDataFrame([(i, "c", "n", "v") for i in runs], "run_id string, category string, name string, value string")
    return archive.History(r, e, m, p)


def test_archive_union(spark):
    a, b = history(spark, ["a"]), history(spark, ["b"], 10)
    union, bridge, totals = archive.archive_union([(1, a), (2, b)])
    assert union.runs.count() == 2 and union.events.count() == 4 and bridge.count() == 2
    union, _, totals = archive.archive_union([(1, a), (2, history(spark, ["a"], 50))])  # other event ids are no conflict
    assert union.runs.count() == 1 and union.events.count() == 2
    assert [(r.runs_added, r.runs_duplicate) for r in totals.orderBy("source_id").collect()] == [(1, 0), (0, 1)]
    with pytest.raises(RuntimeError, match="conflicting"):
        archive.archive_union([(1, a), (2, history(spark, ["a"], 0, 2))])
    assert archive.merge_by_run(a, history(spark, ["a", "b"], 0, 2)).events.where("run_id = 'a'").first().bytes == 1  # the runtime skips
    orphaned = archive.History(a.runs.limit(0), a.events, a.metrics, a.parameters)
    with pytest.raises(RuntimeError, match="orphans"):
        archive.archive_union([(1, orphaned)])
    ordered = archive.import_order(history(spark, ["b", "a"]).runs, history(spark, ["b", "a"]).events).collect()
    assert sorted((r.event_id, r.run_id) for r in ordered) == [(1, "b"), (2, "b"), (3, "a"), (4, "a")]


def test_event_cap_and_retention(spark):
    events = spark.createDataFrame([(i, "r") for i in range(100)], "event_id long, run_id string")
    row = telemetry.cap_counts(events, 4).first()
    assert sorted(r.event_id for r in telemetry.capped_events(events, 4).collect()) == [0, 1, 2, 3] and (row.accepted, row.dropped) == (4, 96)
    runs = spark.createDataFrame([(str(i), i, i) for i in range(6)], "run_id string, started_unix_ns long, row_id long")
    assert {r.run_id for r in telemetry.retained(runs, 3, "0").collect()} == {"0", "5", "4"}
    assert telemetry.latest_run(runs, by_start=False).first().run_id == "5" and telemetry.latest_run(runs.limit(0)).count() == 0


def test_ewma_golden(spark):
    rows = spark.createDataFrame([("cpu", 1, 1024, 8.0), ("cpu", 2, 2048, 32.0), ("cpu", 3, 0, 1.0), ("cpu", 4, 10, -1.0)], "backend string, o long, bytes long, ms double")
    out = model.band_model(rows, "o").collect()
    assert len(out) == 1 and out[0].cost == pytest.approx(0.0087890625) and out[0].samples == 2


def test_band_model_in_parts_and_seeded(spark):
    """A group over many parts against one fold in order, from nothing and from an earlier state."""
    import random

    random.seed(13)
    rows = [("cpu" if i % 4 else "gpu", i, random.choice([100, 120, 200, 70_000]), random.uniform(0.5, 9)) for i in range(3_000)]

    def fold(rows, state):
        state = dict(state)
        for backend, _, size, ms in rows:
            key = backend, (size.bit_length() - 1) // 2
            if key not in state:
                state[key] = (ms / size, 0.0, 1)
            else:
                cost, error, n = state[key]
                state[key] = (cost * 0.875 + ms / size * 0.125, error * 0.875 + abs(ms - cost * size) / size * 0.125, n + 1)
        return state

    def run(rows, seed=None):
        df = spark.createDataFrame(rows, "backend string, o long, bytes long, ms double").repartition(5)
        return model.band_model(df, "o", seed=seed)

    def same(df, want):
        got = {(r.backend, r.band): (r.cost, r.error, r.samples) for r in df.collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)

    early, late = rows[:1_200], [r for r in rows[1_200:] if r[2] < 1_000]
    state = run(early)
    same(state, fold(early, {}))
    same(run(late, state), fold(late, fold(early, {})))  # a band without new rows stays
    calibrated = model.with_seeds(state, spark.createDataFrame([("cpu", 100, 1.0), ("igpu", 100, 5.0), ("igpu", 0, 5.0)], "backend string, bytes long, ms double"))
    same(calibrated, fold(early, {}) | {("igpu", 3): (0.05, 0.0, 0)})
    more = [("igpu", 1, 100, 10.0)]
    same(run(more, calibrated), fold(early, {}) | {("igpu", 3): (0.05 * 0.875 + 0.1 * 0.125, 0.05 * 0.125, 1)})
    assert run(rows[:0] or [("cpu", 1, 0, 1.0)]).count() == 0


def test_bootstrap_upper(spark):
    """The bound of a large group against the normal one, small groups' gates, and the same result for other orders."""
    import random

    from twinspark.operators.benchstats import bootstrap_upper

    random.seed(14)
    wide = [random.gauss(1.0, 0.2) for _ in range(4_000)]
    rows = [("wide", x) for x in wide] + [("few", 1.0)] * 6 + [("fast", 0.5)] * 7 + [("slow", 1.03)] * 7
    df = spark.createDataFrame(rows, "bench string, ratio double")
    got = {r.bench: r for r in bootstrap_upper(df.repartition(3), ["bench"], resamples=2_000).collect()}
    mean = sum(wide) / len(wide)
    error = (sum((x - mean) ** 2 for x in wide) / len(wide) ** 2) ** 0.5
    assert got["wide"].upper == pytest.approx(mean + 1.645 * error, abs=0.2 * error) and got["wide"].pairs == 4_000
    assert {b: (got[b].upper, got[b].gate) for b in ("few", "fast", "slow")} == {"few": (1.0, "insufficient_trials"), "fast": (0.5, "pass"), "slow": (pytest.approx(1.03), "not_demonstrated")}


def test_ledger_load(spark):
    state = model.moments(observations(spark)).select(F.lit("peer").alias("source"), F.explode(F.array(*(F.lit(f"k{i:02}") for i in range(40)))).alias("key"), F.lit(1).cast("long").alias("revision"), F.lit(1.0).alias("attenuation"), "*")
    assert model.loaded_ledger(state).count() == 32
    assert {r.key for r in model.loaded_ledger(state, 3, "k39").collect()} == {"k00", "k01", "k39"}
    with pytest.raises(RuntimeError, match="invalid"):
        model.loaded_ledger(state.withColumn("yty", F.col("yty") / 2))


def test_filter_lets_all_wanted_through(spark):
    rows = spark.range(5_000).selectExpr("id as k", "id % 3 as v")
    wanted = rows.where("k % 50 = 0").select("k")
    passed = dedup.passing(rows, wanted, ["k"])
    assert passed.join(wanted, "k").count() == 100 and passed.count() < 200 and passed.columns == rows.columns
    assert dedup.passing(rows, wanted, ["k"], 1).join(wanted, "k").count() == 100 and dedup.passing(rows, wanted.limit(0), ["k"]).count() == 0


def test_totals_check(spark):
    totals = spark.createDataFrame([("all", 3, 30, 1), ("worker.0", 1, 10, 1), ("worker.1", 2, 20, 0)], "scope string, tasks long, bytes long, errors long")
    assert telemetry.totals_check(totals).first().consistent and telemetry.inconsistent_totals(totals).count() == 0
    odd = totals.withColumn("bytes", F.col("bytes") + (F.col("scope") == "all").cast("int"))
    assert not telemetry.totals_check(odd).first().consistent and telemetry.inconsistent_totals(odd).count() == 1


def observations(spark, n=256):
    rows = []
    for i in range(n):
        size, batch, contention = (i % 16 + 1) * 1048576, (i % 5 + 1) * 65536, float(i % 7)
        mib, batches = size / 1048576, -(-size // batch)
        rows.append(("cpu", size, batch, contention, 2 + 0.3 * mib + 7 * batches / 1024 + 40 * mib * contention / 1024))
    return spark.createDataFrame(rows, "backend string, bytes long, batch_bytes long, contention double, ms double")


def test_ridge_recovery_and_validity(spark):
    rows = observations(spark)
    state = model.moments(rows)
    fitted = model.fit(state).first()
    assert [fitted.beta0, fitted.beta1, fitted.beta2, fitted.beta3] == pytest.approx([2, 0.3, 7, 40], abs=1e-2)
    predicted = model.predict(rows, model.fit(state)).collect()
    assert all(abs(r.ms - r.predicted_ms) < 1e-3 and not r.out_of_domain for r in predicted)
    halves = model.merged(model.moments(rows.limit(100)).unionByName(model.moments(rows.exceptAll(rows.limit(100)))))
    assert halves.first().samples == 256 and model.valid_states(state).first().valid
    assert not model.valid_states(state.withColumn("xtx00", F.col("xtx00") + 1)).first().valid
    assert model.decayed(state, 0.5).first().weight == 128 and model.decayed(state, 0.5).first().samples == 256


def test_ledger(spark):
    state = model.moments(observations(spark)).withColumn("key", F.lit("k"))
    full = state.select(F.lit("local").alias("source"), "key", F.lit(1).cast("long").alias("revision"), F.lit(1.0).alias("attenuation"), *[c for c in state.columns if c != "key"])
    other = full.withColumn("source", F.lit("peer"))
    after = {r.source: r for r in model.run_delta(full.unionByName(other), state, "local").collect()}
    assert after["local"].revision == 2 and after["local"].attenuation == 1 and after["local"].weight == pytest.approx(256 * 1.9) and after["peer"].attenuation == pytest.approx(0.9)
    t = spark.createDataFrame([("a", "k", 2, "old"), ("me", "k", 1, "mine")], "source string, key string, revision long, payload string")
    s = spark.createDataFrame([("a", "k", 2, "equal"), ("me", "k", 9, "forged"), ("b", "k", 1, "new")], "source string, key string, revision long, payload string")
    once = model.newest_revisions(t, s, "me")
    assert {(r.source, r.payload) for r in once.collect()} == {("a", "old"), ("me", "mine"), ("b", "new")}
    assert model.newest_revisions(once, s, "me").exceptAll(once).count() == 0


def test_routing_policies(spark):
    base = {f"{b}_{f}": v for b in routing.BACKENDS for f, v in (("available", True), ("known", True), ("ms", 10.0), ("error", 1.0), ("probes", 9))}
    row = lambda **x: spark.range(1).select(*(F.lit(v).alias(k) for k, v in ({"bytes": 1 << 27, "arrival": 1} | base | x).items()))
    say = lambda df, **o: tuple(routing.choose_backend(df, **o).select("backend", "reason").first())
    assert say(row(bytes=10)) == ("cpu", "size") and say(row(), policy="cuda") == ("cuda", "fixed") and say(row(), learning=False) == ("cuda", "fixed")
    assert say(row()) == ("cpu", "model") and say(row(igpu_ms=2.0)) == ("igpu", "model")
    assert say(row(arrival=64)) == ("cuda", "explore") and say(row(arrival=64, cuda_available=False)) == ("igpu", "explore")
    assert say(row(cuda_known=False, cuda_probes=1, cpu_known=False, cpu_probes=0)) == ("cpu", "explore")
    assert say(row(cpu_known=False, cuda_known=False, igpu_known=False)) == ("cuda", "fixed")


def test_training_budget(spark):
    rows = spark.createDataFrame([(f"f{i}", 1 << (i % 6 + 4)) for i in range(60)], "path string, size long")
    chosen = training.stratified(rows, 3)
    assert chosen.groupBy("band").count().where("count > 3").count() == 0
    taken = training.budgeted(chosen, 5, 1000).orderBy("turn").collect()
    assert len(taken) <= 5 and sum(r["size"] for r in taken) <= 1000 and [r.turn for r in taken] == list(range(len(taken)))
    assert training.budgeted(chosen, 100, 0).count() == 0


def test_ordered_groups(spark):
    from pyspark.sql import Window

    from twinspark.operators.ordered import row_positions, running_sums

    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("o"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"), (F.col("id") % 11).alias("v")).repartition(7)
    w = Window.partitionBy("k").orderBy("o")
    want = df.select("k", "o", F.row_number().over(w).cast("long").alias("n"), F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    got = row_positions(df, ["k"], ["o"], "n").join(running_sums(df, ["k"], ["o"], "v", "s").select("k", "o", "s"), ["k", "o"]).select("k", "o", F.col("n").cast("long"), "s")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert row_positions(df.limit(0), ["k"], ["o"], "n").count() == 0


def test_measures_over_grouping_sets(spark):
    rows = [(i, None if i == 7 else i % 3, "ab"[i % 2], "log" if i % 2 else "span", "error" if i == 5 else "info", float(i * 300), i * 20_000, i * 10) for i in range(12)]
    events = spark.createDataFrame(rows, "event_id long, worker long, name string, type string, severity string, duration_ms double, bytes long, time_ns long").repartition(3)
    found = telemetry.measures(events)
    metrics = {r.name: (r.value, r.unit) for r in telemetry.metric_rows(found).collect()}
    assert metrics["all.tasks"] == (12, "count") and metrics["all.bytes"] == (sum(r[6] for r in rows), "bytes") and metrics["worker.null.tasks"] == (1, "count")
    own = [r for r in rows if r[1] == 2 and r[2] == "b"]
    assert metrics["worker.2.name.b.total_ms"] == (sum(r[5] for r in own), "ms") and metrics["worker.2.name.b.max_bytes"] == (max(r[6] for r in own), "bytes")
    assert metrics["name.a.over_second"] == (sum(r[5] >= 1000 for r in rows if r[2] == "a"), "count") and metrics["all.errors"] == (1, "count") and metrics["all.elapsed_ns"] == (110, "ns")
    assert metrics["all.mib_s"][0] == pytest.approx(sum(r[6] for r in rows) / 2**20 / (sum(r[5] for r in rows) / 1000))
    assert telemetry.inconsistent_measures(found).count() == 0
    forged = found.withColumn("bytes", F.when((F.col("all_workers") == 0) & (F.col("all_names") == 1) & (F.col("worker") == 1), F.col("bytes") + 1).otherwise(F.col("bytes")))
    assert {tuple(r) for r in telemetry.inconsistent_measures(forged).collect()} == {("bytes", "workers")}
    assert telemetry.inconsistent_measures(telemetry.measures(events.limit(0))).count() == 0


def test_backends_agree(spark):
    import hashlib

    df = spark.createDataFrame([("a", "text"), ("b", ""), ("c", "x" * 10_000), ("n", None)], "path string, content string")
    got = {r.path: (r.backends, r.digests, r.digest) for r in training.backend_agreement(training.digests_by_backend(df)).collect()}
    assert got == {p: (3, 1, hashlib.sha256(c.encode()).hexdigest()) for p, c in (("a", "text"), ("b", ""), ("c", "x" * 10_000))} | {"n": (3, 0, None)}
    odd = training.digests_by_backend(df).withColumn("digest", F.when((F.col("path") == "c") & (F.col("backend") == "pieces"), F.lit("0")).otherwise(F.col("digest")))
    assert [r.path for r in training.backend_mismatches(odd).collect()] == ["c"] and training.backend_mismatches(training.digests_by_backend(df)).count() == 0


def test_filter_grows_with_its_keys():
    words = [dedup.filter_words(n) for n in (0, 1000, 10**5, 10**7, 10**8, 10**10)]
    assert words == sorted(words) and words[0] == 1024 and words[-1] == dedup.MOST_WORDS
    passing = [1 - 2.718281828 ** (-n / (64 * dedup.filter_words(n))) for n in (1000, 10**5, 10**6, 8 * 10**6)]
    assert max(passing) < 0.063  # the share of other rows that pass


def test_fnv_against_the_definition(spark):
    from twinspark.functions.scalars import fnv1a_64

    def fnv(data):
        h = 14695981039346656037
        for b in data:
            h = (h ^ b) * 1099511628211 % (1 << 64)
        return str(h)

    texts = ["", "a", "foobar", "é世🎉", "x" * 3000, "\0\0", None] + [f"path/{i}" for i in range(50)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    assert {r.t: r.h for r in df.select("t", fnv1a_64(F.col("t")).cast("string").alias("h")).collect()} == {t: None if t is None else fnv(t.encode()) for t in texts}
    assert df.limit(0).select(fnv1a_64(F.col("t"))).count() == 0


def test_small_files_stay_on_the_cpu(spark):
    """The route of a file that is smaller than both limits' larger one."""
    df = spark.createDataFrame([(n,) for n in (0, 99, 100, 199, 200)], "size long")
    for limits, first in (((100, 50), 100), ((100, 200), 200), ((0, 0), 0)):
        assert [r.x for r in df.orderBy("size").select(routing.small_route(F.col("size"), *limits).alias("x")).collect()] == [n < first for n in (0, 99, 100, 199, 200)]


def test_numbered_groups_and_members(spark):
    df = files(spark, [("a1", "0", "AAAA"), ("a2", "0", "AAAA"), ("b1", "1", "BBBB"), ("b2", "1", "BBBB"), ("0", "1", "BBBB"), ("c", "0", "CCCC"), ("a1", "0", "AAAA")])
    rows = lambda d: {(r.representative, r.member, r["size"], r.members, r.group_number) for r in d.collect()}
    assert rows(dedup.numbered_groups(df)) == rows(dedup.numbered(dedup.matches(df))) and len(rows(dedup.numbered_groups(df))) == 5
    counted = dedup.members(df)
    assert counted.count() == 5 and counted.select("representative").distinct().count() == 2
    assert dedup.numbered_groups(df.limit(0)).count() == 0 == dedup.members(df.limit(0)).count()
