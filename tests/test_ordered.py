"""Values in order, in parts: against plain Python, with one key that holds nearly all rows."""

import math
import random
from statistics import median

import numpy as np
import pytest
from pyspark.sql import functions as F

from twinspark.operators import archive, benchstats, model, selection, telemetry
from twinspark.operators.ordered import lagged, running


def skewed(spark, n=900, seed=21):
    random.seed(seed)
    rows = [("hot" if random.random() < 0.9 else random.choice("abc"), i, random.choice([None, random.randint(-50, 50)])) for i in range(n)]
    random.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k string, i long, v long").repartition(5)


def test_running_and_lagged(spark):
    rows, df = skewed(spark)
    want = {}
    for k in {r[0] for r in rows}:
        total = low = high = before = None
        for key, i, v in sorted((r for r in rows if r[0] == k), key=lambda r: r[1]):
            if v is not None:
                total, low, high = (v if total is None else total + v), (v if low is None else min(low, v)), (v if high is None else max(high, v))
            want[k, i] = (total, low, high, before)
            before = (v, i)
    out = running(df, ["k"], ["i"], {"s": ("sum", "v"), "low": ("min", "v"), "high": ("max", "v")})
    assert out.columns == ["k", "i", "v", "s", "low", "high"]
    got = {(r.k, r.i): (r.s, r.low, r.high) for r in out.collect()}
    assert all(got[key][0] == w[0] or (got[key][0] or 0) == (w[0] or 0) for key, w in want.items()) and {key: g[1:] for key, g in got.items()} == {key: w[1:3] for key, w in want.items()}
    back = {(r.k, r.i): r for r in lagged(df, ["k"], ["i"], {"pv": "v", "pi": "i"}).collect()}
    assert len(back) == len(rows) and all((back[key].pv, back[key].pi) == (w[3] or (None, None)) for key, w in want.items())
    assert running(df.limit(0), ["k"], ["i"], {"s": ("sum", "v")}).count() == 0 == lagged(df.limit(0), ["k"], ["i"], {"p": "v"}).count()


def test_timeline_has_no_window_over_a_run(spark):
    events = spark.createDataFrame([(i, "r", "span" if i % 3 else "log", 10 * i) for i in range(60)], "event_id long, run_id string, type string, time_ns long")
    out = telemetry.timeline(events)
    gaps = {r.event_id: r.gap_ns for r in out.collect()}
    assert gaps == {i: None if i == 1 else 10 if i % 3 == 2 else 20 for i in range(60) if i % 3}
    assert "partitionBy(run_id" not in out._jdf.queryExecution().toString() and out.columns == [*events.columns, "gap_ns"]


@pytest.mark.parametrize("small", [0, 40, selection.SMALL])
def test_medians(spark, small):
    random.seed(22)
    odd = [0.0, -0.0, 1e300, -1e300, 5e-324, -5e-324, math.inf, -math.inf, 1.0, 1.0, 1.0 + 2**-52]
    rows = [("hot", random.choice([random.gauss(0, 1e3), 7.25])) for _ in range(501)] + [("odd", x) for x in odd] + [("one", 3.0), ("two", 1.0), ("two", 4.0), ("none", None), ("two", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(4)
    got = {r.k: r.m for r in selection.medians(df, ["k"], {"m": "x"}, small).collect()}
    for k in {r[0] for r in rows}:
        own = [x for key, x in rows if key == k and x is not None]
        assert got[k] == (median(own) if own else None), k
    assert selection.medians(df.limit(0), ["k"], {"m": "x"}, small).count() == 0
    want = sorted(x for k, x in rows if k == "odd")
    ranks = spark.createDataFrame([("odd", r) for r in range(1, len(want) + 2)], "k string, rank long")
    found = {r.rank: r.value for r in selection.ranked_values(df, ["k"], "x", ranks).collect()}
    assert [found[r] for r in range(1, len(want) + 1)] == want and len(found) == len(want)
    nan = spark.createDataFrame([("a", math.nan), ("a", 1.0), ("a", -math.nan)], "k string, x double")
    last = {r.rank: r.value for r in selection.ranked_values(nan, ["k"], "x", spark.createDataFrame([("a", 1), ("a", 3)], "k string, rank long")).collect()}
    assert last[1] == 1.0 and math.isnan(last[3])


def test_trials_and_summaries_of_a_large_key(spark, monkeypatch):
    trials = spark.createDataFrame([("a", t, float(t)) for t in range(5)] + [("b", t % 4, 1.0) for t in range(5)] + [("c", 0, None)], "k string, t int, x double")
    rows = {r.k: (r.n, r["median"], r.low, r.high, r.complete) for r in benchstats.medians(trials, ["k"], "x", "t", [0, 1, 2, 3, 4]).collect()}
    assert rows == {"a": (5, 2.0, 0.0, 4.0, True), "b": (5, 1.0, 1.0, 1.0, False), "c": (1, None, None, None, False)}
    pairs = spark.createDataFrame([("a", float(i), float(-i)) for i in range(300)], "k string, ratio double, delta double")
    plain = benchstats.paired_summary(pairs, ["k"]).first()
    monkeypatch.setattr(selection.medians, "__defaults__", (10,))
    assert benchstats.paired_summary(pairs, ["k"]).first() == plain and plain.median_ratio == 149.5 and plain.median_delta == -149.5


def test_bootstrap_depends_on_pairs_and_seed_alone(spark):
    random.seed(23)
    rows = [("wide", random.choice([1.0, random.gauss(1, 0.3)])) for _ in range(5000)] + [("few", 0.9), ("few", 1.1)]
    df = spark.createDataFrame(rows, "bench string, ratio double")
    found = []
    for n in (2, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        found.append({r.bench: (r.pairs, r.upper, r.gate) for r in benchstats.bootstrap_upper(df.repartition(n), ["bench"], resamples=500).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0].keys() == found[1].keys() and all(found[0][k] == (found[1][k][0], pytest.approx(found[1][k][1], rel=1e-13), found[1][k][2]) for k in found[0])
    other = {r.bench: r.upper for r in benchstats.bootstrap_upper(df, ["bench"], seed=2, resamples=500).collect()}
    assert other["wide"] != found[0]["wide"][1]


def test_draws_of_blocks_add_up():
    for n in (1, 1023, 1024, 1025, 10_000):
        blocks = [benchstats.draws_of_block(n, b, 200, 5) for b in range(-(-n // benchstats.DRAWN))]
        assert (np.sum(blocks, axis=0) == n).all()
        sizes = [min(benchstats.DRAWN, n - b * benchstats.DRAWN) for b in range(len(blocks))]
        assert all(abs(b.mean() - size) < 6 * math.sqrt(size / 200) for b, size in zip(blocks, sizes))


def event_rows(run, start, names, step=1):
    return [(start + step * i, run, n, None if n == "z" else i) for i, n in enumerate(names)]


def test_only_runs_that_differ_are_put_in_order(spark):
    schema = "event_id long, run_id string, name string, bytes long"
    a = event_rows("same", 5, "xyz") + event_rows("moved", 1, "xyz") + event_rows("gaps", 1, "xyz", 2) + event_rows("odd", 1, "xyz") + event_rows("long", 1, "xy") + event_rows("mine", 1, "x") + event_rows("null", 3, "z")
    b = event_rows("same", 90, "xyz") + event_rows("moved", 4, "xzy") + event_rows("gaps", 7, "xyz", 3) + event_rows("odd", 2, "xyx") + event_rows("long", 3, "xyz") + event_rows("other", 1, "x") + [(8, "null", None, 0)]
    known, incoming = (spark.createDataFrame(rows, schema).repartition(3) for rows in (a, b))
    want = {("moved", 2, True, True), ("moved", 3, True, True), ("odd", 3, True, True), ("long", 3, False, True), ("null", 1, True, True)}
    assert {tuple(r) for r in archive.event_conflicts(known, incoming).collect()} == want
    assert {tuple(r) for r in archive.conflicts(archive.ordinal(known), archive.ordinal(incoming), ["run_id", "pos"]).collect()} == want
    prints = {r.run_id: r for r in archive.run_prints(known).collect()}
    assert prints["same"].dense and not prints["gaps"].dense and archive.run_prints(known.limit(0)).count() == 0


def brute_prequential(rows, prior=None):
    """rows: (x (4), ms). Predicts each from the last solution before it."""
    a, b, low, high = np.zeros((4, 4)), np.zeros(4), np.full(4, np.inf), np.full(4, -np.inf)
    fit, out = None, []

    def solve():
        s = np.sqrt(np.maximum(np.diag(a), 1e-24))
        return np.linalg.solve(a / np.outer(s, s) + 1e-8 * np.eye(4), b / s) / s, low.copy(), high.copy()

    if prior:
        for x, ms in prior:
            a += np.outer(x, x)
            b += x * ms
            low, high = np.minimum(low, x), np.maximum(high, x)
        fit = solve()
    for n, (x, ms) in enumerate(rows, 1):
        p = None if fit is None else float(fit[0] @ x)
        known = p is not None and 0 < p <= 1e9
        out.append((p if known else None, bool(((x < fit[1]) | (x > fit[2])).any()) if fit else None))
        a += np.outer(x, x)
        b += x * ms
        low, high = np.minimum(low, x), np.maximum(high, x)
        if n <= 4 or n % 16 == 0:
            fit = solve()
    return out


def test_prequential(spark):
    random.seed(24)

    def observation(i, key):
        size, contention = random.randint(1, 1 << 24), random.choice([0.0, 1.0, 4.0])
        return (key, i, size, 65536, contention, 3.0 + size / 1e6 + contention * random.random())

    data = [observation(i, "hot" if i % 10 else "cold") for i in range(700)]
    bad = [("hot", 1000, 0, 65536, 0.0, 1.0), ("hot", 1001, 10, 65536, 0.0, -1.0), ("hot", 1002, 10, 0, 0.0, 1.0)]  # invalid: they count for nothing
    schema = "backend string, i long, bytes long, batch_bytes long, contention double, ms double"
    df = spark.createDataFrame(data + bad, schema).repartition(3)

    def features(r):
        return np.array([1.0, r[2] / 2**20, -(-r[2] // r[3]) / 1024, r[2] / 2**20 * r[4] / 1024])

    for prior_rows in (None, [observation(-i, k) for k in ("hot", "cold") for i in range(1, 30)]):
        prior = model.moments(spark.createDataFrame(prior_rows, schema)) if prior_rows else None
        got = {(r.backend, r.i): (r.n, r.predicted_ms, r.out_of_domain) for r in model.prequential(df, ["i"], prior=prior).collect()}
        assert len(got) == len(data)
        for key in ("hot", "cold"):
            own = [r for r in data if r[0] == key]
            want = brute_prequential([(features(r), r[5]) for r in own], [(features(r), r[5]) for r in prior_rows if r[0] == key] if prior_rows else None)
            for n, (r, (p, outside)) in enumerate(zip(own, want), 1):
                mine = got[key, r[1]]
                assert mine[0] == n and (mine[1] is None) == (p is None) and (p is None or mine[1] == pytest.approx(p, rel=1e-5)), (key, n)
                assert p is None or mine[2] == outside
    assert model.prequential(df.limit(0), ["i"]).count() == 0


def test_a_state_without_solution_leaves_the_one_before(spark, monkeypatch):
    rows = [("c", i, 1 << 20, 65536, 0.0, 5.0) for i in range(40)]
    df = spark.createDataFrame(rows, "backend string, i long, bytes long, batch_bytes long, contention double, ms double")
    whole = model.fit
    monkeypatch.setattr(model, "fit", lambda states, keys=("backend",): whole(states.where("samples not in (2, 3, 16)"), keys))
    used = {r.i: r.predicted_ms for r in model.prequential(df, ["i"]).collect()}
    assert used[0] is None and all(used[i] == pytest.approx(5.0, rel=1e-3) for i in range(1, 40))
