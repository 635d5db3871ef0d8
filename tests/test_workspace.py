"""Scans of real folders, workspace merges, readers, streams."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from twinspark.plans.merge import clean_workspace, initialize_workspace, merge_workspaces, merged_rules
from twinspark.plans.scan import scan, summary
from twinspark.sources import records
from twinspark.sources.config import Config, use_color
from twinspark.sources.inventory import binary_inventory, discover_workspaces, overlapping_roots, stamped_inventory


def put(root, **texts):
    for name, text in texts.items():
        path = Path(root) / name.replace("__", "/")
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)


def test_scan_twice_and_change(spark, tmp_path):
    root = str(tmp_path)
    assert initialize_workspace(root) == ["config.toml", "ignore"] and initialize_workspace(root) == []
    put(root, a="abcd", b="abcd", sub__c="other", sub__d="abcd", skip="abcd")
    (tmp_path / ".twinspark" / "ignore").write_text("skip\n")
    os.symlink(tmp_path / "a", tmp_path / "link")
    first = scan(spark, root)
    assert {k: first.counters[k] for k in ("scanned", "hashed", "cached", "groups", "matches", "unique_files")} == {"scanned": 4, "hashed": 4, "cached": 0, "groups": 1, "matches": 3, "unique_files": 1}
    assert {r.member for r in first.groups.collect()} == {"a", "b", "sub/d"}
    second = scan(spark, root)
    assert (second.counters["hashed"], second.counters["cached"]) == (0, 4)
    before = os.stat(tmp_path / "a")
    put(root, a="wxyz")
    os.utime(tmp_path / "a", ns=(before.st_atime_ns, before.st_mtime_ns))  # the change time still tells
    os.remove(tmp_path / "sub" / "d")
    third = scan(spark, root)
    assert (third.counters["scanned"], third.counters["hashed"], third.counters["cached"], third.counters["groups"]) == (3, 1, 2, 0)
    assert "scanned=3" in summary(spark, third.counters)
    assert clean_workspace(root) == 1


def test_blake3_scan(spark, tmp_path):
    initialize_workspace(str(tmp_path))
    put(tmp_path, a="same", b="same")
    found = scan(spark, str(tmp_path), Config(digest="blake3"))
    assert found.counters["groups"] == 1 and len(found.files.first().digest) == 64


def test_inventory_forms(spark, tmp_path):
    put(tmp_path, x="1", sub__y="22", sub__deep__z="333")
    assert {r.path: r["size"] for r in stamped_inventory(spark, str(tmp_path)).collect()} == {"x": 1, "sub/y": 2, "sub/deep/z": 3}
    assert {r.path for r in stamped_inventory(spark, str(tmp_path), recursive=False).collect()} == {"x"}
    assert {r.path: bytes(r.content) for r in binary_inventory(spark, str(tmp_path)).select("path", "content").collect()} == {"x": b"1", "sub/y": b"22", "sub/deep/z": b"333"}
    bad = overlapping_roots(spark, ["/a/b", "/a/bc", "/a/b/c", "/d", "/d/"]).collect()
    assert {(r.i, r.j) for r in bad} == {(0, 2), (3, 4), (4, 3)}


def test_merge_is_idempotent(spark, tmp_path):
    for name in ("one", "two"):
        initialize_workspace(str(tmp_path / name))
        put(tmp_path / name, **{f"{name}.txt": name})
        (tmp_path / name / ".twinspark" / "ignore").write_text(f"*.{name}\n")
        scan(spark, str(tmp_path / name))
    initialize_workspace(str(tmp_path))
    assert discover_workspaces(str(tmp_path), skip=str(tmp_path)) == [str(tmp_path / "one"), str(tmp_path / "two")]
    sources = [str(tmp_path / n) for n in ("two", "one")]
    first = merge_workspaces(spark, str(tmp_path), sources)
    again = merge_workspaces(spark, str(tmp_path), sources)
    none = dict.fromkeys(("model_parts", "setup_parts", "cache_rows", "telemetry_runs", "telemetry_events", "rules_added", "warnings", "sources_removed"), 0)
    assert first == none | {"workspaces": 2, "cache_rows": 2, "rules_added": 2}
    assert again == none | {"workspaces": 2}
    assert "/one/**/*.one" in (tmp_path / ".twinspark" / "ignore").read_text()
    with pytest.raises(ValueError):
        discover_workspaces(str(tmp_path / "one" / ".twinspark"))
    assert merged_rules(["x"], [("s", ["x", "# no", "y"]), ("s", ["y"])])[0] == ["x", "/s/**/x", "/s/**/y"]


def test_merge_brings_telemetry_models_and_digests(spark, tmp_path):
    """Counters of every part, a second merge that changes nothing, moved sources, and a scan that hashes nothing."""
    from twinspark.plans.scan import StateTable
    from twinspark.schema import EVENTS, METRICS, MODEL_PARTS, PARAMETERS, RUNS, SETUP_PARTS

    def fill(root, run, revision):
        initialize_workspace(root)
        rows = {
            "telemetry/runs": (RUNS, [(run, 1, None, "complete", *[None] * 5, *[0] * 6)]), "telemetry/events": (EVENTS, [(k, run, "log", "n", "info", "m", "cpu", 0, 0, 0, k, k, 0, 1.0, "u", 0) for k in (1, 2)]),
            "telemetry/metrics": (METRICS, [(run, "n", 1.0, "u")]), "telemetry/parameters": (PARAMETERS, []),
            "model": (MODEL_PARTS, [(b"peer", b"key", revision, 1.0, 0, [0.0] * 16, [0.0] * 4, [0.0] * 4, [0.0] * 4, 0.0, 0.0, 0)]), "setup": (SETUP_PARTS, [(b"peer", b"key", revision, 1.0, 1.0, 1.0, 1)]),
        }
        for name, (schema, values) in rows.items():
            StateTable(spark, root, name, schema).commit(spark.createDataFrame(values, schema))

    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    put(tmp_path, one__a="same", two__b="same", c="other")
    for root, run, revision in ((one, "r1", 1), (two, "r2", 2)):
        fill(root, run, revision)
        scan(spark, root)
    initialize_workspace(str(tmp_path))
    first = merge_workspaces(spark, str(tmp_path), [one, two])
    assert first == {"workspaces": 2, "model_parts": 1, "setup_parts": 1, "cache_rows": 2, "telemetry_runs": 2, "telemetry_events": 4, "rules_added": 0, "warnings": 0, "sources_removed": 0}
    assert StateTable(spark, str(tmp_path), "model", MODEL_PARTS).read().first().revision == 2
    again = merge_workspaces(spark, str(tmp_path), [one, two], move=True)
    assert {k for k, v in again.items() if v} == {"workspaces", "sources_removed"} and not (tmp_path / "one" / ".twinspark").exists()
    (tmp_path / ".twinspark" / "ignore").write_text(".twinspark/\n")
    found = scan(spark, str(tmp_path))
    assert (found.counters["scanned"], found.counters["cached"], found.counters["hashed"], found.counters["groups"]) == (3, 2, 1, 1)  # a and b from the archive
    assert scan(spark, str(tmp_path), rehash=True).counters["hashed"] == 3


def test_only_wanted_files_are_opened(spark, tmp_path):
    import hashlib

    from twinspark.sources.blocks import with_digest

    put(tmp_path, a="one", sub__b="x" * 3_000_000)
    os.mkfifo(tmp_path / "pipe")  # whoever opens it hangs
    wanted = spark.createDataFrame([("a", 1, 3), ("sub/b", 2, 3_000_000)], "path string, n int, size long")
    got = {r.path: (r.n, r.digest) for r in with_digest(wanted, str(tmp_path)).collect()}
    assert got == {"a": (1, hashlib.sha256(b"one").hexdigest()), "sub/b": (2, hashlib.sha256(b"x" * 3_000_000).hexdigest())}
    with pytest.raises(Exception, match="No such file"):
        with_digest(spark.createDataFrame([("gone",)], "path string"), str(tmp_path)).collect()


def test_digest_by_segments(spark, tmp_path):
    from twinspark.functions.blake3 import blake3
    from twinspark.sources.blocks import with_digest

    sizes = [0, 1, 1024, 1 << 20, (1 << 20) + 1, (2 << 20) - 1, 2 << 20, (5 << 20) + 77]
    data = os.urandom(6 << 20)
    for i, n in enumerate(sizes):
        (tmp_path / f"f{i}").write_bytes(data[:n])
    files = stamped_inventory(spark, str(tmp_path))
    want = {f"f{i}": blake3(data[:n]).hex() for i, n in enumerate(sizes)}
    for segment in (1 << 20, 2 << 20, 64 << 20):
        assert {r.path: r.digest for r in with_digest(files, str(tmp_path), "blake3", segment).collect()} == want
    with pytest.raises(Exception, match="ends before"):
        with_digest(files.withColumn("size", F.col("size") + 1), str(tmp_path), "blake3").collect()


def test_equal_files_by_blocks(spark, tmp_path):
    """Bytes decide, whatever the digests say; no file is held whole."""
    import random

    from twinspark.sources.blocks import equal_files, equal_pairs

    random.seed(5)
    base = random.randbytes((3 << 20) + 5)
    texts = {"a": base, "b": base, "c": base[:-1] + b"x", "d": b"y" + base[1:], "e": base[:-1] + b"x", "f": base, "g": b"", "h": b"", "i": base[: 1 << 20], "j": base[1 : (1 << 20) + 1]}
    for name, data in texts.items():
        (tmp_path / name).write_bytes(data)
    files = stamped_inventory(spark, str(tmp_path)).select("path", "size", F.lit("0" * 64).alias("digest"))  # all digests collide
    for segment in (1 << 20, 64 << 20):
        got = sorted(tuple(r) for r in equal_files(files, str(tmp_path), segment).collect())
        n = len(base)
        assert got == [("a", "a", n, 3), ("a", "b", n, 3), ("a", "f", n, 3), ("c", "c", n, 2), ("c", "e", n, 2), ("g", "g", 0, 2), ("g", "h", 0, 2)]
    assert equal_files(files.limit(0), str(tmp_path)).count() == 0
    pairs = spark.createDataFrame([("a", "b", len(base)), ("a", "d", len(base))], "path string, other string, size long")
    plan = equal_pairs(pairs, str(tmp_path))._jdf.queryExecution().toString()
    assert "content" not in plan and {r.other: r.same for r in equal_pairs(pairs, str(tmp_path), 1 << 20).collect()} == {"b": True, "d": False}


def test_walk_of_a_flat_folder_in_rounds(spark, tmp_path):
    from twinspark.sources.config import load_ignore
    from twinspark.sources.inventory import names_below

    flat = tmp_path / "flat"
    flat.mkdir()
    for i in range(100_000):
        os.mknod(flat / f"f{i}")
    for i in range(40):
        put(tmp_path, **{f"tree__{i % 7}__{i}__deep__x.log": "1", f"tree__{i % 7}__{i}__y": "2"})
    put(tmp_path, skip__me="3", **{".twinspark__ignore": "*.log\nskip/\n"})
    os.chmod(tmp_path / "skip", 0o000)  # an ignored folder is never opened
    rules = load_ignore(str(tmp_path))
    for enough in (50, 20_000):
        names = names_below(spark, str(tmp_path), True, rules, enough)
        assert names.count() == 100_040 and names.distinct().count() == 100_040 and names.where("path like 'tree/%/y'").count() == 40
    assert names.agg(F.max(F.length("path"))).first()[0] < 20
    os.chmod(tmp_path / "skip", 0o755)
    assert names_below(spark, str(tmp_path), False).count() == 0 and stamped_inventory(spark, str(flat)).count() == 100_000


def test_report_opens_no_file(spark, tmp_path):
    """After the scan, files may be gone: the report is written from what the scan found."""
    from twinspark.operators.dedup import write_report

    root = str(tmp_path / "w")
    initialize_workspace(root)
    put(root, a="same", b="same", c="alone", d="also alone")
    found = scan(spark, root)
    for name in "abcd":
        os.remove(f"{root}/{name}")
    write_report(found.files, f"{tmp_path}/report", True, found.groups)
    lines = sorted(line for p in Path(f"{tmp_path}/report").glob("part-*") for line in p.read_text().splitlines())
    assert lines == ['0\t"c"', '0\t"d"', '1\t"a"', '1\t"b"']


def test_generations(spark, tmp_path):
    from twinspark.plans.scan import StateTable

    initialize_workspace(str(tmp_path))
    one, two = (StateTable(spark, str(tmp_path), "setup", "a long") for _ in range(2))
    rows = spark.range(2).withColumnRenamed("id", "a")
    (one.folder / "gen=1").mkdir(parents=True)  # another writer is at work on it
    assert one.commit(rows) == 2 and two.commit(rows) == 3 and two.read().count() == 2
    assert one.commit(two.read().limit(1)) == 4 and one.read().count() == 1
    assert sorted(p.name for p in one.folder.glob("gen=*")) == ["gen=1", "gen=3", "gen=4"] and not list(one.folder.glob("current.json.*"))


def test_unsafe_state_files(spark, tmp_path):
    from twinspark.plans.scan import StateTable, regular_state

    initialize_workspace(str(tmp_path))
    table = StateTable(spark, str(tmp_path), "setup", "a long")
    table.commit(spark.range(2).withColumnRenamed("id", "a"))
    assert table.read().count() == 2 and not regular_state(tmp_path / "none")
    os.link(table.folder / "current.json", tmp_path / "second")
    with pytest.raises(ValueError, match="unsafe"):
        table.read()
    os.unlink(tmp_path / "second")
    os.rename(table.folder / "current.json", tmp_path / "moved")
    os.symlink(tmp_path / "moved", table.folder / "current.json")
    with pytest.raises(ValueError, match="unsafe"):
        table.read()


EVENT = "event_id long, run_id string, time_ns long"


def run_batches(spark, folder, batches, **options):
    """Each batch is added to the stream's folder and taken by a query that starts anew from the checkpoint."""
    from twinspark.streaming.telemetry_stream import events_stream, write_events

    schema = spark.createDataFrame([], EVENT).schema
    for rows in batches:
        spark.createDataFrame(rows, EVENT).repartition(2).write.mode("append").parquet(f"{folder}/in")
        write_events(events_stream(spark, f"{folder}/in", schema), f"{folder}/out", f"{folder}/check", start="time_ns", **options).awaitTermination()
    return schema


def test_stream_caps_each_run(spark, tmp_path):
    from twinspark.streaming.telemetry_stream import read_events, read_runs

    batches = [[(0, "a", 5), (1, "a", 4), (2, "b", 9)], [(10, "a", 1), (11, "c", 7), (13, "c", 7), (12, "c", 8)], [(20, "d", 6)]]
    schema = run_batches(spark, tmp_path, batches, cap=2)
    assert sorted((r.run_id, r.event_id) for r in read_events(spark, f"{tmp_path}/out", schema).collect()) == [("a", 0), ("a", 1), ("b", 2), ("c", 11), ("c", 12), ("d", 20)]
    runs = {r.run_id: (r.accepted, r.dropped, r.started_unix_ns) for r in read_runs(spark, f"{tmp_path}/out").collect()}
    assert runs == {"a": (2, 1, 4), "b": (1, 0, 9), "c": (2, 1, 7), "d": (1, 0, 6)}  # the start is the first batch's
    run_batches(spark, tmp_path, [[(30, "a", 0)]], cap=2)  # a restart goes on from the state
    assert {r.run_id: (r.accepted, r.dropped) for r in read_runs(spark, f"{tmp_path}/out").collect()}["a"] == (2, 2)


def test_stream_keeps_newest_runs_and_the_current_one(spark, tmp_path):
    """Retention goes by start; a run that arrives last stays although its clock was set back."""
    from twinspark.streaming.telemetry_stream import kept_runs, read_events, read_runs

    schema = run_batches(spark, tmp_path, [[(1, "later", 2000), (2, "old", 500)], [(3, "earlier", 1000)]], cap=9)
    held = lambda keep: sorted(r.run_id for r in kept_runs(read_runs(spark, f"{tmp_path}/out"), keep).collect())
    assert held(1) == ["earlier"] and held(2) == ["earlier", "later"] and held(3) == ["earlier", "later", "old"]
    assert [(r.event_id, r.run_id) for r in read_events(spark, f"{tmp_path}/out", schema, 1).collect()] == [(3, "earlier")]
    assert kept_runs(read_runs(spark, f"{tmp_path}/out").limit(0), 2).count() == 0


def test_generations_as_a_stream(spark, tmp_path):
    from twinspark.streaming.snapshot_stream import changes_stream

    root = str(tmp_path / "w")
    initialize_workspace(root)
    folder = f"{root}/.twinspark/state"

    def taken():
        out = changes_stream(spark, folder).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        out.awaitTermination()
        return sorted((r.generation, r.change, r.path) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    put(root, a="one", b="two", c="three")
    scan(spark, root)
    first = [(1, "added", p) for p in "abc"]
    assert taken() == first
    put(root, b="2222", d="new")
    os.remove(f"{root}/c")
    scan(spark, root)
    scan(spark, root)  # nothing changed
    second = [(2, "added", "d"), (2, "changed", "b"), (2, "gone", "c")]
    assert taken() == first + second and taken() == first + second  # restarted: each change once
    put(root, e="x")
    scan(spark, root)
    assert taken() == first + second + [(4, "added", "e")]


def test_config(tmp_path):
    (tmp_path / "c.toml").write_text('digest = "blake3"\nunknown = 1\ndecay = 1\n')
    assert Config.load(tmp_path / "c.toml").digest == "blake3" and Config.load(tmp_path / "none.toml") == Config()
    (tmp_path / "c.toml").write_text('event_cap = "many"\n')
    with pytest.raises(TypeError):
        Config.load(tmp_path / "c.toml")
    with pytest.raises(ValueError):
        Config(decay=0)
    assert use_color("auto", True) and not use_color("auto", True, True) and not use_color("never", True) and use_color("always", False)


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"backend":"cpu","trial":0,"steady_ms":1.5}\n{"backend":"gpu","trial":1}\n')
    assert [r.steady_ms for r in records.read_jsonl(spark, f"file://{tmp_path}/a.jsonl").orderBy("trial").collect()] == [1.5, None]
    (tmp_path / "a.csv").write_text("variant,paired_trial,shape,phase,rows,cache_bytes,operations,elapsed_ms,verified\nnew,1,pairs,scan,10,2,3,4.5,true\n")
    assert records.read_csv(spark, f"file://{tmp_path}/a.csv").first().elapsed_ms == 4.5
    (tmp_path / "r.tsv").write_text('1\t"a"\n1\t"b\\"c"\n0\t"z"\n')
    assert {r.group: r.paths for r in records.read_groups(spark, f"file://{tmp_path}/r.tsv").collect()} == {0: ["z"], 1: ["a", 'b"c']}
    row = spark.range(1).select(records.key_values(F.lit("run.a=1 x=no ms=2.5")).alias("x")).first()
    assert [tuple(x) for x in row.x] == [("run.a", 1.0), ("ms", 2.5)]


def test_stream_of_many_files(spark, tmp_path):
    from twinspark.streaming.telemetry_stream import events_stream, read_events, read_runs, windowed_counts, write_events

    source = spark.createDataFrame([(i, str(i % 3), i) for i in range(30)], EVENT)
    source.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = events_stream(spark, f"{tmp_path}/in", source.schema, 1)
    write_events(stream, f"{tmp_path}/out", f"{tmp_path}/check", cap=4).awaitTermination()
    kept = read_events(spark, f"{tmp_path}/out", source.schema)
    assert kept.groupBy("run_id").count().where("count <> 4").count() == 0 and kept.count() == 12
    assert tuple(read_runs(spark, f"{tmp_path}/out").agg(F.sum("accepted"), F.sum("dropped")).first()) == (12, 18)
    timed = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{tmp_path}/in")
    assert windowed_counts(timed).isStreaming


def test_cli(tmp_path, spark):
    from twinspark.cli import main

    assert main(["new", str(tmp_path)]) == 0
    put(tmp_path, a="q", b="q")
    assert main(["scan", str(tmp_path), "--output", f"{tmp_path}-report"]) == 0
    assert 'a"' in "".join(p.read_text() for p in Path(f"{tmp_path}-report").glob("part-*"))
    assert main(["scan", str(tmp_path)]) == 0
    from twinspark.plans.scan import StateTable
    from twinspark.schema import METRICS, RUNS

    runs = StateTable(spark, str(tmp_path), "telemetry/runs", RUNS).read()
    assert runs.count() == 2 and {r.status for r in runs.collect()} == {"complete"}
    (tmp_path / ".twinspark" / "config.toml").write_text("history_runs = 1\nunmatched = true\n")
    put(tmp_path, c="alone")
    assert main(["scan", str(tmp_path), "--output", f"{tmp_path}-all"]) == 0
    assert '0\t"c"' in "".join(p.read_text() for p in Path(f"{tmp_path}-all").glob("part-*"))  # unmatched, by the settings
    last = StateTable(spark, str(tmp_path), "telemetry/runs", RUNS).read().collect()
    metrics = {r.name: r.value for r in StateTable(spark, str(tmp_path), "telemetry/metrics", METRICS).read().where(F.col("run_id") == last[0].run_id).collect()}
    assert len(last) == 1 and metrics["scanned"] == 3 and metrics["matches"] == 2
    assert main(["merge", str(tmp_path), str(tmp_path / "nowhere")]) in (0, 2) and main(["clean", str(tmp_path)]) == 0


def test_archive_and_train_commands(spark, tmp_path):
    from twinspark.cli import main
    from twinspark.schema import EVENTS, METRICS, PARAMETERS, RUNS
    from twinspark.sources.history import at_most, read_history

    def put_history(name, run, odd=0):
        rows = {"runs": (RUNS, [(run, 1, None, "complete", *[None] * 5, *[0] * 6)]), "events": (EVENTS, [(k, run, "log", "n", "info", "m", "cpu", 0, 0, 0, k, k, odd, 1.0, "u", 0) for k in (1, 2)]), "metrics": (METRICS, [(run, "n", 1.0, "u")]), "parameters": (PARAMETERS, [(run, "c", "n", "v")])}
        for table, (schema, values) in rows.items():
            spark.createDataFrame(values, schema).write.parquet(f"{tmp_path}/{name}/{table}")
        return f"{tmp_path}/{name}"

    a, b, c = put_history("a", "ra"), put_history("b", "rb"), put_history("c", "ra", 7)
    assert main(["archive", a, b, a, "--output", f"{tmp_path}/u"]) == 0
    union = read_history(spark, f"{tmp_path}/u")
    assert union.runs.count() == 2 and union.events.count() == 4
    assert main(["archive", a, c, "--output", f"{tmp_path}/v"]) == 2 and not (tmp_path / "v").exists()
    assert main(["archive", a, "--output", f"{tmp_path}/u"]) == 2 and not [p for p in os.listdir(tmp_path) if ".new-" in p]
    assert main(["archive", a, b, "--output", f"{tmp_path}/late", "--timeout", "0.01"]) == 2 and not (tmp_path / "late").exists()
    assert main(["archive", a, b, "--output", f"{tmp_path}/soon", "--timeout", "600"]) == 0
    put(tmp_path, corpus__x="12345678" * 1000, corpus__y="1")
    assert main(["select", f"{tmp_path}/corpus"]) == 0 and main(["select", f"{tmp_path}/corpus", f"{tmp_path}"]) == 2
    spark.range(1).write.parquet(f"{tmp_path}/d/runs")
    assert main(["archive", f"{tmp_path}/d", "--output", f"{tmp_path}/w"]) == 2
    with pytest.raises(ValueError):
        at_most(spark.range(4), 3, "models")
    spark.range(50).selectExpr("'cpu' as backend", "(id + 1) * 1000000 as bytes", "65536L as batch_bytes", "double(id % 3) as contention", "1.0 + id as ms").write.parquet(f"{tmp_path}/obs")
    assert main(["train", f"{tmp_path}/obs", "--output", f"{tmp_path}/fits"]) == 0 and spark.read.parquet(f"{tmp_path}/fits").count() == 1


def test_training_on_corpora(spark, tmp_path):
    """Files are measured in tasks; a second training starts from what the first one left, decayed."""
    import random

    from twinspark.cli import main
    from twinspark.plans.train import BACKENDS, COSTS, estimated, measured
    from twinspark.plans.scan import StateTable

    work, one, two = (str(tmp_path / n) for n in ("work", "one", "two"))
    initialize_workspace(work)
    (tmp_path / "work" / ".twinspark" / "ignore").write_text("skip*\n")
    random.seed(3)
    for folder in (one, two):
        os.makedirs(folder)
        for i in range(12):
            (Path(folder) / f"f{i}").write_bytes(random.randbytes(1000 * 4 ** (i % 6)))
        (Path(folder) / "skipped").write_bytes(b"x" * 100)
    assert main(["train", one, "--workspace", work]) == 0
    state = {r.backend: r for r in StateTable(spark, work, "costs", COSTS).read().collect()}
    assert state.keys() == BACKENDS.keys() and all(r.samples == 12 and r.weight == 12 for r in state.values())
    assert main(["train", two, "--workspace", work, "--output", f"{tmp_path}/fits"]) == 0
    state = {r.backend: r for r in StateTable(spark, work, "costs", COSTS).read().collect()}
    assert all(r.samples == 24 and r.weight == pytest.approx(12 * 0.9 + 12) for r in state.values()) and spark.read.parquet(f"{tmp_path}/fits").count() == len(BACKENDS)
    files = spark.createDataFrame([("x", 1 << 20)], "path string, size long")
    assert {r.backend for r in estimated(spark, work, files).collect()} == set(BACKENDS)
    assert main(["train", one, f"{one}/", "--workspace", work]) == 2 and main(["train", one]) == 2  # overlapping; no output
    rows = measured(stamped_inventory(spark, one), one, ("sha256",)).collect()
    assert len(rows) == 13 and all(r.ms > 0 and r.bytes == os.path.getsize(f"{one}/{r.path}") for r in rows)


def test_absolute_paths_are_checked(spark):
    from twinspark.functions.scalars import absolute_or_fail

    df = spark.createDataFrame([("/a",), ("/b/c",)], "path string")
    assert [r.p for r in df.select(absolute_or_fail(F.col("path")).alias("p")).collect()] == ["/a", "/b/c"]
    for bad in ("a", "", "./a"):
        with pytest.raises(Exception, match="not an absolute path"):
            df.unionByName(spark.createDataFrame([(bad,)], "path string")).select(absolute_or_fail(F.col("path")).alias("p")).collect()
