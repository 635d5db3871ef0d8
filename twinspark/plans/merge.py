"""Merging workspaces, and their creation and removal."""

from __future__ import annotations

import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from twinspark.functions.ignore import scoped_rule
from twinspark.functions.scalars import absolute_key, absolute_or_fail, safe_relative
from twinspark.operators.archive import History, merge_by_run
from twinspark.operators.cache import difference, latest_wins
from twinspark.operators.model import newest_revisions
from twinspark.plans.scan import StateTable, regular_state
from twinspark.schema import MODEL_PARTS, SETUP_PARTS
from twinspark.sources.config import DEFAULT_IGNORE
from twinspark.sources.history import SCHEMAS
from twinspark.storage import materialized


def initialize_workspace(root: str) -> list[str]:
    """Writes config and ignore file where they are missing; returns which."""
    folder = Path(root) / ".twinspark"
    folder.mkdir(parents=True, exist_ok=True)
    made = []
    for name, text in (("config.toml", 'digest = "sha256"\n'), ("ignore", DEFAULT_IGNORE)):
        if not (folder / name).exists():
            (folder / name).write_text(text, encoding="utf-8")
            made.append(name)
    return made


def clean_workspace(root: str, recursive: bool = False) -> int:
    """Removes state folders (no links) and returns how many."""
    top = Path(root)
    found = [p for p in (top.rglob(".twinspark") if recursive else [top / ".twinspark"]) if p.is_dir() and not p.is_symlink()]
    for p in found:
        shutil.rmtree(p)
    return len(found)


def merged_rules(target: list[str], sources: list[tuple[str, list[str]]]) -> tuple[list[str], list[str]]:
    """(rules, warnings): target's lines with the sources' rules scoped to their subtrees, each once, in order."""
    out, warnings = list(target), []
    seen = set(out)
    for subtree, lines in sources:
        for line in lines:
            if not line or line.startswith("#"):
                continue
            text, outside = scoped_rule(line, subtree)
            if outside:
                warnings.append(line)
            if text not in seen:
                seen.add(text)
                out.append(text)
    return out, warnings


def replace_text(path: str, lines: list[str]) -> None:
    temporary = Path(f"{path}.new")
    temporary.write_text("\n".join(lines) + "\n", encoding="utf-8")
    os.replace(temporary, path)


def merge_caches(old: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """The archive of digests by absolute path: sources' relative rows under their roots, the last writer wins."""
    rows = old.withColumn("turn", F.lit(0))
    for i, (root, files) in enumerate(sources, 1):
        moved = files.where(safe_relative(F.col("path"))).withColumn("path", absolute_or_fail(absolute_key(F.lit(root), F.col("path"))))
        rows = rows.unionByName(moved.select(old.columns).withColumn("turn", F.lit(i)))
    return latest_wins(rows, "turn").select(old.columns)


def merge_histories(spark: SparkSession, target: str, sources: list[str]) -> tuple[int, int]:
    """Runs that the target does not know, with their rows, from each source in turn; returns how many runs and events."""
    tables = {n: StateTable(spark, target, f"telemetry/{n}", s) for n, s in SCHEMAS.items()}
    have = History(*(tables[n].read() for n in SCHEMAS))
    before, merged = have, have
    for source in sources:
        merged = merge_by_run(merged, History(*(StateTable(spark, source, f"telemetry/{n}", s).read() for n, s in SCHEMAS.items())))
    merged = History(*(materialized(getattr(merged, n)) for n in SCHEMAS))
    added = merged.runs.count() - before.runs.count(), merged.events.count() - before.events.count()
    if added[0]:
        for name in reversed(list(SCHEMAS)):  # runs last: children without their run are not met by any reader
            tables[name].commit(getattr(merged, name))
    return added


def merge_parts(spark: SparkSession, target: str, sources: list[str], name: str, schema: StructType, local: str) -> int:
    """Model or setup contributions of a strictly greater revision than the target's; returns how many rows changed."""
    table = StateTable(spark, target, name, schema)
    old = table.read()
    merged = old
    for source in sources:
        merged = newest_revisions(merged, StateTable(spark, source, name, schema).read(), local)
    merged = materialized(merged)
    changed = merged.join(old.select("source", "key", "revision"), ["source", "key", "revision"], "left_anti").count()
    if changed:
        table.commit(merged)
    return changed


def merge_workspaces(spark: SparkSession, target: str, sources: list[str], move: bool = False) -> dict:
    """Merges the sources' digests, telemetry, model and setup contributions and ignore rules into target's; merging again
    changes nothing. With move the sources' state folders are removed at the end, none before all is merged. Returns
    counters."""
    table = StateTable(spark, target, "absolute")
    whole = sorted({str(Path(s).resolve()) for s in sources} - {str(Path(target).resolve())})
    states = [(s, StateTable(spark, s).read()) for s in whole]
    old = table.read()
    merged = old
    for source in whole:  # what the source itself has merged before, by absolute path
        merged = latest_wins(merged.withColumn("turn", F.lit(0)).unionByName(StateTable(spark, source, "absolute").read().withColumn("turn", F.lit(1))), "turn").select(old.columns)
    merged = materialized(merge_caches(merged, states))
    changed = difference(merged, old).where("side = 'left'").count()
    if changed:
        table.commit(merged)
    local = str(Path(target).resolve()).encode("utf-8")
    runs, events = merge_histories(spark, target, whole)
    models = merge_parts(spark, target, whole, "model", MODEL_PARTS, local)
    setups = merge_parts(spark, target, whole, "setup", SETUP_PARTS, local)
    ignore = Path(target) / ".twinspark" / "ignore"
    before = ignore.read_text(encoding="utf-8").splitlines() if regular_state(ignore) else []
    own = []
    for source in whole:
        file = Path(source) / ".twinspark" / "ignore"
        own.append((os.path.relpath(source, Path(target).resolve()), file.read_text(encoding="utf-8").splitlines() if regular_state(file) else []))
    rules, warnings = merged_rules(before, own)
    if rules != before:
        replace_text(str(ignore), rules)
    removed = sum(clean_workspace(s) for s in whole) if move else 0
    return {
        "workspaces": len(whole), "model_parts": models, "setup_parts": setups, "cache_rows": changed, "telemetry_runs": runs, "telemetry_events": events, "rules_added": len(rules) - len(before), "warnings": len(warnings),
        "sources_removed": removed,
    }
