"""python -m twinspark.cli scan|merge|archive|train|select|new|clean ...; exit status 0, or 2 on failure."""

from __future__ import annotations

import argparse
import os
import sys
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from twinspark.session import session
from twinspark.storage import clear_scratch


@contextmanager
def limited(spark, seconds: float) -> Iterator[None]:
    """Jobs that run or begin later than that are cancelled, and it is an error; 0: never."""
    late, done = threading.Event(), threading.Event()

    def watch() -> None:
        if not done.wait(seconds):
            late.set()
            while not done.wait(0.05):
                spark.sparkContext.cancelAllJobs()

    if seconds > 0:
        threading.Thread(target=watch, daemon=True).start()
    try:
        yield
    except Exception:
        if not late.is_set():
            raise
    finally:
        done.set()
    if late.is_set():
        raise TimeoutError(f"not done within {seconds} seconds")


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="twinspark")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("scan", "new", "clean"):
        one = commands.add_parser(name)
        one.add_argument("root")
        if name == "scan":
            one.add_argument("--unmatched", action="store_true")
            one.add_argument("--output")
            one.add_argument("--rehash", action="store_true", help="use no cached digest")
        if name == "clean":
            one.add_argument("--recursive", action="store_true")
    merge = commands.add_parser("merge")
    merge.add_argument("target")
    merge.add_argument("sources", nargs="*", help="none: the workspaces below the target")
    merge.add_argument("-r", "--recursive", action="store_true", help="look for them at any depth")
    merge.add_argument("--move", action="store_true", help="remove the sources' state afterwards")
    union = commands.add_parser("archive")
    union.add_argument("inputs", nargs="+")
    union.add_argument("--output", required=True)
    union.add_argument("--timeout", type=float, default=0, help="seconds after which the union is given up; 0: never")
    train = commands.add_parser("train")
    train.add_argument("inputs", nargs="+", help="with --workspace: corpora, else Parquet with backend, bytes, batch_bytes, contention, ms")
    train.add_argument("--workspace", help="measures the corpora and keeps what is learnt here")
    train.add_argument("--output", help="Parquet for the solutions")
    select = commands.add_parser("select", help="the files of corpora that training would take")
    select.add_argument("corpora", nargs="+")
    given = parser.parse_args(args)
    try:
        from twinspark.plans.merge import clean_workspace, initialize_workspace, merge_workspaces

        if given.command == "new":
            print("\n".join(initialize_workspace(given.root)))
        elif given.command == "clean":
            print(clean_workspace(given.root, given.recursive))
        elif given.command == "merge":
            from twinspark.sources.inventory import discover_workspaces

            sources = given.sources or discover_workspaces(given.target, given.recursive, given.target)
            print(" ".join(f"merge_{k}={v}" for k, v in merge_workspaces(session(), given.target, sources, given.move).items()))
        elif given.command == "archive":
            from twinspark.operators.archive import archive_union, publish, totals_json
            from twinspark.sources.history import read_history

            spark = session()
            with limited(spark, given.timeout):
                whole, _, totals = archive_union([(i, read_history(spark, path)) for i, path in enumerate(given.inputs, 1)])
                publish(whole, given.output)
            print("\n".join(r.totals for r in totals_json(totals).orderBy("source_id").collect()))
        elif given.command == "train":
            from twinspark.plans.train import learn, train_corpora

            spark = session()
            if given.workspace:
                _, fits = train_corpora(spark, given.workspace, given.inputs)
            elif len(given.inputs) == 1 and given.output:
                _, fits = learn(spark.read.parquet(given.inputs[0]))
            else:
                raise ValueError("train takes --workspace and corpora, or one table and --output")
            if given.output:
                fits.write.mode("errorifexists").parquet(given.output)
            else:
                print("\n".join(" ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in fits.orderBy("backend").collect()))  # one a backend
        elif given.command == "select":
            from twinspark.operators.cache import fail_if_any
            from twinspark.plans.train import select as choose
            from twinspark.sources.config import Config
            from twinspark.sources.inventory import overlapping_roots, stamped_inventory

            spark = session()
            roots = [os.path.abspath(c) for c in given.corpora]
            fail_if_any(overlapping_roots(spark, roots), "corpora overlap")
            for root in roots:
                for row in choose(stamped_inventory(spark, root).select("path", "size"), Config(), root).orderBy("turn").collect():  # within training_files
                    print(f"{root}/{row.path}")
        else:
            from twinspark.operators.dedup import write_report
            from twinspark.plans.report import pretty
            from twinspark.plans.scan import record_run, scan, summary
            from twinspark.sources.config import Config, use_color

            spark, began, started = session(), time.monotonic(), time.time_ns()
            config = Config.load(os.path.join(given.root, ".twinspark", "config.toml"))
            found = scan(spark, given.root, config, rehash=given.rehash)
            if given.output:
                write_report(found.files, given.output, given.unmatched or config.unmatched, found.groups)
            record_run(spark, given.root, found.counters, started, config)
            print(summary(spark, found.counters), file=sys.stderr)
            print(pretty(spark, found.counters, time.monotonic() - began, use_color(config.color, sys.stdout.isatty(), "NO_COLOR" in os.environ)))
    except Exception as error:
        print(f"twinspark: {error}", file=sys.stderr)
        return 2
    finally:
        if (spark := SparkSession.getActiveSession()) is not None:
            clear_scratch(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main())
