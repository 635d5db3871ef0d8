"""Ignore files as git reads them: the last rule that fits decides, and nothing comes back out of an ignored folder."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from twinspark.functions.rule_automaton import RuleAutomaton
from twinspark.storage import ship

STATE_DIR = ".twinspark"
MAX_BYTES, MAX_RULES = 1 << 20, 4096
#: A line is a mark of negation, one of the root, the pattern, and one of folders.
_LINE = re.compile(r"(?P<negate>!?)(?P<root>/?)(?P<body>.*?)(?P<folder>/?)", re.S)
_SPECIAL = re.compile(r"[*?\[\]\\]")


class Rule(NamedTuple):
    """pattern: seen from the root, so what may be anywhere begins with **/."""

    pattern: str
    negate: bool
    directory: bool


def _trimmed(line: str) -> str:
    """Without a carriage return and trailing spaces; an escaped one stays."""
    characters = re.findall(r"\\.|.", line.removesuffix("\r"), re.S)
    while characters and characters[-1] == " ":
        characters.pop()
    return "".join(characters)


def parse_rules(text: str) -> list[Rule]:
    """The rules of an ignore file, without comments and empty lines; too large a file is an error."""
    if len(text.encode("utf-8")) > MAX_BYTES:
        raise ValueError("ignore file exceeds 1 MiB")
    lines = [_LINE.fullmatch(line) for line in map(_trimmed, text.removeprefix("\ufeff").split("\n")) if not line.startswith("#")]
    found = [Rule(("" if m["root"] or "/" in m["body"] else "**/") + m["body"], bool(m["negate"]), bool(m["folder"])) for m in lines if m["body"]]
    if len(found) > MAX_RULES:
        raise ValueError("ignore file exceeds 4096 rules")
    return found


@lru_cache(maxsize=4)
def automaton(rules: tuple[Rule, ...]) -> RuleAutomaton:
    """Once a Python worker and list of rules."""
    return RuleAutomaton(rules, STATE_DIR)


def is_ignored(rules: list[Rule], path: Column, is_dir: Column | bool = False) -> Column:
    """Whether a relative path or any of its ancestors is ignored, null for null. The state folder always is.

    Names are compared as bytes, as git does. The rules travel with the function and are compiled where they run."""
    ship(SparkSession.active())
    shipped = tuple(rules)

    @F.arrow_udf("boolean")
    def run(paths: pa.Array, folders: pa.Array) -> pa.Array:
        judge = automaton(shipped).ignored
        return pa.array([None if p is None else judge(p, bool(d)) for p, d in zip(paths.to_pylist(), folders.to_pylist(), strict=True)], pa.bool_())

    return run(path, F.lit(is_dir) if isinstance(is_dir, bool) else is_dir)


def can_prune(rules: list[Rule], directory: Column) -> Column:
    """An ignored folder is skipped whole, later negations inside it or not."""
    return is_ignored(rules, directory, True)


def scoped_rule(line: str, subtree: str | None) -> tuple[str, bool]:
    """The rule for a subtree, seen from the root above it, and whether the source lies outside (then unchanged)."""
    if not subtree or subtree.split("/", 1)[0] == "..":
        return line, True
    if re.search(r"[\x00-\x1f\x7f]", subtree):
        raise ValueError("cannot scope ignore rules through a path with control characters")
    m = _LINE.fullmatch(line.rstrip(" "))
    deep = "" if m["root"] or "/" in m["body"] else "**/"
    place = _SPECIAL.sub(lambda c: "\\" + c[0], subtree)
    return f"{m['negate']}/{place}/{deep}{line[m.start('body') :]}", False


def scope_rules(rules: Column, subtree: Column) -> Column:
    """scoped_rule on columns, for rules kept in tables; the subtree must lie inside."""
    place = F.regexp_replace(subtree, r"([*?\[\]\\])", r"\\$1")
    deep = F.when(F.rlike(rules, F.lit(r"(?s)^!?[^/]*/? *$")) & ~F.rlike(rules, F.lit("^!?/")), "**/").otherwise("")
    return F.concat(F.regexp_extract(rules, "^(!?)", 1), F.lit("/"), place, F.lit("/"), deep, F.regexp_replace(rules, "^!?/?", ""))
