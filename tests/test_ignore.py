"""Ignore rules: against git itself, against a direct recursion, and at their limits."""

import random
import re
import shutil
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from twinspark.functions.ignore import MAX_RULES, STATE_DIR, can_prune, is_ignored, parse_rules, scope_rules, scoped_rule
from twinspark.functions.rule_automaton import RuleAutomaton, components


def judge(text):
    return RuleAutomaton(parse_rules(text), STATE_DIR).ignored


def fits(pattern, path):
    return judge("/" + pattern)(path)


def recursion(glob, path):
    """A glob of bytes over a path, written from its definition: no automaton, no regular expression of the whole."""
    if not glob:
        return not path
    if glob == b"**" or re.fullmatch(rb"\*\*+", glob):
        return bool(path)
    if found := re.match(rb"\*\*+/", glob):
        rest = glob[found.end() :]
        return recursion(rest, path) or any(recursion(rest, path[i + 1 :]) for i, c in enumerate(path) if c == 47)
    if glob[:1] == b"*":
        return any(recursion(glob[1:], path[i:]) for i in range(len(path) + 1) if 47 not in path[:i])
    if glob[:1] == b"[":
        end = glob.index(b"]", 2)
        inside = glob[1:end]
        held = set(inside.strip(b"!"))
        return bool(path) and path[0] != 47 and (path[0] in held) != (inside[:1] == b"!") and recursion(glob[end + 1 :], path[1:])
    return bool(path) and (glob[0] == path[0] or (glob[:1] == b"?" and path[0] != 47)) and recursion(glob[1:], path[1:])


def test_globs_against_recursion():
    random.seed(11)
    parts = ["a", "b", "*", "?", "ab", "*b", "a*", "[ab]", "[!a]b", "a*b", "?*", "é", "*é?", "a[é]*"]
    for _ in range(6000):
        pattern = "/".join(random.choice([*parts, "**"]) for _ in range(random.randint(1, 4)))
        path = "/".join("".join(random.choice("abé") for _ in range(random.randint(1, 3))) for _ in range(random.randint(1, 4)))
        verdict = any(recursion(pattern.encode(), "/".join(path.split("/")[: k + 1]).encode()) for k in range(path.count("/") + 1))
        assert fits(pattern, path) == verdict, (pattern, path)


@pytest.mark.skipif(not shutil.which("git"), reason="no git")
def test_rules_against_git(tmp_path):
    random.seed(12)
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    names = ["log", "x.log", "out", "out1", "src", "k9", "Ab", "[x]", "a b", "é", "tmp~"]
    tokens = ["*.log", "out", "out*", "?ut", "src", "**", "*", "[a-z][0-9]", "[[:upper:]]*", "[!a-m]*", "\\[x\\]", "a\\ b", "é", "*~", "k?", "**x", "[]x[]*", "[--k]*"]
    for round_ in range(25):
        lines = []
        for _ in range(random.randint(1, 12)):
            body = "/".join(random.choice(tokens) for _ in range(random.choice([1, 1, 2, 2, 3])))
            lines.append(random.choice(["", "", "", "!"]) + random.choice(["", "", "/"]) + body + random.choice(["", "", "/"]) + random.choice(["", "", "  "]))
        text = "\n".join(["# note", "", *lines]) + "\n"
        (tmp_path / ".gitignore").write_text(text, encoding="utf-8")
        paths = sorted({"/".join(random.choice(names) for _ in range(random.randint(1, 4))) for _ in range(150)})
        given = "".join(p + "\0" for p in paths)
        found = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", "-z", "--stdin"], input=given.encode(), capture_output=True)
        ignored = set(filter(None, found.stdout.decode().split("\0")))
        mine = judge(text)
        assert {p for p in paths if mine(p)} == ignored, (round_, text)


def test_lines():
    rules = parse_rules("﻿# c\n\\#x\r\n!\\!y\n/\n//\nlast  \nkept\\ \nkept\\\\ \n/top\nlow/\nmid/dle\n  lead\n")
    assert [tuple(r) for r in rules] == [
        ("**/\\#x", False, False), ("**/\\!y", True, False), ("**/last", False, False), ("**/kept\\ ", False, False), ("**/kept\\\\", False, False), ("top", False, False),
        ("**/low", False, True), ("mid/dle", False, False), ("**/  lead", False, False),
    ]
    assert parse_rules("") == [] and len(parse_rules("a\n" * MAX_RULES)) == MAX_RULES
    for text in ("a\n" * (MAX_RULES + 1), "x" * ((1 << 20) + 1)):
        with pytest.raises(ValueError):
            parse_rules(text)


def test_what_never_fits():
    for pattern in ("a\\", "[a", "x[", "[", "[!", "[]", "[!]", "[[:alpha:]", "a[\\", "[[:no"):
        assert components(pattern) is None and not fits(pattern, "a"), pattern
    assert not fits("[[:nothing:]]", "a") and fits("[![:nothing:]]", "a") and not fits("[/]", "a") and not fits("a[/]b", "a/b") and not fits("[z-a]", "m")
    assert fits("[]a]", "]") and fits("[!]a]", "b") and fits("[a-]", "-") and fits("[\\]]", "]") and fits("[a\\-z]", "-") and not fits("[a\\-z]", "b") and fits("[[]", "[")
    assert fits("??", "é") and not fits("?", "é") and fits("*", "é")  # names are bytes


def test_ancestors_and_state_folder():
    mine = judge("cache/\n!cache/keep\nlogs/*\n!logs/keep/\n*.o\n!/lib/*.o\nx/**\n!x/y\n")
    assert mine("cache/keep") and mine("a/cache/b/c") and not mine("cache") and mine("cache", True)
    assert mine("logs/a") and not mine("logs/keep/a") and not mine("logs/keep", True) and mine("logs/keep")
    assert mine("src/a.o") and not mine("lib/a.o") and mine("lib/deep/a.o") and mine("x/z/y") and not mine("x/y") and not mine("x", True)
    assert mine(f"a/{STATE_DIR}/b") and mine(STATE_DIR, True) and not judge("!*")("a") and judge("")(f"{STATE_DIR}/x")


def test_columns(spark):
    rules = parse_rules("*.bin\ndata/\n!a.bin\n")
    rows = [("a.bin", False), ("b.bin", False), ("data", True), ("data", False), ("data/x", False), ("q/b.bin/c", None), (None, True)]
    df = spark.createDataFrame(rows, "path string, folder boolean").repartition(3)
    got = {(r.path, r.folder): (r.x, r.p) for r in df.select("path", "folder", is_ignored(rules, F.col("path"), F.col("folder")).alias("x"), can_prune(rules, F.col("path")).alias("p")).collect()}
    assert {k: v[0] for k, v in got.items()} == {("a.bin", False): False, ("b.bin", False): True, ("data", True): True, ("data", False): False, ("data/x", False): True, ("q/b.bin/c", None): True, (None, True): None}
    assert got[("data", False)][1] and got[(None, True)][1] is None
    assert df.limit(0).where(is_ignored(rules, F.col("path"))).count() == 0


def test_scopes(spark):
    lines = ["*.log", "!kept", "/top/", "a/b", "low/", "sp ", "!/x", "[a]b"]
    for subtree, under in (("pro", "pro"), ("p*q", "p*q"), ("a/[b]", "a/[b]")):
        merged = "\n".join(scoped_rule(line, subtree)[0] for line in lines)
        alone, whole = judge("\n".join(lines)), judge(merged)
        for path in ("x.log", "d/x.log", "kept", "d/kept", "top/a", "d/top/a", "a/b", "d/a/b", "low/x", "e/low/x", "sp", "x", "ab", "d/ab"):
            assert whole(f"{under}/{path}") == alone(path), (subtree, path)
        assert not whole("x.log") and not whole("other/x.log") and not whole("pxq/x.log")
    df = spark.createDataFrame([(line,) for line in lines], "rule string").withColumn("sub", F.lit("a[b]*?\\"))
    assert {r.rule: r.s for r in df.select("rule", scope_rules(F.col("rule"), F.col("sub")).alias("s")).collect()} == {line: scoped_rule(line, "a[b]*?\\")[0] for line in lines}
    assert scoped_rule("*.x", "../out") == ("*.x", True) == scoped_rule("*.x", None) and scoped_rule("*.x", "..up")[1] is False
    with pytest.raises(ValueError):
        scoped_rule("x", "a\nb")


def test_many_rules_and_hard_patterns():
    kinds = ["*.e{0}", "name{0}", "/d{0}/s/", "p{0}*", "a/**/x{0}.?at", "!keep{0}", "dir/*/f{0}[0-9]*.log", "b{0}**c*d"]
    rules = [kinds[i % 8].format(i) for i in range(MAX_RULES)]
    mine, began = judge("\n".join(rules)), time.monotonic()
    paths = [f"d{i % 90}/s/q{i % 77}/file{i}.e{i % 9000}" for i in range(30_000)]
    assert sum(map(mine, paths)) == sum(int(p.rsplit("e", 1)[1]) in range(0, MAX_RULES, 8) or (int(p[1 : p.index("/")]) % 8 == 2) for p in paths)
    assert time.monotonic() - began < 20  # 1,000 rules on 2,000 paths took 33 s as regular expressions
    hard, began = judge("/" + "a*" * 200 + "b\n" + "**/a/" * 200 + "z\n" + "[" + "[:alpha:]" * 2000), time.monotonic()
    assert not hard("a" * 3000) and hard("a" * 3000 + "b") and not hard("a/" * 1500 + "y") and hard("a/" * 1500 + "z")
    assert time.monotonic() - began < 20
    deep = judge("deep")
    assert deep("x/" * 3000 + "deep") and not deep("x/" * 3000 + "y")


def test_memory_is_bounded(monkeypatch):
    from twinspark.functions import rule_automaton

    monkeypatch.setattr(rule_automaton, "MEMORY", 4000)
    mine = judge("*.x\nq/\n")
    assert [mine(f"f{i % 300}/g{i}/n{i}.{'xy'[i % 2]}") for i in range(3000)] == [i % 2 == 0 for i in range(3000)]
    automaton = RuleAutomaton(parse_rules("*.x"), STATE_DIR)
    [automaton.ignored(f"f{i}/n{i}") for i in range(3000)]
    assert len(automaton.fitting) <= automaton.most < 40 and len(automaton.folders) <= automaton.most + 2


