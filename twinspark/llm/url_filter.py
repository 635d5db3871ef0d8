"""URL filter: pattern rules indexed by their rarest literal token.

Every rule is a regular expression over host + path with literal tokens that any match must contain as whole
tokens. The rule is filed under the one of its tokens that the fewest URLs have; a URL fetches the rules filed
under its own tokens, and only those run their expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.llm.shared import ascii_lower, kind_of, picked, ship

#: Up to this many rules travel to the tasks in the closure (some MB); beyond it URLs are joined to the rules.
MAX_BROADCAST_RULES = 50_000
TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class UrlRule:
    """literals: tokens that every match contains whole. weight: the longest rule wins, then the smaller name."""

    name: str
    action: str
    pattern: str
    literals: tuple[str, ...]
    weight: int
    listed: bool = True


def site_rule(action: str, host: str, path: str) -> UrlRule:
    """Fits host and all its subdomains where the path starts with path (which begins with a slash)."""
    inner = re.findall(TOKEN, path)
    if inner and path[-1:].isascii() and path[-1:].isalnum():
        inner.pop()  # a prefix may end inside a token
    return UrlRule(host + path, action, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", (*re.findall(TOKEN, host), *inner), len(host) + len(path))


def word_rule(action: str, *words: str) -> UrlRule:
    """Fits URLs whose host has the words as hyphen or dot parts in a row; such rules name no verdict of a list."""
    return UrlRule("-".join(words), action, r"^(?:[^/]*[.-])?" + "[.-]".join(map(re.escape, words)) + r"(?:[.-][^/]*)?(?:/|$)", words, 0, False)


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """(host, path): host follows the first ://, lower-cased in A-Z; null and no :// give empty strings."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)


def token_counts(urls: DataFrame, tokens: list[str]) -> dict[str, int]:
    """In how many URLs of column `key` each of the rules' tokens occurs; at most one row a token comes back."""
    found = urls.select(F.explode(F.array_distinct(F.regexp_extract_all("key", F.lit(f"({TOKEN})"), F.lit(1)))).alias("token"))
    known = urls.sparkSession.createDataFrame([(t,) for t in tokens], "token string")
    return {r[0]: r[1] for r in found.join(F.broadcast(known), "token", "left_semi").groupBy("token").count().collect()}


def filed(rules: list[UrlRule], counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rules by their rarest token, and the rules without any token, which every URL must try."""
    index: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules):
        if rule.literals:
            index.setdefault(min(rule.literals, key=lambda t: (counts.get(t, 0), t)), []).append(i)
        else:
            always.append(i)
    return index, always


def judge_urls(pages: DataFrame, rules: list[UrlRule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", max_broadcast_rules: int = MAX_BROADCAST_RULES) -> DataFrame:
    """One row for each row of pages: id, host, path, rule, pattern, verdict.

    The longest listed rule that fits gives verdict and `rule`; without one the unlisted pattern rules decide
    (`pattern` names the first by name; block before allow), and without those the default. A null or relative URL
    has empty host and path and so takes the default. Repeated rows are judged each; an empty table gives none.
    """
    spark = pages.sparkSession
    ship(spark)
    host, path = url_parts(F.col("url"))
    urls = picked(pages, id=id_col, url=url_col).select("id", host.alias("host"), path.alias("path"))
    counts = token_counts(urls.select(F.concat("host", "path").alias("key")), sorted({t for r in rules for t in r.literals}))
    index, always = filed(rules, counts)
    order = {i: (not r.listed, -r.weight, r.action != "block", r.name) for i, r in enumerate(rules)}
    if len(rules) > max_broadcast_rules:
        return _judge_joined(urls, rules, index, always, order, default)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = re.compile(TOKEN)
        compiled = {i: re.compile(r.pattern, re.S) for i, r in enumerate(rules)}
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            rule, pattern, verdict = [], [], []
            for h, p in zip(hosts, paths, strict=True):
                key = h + p
                tried = {i for t in set(token.findall(key)) for i in index.get(t, ())}
                hit = min((order[i] + (i,) for i in (*tried, *always) if compiled[i].search(key)), default=None)
                r = rules[hit[-1]] if hit else None
                rule.append(r.name if r and r.listed else None)
                pattern.append(r.name if r and not r.listed else None)
                verdict.append(r.action if r else default)
            text = lambda x: pa.array(x, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), text(hosts), text(paths), text(rule), text(pattern), text(verdict)], names=["id", "host", "path", "rule", "pattern", "verdict"])

    return urls.mapInArrow(run, f"id {kind_of(urls, 'id')}, host string, path string, rule string, pattern string, verdict string")


def _judge_joined(urls: DataFrame, rules: list[UrlRule], index: dict, always: list[int], order: dict, default: str) -> DataFrame:
    """The same by a join on the token, for rule lists too long to broadcast."""
    spark = urls.sparkSession
    ranks = {i: n for n, i in enumerate(sorted(order, key=order.get))}
    rows = [(t, ranks[i], rules[i].pattern) for t, members in index.items() for i in members] + [("", ranks[i], rules[i].pattern) for i in always]
    by_token = spark.createDataFrame(rows, "token string, rank int, regex string")
    named = spark.createDataFrame([(ranks[i], r.name, r.listed, r.action) for i, r in enumerate(rules)], "rank int, name string, listed boolean, action string")
    keys = urls.select("host", "path").distinct().withColumn("key", F.concat("host", "path"))
    tokens = F.array_union(F.array(F.lit("")), F.regexp_extract_all("key", F.lit(f"({TOKEN})"), F.lit(1)))
    hits = keys.withColumn("token", F.explode(tokens)).join(by_token, "token").where(F.expr("key rlike regex"))
    won = hits.groupBy("host", "path").agg(F.min("rank").alias("rank")).join(named, "rank")
    return urls.join(won, ["host", "path"], "left").select(
        "id", "host", "path", F.when(F.col("listed"), F.col("name")).alias("rule"), F.when(~F.col("listed"), F.col("name")).alias("pattern"), F.coalesce("action", F.lit(default)).alias("verdict")
    )
