"""Quality rules under weak supervision, DataFrame and SQL functions only.

A rule looks at a measure of a text and votes drop or keep, or abstains, as most rules do on most texts: that one kind of
fault is absent says little. How often a rule's votes are right is not given. Expectation-maximisation finds it from how
rules agree, together with the share of bad texts: a rule that others confirm counts for much, one that they contradict
for little. A text's votes then give the posterior probability that it is good, which decides.

The votes on a text are one of 3^rules patterns, so all rows are counted by pattern once, and every step reads that small
table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspark.llm.shared import full_text, picked, remove, shared_root, stored

#: What parts words: space and \x09 to \x0d.
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS, MARKS = "#*$%&|<>", "!?"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STEPS = 25


@dataclass(frozen=True)
class Rule:
    """drop and keep are SQL conditions over the measured columns, in integers; a text that fits neither is left to others."""

    name: str
    drop: str
    keep: str = "false"

    def vote(self) -> Column:
        """1 keep, 0 drop, -1 abstain."""
        return F.when(F.expr(self.drop), 0).when(F.expr(self.keep), 1).otherwise(-1)


#: Each kind of bad text that these are meant for moves two measures or more, so that rules can confirm each other.
RULES = (
    Rule("symbols", "100 * n_symbols > 3 * word_chars"),
    Rule("punctuation", "100 * n_punctuation > 45 * n_words"),
    Rule("capitals", "100 * n_capitals > 30 * word_chars"),
    Rule("exclamations", "100 * n_marks > 20 * n_words"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("variety", "4 * n_distinct * n_distinct < 25 * n_words"),
    Rule("repeated_lines", "n_dup_lines >= 3 and 100 * n_dup_lines > 30 * n_lines"),
    Rule("word_length", "word_chars > 14 * n_words or word_chars < 2 * n_words"),
    Rule("prose", "false", "n_words >= 50 and 100 * n_punctuation <= 30 * n_words and 100 * n_symbols <= word_chars and 100 * n_capitals <= 15 * word_chars and 100 * n_repeat_words <= 20 * n_words"),
)
#: Where the search begins: the share of bad texts (one text is added to the count by it), and how often a vote is right.
SHARE_BAD, RIGHT = 0.1, 0.99
#: Rules that only ever say drop do not tell by themselves whether they are all right or all wrong, so the first belief
#: keeps counting as TRUST votes for each vote cast, at every size. No rule counts as right less often than by chance.
TRUST, LEAST = 0.5, 0.5


def _without(text: str, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and the measures of each row's whole text: n_words, n_distinct (words), word_chars, n_symbols, n_capitals,
    n_marks, n_punctuation, n_lines (with a word), n_dup_lines, n_repeat_words.

    A word in a three-word window that the text holds twice is counted once. Windows go by 64-bit hashes, so two
    different ones of a text are taken for the same with a chance of some 10^-10 for 100,000 words. Each step uses a
    column of the step before more than once, which keeps them apart in the plan."""
    rows = picked(docs, id=id_col, text=text_col).select("id", full_text().alias("text"))
    spaces = F.translate("text", BLANKS, " " * len(BLANKS))
    words = F.filter(F.split(spaces, " "), lambda w: w != "")
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    chars, whole = _without("text", BLANKS), F.length("text")
    rows = rows.select(
        "id", words.alias("w"), lines.alias("l"), chars.alias("word_chars"), (whole - _without("text", SYMBOLS)).alias("n_symbols"),
        (whole - _without("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).alias("n_capitals"), (whole - _without("text", MARKS)).alias("n_marks"), (whole - _without("text", PUNCTUATION)).alias("n_punctuation"),
    )
    pairs = "zip_with(slice(w, 1, size(w) - 2), slice(w, 2, size(w) - 2), (a, b) -> xxhash64(a, b))"
    windows = f"if(size(w) < 3, array(), zip_with({pairs}, slice(w, 3, size(w) - 2), (ab, c) -> xxhash64(ab, c)))"
    plain = ["word_chars", "n_symbols", "n_capitals", "n_marks", "n_punctuation"]
    counts = {"n_words": F.size("w"), "n_distinct": F.size(F.array_distinct("w")), "n_lines": F.size("l"), "n_dup_lines": F.size("l") - F.size(F.array_distinct("l"))}
    rows = rows.select("id", *(F.col(c).cast("long").alias(c) for c in plain), *(c.cast("long").alias(n) for n, c in counts.items()), F.expr(windows).alias("h"))
    kept = ["id", *plain, *counts]
    # Places of the windows in the order of their hashes, where any is there twice.
    rows = rows.select(*kept, F.expr("if(size(array_distinct(h)) = size(h), array(), sort_array(zip_with(h, sequence(1, size(h)), (v, i) -> named_struct('v', v, 'i', i))))").alias("s"))
    same = "zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (x, y) -> if(x.v = y.v, array(x.i, y.i), array()))"
    rows = rows.select(*kept, F.expr(f"if(size(s) = 0, array(), sort_array(array_distinct(flatten({same}))))").alias("p"))
    # A window covers three words, or as many as there are up to the next one.
    covered = "if(size(p) = 0, 0, 3 + aggregate(zip_with(slice(p, 1, size(p) - 1), slice(p, 2, size(p) - 1), (a, b) -> least(3, b - a)), 0, (t, d) -> t + d))"
    return rows.select(*kept, F.expr(covered).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


@dataclass(frozen=True)
class Estimate:
    """The share of bad texts, and how often each rule's votes are right."""

    share_bad: float
    right: tuple[float, ...]

    def good(self, votes: Column) -> Column:
        """Posterior probability that a text with these votes (an array) is good. The numbers are one array and not parts
        of the expression, so that the steps of the estimate share their compiled code."""
        weights = F.array(*(F.lit(math.log(right / (1 - right))) for right in self.right))
        terms = F.zip_with(votes, weights, lambda v, w: F.when(v == 1, w).when(v == 0, -w).otherwise(F.lit(0.0)))
        odds = F.aggregate(terms, F.lit(math.log((1 - self.share_bad) / self.share_bad)), lambda s, x: s + x)
        return 1 / (1 + F.exp(-odds))


def estimated(patterns: DataFrame, n_rules: int, steps: int = STEPS) -> Estimate:
    """Expectation-maximisation over patterns: v (array of votes), n (texts). Without texts the start stays."""
    found = Estimate(SHARE_BAD, (RIGHT,) * n_rules)
    for _ in range(steps):
        rows = patterns.select("n", "v", found.good(F.col("v")).alias("good"))
        good, bad = F.col("n") * F.col("good"), F.col("n") * (1 - F.col("good"))
        sums = [F.sum("n"), F.sum(bad)]
        for i in range(n_rules):
            vote = F.col("v")[i]
            sums += [F.sum(F.when(vote >= 0, F.col("n"))), F.sum(F.when(vote == 1, good).when(vote == 0, bad))]
        n, n_bad, *rest = (float(x or 0) for x in rows.agg(*sums).first())
        right = tuple(max(LEAST, (rest[2 * i + 1] / rest[2 * i] + TRUST * RIGHT) / (1 + TRUST)) if rest[2 * i] else RIGHT for i in range(n_rules))
        found = Estimate((n_bad + SHARE_BAD) / (n + 1), right)
    return found


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, steps: int = STEPS, threshold: float = 0.5) -> DataFrame:
    """For each row of docs: id, the measures, votes, good (posterior probability), base_failed and kept.

    kept: the base limits hold and good is the threshold or more. A null text counts as empty and fails the base
    limits; ids may repeat or be null; rows that repeat are judged alike; an empty table gives no rows; other columns
    are not read."""
    root = shared_root(docs.sparkSession)
    rows = measured(docs, id_col, text_col)
    rows = stored(rows.select("*", F.array(*(r.vote() for r in rules)).alias("votes")), f"{root}/measured")
    patterns = stored(rows.groupBy(F.col("votes").alias("v")).agg(F.count(F.lit(1)).alias("n")).coalesce(1), f"{root}/patterns")  # at most 3^rules rows
    found = estimated(patterns, len(rules), steps)
    remove(docs.sparkSession, f"{root}/patterns")
    rows = rows.withColumn("good", found.good(F.col("votes"))).withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("good") >= threshold))
