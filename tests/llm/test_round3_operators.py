"""Hard negatives, quality rules and fill-in-middle against brute force, and odd inputs: nulls, empty and long texts, ties, repeated rows, empty tables."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("twinspark.llm")

SCHEMA = "doc_id long, text string, id long, n long, output string, v string, w string, good double"
VECTORS = "vec_id long, embedding array<double>, label int, id long, score long, q string"
BLANK = " \t\n\x0b\x0c\r"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", "y", "z", 0.5) for i, t in rows], SCHEMA).repartition(3)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, k, 7, 8, "x") for i, v, k in rows], VECTORS).repartition(3)


def brute_negatives(rows, positives=5, negatives=3, limit=None):
    known = [(i, [math.floor(256 * x) for x in v], k) for i, v, k in rows if i is not None and k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    cut = (lambda s: max(-limit, min(limit, s))) if limit else (lambda s: s)
    out = Counter()
    for ai, av, ak in known:
        if ai % 50:
            continue
        scored = [(-cut(sum(x * y for x, y in zip(av, v))), i, k) for i, v, k in known if i != ai]
        for s, i, k in sorted(x for x in scored if x[2] == ak)[:positives]:
            fit = sorted((t, j) for t, j, other in scored if other != ak and 50 * -s <= 100 * -t <= 95 * -s)[:negatives]
            out.update((ai, i, r, j, -s, -t) for r, (t, j) in enumerate(fit, 1))
    return out


def mined(spark, rows, **options):
    from twinspark.llm.hard_negatives import FOUND, mine_hard_negatives

    df = mine_hard_negatives(vectors_of(spark, rows), F.col("id") % 50 == 0, **options)
    assert df.columns == [c.split()[0] for c in FOUND.split(", ")]
    return Counter(map(tuple, df.collect()))


def test_hard_negatives_against_brute_force(spark):
    random.seed(3)
    centre = [[random.gauss(0, 1) for _ in range(9)] for _ in range(4)]
    rows = [(i, [c + random.gauss(0, 0.3) for c in centre[i % 4]], random.randrange(3)) for i in range(400)]
    rows += [(1000 + i, rows[0][1], i % 3) for i in range(150)]  # one very common vector: ties go by id
    rows += [(None, [1.0] * 9, 1), (2000, None, 1), (2001, [1.0] * 8 + [None], 1), (2002, [1.0] * 8 + [math.inf], 1), (2003, [1.0] * 8 + [math.nan], 1), (2004, [1.0] * 9, None), (2050, [], 1), (2100, [2.0, 1.0], 2), (2101, [0.0] * 9, 2)]
    want = brute_negatives(rows)
    assert len(want) > 100 and mined(spark, rows) == want
    assert mined(spark, rows, block_bytes=1) == brute_negatives(rows)  # at least 64 anchors a block
    assert mined(spark, rows, positives=2, negatives=7) == brute_negatives(rows, 2, 7)


def test_hard_negatives_many_blocks(spark, monkeypatch):
    random.seed(4)
    rows = [(50 * i, [random.uniform(0, 1) for _ in range(5)], i % 4) for i in range(300)]
    got = mined(spark, rows, block_bytes=1)
    assert got == brute_negatives(rows) and len({k[0] for k in got}) > 250


def test_hard_negatives_large_numbers_repeats_and_empty(spark):
    from twinspark.llm.hard_negatives import LIMIT

    rows = [(i, [1e30 * (i + 1), 1.0], i % 2) for i in range(60)] + [(100 + i, [float(2**60), -(2.0**61)], i % 2) for i in range(5)]
    assert mined(spark, rows) == brute_negatives(rows, limit=LIMIT)
    twice = [(50, [1.0, 1.0], 0)] * 2 + [(1, [1.0, 0.9], 0)] * 2 + [(2, [0.8, 0.8], 1)] * 2 + [(3, [0.7, 0.7], 1)]
    want = brute_negatives(twice)
    assert mined(spark, twice) == want and sum(want.values()) == 12  # two anchors, two positives each, three negatives
    assert not mined(spark, []) and not mined(spark, [(1, [1.0], 0)]) and not mined(spark, [(50, [1.0], 0)]) and not mined(spark, [(50, None, None)])


def test_bounds_lose_no_pair():
    from twinspark.llm.hard_negatives import Best, Turned, exact_scores, may_score, principal_axes, slack

    rng = np.random.default_rng(5)
    for width in (1, 2, 3, 8, 33):
        vectors = np.floor(256 * rng.normal(size=(300, width)) * rng.uniform(0, 2, width))
        axes, ends = principal_axes(vectors[:50])
        assert ends == sorted(set(ends)) and 1 <= ends[0] <= ends[-1] <= width
        all_, first = Turned(vectors, axes, ends), Turned(vectors[:40], axes, ends)
        scores = (vectors[:40] @ vectors.T).astype(np.int64)
        low, high = np.quantile(scores, 0.9, axis=1), np.quantile(scores, 0.97, axis=1)
        low[::2] = np.floor(low[::2])
        a, r = may_score(first, all_, np.ones(scores.shape, bool), low, high, slack(axes))
        assert set(zip(*np.nonzero((scores >= low[:, None]) & (scores <= high[:, None])))) <= set(zip(a, r))
        assert (exact_scores(first, all_, a, r) == scores[a, r]).all()
        if width == 33:
            assert len(a) < scores.size / 2  # most pairs go by the bounds
    best = Best(2, 2)
    best.add(np.array([0, 0, 0, 1]), np.array([5, 3, 4, 9]), np.array([1, 1, 0, -7]))
    best.add(np.array([0, 1]), np.array([2, 8]), np.array([1, -7]))
    assert best.ids.tolist() == [[2, 3], [8, 9]] and best.scores.tolist() == [[1, 1], [-7, -7]]


def brute_measures(text):
    words = [w for w in "".join(" " if c in BLANK else c for c in text or "").split(" ") if w]
    lines = [x for x in (text or "").split("\n") if x.strip(BLANK)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark):
    from twinspark.llm.quality_rules import measured

    random.seed(6)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a b c a b c", "a a a a a", "x\n\nx\n x\nx\r\nx", "Grüße, 世界 🎉 <b>|</b> é  nbsp em", "a\0b \0"]
    texts += [" ".join(random.choice("abc") for _ in range(random.randint(0, 60))) for _ in range(150)]
    texts += ["\n".join(random.choice(["one line", "two", "", "three # lines"]) for _ in range(random.randint(1, 9))) for _ in range(50)]
    texts += [" ".join(random.choice(["x", "yy", "zzz"]) for _ in range(200_000))]
    rows = list(enumerate(texts)) + [(None, "no id"), (3, "a"), (3, "a")]
    got = measured(docs_of(spark, rows)).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert Counter(map(tuple, got)) == Counter((i, *brute_measures(t)) for i, t in rows)
    assert measured(docs_of(spark, [])).count() == 0


def brute_em(patterns, steps):
    from twinspark.llm.quality_rules import LEAST, RIGHT, SHARE_BAD, TRUST

    rules = len(next(iter(patterns)))
    share, right = SHARE_BAD, [RIGHT] * rules

    def good(votes):
        odds = math.log((1 - share) / share) + sum((1 if v else -1) * math.log(right[i] / (1 - right[i])) for i, v in enumerate(votes) if v >= 0)
        return 1 / (1 + math.exp(-odds))

    for _ in range(steps):
        posterior = {v: good(v) for v in patterns}
        right = [
            max(LEAST, (sum(n * (posterior[v] if v[i] else 1 - posterior[v]) for v, n in patterns.items() if v[i] >= 0) / sum(n for v, n in patterns.items() if v[i] >= 0) + TRUST * RIGHT) / (1 + TRUST))
            for i in range(rules)
        ]
        share = (sum(n * (1 - posterior[v]) for v, n in patterns.items()) + SHARE_BAD) / (sum(patterns.values()) + 1)
    return {v: good(v) for v in patterns}, right


def test_quality_votes_and_estimates(spark):
    from twinspark.llm.quality_rules import Estimate, Rule, estimated, quality

    random.seed(7)
    patterns = Counter()
    for _ in range(3000):  # three rules: right in 95 %, 85 % and 50 % of their votes, one text in five is bad
        good = random.random() > 0.2
        votes = tuple(-1 if random.random() < 0.2 else int(good == (random.random() < right)) for right in (0.95, 0.85, 0.5))
        patterns[votes] += 1
    df = spark.createDataFrame([(list(v), n) for v, n in patterns.items()], "v array<int>, n long")
    found = estimated(df, 3, 8)
    want, right = brute_em(patterns, 8)
    assert np.allclose(found.right, right) and found.right[0] > found.right[1] > found.right[2]
    got = {tuple(r.v): r.g for r in df.select("v", found.good(F.col("v")).alias("g")).collect()}
    assert all(abs(got[v] - want[v]) < 1e-9 for v in want)
    assert estimated(df.limit(0), 3, 2) == Estimate(0.1, (0.99,) * 3)

    prose = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8))) for _ in range(3000)]
    texts = {i: " ".join(random.sample(prose, 120)) + "." for i in range(200)}
    junk = {200 + i: " ".join(w + random.choice(["%%%", "$$$"]) for w in random.sample(prose, 120)) for i in range(20)}
    short = {300: "too short", 301: "a b c " * 40, 302: None, 303: ""}
    rows = list((texts | junk | short).items())
    out = {r.id: r for r in quality(docs_of(spark, rows + [(None, texts[0])] * 2)).collect()}
    assert all(out[i].kept for i in texts) and not any(out[i].kept for i in junk) and out[None].kept
    assert all(out[i].base_failed and not out[i].kept for i in short) and not any(out[i].base_failed for i in junk)
    assert quality(docs_of(spark, [])).count() == 0
    one = quality(docs_of(spark, rows), rules=(Rule("long", "n_words > 110"),), steps=3)
    assert {r.votes[0] for r in one.collect()} == {0, -1}


def test_quality_is_native(spark):
    from twinspark.llm.quality_rules import quality

    df = quality(docs_of(spark, [(1, "a b c")]))
    assert not any(x in df._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


def brute_units(text, unit):
    if unit == "character":
        return list(text)
    out = []
    for i, c in enumerate(text):
        begins = i == 0 or (text[i - 1] == "\n" if unit == "line" else text[i - 1] in BLANK and c not in BLANK)
        out += [c] if begins else []
        if not begins:
            out[-1] += c
    return out


def brute_middle(name, text, unit="character", rate=90, spm=20, seed="1"):
    units = brute_units(text, unit)
    n, h = len(units), hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    form = "spm" if h4 % 100 < spm else "psm"
    return n, form, len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit,chunk", [("character", 4096), ("character", 1), ("character", 7), ("word", 4096), ("word", 3), ("line", 5)])
def test_fill_in_middle(spark, unit, chunk):
    from twinspark.llm.fill_in_middle import fill_in_middle, restored

    random.seed(8)
    texts = [None, "", " ", "<P>", "a<S>b", "x<M", "<", ">", "<<P", "P><S", "é🎉世界", "🎉" * 9, "\n\n", " a  b\n c ", "a\0b", "long 世 " * 40_000]
    texts += ["".join(random.choice("ab <PSM>é世🎉\n") for _ in range(random.randint(0, 60))) for _ in range(300)]
    rows = list(enumerate(texts)) + [(None, "no id here"), (None, "no id here"), (5, "x<M"), (-3, "negative id")]
    out = fill_in_middle(docs_of(spark, rows), unit=unit, chunk=chunk, rate=97).withColumn("back", restored(F.col("output"), F.col("form")))
    got = Counter(tuple(r) for r in out.collect())
    want = Counter((i, *brute_middle("" if i is None else i, t or "", unit, 97), t or "") for i, t in rows)
    assert got == want and {"plain", "psm", "spm"} == {k[2] for k in got}
    assert fill_in_middle(docs_of(spark, [])).count() == 0


def test_fill_in_middle_shares_and_arguments(spark):
    from twinspark.llm.fill_in_middle import fill_in_middle

    docs = docs_of(spark, [(i, "some text") for i in range(2000)])
    forms = Counter(r.form for r in fill_in_middle(docs).collect())
    assert abs(forms["plain"] - 200) < 60 and abs(forms["spm"] - 360) < 80
    assert fill_in_middle(docs, seed="2").exceptAll(fill_in_middle(docs)).count() > 0
    named = fill_in_middle(docs.selectExpr("concat('k', doc_id) as `the key`", "text as body"), "the key", "body")
    assert named.schema["id"].dataType.simpleString() == "string" and named.count() == 2000
    with pytest.raises(ValueError):
        fill_in_middle(docs, unit="page")
