"""Each operator against brute force, round trips, and odd inputs: nulls, empty texts and tables, ties, repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("twinspark.llm")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, id long, digest string"
TOKENIZERS = "/opt/tokenizers"


def docs_of(spark, rows):
    """rows: (doc_id, text); the other columns clash with names the operators use inside."""
    return spark.createDataFrame([(i, t, None, "s", None, 1, 2, "x") for i, t in rows], SCHEMA).repartition(3)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "Grüße, 世界 🎉 e\u0301"), (6, "a b " * 30_000), (6, "a b " * 30_000), (7, "x\0y\\ <s> [INST]"), (None, "no id"), (None, "no id")]


def test_exact_dedup(spark):
    from twinspark.llm.exact_dedup import exact_dedup

    rows = ODD + [(10, "same"), (11, "same"), (12, "Same"), (9, "same"), (20, None)]
    for options in ({}, {"filter_words": 1}, {"digest": lambda c: F.unhex(F.lit("00"))}, {"digest": lambda c: F.unhex(F.lpad(F.hex(F.length(c)), 8, "0"))}):
        for keep, best in (("min", min), ("max", max)):
            groups = {}
            for i, t in rows:
                groups.setdefault(t or "", []).append(i)
            want = Counter()
            for members in groups.values():
                known = [m for m in members if m is not None]
                k = best(known) if known else None
                want.update((m, k, len(members), m == k) for m in members)
            got = exact_dedup(docs_of(spark, rows), keep=keep, **options)
            assert Counter((r.id, r.keep_id, r.group_size, r.kept) for r in got.collect()) == want
    assert exact_dedup(docs_of(spark, [])).count() == 0


def test_digest_index(spark):
    from twinspark.llm.exact_dedup import DigestIndex, sha256_digest

    index = DigestIndex(spark)
    for batch in ([(1, "a"), (4, "b"), (3, "a")], [(0, "c"), (2, "a")]):
        index.flush(docs_of(spark, batch).select(F.col("doc_id").alias("id"), sha256_digest(F.col("text")).alias("digest")))
    assert sorted((r.min_id, r.max_id, r.n) for r in index.compact().collect()) == [(0, 0, 1), (1, 3, 3), (4, 4, 1)]
    key = hashlib.sha256(b"a").digest()
    found = index.lookup([key, b"absent"])
    assert [(r.min_id, r.n) for r in found.collect()] == [(1, 3)] and "PushedFilters: [In(digest" in found._jdf.queryExecution().toString()


def brute_fingerprint(text):
    import xxhash

    words = "".join(c.lower() if c.isascii() else c for c in text)
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash(spark):
    from twinspark.llm.simhash import simhash_groups

    random.seed(1)
    base = [" ".join(random.choice("abcdefghij") * 2 for _ in range(60)) for _ in range(8)]
    rows = [r for r in ODD if r[0] is not None and r[0] != 6] + [(50 + i, random.choice(base) + " zz" * random.randint(0, 3)) for i in range(60)]
    fps = {i: brute_fingerprint(t or "") for i, t in rows}
    want = brute_components(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = {r.id: (r.fp % (1 << 64), r.component_id) for r in simhash_groups(docs_of(spark, rows)).collect()}
    assert got == {i: (fps[i], want[i]) for i in fps}
    assert simhash_groups(docs_of(spark, [])).count() == 0
    assert {r.component_id for r in simhash_groups(docs_of(spark, [(None, "a"), (None, "a")])).collect()} == {None}


def test_covering_masks_and_large_buckets(spark):
    from twinspark.llm.components import components
    from twinspark.llm.shared import shared_root
    from twinspark.llm.simhash import covering_masks, near_links

    masks = covering_masks(2)
    assert all(any(not (1 << a | 1 << b) & m % (1 << 64) for m in masks) for a in range(64) for b in range(a, 64))
    random.seed(2)
    seeds = [random.getrandbits(64) for _ in range(4)]
    fps = set(seeds)
    for _ in range(300):
        fps.add(random.choice(sorted(fps)) ^ 1 << random.randrange(64) ^ 1 << random.randrange(64))
    nodes = dict(enumerate(sorted(fps)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in nodes.values()], "fp long")
    for radius, small in ((2, 2), (2, 5), (2, 1000), (0, 2), (1, 2), (1, 1000), (3, 2), (3, 1000), (4, 3)):
        want = brute_components(list(nodes), lambda a, b: (nodes[a] ^ nodes[b]).bit_count() <= radius)
        root = shared_root(spark)
        got = {r.node % (1 << 64): r.component % (1 << 64) for r in components(near_links(df, radius, root, small), root).collect()}
        parts = {}
        for n, f in nodes.items():
            parts.setdefault(got.get(f, f), []).append(n)
        assert sorted(map(sorted, parts.values())) == sorted(sorted(n for n in nodes if want[n] == w) for w in set(want.values())), (radius, small)


def test_components_of_a_path(spark):
    from twinspark.llm.components import components
    from twinspark.llm.shared import shared_root

    order = list(range(200))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([*zip(order, order[1:]), (1, 1), (1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in components(edges, shared_root(spark)).collect()}
    assert got == dict.fromkeys(range(200), 0) | {1000: 1000, 1001: 1000}


@pytest.mark.parametrize("min_words", [1, 8, 20])
def test_substring_dedup(spark, min_words):
    from twinspark.llm.substring_dedup import UNIT, fold, substring_dedup

    line = "This is a line that many documents share."
    more = "Here are some further words of it. And so on!"
    rows = ODD[:-2] + [(None, line), (30, f"First.\n{line}\nThe end of thirty is near here."), (31, f"Intro words, {line} {line.upper()} {more}"), (29, line + " " + more + "\nown words of this one document here"), (32, line), (33, f"{line} Not this one. {more}"), (34, f"{line}\n\n...{more} The end."), (35, f"{line} {more} " * 2)]
    cut = lambda text: [(m.start(), m.end(), fold(m[0])) for m in re.finditer(UNIT, text)]
    assert all("".join(t[a:b] for a, b, _ in cut(t)) == t for t in (t or "" for _, t in rows))
    seen, want = set(), {}
    for i, t in sorted({r for r in rows if r[0] is not None}, key=lambda r: r[0]):
        later, t = [], t or ""
        worded = [u for u in cut(t) if u[2]]
        for a, b, form in worded:
            later.append(form in seen)
            seen.add(form)
        gone, k = [], 0
        while k < len(worded):
            stop = k
            while stop < len(worded) and later[stop]:
                stop += 1
            if sum(len(u[2].split()) for u in worded[k:stop]) >= min_words:
                gone += [u[:2] for u in worded[k:stop]]
            k = stop + 1
        want[i] = gone
    got = substring_dedup(docs_of(spark, rows), min_words=min_words).collect()
    assert len(got) == len(rows) and {r.id: [(s.start, s.stop) for s in r.removed] for r in got if r.id} == want and any(want.values())
    texts = dict(rows)
    for r in got:
        assert r.kept_text == "".join(c for k, c in enumerate(texts[r.id] or "") if not any(s.start <= k < s.stop for s in r.removed)) and r.n_removed == len(r.removed)
    assert substring_dedup(docs_of(spark, [])).count() == 0


def test_toxicity(spark):
    from twinspark.llm.toxicity import drop_toxic, held_out, score, train_on_labels

    random.seed(4)
    word = lambda: "".join(random.choice("aeioulnrst") for _ in range(5))
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        rows.append((i, " ".join([word() for _ in range(30)] + ["Scumbag"] * toxic)))
        labels.append((i, 0, int(toxic), "clash"))
    labels += [(3, 0, None, ""), (None, 0, 1, ""), (5_000, 0, 1, "")]
    docs, given = docs_of(spark, rows + ODD[:-2]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    model = train_on_labels(docs.where("doc_id >= 10"), given)
    got = {r.id: r.score for r in score(docs, model).collect()}
    unseen = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0 and i >= 10]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in unseen) >= 0.95 * len(unseen)
    assert all(0 <= s <= 1 for s in got.values())
    assert {r.doc_id for r in docs.where(held_out()).select("doc_id").collect()} == {i for i, _ in rows + ODD[:-2] if zlib.crc32(str(i).encode()) % 5 == 0}
    assert drop_toxic(docs, given).columns == docs.columns
    joined = train_on_labels(docs.where("doc_id >= 10"), given, max_broadcast_labels=0)
    assert joined.bias == pytest.approx(model.bias) and abs(joined.weights - model.weights).max() < 1e-9
    assert score(docs_of(spark, []), model).count() == 0
    flat = train_on_labels(docs, given.where("toxic = 0"))
    assert len({r.score for r in score(docs, flat).collect()}) == 1


def test_toxicity_against_brute_force(spark):
    """Counts, ratios and scores again in plain Python; empty labels and one class fit nothing and drop nothing."""
    import math

    import numpy as np

    from twinspark.llm import toxicity as T

    random.seed(15)
    word = lambda: "".join(random.choice("aeioulnrst") for _ in range(4))
    rows = [(i, " ".join([word() for _ in range(random.randint(0, 12))] + ["Foul, mouth!"] * (i % 3 == 0))) for i in range(150)] + [(150, None), (151, "Grüße, 世界 ΣΑ")]
    labels = [(i, 0, int(i % 3 == 0)) for i, _ in rows if i % 5] + [(2, 0, None), (4, 0, 7)]
    docs, given = docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")

    def grams(text):
        text = "".join(c.lower() if c.isascii() else c for c in f" {text or ''} ")
        text = re.sub("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", " ", text)
        return {text[i : i + n] for n in (3, 4, 5, 6) for i in range(len(text) - n + 1)}

    def bucket(gram):
        h, m = 0, (1 << 64) - 1
        for c in gram:
            h = (h ^ ord(c)) * 0x9E3779B97F4A7C15 & m
            h ^= h >> 29
        return (h * 0xBF58476D1CE4E5B9 & m) >> 64 - T.BITS

    texts = dict(rows)
    assert all(T.features(t or "").tolist() == sorted({bucket(g) for g in grams(t)}) for t in texts.values())
    learnt = [(texts[i], y) for i, _, y in labels if y in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    counts, size = (Counter(), Counter()), Counter(y for _, y in learnt)
    for t, y in learnt:
        counts[y].update({bucket(g) for g in grams(t)})
    total = [sum(c.values()) + T.SIZE for c in counts]
    ratios = {}
    for b in counts[0].keys() | counts[1].keys():
        share = [(counts[y][b] + 0.5) / (size[y] + 1) for y in (0, 1)]
        pooled = (counts[0][b] + counts[1][b] + 0.5) / (size[0] + size[1] + 1)
        if abs(share[1] - share[0]) / math.sqrt(max(pooled * (1 - pooled), 1e-9) * (1 / size[0] + 1 / size[1])) >= T.LEAST_ERRORS and max(share) >= T.LEAST_SHARE * min(share):
            ratios[b] = math.log((counts[1][b] + 1) / total[1]) - math.log((counts[0][b] + 1) / total[0])
    assert ratios
    # Gradient descent on the same loss, feature by feature.
    weight, bias = dict.fromkeys(ratios, 0.0), math.log((size[1] + 1) / (size[0] + 1))
    found = [[b for b in {bucket(g) for g in grams(t)} if b in ratios] for t, _ in learnt]
    m, v, mb, vb = dict.fromkeys(ratios, 0.0), dict.fromkeys(ratios, 0.0), 0.0, 0.0
    for step in range(1, 201):
        errors = [1 / (1 + math.exp(-(bias + sum(weight[b] * ratios[b] for b in own)))) - y for own, (_, y) in zip(found, learnt)]
        slope = {b: T.PENALTY / len(learnt) * weight[b] for b in ratios}
        for own, e in zip(found, errors):
            for b in own:
                slope[b] += ratios[b] * e / len(learnt)
        adam = lambda m, v: 0.02 * (m / (1 - 0.9**step)) / (math.sqrt(v / (1 - 0.999**step)) + 1e-8)  # noqa: B023, E731
        for b, g in slope.items():
            m[b], v[b] = 0.9 * m[b] + 0.1 * g, 0.999 * v[b] + 0.001 * g * g
            weight[b] -= adam(m[b], v[b])
        g = sum(errors) / len(errors)
        mb, vb = 0.9 * mb + 0.1 * g, 0.999 * vb + 0.001 * g * g
        bias -= adam(mb, vb)
    model = T.train_on_labels(docs, given)
    got = {r.id: r.score for r in T.score(docs, model).collect()}
    for i, t in rows:
        z = bias + sum(weight[b] * ratios[b] for b in {bucket(g) for g in grams(t)} if b in ratios)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4)

    few = T.train(docs.join(given, "doc_id"), max_fit_rows=3, max_fit_features=1)  # bounded, with ties
    assert np.isfinite(few.weights).all()
    for odd in (given.limit(0), given.where("toxic = 1"), given.where("toxic = 0"), given.where("toxic = 7")):
        assert not T.train_on_labels(docs, odd).fitted and T.drop_toxic(docs, odd).count() == len(rows)


ODD_SCHEMA = "`doc.id` string, `Te.xt` string, `text_digest` string, ID int, `key` int, c0 int, `a b` array<int>"


def test_any_schema(spark):
    """Dotted and clashing names, string identifiers: the dropping stages keep the columns, the operators their rows."""
    from twinspark.llm.chat_format import format_chats, read_back
    from twinspark.llm.decontaminate import drop_contaminated, find_items
    from twinspark.llm.exact_dedup import drop_copies, exact_dedup
    from twinspark.llm.long_repeats import remove_long_repeats
    from twinspark.llm.sentencepiece_bpe import encode_pieces
    from twinspark.llm.shared import shared_root
    from twinspark.llm.similar import drop_similar
    from twinspark.llm.simhash import drop_near_copies, simhash_groups
    from twinspark.llm.sstable import open_shard, read_sstables, write_sstables
    from twinspark.llm.substring_dedup import substring_dedup
    from twinspark.llm.toxicity import drop_toxic, score, train
    from twinspark.llm.url_filter import judge_urls, site_rule

    long = " ".join(f"w{i}" for i in range(300))
    rows = [("b", long), ("a", long), ("c", "short"), (None, "no id"), ("d", None), ("e", "")]
    docs = spark.createDataFrame([(i, t, "x", 1, 2, 3, [4]) for i, t in rows], ODD_SCHEMA)
    names = {"id_col": "doc.id", "text_col": "te.xt"}  # in another case
    items = spark.createDataFrame([(1, "nothing of this is in any document at all")], "item_id long, text string")
    labels = spark.createDataFrame([("a", 1), ("c", 0), ("b", 0)], "`doc.id` string, toxic int")
    for drop, left in ((drop_copies, 4), (drop_near_copies, 5), (drop_similar, 5), (lambda d, **o: drop_contaminated(d, items, **o), 6), (lambda d, **o: drop_toxic(d, labels, **o), None)):
        out = drop(docs, **names)
        assert out.schema == docs.schema and (left is None or out.count() == left)
        assert drop(docs.limit(0), **names).count() == 0
    assert {r.id: r.component_id for r in simhash_groups(docs, **names).collect()}["b"] == "a"
    assert {r.id: r.keep_id for r in exact_dedup(docs, **names).collect()}["b"] == "a"
    assert {r.id for r in substring_dedup(docs, **names).collect() if r.n_removed == 0} == {"a", "c", "d", "e", None} - set()  # units of one document
    assert {r.id: r.n_removed > 0 for r in remove_long_repeats(docs, **names).collect()} == {"b": True, "a": True, "c": False, "d": False, "e": False, None: False}
    assert find_items(docs, items, **names).count() == 0 and score(docs, train(docs.withColumn("toxic", F.lit(1)), id_col="doc.id", text_col="Te.xt"), **names).count() == 6
    manifest = write_sstables(docs, shared_root(spark), f"{TOKENIZERS}/word_bpe_49k.json", 1, **names, shards=2)
    assert [r.doc_id for r in read_sstables(manifest, id_kind="string").orderBy("start").collect()] == [None, "a", "b", "c", "d", "e"]
    assert sum(len(open_shard(r.shard_path).lookup("c")) for r in manifest.collect()) == 1
    pieces = encode_pieces(docs.withColumnRenamed("doc.id", "ids"), f"{TOKENIZERS}/piece_bpe_32k.model", id_col="ids", text_col="Te.xt", decode=True)
    assert {r.id: r.decoded for r in pieces.collect()} == {i: t or "" for i, t in rows}
    pages = spark.createDataFrame([("http://a.com/en/x", 7)], "host string, `u.rl` int")
    assert [tuple(r)[:4] for r in judge_urls(pages, [site_rule("block", "com", "/en/")], id_col="host", url_col="host").collect()] == [("http://a.com/en/x", "a.com", "/en/x", "com/en/")]
    turns = spark.createDataFrame([("k", 1, "user", "hi"), ("k", 2, "assistant", "yes")], "`conv.id` string, `Turn` int, `ro.le` string, `text` string")
    assert read_back(format_chats(turns, f"{TOKENIZERS}/byte_bpe_50k.json", "conv.id", "turn", "ro.le")).first().loss_text == "yes"


def test_decontamination(spark):
    from twinspark.llm.decontaminate import drop_contaminated, find_items, shingles
    from twinspark.llm.substring_dedup import fold

    random.seed(5)
    text = lambda n: " ".join(random.choice("ab") + random.choice("cdefgh") + random.choice("ijkl") for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([3, 5, 6, 9, 20, 40, 40])] + [(7, None), (8, ""), (4, "again " + text(8)), (None, text(12)), (9, "one, two: three FOUR")]
    rows = [r for r in ODD if r[0] != 6]
    for i in range(60):
        item = (random.choice(items)[1] or "").split()
        a, b = sorted((random.randint(0, 4), random.randint(len(item) - 4, len(item)))) if len(item) > 8 else (0, len(item))
        rows.append((100 + i, " ".join([text(50), ", ".join(item[a:b]).upper(), text(30)])))
    rows.append((99, "so ONE two three; four."))
    want = Counter()
    for i, t in rows:
        own = fold(t or "").split()
        for k, u in items:
            parts = fold(u or "").split()
            if parts:
                n = min(5, len(parts))
                have, need = shingles(own, n), shingles(parts, n)
                if len(need & have) * 10 >= len(need) * 8:
                    want[i, k, len(need), len(need & have)] += 1
    assert len(want) > 20
    docs, bench = docs_of(spark, rows), spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id long")
    for options in ({}, {"max_broadcast_bytes": 0}):
        got = find_items(docs, bench, **options)
        assert Counter((r.id, r.item_id, r.item_shingles, r.shared_shingles) for r in got.collect()) == want, options
        assert find_items(docs_of(spark, []), bench, **options).count() == 0
        assert find_items(docs, bench.limit(0), **options).count() == 0
    kept = drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == len(rows) - sum(1 for i, _ in rows if i in {k[0] for k in want})


def brute_repeats(texts, length):
    where = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if where[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append((sum(gone), sum(g and not h for g, h in zip(gone, [False, *gone])), bytes(b for b, g in zip(t, gone) if not g)))
    return out


@pytest.mark.parametrize("most_slices", [0, 3, 4096])
@pytest.mark.parametrize("alphabet", ["ab", "abcdefghé", "a"])
def test_long_repeats(spark, most_slices, alphabet):
    from twinspark.llm.long_repeats import remove_long_repeats

    random.seed(6)
    text = lambda n: "".join(random.choice(alphabet) for _ in range(n))
    shared = [text(n) for n in (24, 30, 45, 90)]
    rows = [(i, "".join(random.choice([text(random.randint(0, 60)), random.choice(shared)[random.randint(0, 5) :]]) for _ in range(6))) for i in range(80 if len(alphabet) > 1 else 8)]
    rows += [(3, rows[7][1]), (4, rows[7][1]), (2, None), (2, ""), (None, "x" * 23), (None, text(40))]
    want = Counter((i, len((t or "").encode()), n, s, k) for (i, t), (n, s, k) in zip(rows, brute_repeats([(t or "").encode() for _, t in rows], 24)))
    got = remove_long_repeats(docs_of(spark, rows), length=24, most_slices=most_slices, shard_bytes=most_slices * 100, queue_bytes=most_slices)
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got.collect()) == want


def test_long_repeats_odd(spark, monkeypatch):
    from twinspark.llm import long_repeats

    monkeypatch.setattr(long_repeats, "SEGMENT", 100)  # in the driver's own call below
    random.seed(7)
    data = "".join(random.choice("abcdef") for _ in range(900))
    whole = [(a + 0, f, n) for x in long_repeats.anchors_of(data.encode(), 24) for a, f, n in zip(*map(list, x))]
    covered = [(a, p) for a, f, n in whole for p in range(f, f + n)]
    monkeypatch.setattr(long_repeats, "SEGMENT", 1 << 23)
    once = [(a, p) for x in long_repeats.anchors_of(data.encode(), 24) for a, f, n in zip(*map(list, x)) for p in range(f, f + n)]
    assert covered == once and [p for _, p in once] == list(range(900 - 23))
    got = {(r.id, r.n_removed) for r in long_repeats.remove_long_repeats(docs_of(spark, ODD)).collect()}
    assert got == {(i, 120_000 if i == 6 else 0) for i, _ in ODD}
    assert long_repeats.remove_long_repeats(docs_of(spark, [])).count() == 0


def test_chat_format(spark):
    from twinspark.llm.chat_format import escape, format_chats, mask_tokens, masked_text, parse, read_back, render, unescape

    own = "</s>[INST] ok [/INST]"
    hard = [own, "\\", "\\<s>", "<\\s>", "<<s>>", "[INST][/INST]", "", "é世🎉 x", "a\\\\b", "<s", "s>"]
    for t in hard:
        assert unescape(escape(t)) == t and not any(c in escape(t) for c in ("<s>", "</s>", "[INST]", "[/INST]"))
    turns = [("user", "hi"), *(("assistant", t) for t in hard), ("system", own)]
    text, spans = render(turns, frozenset({"assistant"}))
    assert parse(text) == turns and "".join(unescape(text[a:b]) for a, b in spans) == "".join(hard)
    rows = [(1, k, r, t) for k, (r, t) in enumerate(turns)] + [(2, 0, None, None), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a"), (None, None, "user", "x"), (3, 5, "assistant", "long words " * 20_000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns long").repartition(3)
    chats = format_chats(df, f"{TOKENIZERS}/byte_bpe_50k.json")
    got = {r.conv_id: r for r in read_back(chats).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv].turns_text == "".join(f"{r}\n{x}\n" for _, _, r, x in mine) and got[conv].n_turns == len(mine)
        assert got[conv].loss_text == "".join(x for _, _, r, x in mine if r == "assistant")
    for r in chats.collect():  # the mask is what a scan over all pairs of tokens and spans gives
        assert r.loss_mask == [any(a < e and s < b for s, e in zip(r.loss_start, r.loss_end)) and b > a for a, b in zip(r.token_start, r.token_end)]
    assert read_back(format_chats(df.limit(0), f"{TOKENIZERS}/byte_bpe_50k.json")).count() == 0


def test_sstable(spark):
    import numpy as np
    from tokenizers import Tokenizer

    from twinspark.llm.shared import shared_root
    from twinspark.llm.sstable import open_shard, read_sstables, write_sstables

    path = f"{TOKENIZERS}/word_bpe_49k.json"
    plain = Tokenizer.from_file(path)
    random.seed(8)
    rows = ODD + [(random.randint(-(10**12), 10**12), " ".join(random.choice(["Déjà", "vu,", "don't", "ΣΑΣ", "\u2003", "x\u00a0y", "12ab", "\x1cq", "日本"]) for _ in range(random.randint(0, 900)))) for _ in range(300)]
    manifest = write_sstables(docs_of(spark, rows), shared_root(spark), path, 1, shards=3)
    got = read_sstables(manifest).collect()
    tie = {r.text: r.tie for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").select("text", F.xxhash64("text").alias("tie")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, tie[r[1] or ""]))
    ids = [[*plain.encode(t or "", add_special_tokens=False).ids, 1] for _, t in order]
    starts = np.cumsum([0, *map(len, ids)])[:-1].tolist()
    got.sort(key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.ids) for r in got] == [(i, s, x) for (i, _), s, x in zip(order, starts, ids)]
    digests = {(r.start, r.n_tokens, r.ids_crc32) for r in read_sstables(manifest, digest=True).collect()}
    assert digests == {(s, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for s, x in zip(starts, ids)}
    shards = [open_shard(r.shard_path) for r in manifest.collect()]
    assert len(shards) == 3 and sum(s.entries for s in shards) == len(rows) and any(len(s.index) > 1 for s in shards)
    for doc_id in [None, 6, *random.sample([r[0] for r in rows if r[0] is not None], 40)]:
        assert sorted(x.tolist() for s in shards for x in s.lookup(doc_id)) == sorted(x for (i, _), x in zip(order, ids) if i == doc_id)
    assert not any(s.lookup(k) for s in shards for k in (10**15, -(10**15), 8))
    assert read_sstables(write_sstables(docs_of(spark, []), shared_root(spark), path, 1)).count() == 0


def test_sentencepiece(spark):
    import numpy as np

    from twinspark.llm.sentencepiece_bpe import MergeTable, decode_pieces, encode_pieces, load

    path = f"{TOKENIZERS}/piece_bpe_32k.model"
    library = load(path)
    random.seed(9)
    rows = [r for r in ODD if r[0] != 6] + [(100, " " * 999), (101, "▁▁x▁ \n\n y"), (102, "<s></s><0x0A>"), (103, "theainrs" * 400), (104, "a   b    c  ")]
    rows += [(200 + i, "".join(random.choice("thein ars\n\té世🎉") for _ in range(random.randint(1, 900)))) for i in range(150)]
    rows += [(900, "".join(chr(random.randint(0x4E00, 0x9FFF)) for _ in range(20_000))), (901, "a" * 5_001), (902, "".join(random.choice("theainrsou") for _ in range(6_000)))]
    got = {r.id: r for r in decode_pieces(encode_pieces(docs_of(spark, rows), path), path).collect()}
    for i, t in rows:
        assert got[i].ids == library.encode(t or "")
        assert got[i].decoded == (library.decode(got[i].ids) if t else "")
    both = {r.id: (r.ids, r.decoded) for r in encode_pieces(docs_of(spark, rows), path, decode=True).collect()}
    assert both == {i: (r.ids, r.decoded) for i, r in got.items()}
    table = MergeTable(library)
    assert 0 < table.everywhere.mean() < 1  # both kinds of rounds are met below
    texts = ["".join(random.choice(a) for _ in range(random.randint(1, 200))) for a in ("theainrs", "ab", "aeiou ", "=-_ 01", "▁ x") for _ in range(60)]
    for t in texts:
        assert np.frombuffer(b"".join(table.encode_words(table.split(t))), "<i4").tolist() == library.encode(t)
    assert encode_pieces(docs_of(spark, []), path).count() == 0


def test_url_filter(spark):
    from twinspark.llm.queries import SITE_RULES, url_rules
    from twinspark.llm.url_filter import judge_urls

    urls = [None, "", "x", "/a/b", "http://", "http://COM/en/x", "https://a.b.COM/en/", "http://xcom/en/", "ftp://example.com/en/71?x=/de/", "http://www.example.com/en/7", "http://example.net/de/8", "http://example.net/de/7#8", "//org/es/", "a://org/es/://net/de/", "http://o.org/ES/", "http://É.org/es/é", "http://www.cheap-pills.example.com/x", "http://spam-farm.org/es/1", "http://spam-farmer.org", "http://a.com?/en/", "http://xxx", "http://a.com/en/\nq"] * 2
    pages = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string").repartition(3)

    def brute(u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        fits = [(len(h + p), h + p, a) for a, h, p in SITE_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[1], best and best[2]

    for options in ({}, {"max_broadcast_rules": 0}):
        got = {r.id: r for r in judge_urls(pages, url_rules(), **options).collect()}
        assert len(got) == len(urls)
        for i, u in enumerate(urls):
            host, path, rule, verdict = brute(u)
            r = got[i]
            bad = any(w in host for w in ("cheap-pills", "spam-farm.")) or host == "xxx"
            assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or ("block" if bad else "allow")), u
        assert judge_urls(pages.limit(0), url_rules(), **options).count() == 0


def test_url_filter_runs_candidates_only(spark):
    """Thousands of rules: those that a URL does not fetch by their rarest token are never run, and both ways agree."""
    from twinspark.llm.url_filter import UrlRule, filed, judge_urls, site_rule, token_counts

    rules = [site_rule("block" if k % 2 else "allow", f"site{k}.com", f"/{'en' if k % 3 else 'de'}/") for k in range(5_000)]
    broken = [UrlRule(f"bad{k}", "block", "(", ("never", f"rare{k}"), 1) for k in range(2)]  # no expression: running it fails
    urls = [(k, f"http://www.site{k % 700}.com/{'en' if k % 2 else 'de'}/never") for k in range(1_500)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    counts = token_counts(spark.createDataFrame([(u.split("://")[1],) for _, u in urls], "key string"), sorted({t for r in rules + broken for t in r.literals}))
    assert counts["com"] == counts["never"] == 1_500 and counts["site3"] == 3 and "rare0" not in counts
    index, always = filed(rules + broken, counts)
    assert not always and max(map(len, index.values())) == 1 and "com" not in index and "rare0" in index
    want = {k: f"site{k % 700}.com/{'en' if k % 2 else 'de'}/" if (k % 700 % 3 != 0) == (k % 2 == 1) else None for k, _ in urls}
    with pytest.raises(re.error):
        re.compile(broken[0].pattern)
    for options in ({}, {"max_broadcast_rules": 0}):
        got = {r.id: r.rule for r in judge_urls(pages, rules, **options).collect()}
        assert got == want


def test_pipeline_without_labels(spark, tmp_path):
    """Empty labels, or one class only, cost no document in the first stage."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")

    docs = docs_of(spark, [(i, f"a harmless text number {i}") for i in range(50)])
    for n, labels in enumerate(([], [(i, 1, 1) for i in range(50)])):
        sf = str(tmp_path / str(n))
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        assert corpus_pipeline.toxicity(spark, docs, sf).count() == 50


def test_pipeline(spark, tmp_path):
    """Against the stages' own operators applied one by one to rows held in Python, where that is feasible."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from test_similar import brute_kept

    from twinspark.llm.sentencepiece_bpe import load

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    from twinspark.llm.decontaminate import shingles
    from twinspark.llm.substring_dedup import fold
    from twinspark.llm.toxicity import train_on_labels

    model = train_on_labels(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    left = {i: t for i, t in rows.items() if model.score(t) < 0.5}
    last = {t: i for i, t in sorted(left.items())}
    left = {i: t for t, i in last.items()}
    kept = brute_kept(list(left.items()))
    left = {i: t for i, t in left.items() if i in kept}
    items = [shingles(fold(r.text).split(), 5) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {i: t for i, t in left.items() if not any(len(x & shingles(fold(t).split(), 5)) * 10 >= 8 * len(x) for x in items)}
    library = load(f"{TOKENIZERS}/piece_bpe_32k.model")
    got = {r.doc_id: (r.ids, r.decoded) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == {i: (library.encode(t), library.decode(library.encode(t))) for i, t in left.items()}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, sf)
        assert stage.columns == docs.columns


def test_digest_of_queries(spark):
    """The thin queries' digest columns come from the operators' outputs."""
    from twinspark.llm.queries import piece_digests

    row = piece_digests(spark.createDataFrame([(1, [5, 7], "é"), (2, [], "")], "id long, ids array<int>, decoded string")).collect()
    assert row[0].ids_sha256 == hashlib.sha256(b"5,7").hexdigest() and row[0].decoded_sha256 == hashlib.sha256("é".encode()).hexdigest()
    assert row[1].ids_sha256 == hashlib.sha256(b"").hexdigest() and row[1].n_tokens == 0


def test_drops(spark):
    """One row of each group stays, repeated rows included; both ways of joining agree; other columns are untouched."""
    from twinspark.llm.decontaminate import drop_contaminated
    from twinspark.llm.exact_dedup import drop_copies
    from twinspark.llm.shared import shared_root, stored, without
    from twinspark.llm.simhash import drop_near_copies

    long = " ".join(f"w{i}" for i in range(300))
    rows = [(1, "a"), (2, "a"), (2, "a"), (2, "b"), (3, "c"), (None, "a"), (4, None), (5, ""), (6, long), (7, long), (8, "  ")]
    docs = docs_of(spark, rows)
    for keep, want in (("max", [(2, "a"), (2, "b"), (3, "c"), (None, "a"), (5, ""), (7, long), (8, "  ")]), ("min", [(1, "a"), (2, "b"), (3, "c"), (None, "a"), (4, None), (6, long), (8, "  ")])):
        out = drop_copies(docs, keep=keep)
        assert out.columns == docs.columns and Counter((r.doc_id, r.text) for r in out.collect()) == Counter(want)
    out = drop_near_copies(docs)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, "a"), (2, "a"), (2, "a"), (2, "b"), (3, "c"), (None, "a"), (4, None), (5, ""), (6, long), (8, "  ")])
    assert drop_contaminated(docs, spark.createDataFrame([(1, long)], "item_id long, text string")).count() == len(rows) - 2
    ids = stored(docs.where("doc_id in (2, 6)").select("doc_id").distinct(), shared_root(spark))
    assert without(docs, ids, ["doc_id"], 0).exceptAll(without(docs, ids, ["doc_id"])).count() == 0 and without(docs, ids, ["doc_id"], 0).count() == 7
    for f in (drop_copies, drop_near_copies):
        assert f(docs_of(spark, [])).count() == 0
