"""The pipeline's near-dedup stage against brute force over five-word shingles."""

import random

import pytest

pytest.importorskip("twinspark.llm")


def shingles(text):
    own = text.lower().split()
    n = min(5, len(own))
    return {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()


def brute_kept(rows):
    sets, group = [shingles(t or "") for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]) and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    best = {}
    for (i, _), g in zip(rows, group):
        best[g] = min(i, best.get(g, i))
    return {i for (i, _), g, s in zip(rows, group, sets) if not s or best[g] == i}


@pytest.mark.parametrize("small_bucket, met", [(32, 64), (2, 64), (2, 1)])
def test_drop_similar(spark, small_bucket, met):
    from twinspark.llm.similar import drop_similar

    random.seed(11)
    word = lambda: f"w{random.randint(0, 999)}"
    bases = [[word() for _ in range(n)] for n in (6, 30, 90, 200)]
    rows = [(900, ""), (901, None), (902, " \n"), (903, "one two"), (904, "One\ttwo"), (905, "one two three")]
    for i in range(160):
        own = list(random.choice(bases))
        for _ in range(random.choice([0, 1, 1, 2, 3, 4, 6])):  # from equal to unlike, around the threshold
            own[random.randrange(len(own))] = word()
        rows.append((i, " ".join(own)))
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in drop_similar(docs, small_bucket=small_bucket, met=met).collect()} == brute_kept(rows)


def test_bitmaps_rule_out_no_similar_pair():
    import numpy as np

    from twinspark.llm.similar import bitmap_of

    rng = np.random.default_rng(16)
    for _ in range(300):
        n = int(rng.integers(1, 4_000))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.append(a[: len(a) - int(rng.integers(0, max(1, n // 4)))], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 4)))).astype(np.uint64)))
        differ = len(np.setxor1d(a, b))
        marks, width = [bitmap_of(a), bitmap_of(b)], min(len(bitmap_of(a)), len(bitmap_of(b)))
        x, y = (np.bitwise_or.reduce(m.reshape(-1, width)) for m in marks)
        bits = np.unpackbits((x ^ y).view(np.uint8)).sum()
        assert bits <= differ
        if len(b) and len(np.intersect1d(a, b)) * 5 >= 4 * len(np.union1d(a, b)):
            assert 9 * bits <= len(a) + len(b)


def test_bitmap_condition_in_spark(spark):
    """near_pairs keeps every similar pair, bitmaps of other widths included, and none of unlike sets."""
    import numpy as np

    from twinspark.llm.similar import bitmap_of, near_pairs

    rng, rows, similar, unlike = np.random.default_rng(5), [], set(), set()
    for i in range(0, 240, 2):
        n = int(rng.integers(2, 3_000))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = a[: max(1, len(a) - int(rng.integers(0, max(1, n // 4))))] if i % 8 else np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        rows += [(i, len(a), bitmap_of(a).tolist()), (i + 1, len(b), bitmap_of(b).tolist())]
        if len(np.intersect1d(a, b)) * 5 >= 4 * len(np.union1d(a, b)):
            similar.add((i, i + 1))
        elif not len(np.intersect1d(a, b)) and n > 20:
            unlike.add((i, i + 1))
    marked = spark.createDataFrame(rows, "key long, n long, bitmap array<long>")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 240, 2)], "a long, b long")
    found = {(r.a, r.b) for r in near_pairs(pairs, marked).collect()}
    assert similar <= found and not unlike & found and len(similar) > 20 and len(unlike) > 10


def test_repeated_ids(spark):
    """Rows of one id with other texts, and with one text many times, go or stay together."""
    from twinspark.llm.similar import drop_similar

    base = [f"w{i}" for i in range(60)]
    near, other = " ".join([*base[:-1], "x"]), " ".join(f"o{i}" for i in range(60))
    rows = [(5, " ".join(base)), (5, other), (7, near), (7, near), (9, other + " x")]
    out = drop_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in out.collect()) == [5, 5]


def test_stage_takes_similarity(spark):
    """A pair at a similarity of 0.8 or more whose fingerprints differ by more than two bits."""
    from corpus_pipeline import near_dedup

    from twinspark.llm.simhash import fingerprint

    words = [f"w{i}" for i in range(100)]
    pairs = [(" ".join(words), " ".join([*words[:-n], *(f"x{i}" for i in range(n))])) for n in range(1, 10)]
    a, b = next((a, b) for a, b in pairs if ((fingerprint(a) ^ fingerprint(b)) & ((1 << 64) - 1)).bit_count() > 2)
    out = near_dedup(spark, spark.createDataFrame([(1, a), (2, b), (None, a)], "doc_id long, text string"), "")
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1]
    assert near_dedup(spark, spark.createDataFrame([], "doc_id long, text string"), "").count() == 0
