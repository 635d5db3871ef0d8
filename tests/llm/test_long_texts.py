"""Long texts in remove_long_repeats: borders of pieces, and periodic texts."""

import random

import pytest

pytest.importorskip("twinspark.llm")


def test_piece_borders(spark):
    """A unique text loses nothing at the borders of its pieces; a repeat across one goes whole."""
    from twinspark.llm.long_repeats import remove_long_repeats

    random.seed(5)
    text = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))
    shared = text(90)
    rows = [(1, text(3000)), (2, text(260) + shared + text(300)), (3, text(35) + shared)]
    got = remove_long_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=24, segment=100).collect()
    assert {r.id: (r.n_removed, [(x.start, x.stop) for x in r.removed]) for r in got} == {1: (0, []), 2: (90, [(260, 350)]), 3: (90, [(35, 125)])}


def test_periodic_text_opens_one_piece_a_full(spark):
    """A repeated full is compared once, however often it occurs in the document that holds it."""
    from twinspark.llm.long_repeats import remove_long_repeats, repeated_runs
    from twinspark.llm.shared import shared_root, ship

    ship(spark)
    root, text = shared_root(spark), "a" * 40_000
    repeated_runs(spark.createDataFrame([(1, 7, text), (2, 8, "xyz" + "a" * 30)], "hi long, lo long, text string"), root, 24)
    assert spark.read.parquet(f"{root}/pieces").count() < 200
    got = remove_long_repeats(spark.createDataFrame([(1, text), (2, "xyz" + "a" * 30)], "doc_id long, text string"), length=24).collect()
    assert {r.id: r.n_removed for r in got} == {1: 40_000, 2: 30}


def test_one_letter_text_of_five_megabytes(spark):
    """At the production length; the document with the same letters behind others loses all of them too."""
    from twinspark.llm.long_repeats import remove_long_repeats

    rows = [("x", "a" * 5_000_000), ("y", "b" * 500 + "a" * 800 + "c"), (None, "short"), (None, "short"), ("z", "xy" * 1_000_000), ("z", "q" * 399)]
    got = remove_long_repeats(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.id or "", r.n_bytes, r.n_removed, r.n_spans) for r in got) == [("", 5, 0, 0), ("", 5, 0, 0), ("x", 5_000_000, 5_000_000, 1), ("y", 1301, 1300, 1), ("z", 399, 0, 0), ("z", 2_000_000, 2_000_000, 1)]


def brute_suffixes(text, most):
    order = sorted(range(len(text)), key=lambda i: text[i:])
    shared = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while k < most and text[a + k : a + k + 1] == text[b + k : b + k + 1] != b"":
            k += 1
        shared.append(k)
    return order, shared


@pytest.mark.parametrize("symbols, budget", [(4096, 1 << 20), (3, 0)])
def test_induced_sorting(tmp_path, monkeypatch, symbols, budget):
    """Suffixes and common prefixes against plain sorting; few symbols a name and queues in files too."""
    import numpy as np

    from twinspark.llm import induced

    monkeypatch.setattr(induced, "MOST_SYMBOLS", symbols)
    random.seed(12)
    for _ in range(300):
        alphabet = random.choice([b"\1", b"\1\2", b"\1\2\3", bytes(range(1, 40))])
        word = lambda n: bytes(random.choice(alphabet) for _ in range(random.randint(0, n)))
        base = word(30)
        text = b"".join(random.choice([base, word(9)]) for _ in range(random.randint(0, 8))) + b"\0"
        most = random.choice([5, 400])
        order, shared = induced.sort_suffixes(np.frombuffer(text, np.uint8), most, induced.backed(str(tmp_path / "queues"), budget))
        assert (order.tolist(), shared.tolist()) == brute_suffixes(text, most)
    assert not any((tmp_path / "queues").iterdir()) if budget == 0 else True
