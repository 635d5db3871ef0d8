"""Near-dedup by similarity: documents link at a Jaccard similarity of 4/5 or more over their sets of five-word shingles.

Covering SimHash comes first: fingerprints of the sets within RADIUS bits give pairs, which are verified on whole sets.
Not every similar pair is that near by fingerprint, so prefix filtering follows for the rest.

Prefix filtering misses no pair. Put every set in one global order; a pair at the threshold shares ceil(4 n / 5) of a
set's n shingles or more, so it shares one among the first n - ceil(4 n / 5) + 1 of both. Shingles that a sample finds
to be common come last in the order, which only keeps them out of most prefixes. Candidates are compared by a bitmap
of each set first: where two bitmaps differ in a bit the sets differ in a shingle of their own, so too many such bits
rule a pair out for certain. What is left is verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.llm.components import components, joined
from twinspark.llm.shared import full_text, kind_of, positional, release, remove, shared_root, ship, small_batches, stored, without
from twinspark.llm.simhash import fingerprint_of, near_links

WORDS = 5
#: Fingerprints link at so many differing bits or fewer; more are dear where very many lie together, see near_links.
RADIUS = 2
#: Prefix shingles with up to this many sets compare them inside; larger ones go by leaders, see similar_links.
SMALL_BUCKET = 32
#: A bitmap has this many bits for each shingle of its set or more, rounded up to a power of two.
BITS = 4
#: Tokens by which two sets of a crowded token are told to have met before, and 64-bit words of their bitmaps there, see
#: similar_links.
MET, FOLDED = 64, 16
#: The order of shingles is made from about this many documents and holds this many common ones; results do not depend on it.
SAMPLE, MOST_COMMON = 10_000, 500_000
#: Identifiers of candidates up to this many are broadcast to the documents; beyond it texts are shuffled.
MAX_BROADCAST_IDS = 200_000


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the runs of `words` words (ASCII white space, A-Z lower-cased); a shorter text is one shingle."""
    own = text.encode("utf-8").lower().split()
    n = min(words, len(own))
    if not n:
        return np.zeros(0, np.uint64)
    strings = map(b" ".join, zip(*(own[i:] for i in range(n)), strict=False))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in strings), np.uint64, len(own) - n + 1))


def key_of(shingles: np.ndarray) -> int:
    """Signed 64-bit digest of the set."""
    key = xxhash.xxh3_64_intdigest(shingles.tobytes())
    return key - (1 << 64) if key >> 63 else key


def bitmap_of(shingles: np.ndarray) -> np.ndarray:
    """Signed 64-bit words, a power of two of them, with a bit for each shingle; half of them or-ed with the other half
    are the bitmap of half the words."""
    bits = max(64, 1 << (BITS * max(len(shingles), 1) - 1).bit_length())
    marks = np.zeros(bits, bool)
    marks[shingles % np.uint64(bits)] = True
    return np.packbits(marks, bitorder="little").view("<i8")


def may_be_near(nx: str, bx: str, ny: str, by: str) -> str:
    """A condition on n and bitmap of two sets that all similar pairs fulfil: sizes within 4/5 of each other, so that
    bitmaps are of one width or one is twice the other; 9 times the shingles that only one set has is no more than both
    sizes, and no fewer shingles than bits differ."""

    def level(b: str, other: str) -> str:
        half = f"size({b}) div 2"
        return f"if(size({b}) > size({other}), zip_with(slice({b}, 1, {half}), slice({b}, {half} + 1, {half}), (p, q) -> p | q), {b})"

    bits = f"aggregate(zip_with({level(bx, by)}, {level(by, bx)}, (p, q) -> bit_count(p ^ q)), 0L, (s, c) -> s + c)"
    return f"case when least({nx}, {ny}) * 5 < greatest({nx}, {ny}) * 4 then false else 9 * {bits} <= {nx} + {ny} end"


def prefix_of(shingles: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The set's first n - ceil(4 n / 5) + 1 shingles by (count among the common ones, hash)."""
    n = len(shingles)
    if not n:
        return shingles
    weight = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        weight = np.where(common[at] == shingles, counts[at], 0)
    return shingles[np.lexsort((shingles, weight))[: n - (4 * n + 4) // 5 + 1]]


def _common(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles that more than one document of a sample has, and their counts."""
    every = max(1, rows.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(text.as_py(), words).view(np.int64))], names=["s"])

    found = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("text").mapInArrow(run, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    table = found.orderBy(F.desc("n"), "s").limit(MOST_COMMON).toArrow()
    common, counts = table.column("s").to_numpy().view(np.uint64), table.column("n").to_numpy()
    order = np.argsort(common)
    return common[order], counts[order]


def folded(words: int = FOLDED) -> str:
    """The bitmap or-ed down to `words` (a power of two), where it is wider: still no fewer shingles differ than bits."""
    spans = f"transform(sequence(0, size(bitmap) div {words} - 1), i -> slice(bitmap, 1 + i * {words}, {words}))"
    return f"case when size(bitmap) <= {words} then bitmap else aggregate({spans}, array_repeat(0L, {words}), (x, y) -> zip_with(x, y, (p, q) -> p | q)) end"


def near_pairs(pairs: DataFrame, marked: DataFrame) -> DataFrame:
    """The pairs (a, b) that their bitmaps do not rule out. marked: key, n, bitmap."""
    left, right = (marked.select(F.col("key").alias(c), F.col("n").alias(f"n{c}"), F.col("bitmap").alias(f"m{c}")) for c in ("a", "b"))
    return pairs.join(left, "a").join(right, "b").where(may_be_near("na", "ma", "nb", "mb")).select("a", "b")


def cells(pairs: DataFrame, count: int, root: str) -> DataFrame:
    """The `count` pairs as (cell, key): cell is the end that has more pairs, so that few sets are cells."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("d"))
    ends = stored(ends, f"{root}-degrees", 2 * count)
    both = pairs.join(ends.select(F.col("key").alias("a"), F.col("d").alias("da")), "a").join(ends.select(F.col("key").alias("b"), F.col("d").alias("db")), "b")
    return stored(both.selectExpr("if(da >= db, a, b) as cell", "if(da >= db, b, a) as key"), f"{root}-cells")


def verified(pairs: DataFrame, count: int, ids: DataFrame, texts: DataFrame, once: bool, words: int, root: str) -> DataFrame:
    """Of the `count` pairs (a, b) those whose sets are similar: shared / (na + nb - shared) >= 4 / 5, in integers. Stored at root.

    Sets are made from texts where these are read, and meet by one shuffle: a set for each cell and one for each pair.
    ids: key, id of one text of each set; once: no id is on two texts."""
    spark = pairs.sparkSession
    dealt = cells(pairs, count, root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in small_batches(batches, most=1 << 20):
            found = []
            for text in batch.column("text").to_pylist():
                if last is None or last[0] != text:
                    own = shingle_set(text, words)
                    last = text, own, key_of(own)
                found.append(last[1:])
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(own) for own, _ in found)]), pa.int32()), pa.array(np.concatenate([own for own, _ in found]).view(np.int64)))
            made = pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("key"), lists], names=["cell", "key", "shingles"])
            yield made.filter(pa.array([key == asked for (_, key), asked in zip(found, batch.column("key").to_pylist())]))

    def sets(asked: DataFrame, name: str) -> DataFrame:
        """cell, key, shingles of the asked (cell, key); an id that is repeated may be on texts of other keys."""
        asked = stored(asked.join(ids, "key"), f"{root}-{name}")
        few = asked.limit(MAX_BROADCAST_IDS + 1).count() <= MAX_BROADCAST_IDS
        chosen = texts.join(F.broadcast(asked) if few else asked, "id").select("cell", "key", "text")
        made = chosen.mapInArrow(run, "cell long, key long, shingles array<long>")
        return made if once else made.dropDuplicates(["cell", "key"])

    left = sets(dealt.select("cell").distinct().withColumn("key", F.col("cell")), "leads").select("cell", F.col("shingles").alias("own"))
    right = sets(dealt, "members")
    shared = F.size(F.array_intersect("own", "shingles")).cast("long")
    near = right.join(left, "cell").where(shared * 9 >= (F.size("own") + F.size("shingles")).cast("long") * 4)
    links = stored(near.select(F.least("cell", "key").alias("a"), F.greatest("cell", "key").alias("b")).distinct(), root, count)
    release(spark, *(f"{root}-{name}" for name in ("degrees", "cells", "leads", "members")))
    return links


def fingerprint_pairs(marked: DataFrame, root: str, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of sets whose fingerprints covering SimHash links: each set and the smallest key of its own
    fingerprint, and these keys of linked fingerprints. marked: key, fp."""
    nodes = stored(marked.groupBy("fp").agg(F.min("key").alias("low")), f"{root}/nodes")
    links = near_links(nodes.select("fp"), radius, root)
    ends = [nodes.select(F.col("fp").alias(c), F.col("low").alias(f"low_{c}")) for c in ("a", "b")]
    across = links.join(ends[0], "a").join(ends[1], "b").select(F.col("low_a").alias("one"), F.col("low_b").alias("other"))
    pairs = marked.join(nodes, "fp").where("key <> low").select(F.col("key").alias("one"), F.col("low").alias("other")).unionByName(across)
    return stored(pairs.select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b")).distinct(), f"{root}/pairs")


def shared_tokens(tokens: DataFrame, root: str) -> DataFrame:
    """The rows of tokens that more than one set has, each once, as token, key, n, m, lead, lead_n. tokens: token, key, n.

    m is the number of rows with the token, repeated sets included. The leader is the set whose key has the smallest
    hash, so the tokens of a group of near copies have few leaders: a group costs about a pair a member, not a pair a
    pair."""
    lead = (F.min_by(c, F.xxhash64("key")).alias(name) for c, name in (("key", "lead"), ("n", "lead_n")))
    sizes = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("low"), F.max("key").alias("high"), *lead)
    # Written, so that the join has an exchange of its own and adaptive execution can split a hot token.
    sizes = stored(sizes.where("low < high").drop("low", "high"), f"{root}/tokens")
    return stored(tokens.join(sizes, "token").distinct(), f"{root}/sized")


def first_pairs(sized: DataFrame) -> DataFrame:
    """Pairs (a, b) of each set and the leader of each of its tokens."""
    near = F.expr("key <> lead and least(n, lead_n) * 5 >= greatest(n, lead_n) * 4")
    return sized.where(near).select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b"))


def open_rows(sized: DataFrame, parts: DataFrame, root: str) -> DataFrame:
    """The rows, with `part`, of tokens whose sets are not all in one part. parts: node, component."""
    state = stored(with_part(sized.select("token", "key", "n", "m"), parts), f"{root}/parted")
    several = state.groupBy("token").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("token")
    return stored(state.join(stored(several, f"{root}/several"), "token", "left_semi"), f"{root}/unsettled")


def with_part(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """rows with the part of their key, a set without one being a part of its own."""
    return rows.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("part", F.coalesce("component", "key")).drop("component")


def candidates(unsettled: DataFrame, root: str, small_bucket: int = SMALL_BUCKET) -> tuple[DataFrame, DataFrame]:
    """pairs (a, b) of different parts that may be similar by their tokens with few sets, and the rows (token, key, n,
    part) of tokens with more.

    If x's prefix ends first in the order, what x shares beyond both prefixes is in the rest of x. So a pair shares at
    most its common prefix tokens and the longer rest; tokens with many sets, not counted here, count as common."""
    many = stored(unsettled.where(F.col("m") > small_bucket).groupBy("key").agg(F.count(F.lit(1)).alias("many")), f"{root}/many")
    small = unsettled.where(F.col("m") <= small_bucket).join(many, "key", "left").withColumn("many", F.coalesce("many", F.lit(0)))
    small = small.groupBy("token").agg(F.collect_list(F.struct("key", "n", "many", "part")).alias("all"))
    inside = F.expr("flatten(transform(all, x -> transform(filter(all, y -> y.key > x.key and y.part <> x.part and least(x.n, y.n) * 5 >= greatest(x.n, y.n) * 4), y -> struct(x.key as a, y.key as b, x.n + y.n as n, least(x.many, y.many) + (greatest(x.n, y.n) * 4 + 4) div 5 - 1 as rest))))")
    pairs = small.select(F.explode(inside).alias("e")).groupBy("e.a", "e.b").agg(F.count(F.lit(1)).alias("c"), F.max("e.n").alias("n"), F.max("e.rest").alias("rest"))
    return stored(pairs.where("9 * (c + rest) >= 4 * n").select("a", "b"), f"{root}/pairs"), unsettled.where(F.col("m") > small_bucket).select("token", "key", "n", "part")


def similar_parts(parts: DataFrame, pairs: DataFrame, crowded: DataFrame, marked: DataFrame, near: Callable[[DataFrame, str], DataFrame], root: str, small_bucket: int = SMALL_BUCKET, met: int = MET) -> DataFrame:
    """node, component of exactly what all similar pairs connect.

    parts: node, component of the edges that are verified already; near finds the similar ones of some pairs, stored
    under a name. pairs and crowded: see candidates; its `part` is that of parts. A round that finds no edge leaves the
    parts as they are, so nothing is computed again.

    In tokens with many sets all are compared with one leader of the largest part first, as a group of near copies is
    all like the one that changed least: the leader is the set that has most of these tokens, and in later rounds any.
    That goes on as long as a round leaves half of the pairs or fewer. Then the pairs that no edges connect yet are
    compared, each at the smallest of the tokens that it shares: sets carry the `met` smallest of theirs, and a pair
    that shares none of these is made at each token that it has. They carry their bitmaps too, or-ed down to a bounded
    width, and a pair that these rule out is not made (marked: key, n, bitmap). So a large group of near copies costs no
    square of its size; of many unlike documents of nothing but common shingles all bitmaps are compared where they
    share one, but no rows are made."""
    alike = F.expr("part <> part2 and least(n, n2) * 5 >= greatest(n, n2) * 4")
    found = joined(parts, near(pairs, "links-near"), f"{root}/round-0")
    total, before, i = crowded.count(), None, 0
    while total:
        state = crowded if found is parts else with_part(crowded.drop("part"), found)
        if i == 0:
            state = state.join(stored(crowded.groupBy("key").agg(F.count(F.lit(1)).alias("reach")), f"{root}/reach"), "key")
        if found is not parts or i == 0:
            state = stored(state, f"{root}/state-{i}")
        parts = found
        lead = F.max_by(F.struct("key", "n"), F.struct(F.col("reach") if i == 0 else F.lit(0), F.xxhash64("key", F.lit(i))))
        members = state.groupBy("token", "part").agg(F.count(F.lit(1)).alias("m"), lead.alias("lead"))
        open_ = members.groupBy("token").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("inner"), F.max_by(F.struct("part", "lead"), F.struct("m", "part")).alias("x")).where("m * m > inner")
        open_ = stored(open_.select("token", ((F.col("m") * F.col("m") - F.col("inner")) / 2).alias("left"), F.col("x.part").alias("part2"), F.col("x.lead.key").alias("key2"), F.col("x.lead.n").alias("n2")), f"{root}/open-{i}")
        left = open_.agg(F.sum("left")).first()[0] or 0
        if not left:
            break
        last = left <= small_bucket * total or (before is not None and 2 * left > before)
        crowded = stored(state.join(open_.select("token"), "token", "left_semi").select("token", "key", "n", "part"), f"{root}/crowded-{i}")
        if last:
            held = stored(crowded.groupBy("key").agg(F.slice(F.sort_array(F.collect_set("token")), 1, met).alias("held")), f"{root}/held-{i}")  # a set's own tokens
            held = stored(held.join(marked.select("key", F.expr(folded()).alias("bits")), "key"), f"{root}/marks-{i}")
            one = stored(crowded.join(held, "key"), f"{root}/ends-{i}")
            other = one.select("token", *(F.col(c).alias(f"{c}2") for c in ("key", "n", "part", "held", "bits")))
            once = "token = coalesce(array_min(array_intersect(held, held2)), token)"
            both = one.join(other, "token").where("key < key2").where(alike).where(f"case when not ({once}) then false else {may_be_near('n', 'bits', 'n2', 'bits2')} end")
        else:
            both = state.join(open_, "token").where(alike)
        both = both.select(F.least("key", "key2").alias("a"), F.greatest("key", "key2").alias("b")).distinct()
        found = joined(parts, near(stored(both, f"{root}/pairs-{i}"), f"near-{i}"), f"{root}/round-{i + 1}")
        release(crowded.sparkSession, *(f"{root}/{name}-{i}" for name in ("state", "pairs", "held", "marks", "ends")))
        if last:
            break
        before, i = left, i + 1
    return found


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, small_bucket: int = SMALL_BUCKET, met: int = MET) -> DataFrame:
    """The rows of docs that stay, one document (the smallest id) of each group that links of similarity 0.8 connect.

    Documents without words, and rows without an id, all stay. Rows of one id go or stay together. Exact up to
    collisions of 64-bit hashes. Identifiers are of any type that has an order, columns may be called anything. Null
    text counts as empty, an empty table stays empty."""
    spark = docs.sparkSession
    ship(spark)
    home = shared_root(spark)
    root = f"{home}/work"
    plain, (own, text) = positional(docs, id_col, text_col)
    texts = plain.select(F.col(own).alias("id"), full_text(text).alias("text")).where("id is not null")
    shipped = spark.sparkContext.broadcast(_common(texts, words))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, most=1 << 20):
            found = [shingle_set(t.as_py(), words) for t in batch.column("text")]
            prefix = [prefix_of(s, *shipped.value) for s in found]
            ends = np.cumsum([0, *map(len, prefix)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefix).view(np.int64)))
            bits = [bitmap_of(s) for s in found]
            maps = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, bits)]), pa.int32()), pa.array(np.concatenate(bits)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([key_of(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int64()), lists, maps, pa.array([fingerprint_of(s) for s in found], pa.int64())], names=["id", "key", "n", "prefix", "bitmap", "fp"])

    rows = stored(texts.mapInArrow(first, f"id {kind_of(texts, 'id')}, key long, n long, prefix array<long>, bitmap array<long>, fp long"), f"{root}/prefixes")
    tokens = rows.select("key", "n", F.explode("prefix").alias("token"))
    sized = shared_tokens(tokens, root)
    release(spark, f"{root}/tokens")
    keys = sized.select("key").distinct()
    marked = rows.join(keys, "key", "left_semi").groupBy("key", "n").agg(F.min("id").alias("id"), F.first("bitmap").alias("bitmap"), F.first("fp").alias("fp"))
    marked = stored(marked, f"{root}/bitmaps")

    once = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()

    def near(pairs: DataFrame, name: str) -> DataFrame:
        pairs = stored(near_pairs(pairs, marked), f"{root}/{name}-pairs")
        count = pairs.count()
        return verified(pairs, count, marked.select("key", "id"), texts, once, words, f"{root}/{name}") if count else pairs

    known = near(fingerprint_pairs(marked.select("key", "fp"), f"{root}/simhash").unionByName(first_pairs(sized)).distinct(), "known")
    parts = components(known, f"{root}/parts")
    release(spark, *(f"{root}/simhash/{name}" for name in ("nodes", "sizes", "crowded", "pairs")))
    pairs, crowded = candidates(open_rows(sized, parts, root), root, small_bucket)
    release(spark, f"{root}/sized", f"{root}/parted")
    crowded = stored(crowded, f"{root}/crowded")
    release(spark, f"{root}/unsettled", f"{root}/many")
    found = similar_parts(parts, pairs, crowded, marked, near, root, small_bucket, met)
    named = with_part(rows.select("id", "key", "n"), found).select("id", "n", F.col("part").alias("component"))
    named = stored(named, f"{root}/named")
    low = stored(named.groupBy("component").agg(F.min("id").alias("low")), f"{root}/low")
    ends = named.join(low, "component")
    gone = ends.where("n > 0 and id <> low").select("id") if once else named.select("id").distinct().join(ends.where("n = 0 or id = low"), "id", "left_anti")
    dropped = stored(gone.select(F.col("id").alias(own)), f"{home}/dropped")
    remove(spark, root)
    return without(plain, dropped, [own]).select(plain.columns).toDF(*docs.columns)
