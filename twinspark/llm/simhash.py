"""SimHash near-dedup with covering locality-sensitive hashing.

A document's fingerprint has 64 bits from its word shingles. For a radius r every bit position i has a vector m(i)
of r + 1 bits, and each of the 2^(r+1) - 1 non-zero vectors v is a table whose mask keeps the positions with
<m(i), v> = 1 (mod 2). The vectors of at most r differing positions span at most r dimensions, so some v is
orthogonal to all of them: its mask hides every difference, and the pair collides in that table for certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.llm.components import components
from twinspark.llm.shared import full_text, kind_of, picked, positional, release, shared_root, ship, small_batches, stored, without

BITS = 64
#: Buckets with up to this many fingerprints compare them inside; larger ones are split exactly, see near_links.
SMALL_BUCKET = 32


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """Signed 64-bit fingerprint: a bit is set if over half of the shingles' XXH64 have it; no words give zero."""
    words = text.encode("utf-8").lower().split()  # bytes: A-Z only, and exactly \x20 and \x09-\x0d
    if not words:
        return 0
    hash_of, n = xxhash.xxh64_intdigest, max(1, len(words) - shingle + 1)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        part = words[at : at + (1 << 16) + shingle - 1]
        if len(words) < shingle:
            hashes = np.array([hash_of(b" ".join(words), seed)], "<u8")
        else:
            strings = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False))
            hashes = np.array([hash_of(s, seed) for s in strings], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<i8")[0])


def fingerprint_of(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint of given hashes: a bit is set if over half of them have it; none give zero."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def covering_masks(radius: int) -> list[int]:
    """The tables' masks as signed 64-bit integers."""
    vectors = [i % ((1 << radius + 1) - 1) + 1 for i in range(BITS)]
    masks = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 1 << radius + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """id, fp: one row for each row of docs, over the whole text; null counts as empty."""
    ship(docs.sparkSession)
    rows = picked(docs, id=id_col, text=text_col).select("id", full_text().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps, pa.int64())], names=["id", "fp"])

    return rows.mapInArrow(run, f"id {kind_of(rows, 'id')}, fp long")


def near_links(nodes: DataFrame, radius: int, root: str, small_bucket: int = SMALL_BUCKET) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints (fp, each once) within the radius, over covering tables.

    Fingerprints that are alone in all their buckets have no partner. Those in small buckets are compared there, and
    only true links are emitted. One in a larger bucket goes to the groups of all strings within half the radius,
    rounded up, of it: two within the radius share a group where one of them is within half, rounded down, so all
    members of such a group are linked to the smallest of those near ones, which says the same without pairs. The
    tables are 2^(radius + 1) - 1 and these groups 64 choose half the radius, so the radius is for 0 to 4 or so."""
    if not 0 <= radius <= 8:
        raise ValueError("more than 511 tables")
    masks = covering_masks(radius)
    keys = F.array(*(F.struct(F.lit(t).cast("byte").alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)))
    rows = nodes.select("fp", F.explode(keys).alias("x")).select("fp", "x.t", "x.key")
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Written, so that the join has an exchange of its own and adaptive execution can split a hot bucket.
    sizes = stored(sizes, f"{root}/sizes")
    crowded = stored(rows.join(sizes, ["t", "key"]), f"{root}/crowded")

    small = crowded.where(F.col("n") <= small_bucket).groupBy("t", "key").agg(F.collect_list("fp").alias("all"))
    near = F.expr(f"flatten(transform(all, x -> transform(filter(all, y -> y > x and bit_count(x ^ y) <= {radius}), y -> struct(x as a, y as b))))")
    pairs = small.select(F.explode(near).alias("e")).select("e.a", "e.b")

    hubs = crowded.where(F.col("n") > small_bucket).select("fp", F.col("fp").alias("hub")).distinct()
    flips = F.array(F.col("hub"), *(F.col("hub").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(BITS)))
    for _ in range(-(-radius // 2)):
        hubs = hubs.select("fp", F.explode(flips).alias("hub")).distinct()
    inner = F.expr(f"bit_count(fp ^ hub) <= {radius // 2}")
    lows = hubs.groupBy("hub").agg(F.min(F.when(inner, F.col("fp"))).alias("low")).where("low is not null")
    stars = hubs.join(lows, "hub").where("low <> fp").select(F.least("low", "fp").alias("a"), F.greatest("low", "fp").alias("b"))
    return pairs.unionByName(stars)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """One row for each row of docs: id, fp (signed), component_id, the smallest id reachable over links.

    Fingerprints link at `radius` or fewer differing bits; equal ones at none, so repeated rows and documents without
    words (fingerprint zero) are together. Identifiers are of any type that has an order. Null text counts as empty. A
    null id has a fingerprint and the component of its fingerprint's other documents, or null. An empty table gives no
    rows. Other columns are not read."""
    spark = docs.sparkSession
    root = shared_root(spark)
    rows = stored(fingerprints(docs, id_col, text_col, shingle), f"{root}/fingerprints")
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("low")), f"{root}/nodes")
    found = components(near_links(nodes.where("low is not null").select("fp"), radius, root).distinct(), root)
    release(spark, f"{root}/crowded", f"{root}/sizes")
    whole = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("part"))
    named = whole.join(whole.groupBy("part").agg(F.min("low").alias("component_id")), "part").select("fp", "component_id")
    return rows.join(named, "fp", "left").select("id", "fp", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, shingle: int = 3) -> DataFrame:
    """The rows of docs that stay, one document of each group (its smallest id), with their own columns, whatever these
    are called.

    Documents without words have no shingles to compare; all of them stay, as near copies of nothing, and so do rows
    without an id. Rows of one id go or stay together."""
    plain, (own, text) = positional(docs, id_col, text_col)
    root = shared_root(docs.sparkSession)
    found = stored(simhash_groups(plain, own, text, radius, shingle), f"{root}/found")
    kept = found.where("fp = 0 or id = component_id").select("id")
    dropped = stored(found.select("id").where("id is not null").distinct().join(kept, "id", "left_anti").select(F.col("id").alias(own)), f"{root}/dropped")
    return without(plain, dropped, [own]).select(plain.columns).toDF(*docs.columns)
