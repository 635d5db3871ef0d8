"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are partitioned by size. In the partition of items with up to u shingles each item is represented by its k
smallest shingle hashes, k = floor((1 - threshold) u) + 1. A document that contains `threshold` of an item's shingles
misses fewer than k of them, so it has at least one of the k: the sketches find short items inside documents of any
length without false negatives, and candidates are then verified on all of the item's shingles.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.llm.shared import ascii_lower, full_text, kind_of, picked, positional, shared_root, ship, small_batches, stored, without
from twinspark.llm.substring_dedup import fold

WORDS, THRESHOLD = 5, 0.8
#: Items up to this many UTF-8 bytes travel to the tasks; a larger benchmark is joined by its sketches instead.
MAX_BROADCAST_BYTES = 16 << 20
#: For Spark's regular expressions: runs of ASCII characters that are no letters or digits.
NO_WORD = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"


def least_shared(n: int, threshold: float) -> int:
    """How many of n shingles a document must contain."""
    return max(1, math.ceil(threshold * n - 1e-9))


def sketch_size(n: int, threshold: float) -> int:
    """By the upper bound of the size partition (powers of two) that n is in."""
    bound = 1 << (n - 1).bit_length()
    return min(n, math.floor((1 - threshold) * bound + 1e-9) + 1)


def shingles(words: list[bytes], size: int) -> set[bytes]:
    return set(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def find_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", words: int = WORDS, threshold: float = THRESHOLD, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """id, item_id, item_shingles, shared_shingles, containment: one row for each document and item it contains.

    Shingles are distinct runs of `words` words of the folded text (see substring_dedup.fold); an item with fewer words
    is one shingle, its whole sequence; items without words are never found. Rows that repeat a document or an item
    are searched each, null text counts as empty, empty tables give no rows, null ids are carried along. Other columns
    are not read. Documents are read once and not shuffled while the items are within the bound."""
    ship(docs.sparkSession)
    texts = picked(docs, id=id_col, text=text_col).select("id", full_text().alias("text"))
    wanted = picked(items, item_id=item_col, text=item_text).select("item_id", full_text().alias("text"))
    size = wanted.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size > max_broadcast_bytes:
        return _find_joined(texts, wanted, words, threshold)

    known = wanted.collect()  # within max_broadcast_bytes
    shipped = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in known])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketches: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        full, item_ids = [], []
        for item_id, text in shipped.value:
            own = fold(text).split()
            if own:
                n = min(words, len(own))
                parts = shingles(own, n)
                for s in sorted(parts, key=lambda s: (xxhash.xxh64_intdigest(s, 42), s))[: sketch_size(len(parts), threshold)]:
                    sketches[n][s].append(len(full))
                full.append((n, parts))
                item_ids.append(item_id)
        for batch in small_batches(batches):
            rows = []
            for i, text in enumerate(batch.column("text")):
                own = fold(text.as_py()).split()
                for n, sketch in sketches.items():
                    mine = shingles(own, n)
                    found = {k for s in sketch.keys() & mine for k in sketch[s]}
                    for k in sorted(found):
                        parts = full[k][1]
                        shared = len(parts & mine)
                        if shared >= least_shared(len(parts), threshold):
                            rows.append((i, k, len(parts), shared))
            index = pa.array([r[0] for r in rows], pa.int32())
            kind = whole_item.type
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(index), pa.array([item_ids[r[1]] for r in rows], kind), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[3] / r[2] for r in rows], pa.float64())],
                names=["id", "item_id", "item_shingles", "shared_shingles", "containment"],
            )

    from pyspark.sql.pandas.types import to_arrow_type

    whole_item = pa.field("item_id", to_arrow_type(wanted.schema["item_id"].dataType))
    return texts.mapInArrow(run, f"id {kind_of(texts, 'id')}, item_id {kind_of(wanted, 'item_id')}, item_shingles long, shared_shingles long, containment double")


def _find_joined(texts: DataFrame, wanted: DataFrame, words: int, threshold: float) -> DataFrame:
    """The same with DataFrame joins, for benchmarks past the bound: documents' shingles meet the sketches."""
    split = F.filter(F.split(F.regexp_replace(ascii_lower(F.col("text")), NO_WORD, " "), " "), lambda w: w != "")
    grams = lambda n: F.array_distinct(F.expr(f"transform(sequence(1, greatest(1, size(w) - {n} + 1)), i -> array_join(slice(w, i, {n}), ' '))"))
    items = wanted.withColumn("w", split).where("size(w) > 0").withColumn("n", F.least(F.size("w"), F.lit(words)))
    # Written, as row numbers are only the same in every use if the rows are not dealt anew.
    root = shared_root(texts.sparkSession)
    items = stored(items.withColumn("key", F.monotonically_increasing_id()).select("key", "item_id", "n", grams("n").alias("parts")), f"{root}/items")
    sizes = [r[0] for r in items.select("n").distinct().collect()]  # at most `words` values
    bound = F.expr("shiftleft(1L, cast(ceil(log2(size(parts))) as int))")
    k = F.least(F.size("parts"), (F.floor(F.lit(1 - threshold) * bound + 1e-9) + 1).cast("int"))
    sketch = items.withColumn("k", k).select("key", "n", F.explode(F.expr("slice(array_sort(transform(parts, s -> struct(xxhash64(s) as h, s))), 1, k)")).alias("x")).select("key", "n", F.col("x.s").alias("s"))
    own = stored(texts.withColumn("row", F.monotonically_increasing_id()), f"{root}/texts").withColumn("w", split)
    mine = None
    for n in sizes:
        part = own.where(F.size("w") >= n).select("row", "id", F.lit(n).alias("n"), F.explode(grams(n)).alias("s"))
        mine = part if mine is None else mine.unionByName(part)
    if mine is None:
        mine = own.select("row", "id", F.lit(0).alias("n"), F.lit("").alias("s")).limit(0)
    found = mine.join(sketch, ["n", "s"]).select("row", "id", "key").distinct()
    parts = items.select("key", "item_id", F.size("parts").cast("long").alias("item_shingles"), "n", F.explode("parts").alias("s"))
    wants = found.join(parts, "key")
    shared = wants.join(mine.select("row", "n", "s"), ["row", "n", "s"]).groupBy("row", "key", "item_shingles").agg(F.first("id").alias("id"), F.first("item_id").alias("item_id"), F.count(F.lit(1)).alias("shared_shingles"))
    return shared.where(F.col("shared_shingles") >= F.ceil(F.lit(threshold) * F.col("item_shingles") - 1e-9)).select("id", "item_id", "item_shingles", "shared_shingles", (F.col("shared_shingles") / F.col("item_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that contain no item, with their own columns, whatever these are called; rows without an id stay."""
    plain, (own, text) = positional(docs, id_col, text_col)
    found = find_items(plain, items, own, text, **options).select(F.col("id").alias(own)).distinct()
    return without(plain, stored(found, f"{shared_root(docs.sparkSession)}/found"), [own]).select(plain.columns).toDF(*docs.columns)
