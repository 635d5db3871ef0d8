"""Exact dedup by a log-structured merge index of content digests, DataFrame operations only.

A memtable is what one task holds of its input split: the task sorts its (digest, id) pairs and flushes them as one
sorted run, a Parquet file with a Bloom filter on the digest. Compaction merges all runs into one level in digest order
with a single row for each digest: the smallest and the largest identifier and the number of rows. A digest with
several rows is a hit; a bit filter over the hits picks the texts that must be read again, and these are compared as
bytes before rows count as copies.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinspark.llm.shared import full_text, picked, positional, shared_root, stored, without

#: The filter over the hits has this many 64-bit words at most (some 8 MB when broadcast), whatever the input's size.
#: It only lets through what cannot be ruled out; the join behind it is exact.
FILTER_WORDS = 1 << 18


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class DigestIndex:
    """The index: any number of sorted runs under one folder of the shared store, and their compaction."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root, self.runs = spark, root or shared_root(spark), 0

    def flush(self, rows: DataFrame) -> None:
        """rows: (id, digest). Every task sorts what it has read and writes it as a run; nothing is shuffled."""
        (
            rows.sortWithinPartitions("digest", "id")
            .write.option("parquet.bloom.filter.enabled#digest", "true")
            .option("parquet.bloom.filter.expected.ndv#digest", "100000")
            .parquet(f"{self.root}/level0/run={self.runs}")
        )
        self.runs += 1

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.root}/level0/run={i}" for i in range(self.runs)))

    def compact(self) -> DataFrame:
        """One row for each digest: min_id, max_id, n. Partial aggregation keeps a hot digest to a row a task, and the
        level is dealt by ranges of the digest only after that."""
        merged = self.rows().groupBy("digest").agg(F.min("id").alias("min_id"), F.max("id").alias("max_id"), F.count(F.lit(1)).alias("n"))
        (
            merged.repartitionByRange("digest")
            .sortWithinPartitions("digest")
            .write.mode("overwrite")
            .option("parquet.bloom.filter.enabled#digest", "true")
            .parquet(f"{self.root}/level1")
        )
        return self.spark.read.schema(merged.schema).parquet(f"{self.root}/level1")

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """Rows of the compacted level for a short list of digests: the filter is pushed to the scan, where the files'
        Bloom filters leave out row groups without them. Later batches are checked so before they are flushed."""
        return self.spark.read.parquet(f"{self.root}/level1").where(F.col("digest").isin(digests))


def passing(rows: DataFrame, hits: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """The rows whose digest may be among the hits: a Bloom filter of one hash and 64 * words bits, as a broadcast
    table of at most `words` rows. All hits pass; of the others about the share of bits that are set."""
    bit = F.pmod(F.xxhash64("digest"), F.lit(64 * words))
    marks = hits.select(bit.alias("bit")).groupBy((F.col("bit") / 64).cast("long").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("bits"))
    placed = rows.withColumn("bit", bit).withColumn("word", (F.col("bit") / 64).cast("long"))
    return placed.join(F.broadcast(marks), "word").where("shiftrightunsigned(bits, cast(bit % 64 as int)) & 1 = 1").drop("bit", "word", "bits")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "min",
    digest: Callable[[Column], Column] = sha256_digest,
    filter_words: int = FILTER_WORDS,
) -> DataFrame:
    """One row for each row of docs: id, digest, keep_id, group_size, kept.

    Rows are copies when their texts are the same bytes, whatever the digest says. keep: "min" or "max", the
    identifier of a group that stays; identifiers are of any type that has an order. Null text counts as empty; a null
    id never wins over another id, and in a group of null ids keep_id is null and all of them are kept. Of rows that
    repeat both id and text all have the same keep_id and count in group_size; kept holds for each of them. An empty
    table gives no rows. Other columns of docs are not read.
    """
    best, best_id = {"min": (F.min, "min_id"), "max": (F.max, "max_id")}[keep]
    spark = docs.sparkSession
    texts = picked(docs, id=id_col, text=text_col).select("id", full_text().alias("text"))
    index = DigestIndex(spark)
    index.flush(texts.select("id", digest(F.col("text")).alias("digest")))
    hits = index.compact().where("n > 1").select("digest", F.col(best_id).alias("keep_id"), F.col("n").alias("group_size"))

    # Only texts that pass the filter are shuffled. The bytes themselves are the grouping key; copies meet before the
    # shuffle, one row a task and text.
    hashed = passing(texts.withColumn("digest", digest(F.col("text"))), hits, filter_words)
    verified = hashed.groupBy("digest", "text").agg(best("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    verified = verified.withColumn("text_sha", F.sha2("text", 256)).drop("text").join(hits.select("digest"), "digest", "left_semi")
    verified = stored(verified, f"{index.root}/verified")

    collided = stored(verified.groupBy("digest").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("digest"), f"{index.root}/collided")
    rows = index.rows()
    if collided.isEmpty():
        out = rows.join(hits, "digest", "left")
    else:  # different texts share a digest: those rows go by their own text
        odd = texts.withColumn("digest", digest(F.col("text"))).join(collided, "digest", "left_semi")
        odd = odd.select("id", "digest", F.sha2("text", 256).alias("text_sha")).join(verified, ["digest", "text_sha"])
        out = rows.join(collided, "digest", "left_anti").join(hits, "digest", "left")
        out = out.unionByName(odd.select(out.columns))
    keep_id = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id"),
        "digest",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("id").eqNullSafe(keep_id).alias("kept"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of docs that stay, with their own columns, whatever these are called: one of each group; rows without
    an id all stay, null text counts as empty, an empty table stays empty.

    What goes is joined to docs, not what stays, so texts are shuffled only where very many rows go."""
    plain, (own, text) = positional(docs, id_col, text_col)
    found = exact_dedup(plain, own, text, keep)
    root = shared_root(docs.sparkSession)
    rows = stored(found.select(F.col("id").alias(own), F.col("digest").alias("key"), "kept"), f"{root}/found")
    dropped = stored(rows.where("not kept").drop("kept").distinct(), f"{root}/dropped")
    hashed = plain.withColumn("key", sha256_digest(full_text(text)))
    out = without(hashed, dropped, [own, "key"])
    again = rows.where(f"kept and {own} is not null").groupBy(own, "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    if not again.isEmpty():  # rows that repeat id and text: one of them stays
        twice = out.join(again, [own, "key"], "left_semi").dropDuplicates([own, "key"])
        out = out.join(again, [own, "key"], "left_anti").select(plain.columns).unionByName(twice.select(plain.columns))
    return out.select(plain.columns).toDF(*docs.columns)
