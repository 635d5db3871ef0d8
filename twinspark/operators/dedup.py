"""Exact duplicates: digests narrow the candidates, bytes decide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.functions.scalars import quoted_path
from twinspark.operators.ordered import row_positions
from twinspark.storage import materialized

#: Bits of the filter for each wanted key, and its 64-bit words at most (some 100 MB as a broadcast table). With n keys and
#: m bits a share of 1 - exp(-n / m) of the other rows passes: 6 % up to 8 million keys, 53 % at 10^8.
BITS_A_KEY, MOST_WORDS = 16, 1 << 21


def dup_candidates(files: DataFrame) -> DataFrame:
    """Files whose (size, digest) another file has too. The counts are partially aggregated, so a hot bucket is no skew."""
    buckets = files.groupBy("size", "digest").agg(F.count(F.lit(1)).alias("bucket_size")).where("bucket_size > 1")
    return files.join(buckets, ["size", "digest"])


def filter_words(keys: int, most: int = MOST_WORDS) -> int:
    """64-bit words of a filter for so many keys, a power of two."""
    return min(most, max(1024, 1 << (keys * BITS_A_KEY // 64).bit_length()))


def passing(rows: DataFrame, wanted: DataFrame, keys: list[str], words: int | None = None) -> DataFrame:
    """The rows whose keys may be among the wanted ones: a Bloom filter of one hash whose size follows the number of
    wanted keys up to a bound, broadcast as a table of its words. Whoever needs exactly the wanted ones joins behind it."""
    words = words or filter_words(wanted.count())
    bit = F.pmod(F.xxhash64(*keys), F.lit(64 * words))
    marks = wanted.select(bit.alias("_bit")).groupBy((F.col("_bit") / 64).cast("long").alias("_word")).agg(F.expr("bit_or(shiftleft(1L, cast(_bit % 64 as int)))").alias("_bits"))
    placed = rows.withColumn("_bit", bit).withColumn("_word", (F.col("_bit") / 64).cast("long"))
    return placed.join(F.broadcast(marks), "_word").where("shiftrightunsigned(_bits, cast(_bit % 64 as int)) & 1 = 1").drop("_bit", "_word", "_bits")


def content_classes(files: DataFrame) -> DataFrame:
    """path, size, digest, content_id (SHA-256 of the bytes) of the files whose bytes another file has too.

    Contents move for candidates only: a bounded filter of the buckets (size, digest) with two files or more goes before
    the scan, and what passes is grouped by its bytes with nothing but a count, so that copies meet before the shuffle.
    Bytes decide: two contents of one bucket that share their SHA-256 fail the step."""
    buckets = materialized(files.groupBy("size", "digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("size", "digest"))
    may = passing(files.select("path", "size", "digest", "content"), buckets, ["size", "digest"])
    counted = may.groupBy("size", "digest", "content").agg(F.count(F.lit(1)).alias("n")).select("size", "digest", F.sha2("content", 256).alias("content_id"), "n")
    classes = materialized(counted.groupBy("size", "digest", "content_id").agg(F.count(F.lit(1)).alias("contents"), F.sum("n").alias("members")).where("members > 1"))
    named = may.select("path", "size", "digest", F.sha2("content", 256).alias("content_id"))
    one = F.when(F.col("contents") > 1, F.raise_error(F.lit("different contents share a SHA-256"))).otherwise(F.col("members"))
    return named.join(classes, ["size", "digest", "content_id"]).withColumn("members", one).drop("contents")


def members(files: DataFrame) -> DataFrame:
    """Like matches(), with the class's own name in place of the representative's path: enough to count, and to leave out."""
    name = F.concat_ws(" ", F.col("size").cast("string"), "digest", "content_id")
    return content_classes(files).select(name.alias("representative"), F.col("path").alias("member"), "size", "members").dropDuplicates(["representative", "member"])


def matches(files: DataFrame) -> DataFrame:
    """representative (the smallest path), member, size, members: every member of a class of two files or more, the
    representative itself included. A stored table; classes are joined by their id, never by their bytes."""
    key = ["size", "digest", "content_id"]
    rows = materialized(content_classes(files).dropDuplicates([*key, "path"]))
    first = materialized(rows.groupBy(*key).agg(F.min("path").alias("representative")))
    return materialized(rows.join(first, key).select("representative", F.col("path").alias("member"), "size", "members"))


def numbered(groups: DataFrame) -> DataFrame:
    """With group_number from 1 in the representatives' order, by range partitions and their offsets."""
    order = row_positions(groups.where("representative = member").select("representative").withColumn("all", F.lit(0)), ["all"], ["representative"], "group_number")
    return groups.join(order.drop("all"), "representative")


def numbered_groups(files: DataFrame) -> DataFrame:
    """numbered(matches(files)) with fewer tables on the way: the classes get their first path and number at once."""
    key = ["size", "digest", "content_id"]
    rows = materialized(content_classes(files).dropDuplicates([*key, "path"]))
    first = rows.groupBy(*key).agg(F.min("path").alias("representative")).withColumn("all", F.lit(0))
    order = row_positions(first, ["all"], ["representative"], "group_number").drop("all")
    return rows.join(order, key).select("representative", F.col("path").alias("member"), "size", "members", "group_number")


def unique_files(files: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """The files without a copy; groups: what matches() gave for them, if that is known."""
    return files.join((members(files) if groups is None else groups).select(F.col("member").alias("path")), "path", "left_anti")


def report_lines(files: DataFrame, unmatched: bool = True, groups: DataFrame | None = None) -> DataFrame:
    """group_number, path, line: the TSV report's rows; group 0 has files without copies. groups: what matches() gave
    for files, if that is known; then nothing but their paths is read."""
    found = numbered_groups(files) if groups is None else numbered(groups)
    groups = materialized(found) if unmatched and groups is None else found
    rows = groups.select("group_number", F.col("member").alias("path"))
    if unmatched:
        rows = rows.unionByName(unique_files(files.select("path"), groups).select(F.lit(0).cast("long").alias("group_number"), "path"))
    return rows.withColumn("line", F.concat(F.col("group_number").cast("string"), F.lit("\t"), quoted_path(F.col("path"))))


def write_report(files: DataFrame, path: str, unmatched: bool = False, groups: DataFrame | None = None) -> None:
    """The report as text files in group and path order, one range of groups a file."""
    report_lines(files, unmatched, groups).repartitionByRange("group_number", "path").sortWithinPartitions("group_number", "path").select("line").write.mode("errorifexists").text(path)


def scan_counters(inventory: DataFrame, cached: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: scanned, cached, hashed, their bytes, groups, matches, unique. hashed + cached = scanned."""
    hits = cached.select("path").withColumn("hit", F.lit(True))
    scan = inventory.join(hits, "path", "left").agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("hit")).alias("cached"), F.count_if(F.col("hit").isNull()).alias("hashed"),
        F.coalesce(F.sum("size"), F.lit(0)).alias("scanned_bytes"), F.coalesce(F.sum(F.when(F.col("hit"), F.col("size"))), F.lit(0)).alias("cached_bytes"),
    )
    found = groups.agg(F.count_distinct("representative").alias("groups"), F.count(F.lit(1)).alias("matches"), F.coalesce(F.sum("size"), F.lit(0)).alias("matched_bytes"))
    return scan.crossJoin(F.broadcast(found)).withColumn("unique_files", F.col("scanned") - F.col("matches"))  # one row by one row


def reclaimable(groups: DataFrame) -> DataFrame:
    """representative, members, reclaimable_bytes: what the copies beyond one of each group take."""
    return groups.groupBy("representative").agg(F.count(F.lit(1)).alias("member_count"), ((F.count(F.lit(1)) - 1) * F.max("size")).alias("reclaimable_bytes"))
