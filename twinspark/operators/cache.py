"""Incremental digests: a digest is reused only if all four stamp fields are equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.schema import STAMP




def cache_hits(inventory: DataFrame, cache: DataFrame) -> DataFrame:
    """inventory's rows with the cached digest."""
    a, b = inventory.alias("a"), cache.select("path", *STAMP, F.col("digest").alias("cached_digest")).alias("b")
    on = F.expr(" and ".join(["a.path = b.path", *(f"a.{c} <=> b.{c}" for c in STAMP)]))
    return a.join(b, on).select("a.*", "b.cached_digest")


def cache_misses(inventory: DataFrame, cache: DataFrame) -> DataFrame:
    a, b = inventory.alias("a"), cache.alias("b")
    return a.join(b, F.expr(" and ".join(["a.path = b.path", *(f"a.{c} <=> b.{c}" for c in STAMP)])), "left_anti")


def refreshed(inventory: DataFrame, cache: DataFrame, archive: DataFrame | None = None, digest=lambda content: F.sha2(content, 256)) -> DataFrame:
    """inventory's rows with digest and origin: current cache, then archive (both on equal stamps), else hashed anew.

    inventory has content; contents of hits are not read where the source prunes the column."""
    on = ["path", *STAMP]
    out = inventory.join(cache.select(*on, F.col("digest").alias("d1")), on, "left")
    if archive is not None:
        out = out.join(archive.select(*on, F.col("digest").alias("d2")), on, "left")
    else:
        out = out.withColumn("d2", F.lit(None).cast("string"))
    origin = F.when(F.col("d1").isNotNull(), F.lit("cache")).when(F.col("d2").isNotNull(), F.lit("archive")).otherwise(F.lit("hashed"))
    return out.withColumn("origin", origin).withColumn("digest", F.coalesce("d1", "d2", digest(F.col("content")))).drop("d1", "d2")


def unseen(cache: DataFrame, inventory: DataFrame) -> DataFrame:
    """Rows that the next generation drops: paths that the scan did not meet."""
    return cache.join(inventory.select("path"), "path", "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "path") -> DataFrame:
    """old with new's rows in place of rows of the same key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def latest_wins(rows: DataFrame, order: str, key: str = "path") -> DataFrame:
    """For each key the row with the largest order; max_by keeps one row a task before the shuffle."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("x")).select(key, "x.*")


def changed_members(members: DataFrame, current: DataFrame) -> DataFrame:
    """Members whose stamp is no longer what was scanned; must be empty before a report goes out."""
    return cache_misses(members, current)


def fail_if_any(df: DataFrame, message: str) -> None:
    row = df.limit(1).collect()
    if row:
        raise RuntimeError(f"{message}: {row[0].asDict()}")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, with side: full comparison of two snapshots."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
