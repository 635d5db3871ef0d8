"""Deterministic stratified choice of training files."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from twinspark.functions.scalars import size_band, train_rank
from twinspark.storage import ship

PIECE = 4096


def eligible(files: DataFrame, max_bytes: int) -> DataFrame:
    return files.where((F.col("size") > 0) & (F.col("size") <= max_bytes))


def stratified(files: DataFrame, per_band: int = 64, root: str = "root") -> DataFrame:
    """The per_band files of the smallest hashed rank in each size band, with band, rank and place in the band.

    A window filter on the row number: Spark keeps per_band rows of each band a task before the shuffle."""
    ranked = files.withColumn("band", size_band(F.col("size"))).withColumn("rank", train_rank(F.lit(root), F.col("path")))
    place = F.row_number().over(Window.partitionBy("band").orderBy("rank", "path"))
    return ranked.withColumn("place", place).where(F.col("place") <= per_band)


def budgeted(chosen: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """Round robin over the bands; a file that no longer fits the bytes left is passed over. At most 32 bands of 64 files."""
    step = lambda s, x: F.when(
        (F.size(s["taken"]) < max_files) & (x["size"] <= max_bytes - s["total"]), F.struct((s["total"] + x["size"]).alias("total"), F.concat(s["taken"], F.array(x["path"])).alias("taken"))
    ).otherwise(s)
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<string>").alias("taken"))
    folded = chosen.agg(F.aggregate(F.array_sort(F.collect_list(F.struct("place", "band", "size", "path"))), start, step)["taken"].alias("taken"))
    return chosen.join(folded.select(F.posexplode("taken").alias("turn", "path")), "path")


@F.arrow_udf(StringType())
def _whole(contents: pa.Array) -> pa.Array:
    return pa.array([None if c is None else hashlib.sha256(c).hexdigest() for c in contents.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _pieces(contents: pa.Array) -> pa.Array:
    out = []
    for content in contents.to_pylist():
        state = hashlib.sha256()
        for at in range(0, len(content or b""), PIECE):
            state.update(content[at : at + PIECE])
        out.append(None if content is None else state.hexdigest())
    return pa.array(out, pa.string())


def digests_by_backend(files: DataFrame, content: str = "content") -> DataFrame:
    """path, backend, digest: SHA-256 of each content by the JVM, by Python at once, and by Python piece by piece."""
    ship(files.sparkSession)
    raw = F.col(content).cast("binary")
    ways = {"jvm": F.sha2(raw, 256), "python": _whole(raw), "pieces": _pieces(raw)}
    rows = files.select("path", *(digest.alias(name) for name, digest in ways.items()))
    return rows.select("path", F.explode(F.array(*(F.struct(F.lit(name).alias("backend"), F.col(name).alias("digest")) for name in ways))).alias("x")).select("path", "x.*")


def backend_agreement(digests: DataFrame) -> DataFrame:
    """path, backends, digests (how many different ones) and the smallest of them."""
    return digests.groupBy("path").agg(F.count(F.lit(1)).alias("backends"), F.count_distinct("digest").alias("digests"), F.min("digest").alias("digest"))


def backend_mismatches(digests: DataFrame) -> DataFrame:
    """Files on whose digest the backends differ; must be empty."""
    return digests.groupBy("path").agg(F.count_distinct("digest").alias("n")).where("n > 1")
