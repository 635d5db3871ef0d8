"""Files read as ranges of bytes: digests and comparison of files of any size, with a block of each in memory.

Files are rows of paths below a root that driver and executors share. A long file is cut into segments, which are rows
of their own, so several tasks work on it; what they find is a few bytes a segment, and is joined by path. A file that
cannot be read, or ends early, fails the job.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.functions.blake3 import Blake3, joined
from twinspark.operators.cache import fail_if_any
from twinspark.sources.inventory import tasks_of
from twinspark.storage import materialized, ship

BLOCK = 1 << 20
#: Bytes of a file that are one row of work; a power of two.
SEGMENT = 64 << 20


def blocks(path: str, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
    """The bytes of a file from start, up to stop or to its end, at most BLOCK at once."""
    with open(path, "rb") as f:
        f.seek(start)
        while stop is None or start < stop:
            block = f.read(BLOCK if stop is None else min(BLOCK, stop - start))
            if not block:
                if stop is not None:
                    raise ValueError(f"{path} ends before byte {stop}")
                return
            start += len(block)
            yield block


def segments(files: DataFrame, size: int) -> DataFrame:
    """files (with size) as rows of `start` and `stop`, one at least for each file."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("size") - 1, F.lit(0)).cast("long"), F.lit(size).cast("long"))
    return files.withColumn("start", F.explode(starts)).withColumn("stop", F.least(F.col("start") + size, F.col("size")))


def _made(rows: DataFrame, keys: list[str], value: Callable, kind: str, like: pa.DataType) -> DataFrame:
    """rows' keys with `made`, from the row as a dictionary. Rows are dealt out anew, as neighbours are often of one size."""
    ship(rows.sparkSession)
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + f", made {kind}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([value(row) for row in batch.to_pylist()], like)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), made], names=[*keys, "made"])

    return rows.repartition(tasks_of(rows.sparkSession), *keys).mapInArrow(run, schema)


def with_digest(files: DataFrame, root: str, digest: str = "sha256", segment: int = SEGMENT) -> DataFrame:
    """files (path, size) with the hexadecimal digest of each. SHA-256 and SHA-512 go through a file in order; a BLAKE3
    tree is hashed by segments, each in a task of its own, and joined."""
    if digest != "blake3":

        def whole(row: dict) -> str:
            state = hashlib.new(digest)
            for block in blocks(os.path.join(root, row["path"])):
                state.update(block)
            return state.hexdigest()

        made = _made(files.select("path"), ["path"], whole, "string", pa.string()).withColumnRenamed("made", "digest")
        return files.join(made, "path")

    def part(row: dict) -> bytes:
        state = Blake3(row["start"])
        for block in blocks(os.path.join(root, row["path"]), row["start"], row["stop"]):
            state.update(block)
        return state.value(root=row["only"])

    cut = segments(files.select("path", "size"), segment).withColumn("only", F.col("size") <= segment)
    parts = _made(cut, ["path", "start"], part, "binary", pa.binary())

    @F.arrow_udf("string")
    def top(values: pa.Array) -> pa.Array:
        return pa.array([joined(v).hex() for v in values.to_pylist()])

    tops = parts.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("start", "made"))).alias("parts"))  # 32 bytes a segment
    return files.join(tops.select("path", top("parts.made").alias("digest")), "path")


def equal_pairs(pairs: DataFrame, root: str, segment: int = SEGMENT) -> DataFrame:
    """pairs (path, other, size) of files of one size, with `same`: whether all their bytes are. A pair is compared by
    segments, block by block, and a segment is left at the first difference. No bytes are shuffled."""

    def same(row: dict) -> bool:
        one, two = (blocks(os.path.join(root, row[c]), row["start"], row["stop"]) for c in ("path", "other"))
        return all(x == y for x, y in zip(one, two, strict=True))

    found = _made(segments(pairs, segment), ["path", "other", "start"], same, "boolean", pa.bool_())
    return found.groupBy("path", "other").agg(F.bool_and("made").alias("same"))


def equal_files(candidates: DataFrame, root: str, segment: int = SEGMENT) -> DataFrame:
    """representative (the smallest path), member, size, members: what dedup.matches gives, for files that share
    (size, digest) with another; bytes decide. A stored table.

    Each file is compared with the first of its class, so a class of any size is as many rows. Files that differ from it
    although their digests agree get a second digest, are put into classes by that and compared again; a difference
    then is an error."""
    keys, equal = ["size", "digest"], None
    files = candidates.select("path", *keys)
    for last in (False, True):
        first = materialized(files.groupBy(*keys).agg(F.min("path").alias("other"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
        pairs = materialized(files.join(first, keys).where("path <> other").select("path", "other", "size"))
        judged = materialized(equal_pairs(pairs, root, segment).join(pairs, ["path", "other"]))
        found = judged.where("same").select(F.col("other").alias("representative"), F.col("path").alias("member"), "size")
        equal = found if equal is None else equal.unionByName(found)
        odd = judged.where("not same").select("path")
        if odd.isEmpty():
            break
        if last:
            fail_if_any(odd, "different contents share two digests")
        # Copies of the odd ones are odd as well, as they were compared with the same file.
        again = files.join(odd, "path", "left_semi").withColumnRenamed("digest", "first")
        files, keys = with_digest(again, root, "sha512"), ["size", "first", "digest"]
    first = equal.select("representative", F.col("representative").alias("member"), "size").distinct()
    rows = materialized(equal.unionByName(first))
    counts = materialized(rows.groupBy("representative").agg(F.count(F.lit(1)).alias("members")))
    return materialized(rows.join(counts, "representative").select("representative", "member", "size", "members"))
