"""Scalar functions as native Spark columns; FNV-1a alone runs over Arrow batches."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from twinspark.storage import ship

#: Fixed values.
BYTE_UNITS = ("B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB")
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211


def hex_digest(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def quoted_path(path: Column) -> Column:
    """In double quotes; quotes and backslashes escaped, control characters as \\u00xx."""
    body = F.regexp_replace(path, r'(["\\])', r"\\$1")
    for code in (*range(32), 127):
        body = F.replace(body, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), body, F.lit('"'))


def generic_path(path: Column) -> Column:
    """With / as separator."""
    return F.replace(path, F.lit("\\"), F.lit("/"))


def absolute_key(root: Column, relative: Column) -> Column:
    return F.concat_ws("/", F.regexp_replace(root, "/+$", ""), generic_path(relative))


def relative_key(root: Column, absolute: Column) -> Column:
    """Null if absolute does not lie under root."""
    prefix = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return F.when(F.startswith(absolute, prefix), F.substr(absolute, F.length(prefix) + 1))


def normal_path(path: Column) -> Column:
    """Lexical normal form: no empty and . components, .. takes the component before it."""
    step = lambda out, c: (
        F.when((c == "") | (c == "."), out)
        .when((c == "..") & (F.size(out) > 0) & (F.element_at(out, -1) != ".."), F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))))
        .when((c == "..") & F.startswith(path, F.lit("/")), out)
        .otherwise(F.concat(out, F.array(c)))
    )
    joined = F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
    return F.when(F.startswith(path, F.lit("/")), F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def safe_relative(path: Column) -> Column:
    """Not empty, relative, no . or .. component."""
    return (path != "") & ~F.startswith(path, F.lit("/")) & ~F.exists(F.split(path, "/"), lambda c: c.isin(".", ".."))


def absolute_or_fail(path: Column) -> Column:
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.raise_error(F.concat(F.lit("not an absolute path: "), path)))


def two_decimals(value: Column) -> Column:
    """Rounded by the exact binary value, which %.2f of Java strings is not."""
    return F.replace(F.format_number(value, 2), F.lit(","), F.lit(""))


def human_bytes(value: Column) -> Column:
    """Binary units to EiB, two decimals; none for zero."""
    v = value.cast("double")
    out = F.when(v == 0, F.lit("0 B")).when(v < 1024, F.concat(two_decimals(v), F.lit(" B")))
    for i, unit in enumerate(BYTE_UNITS[1:], 1):
        scaled = F.concat(two_decimals(v / F.lit(float(1024**i))), F.lit(f" {unit}"))
        out = out.otherwise(scaled) if i == len(BYTE_UNITS) - 1 else out.when(v < float(1024 ** (i + 1)), scaled)
    return out


def human_duration(ms: Column, smallest: str = "ns", largest: str = "h") -> Column:
    """In units from `smallest` to `largest` (of ns, us, ms, s, min and h), two decimals; none for zero."""
    v = ms.cast("double")
    say = lambda x, unit: F.concat(two_decimals(x), F.lit(f" {unit}"))
    steps = {"ns": (0.001, v * 1_000_000), "us": (1, v * 1000), "ms": (1000, v), "s": (60_000, v / 1000), "min": (3_600_000, v / 60_000), "h": (None, v / 3_600_000)}
    units = list(steps)[list(steps).index(smallest) : list(steps).index(largest) + 1]
    out = F.when(v == 0, F.lit("0 ms"))
    for unit in units[:-1]:
        end, scaled = steps[unit]
        out = out.when(v < end, say(scaled, unit))
    return out.otherwise(say(steps[units[-1]][1], units[-1]))


def throughput_mib(size: Column, seconds: Column) -> Column:
    """MiB a second; zero where no time passed."""
    return F.when(seconds > 0, size / F.lit(1048576.0) / seconds).otherwise(F.lit(0.0))


def bit_width(value: Column) -> Column:
    """Exact at every power of two, which log2 on doubles is not."""
    return F.when(value == 0, F.lit(0)).otherwise(F.length(F.bin(value.cast("long"))))


def size_band(size: Column) -> Column:
    """Factor-4 band of a positive size, 0 to 31."""
    return F.floor((bit_width(size) - 1) / 2).cast("int")


def latency_bucket(ms: Column) -> Column:
    """log2 of microseconds, 0 to 31, saturated at both ends."""
    return F.when(ms < 0.002, F.lit(0)).when(ms >= 2147483.648, F.lit(31)).otherwise((bit_width(F.floor(ms * 1000.0)) - 1).cast("int"))


def bucket_range(bucket: Column) -> Column:
    """The bucket's range of microseconds as text: lower..upper, open at 31."""
    low = F.when(bucket > 0, F.expr("1L") * F.pow(F.lit(2), bucket).cast("long")).otherwise(F.lit(0))
    return F.when(bucket == 31, F.concat(low.cast("string"), F.lit("+"))).otherwise(F.concat_ws("..", low.cast("string"), (F.pow(F.lit(2), bucket + 1) - 1).cast("long").cast("string")))


@F.arrow_udf(DecimalType(20, 0))
def _fnv1a(texts: pa.Array) -> pa.Array:
    """All texts of a batch byte by byte side by side, the longest first, so that those at work are always in front."""
    raw = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] else np.zeros(0, np.uint8)
    sizes = np.diff(ends)
    order = np.argsort(-sizes, kind="stable")
    starts, lengths, out = ends[:-1][order], sizes[order], np.full(len(raw), FNV_OFFSET, np.uint64)
    for i in range(int(lengths[0]) if len(raw) else 0):
        n = int(np.searchsorted(-lengths, -i, "left"))
        out[:n] = (out[:n] ^ data[starts[:n] + i]) * np.uint64(FNV_PRIME)
    found = np.empty(len(raw), np.uint64)
    found[order] = out
    return pa.array(found, mask=texts.is_null().to_numpy(zero_copy_only=False)).cast(pa.decimal128(20, 0))


def fnv1a_64(text: Column) -> Column:
    """FNV-1a over the UTF-8 bytes as decimal(20, 0), since a long is signed; null stays null."""
    ship(SparkSession.active())
    return _fnv1a(text)


def train_rank(root: Column, path: Column) -> Column:
    return fnv1a_64(F.concat(root, F.lit("/"), path))


def big_endian(value: Column) -> Column:
    """Eight bytes whose order is the numbers' order."""
    return F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0"))


def from_big_endian(value: Column) -> Column:
    return F.conv(F.hex(value), 16, -10).cast("long")


def learning_key(*fields: Column) -> Column:
    """Length-prefixed fields in a row, an injective key; over 4096 bytes fails."""
    parts = [F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")) for f in fields]
    key = reduce(F.concat, parts)
    return F.when(F.octet_length(key) <= 4096, key).otherwise(F.raise_error(F.lit("model identity exceeds 4096 bytes")))


def truncated_utf8(text: Column, most: int) -> Column:
    """struct(text, truncated): the longest prefix of whole characters in most - 1 bytes."""
    fits = F.octet_length(text) <= most - 1
    longest = F.aggregate(
        F.split(F.substring(text, 1, most), ""),
        F.struct(F.lit("").alias("t"), F.lit(False).alias("full")),
        lambda a, c: F.when(~a["full"] & (F.octet_length(a["t"]) + F.octet_length(c) <= most - 1), F.struct(F.concat(a["t"], c).alias("t"), F.lit(False).alias("full"))).otherwise(F.struct(a["t"].alias("t"), F.lit(True).alias("full"))),
    )["t"]
    return F.struct(F.when(fits, text).otherwise(longest).alias("text"), (~fits).alias("truncated"))


def utc_time(unix_ns: Column) -> Column:
    return F.timestamp_micros(F.floor(unix_ns / 1000).cast("long"))


def run_id() -> Column:
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def source_id(root: Column) -> Column:
    """The root, a zero byte and 16 random bytes."""
    return F.concat(F.encode(root, "UTF-8"), F.unhex(F.lit("00")), F.unhex(run_id()))


def features(size: Column, batch: Column, contention: Column) -> Column:
    """[1, MiB, batches / 1024, MiB * contention / 1024]; batches are rounded up. Null where the context is invalid."""
    mib = size / F.lit(1048576.0)
    batches = F.expr("0L") + F.floor((size + batch - 1) / batch)
    x = F.array(F.lit(1.0), mib, batches / F.lit(1024.0), mib * contention / F.lit(1024.0))
    valid = (size > 0) & (batch > 0) & (contention >= 0) & (contention <= 1024) & ~F.isnan(contention) & F.forall(x, lambda v: v <= 1e9)
    return F.when(valid, x)


def valid_observation(size: Column, ms: Column) -> Column:
    return (size > 0) & (ms > 0) & ~F.isnan(ms) & (ms < float("inf")) & (ms / size > 0)


def glob_like(text: Column, pattern: str) -> Column:
    """SQLite's GLOB with * and ?: anchored, other characters as they are."""
    import re

    return text.rlike("(?s)^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$")
