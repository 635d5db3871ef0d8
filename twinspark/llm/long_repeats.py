"""Removal of long repeated substrings by sorted suffixes with their common prefixes, in shards.

A string of `length` bytes that starts at two places or more shows as suffixes, neighbours in order, that share at least
`length` bytes. Suffixes are sorted by external induction (llm/induced.py), shard by shard. So that no match crosses
shards, and unique text is not sorted at all, Spark deals windows of `length` bytes to shards by what they hold:

1. Each window has an anchor: the leftmost of its k-grams with the smallest hash. Equal windows have equal anchors at
   equal offsets. An anchor governs a run of neighbouring windows.
2. Each anchor gives a row with two digests: `core`, of what all windows around it share, and `full`, of everything
   its windows can reach. A core that occurs once has no repeated window. A full that occurs twice makes all its
   windows repeated. Only counts are grouped, so a hot passage leaves each task as one row.
3. Of the remaining anchors, at the borders of repeated passages, one context for each distinct full is cut out, and
   its windows are parted into slices by their offset from the anchor; the same two digests and counts decide most of
   them again.
4. The slices that are left are joined to shards by the digest of what their windows share, and a shard's suffixes are
   sorted. Where very many different slices share a digest, their windows are counted one by one instead, by digests of
   whole windows, so no such group has to meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.llm.induced import backed, sort_suffixes
from twinspark.llm.shared import full_text, kind_of, picked, release, remove, shared_root, ship, small_batches, stored, with_spans
from twinspark.operators.dedup import passing

LENGTH = 400
#: Digests with more different slices than this count their windows one by one; fewer meet in a shard.
MOST_SLICES = 256
SEGMENT = 1 << 20  # longer texts are read in pieces that overlap by a window; under 2^24
SHARD_BYTES = 2 << 20  # of text whose suffixes are sorted together
QUEUE_BYTES = 32 << 20  # of a shard's queues that stay in memory; the rest is in files of the shared folder
SEPARATOR = 0xFF  # occurs in no UTF-8 text


def anchors_of(data: bytes, length: int, segment: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """anchor, first window, number of windows: arrays, for each piece of the text. An anchor that governs windows on
    both sides of a border comes once, with all of them."""
    segment = segment or SEGMENT
    held = None
    k = 1 << max(1, (length // 3).bit_length() - 1)  # a power of two from a sixth to a third of the window
    span = length - k + 1  # k-grams in a window
    for at in range(0, max(0, len(data) - length + 1), segment):
        h = (np.frombuffer(data, np.uint8, min(segment + length - 1, len(data) - at), at).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        step = 1
        while step < k:
            h = h[:-step] * np.uint64(0xD6E8FEB86659FD93) + (h[step:] ^ (h[step:] >> np.uint64(29)))
            h ^= h >> np.uint64(32)
            step *= 2
        low = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        reach = 1
        while reach * 2 <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < span:
            low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        anchor = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        runs = np.array([anchor[first] + at, first + at, np.diff(np.append(first, len(anchor)))])
        if held is not None:
            if held[0, 0] == runs[0, 0]:
                runs[1:, 0] = held[1, 0], held[2, 0] + runs[2, 0]
            else:
                runs = np.hstack([held, runs])
        held = runs[:, -1:]
        yield tuple(runs[:, :-1])
    if held is not None:
        yield tuple(held)


def anchor_digests(data: bytes, anchor: int, length: int) -> tuple[int, int]:
    """core: the bytes in every window whose anchor this is. full: all bytes that such windows reach, cut at the text's ends."""
    k = 1 << max(1, (length // 3).bit_length() - 1)
    left, right = max(0, anchor - (length - k)), min(len(data), anchor + length)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(xxhash.xxh3_64_intdigest(data[anchor : anchor + k])), signed(xxhash.xxh3_64_intdigest(data[left:right], anchor - left))


def runs_of(hit: np.ndarray) -> Iterator[tuple[int, int]]:
    """start and length of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        yield a, b - a


def slice_width(length: int) -> int:
    return max(1, length // 12)


def slices_of(data: bytes, anchor: int, windows: int, length: int) -> Iterator[tuple[bytes, int, int, int]]:
    """sub, full, first, windows of each slice of a context: sub is the digest of the bytes that all windows of the
    slice's range share, in any context of the core, and full of the bytes that this context's windows reach.

    data begins with the first of the windows; anchor, counted from there, may be any distance behind."""
    width = slice_width(length)
    for j in range(-anchor // width, (windows - 1 - anchor) // width + 1):
        at = anchor + j * width
        low, high = max(0, at), min(windows - 1, at + width - 1)
        sub = xxhash.xxh3_128_digest(data[at + width - 1 : at + length], j & 0xFFFFFFFF)
        full = xxhash.xxh3_64_intdigest(data[low : high + length], low - at)
        yield sub, full - (1 << 64) if full >> 63 else full, low, high - low + 1


def repeated_windows(pieces: list[bytes], length: int, folder: str | None = None, queue_bytes: int = QUEUE_BYTES) -> list[np.ndarray]:
    """For each piece: which of its windows also starts elsewhere in the pieces. The suffixes of all pieces are sorted
    together; one that is a whole window is repeated if it shares `length` bytes with a neighbour."""
    sizes = np.array([len(p) + 1 for p in pieces])
    text = np.frombuffer(bytes([SEPARATOR]).join(pieces) + bytes([SEPARATOR]), np.uint8)
    symbols = np.append(np.where(text == SEPARATOR, SEPARATOR, text.astype(np.int16) + 1), 0)
    order, shared = sort_suffixes(symbols, length, backed(folder, queue_bytes))
    same = shared >= length
    hit = np.zeros(len(symbols), bool)
    hit[order[same | np.append(same[1:], False)]] = True
    ends = np.cumsum(sizes)
    return [hit[end - size : end - length] for end, size in zip(ends.tolist(), sizes.tolist(), strict=True)]


def shards_of(rows: Iterator[tuple], shard_bytes: int) -> Iterator[list[tuple]]:
    """Rows (sub, piece, ...) in the order of sub, in lists of about shard_bytes of pieces that keep equal subs together."""
    held, size = [], 0
    for row in rows:
        if size >= shard_bytes and row[0] != held[-1][0]:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[1])
    if held:
        yield held


def _undecided(rows: DataFrame, group: list[str], full: str, root: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Of rows (group, full, hi, lo, first, windows): those whose full occurs twice, and of the groups in which another
    full occurs once, one row a full (`different`: how many fulls the group has). The groups' counts are written, so
    that the joins have exchanges of their own and adaptive execution can split a hot group."""
    fulls = rows.groupBy(*group, full).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("hi", "lo", "first")).alias("of"))
    fulls = stored(fulls, f"{root}/{name}-all")
    mixed = fulls.groupBy(*group).agg(F.min("n").alias("least"), F.count(F.lit(1)).alias("different")).where("least = 1 and different > 1").drop("least")
    mixed = stored(mixed, f"{root}/{name}-mixed")
    known = fulls.join(mixed, group, "left").withColumn("different", F.coalesce("different", F.lit(0))).where("n > 1 or different > 0")
    joined = stored(rows.join(stored(known, f"{root}/{name}-fulls"), [*group, full]), f"{root}/{name}-joined")
    release(rows.sparkSession, f"{root}/{name}-fulls", f"{root}/{name}-mixed", f"{root}/{name}-all")
    open_ = joined.where("different > 0 and struct(hi, lo, first) = of").drop("n", "of").dropDuplicates(["hi", "lo", "first"])
    return joined.where("n > 1").select("hi", "lo", "first", "windows"), open_


def repeated_runs(texts: DataFrame, root: str, length: int = LENGTH, most_slices: int = MOST_SLICES, segment: int = SEGMENT, shard_bytes: int = SHARD_BYTES, queue_bytes: int = QUEUE_BYTES) -> DataFrame:
    """hi, lo, first, windows: runs of start positions (in bytes) whose `length` bytes occur elsewhere too.

    texts: hi, lo (a 128-bit digest of the text), text (not null); equal texts are one text that occurs several times."""
    spark = texts.sparkSession

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, most=1 << 20):
            rows = [[] for _ in range(7)]
            for hi, lo, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode("utf-8")
                for anchor, first, windows in anchors_of(data, length, segment):
                    digests = [anchor_digests(data, a, length) for a in anchor.tolist()]
                    for column, values in zip(rows, ([d[0] for d in digests], [d[1] for d in digests], [hi] * len(anchor), [lo] * len(anchor), anchor.tolist(), first.tolist(), windows.tolist()), strict=True):
                        column += values
            kinds = [*[pa.int64()] * 4, *[pa.int32()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=["core", "full", "hi", "lo", "anchor", "first", "windows"])

    found = stored(texts.mapInArrow(cells, "core long, full long, hi long, lo long, anchor int, first int, windows int"), f"{root}/anchors")
    again = stored(found.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("core"), f"{root}/again")
    found = stored(found.join(again, "core", "left_semi"), f"{root}/candidates")
    release(spark, f"{root}/anchors", f"{root}/again")
    resolved, open_ = _undecided(found, ["core"], "full", root, "cores")

    # The bytes around the anchors that are left, one row a full.
    asked = open_.groupBy("hi", "lo").agg(F.collect_list(F.struct("first", "windows", "anchor")).alias("asked"))
    asked = stored(asked, f"{root}/asked")
    release(spark, f"{root}/candidates")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, most=1 << 20):
            rows = []
            for hi, lo, text, wanted in zip(*(batch.column(n).to_pylist() for n in ("hi", "lo", "text", "asked")), strict=True):
                data = text.encode("utf-8")
                rows += ((hi, lo, x["first"], x["windows"], x["anchor"], data[x["first"] : x["first"] + x["windows"] - 1 + length]) for x in wanted)
            kinds = [*[pa.int64()] * 2, *[pa.int32()] * 3, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["hi", "lo", "context", "windows", "anchor", "data"])

    contexts = passing(texts, asked, ["hi", "lo"]).join(asked, ["hi", "lo"]).select("hi", "lo", "text", "asked").mapInArrow(cut, "hi long, lo long, context int, windows int, anchor int, data binary")
    contexts = stored(contexts, f"{root}/contexts")
    release(spark, f"{root}/asked")

    def parted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "data", 1 << 20):
            index, subs, rows = [], [], []
            for i, (context, windows, anchor, data) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("context", "windows", "anchor", "data")), strict=True)):
                for sub, full, low, n in slices_of(data, anchor - context, windows, length):
                    index.append(i)
                    subs.append(sub)
                    rows.append((full, context + low, n))
            both = np.frombuffer(b"".join(subs), ">i8").astype("<i8").reshape(-1, 2)
            kept = [batch.column(n).take(pa.array(index, pa.int32())) for n in ("hi", "lo", "context")]
            values = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), *kept, *values], names=["sub1", "sub2", "hi", "lo", "context", "full", "first", "windows"])

    slices = contexts.mapInArrow(parted, "sub1 long, sub2 long, hi long, lo long, context int, full long, first int, windows int")
    resolved_too, open_ = _undecided(stored(slices, f"{root}/slices"), ["sub1", "sub2"], "full", root, "subs")
    piece = F.substring("data", F.col("first") - F.col("context") + 1, F.col("windows") - 1 + length)
    pieces = open_.select("sub1", "sub2", "hi", "lo", "context", "first", "windows", "different").join(contexts.select("hi", "lo", "context", "data"), ["hi", "lo", "context"])
    # A text that occurs several times has each of its contexts as often.
    pieces = pieces.select("sub1", "sub2", "hi", "lo", "first", "different", piece.alias("data")).dropDuplicates(["hi", "lo", "first"])
    pieces = stored(pieces, f"{root}/pieces")
    release(spark, f"{root}/slices", f"{root}/contexts")

    run_kind = "hi long, lo long, first int, windows int"
    folder = root.removeprefix("file:") if root.startswith("file:/") else None  # of which files can be mapped

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (((s1, s2), data, hi, lo, first) for batch in batches for s1, s2, data, hi, lo, first in zip(*(batch.column(n).to_pylist() for n in ("sub1", "sub2", "data", "hi", "lo", "first")), strict=True))
        for shard in shards_of(rows, shard_bytes):
            out = [(hi, lo, first + a, n) for (_, _, hi, lo, first), hit in zip(shard, repeated_windows([r[1] for r in shard], length, folder and f"{folder}/queues", queue_bytes), strict=True) for a, n in runs_of(hit)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["hi", "lo", "first", "windows"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = pieces.where(F.col("different") <= most_slices).repartition(n, "sub1", "sub2").sortWithinPartitions("sub1", "sub2", "hi", "lo", "first").mapInArrow(compare, run_kind)

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "data", 1 << 18):
            rows, digests = [], []
            for hi, lo, first, data in zip(*(batch.column(n).to_pylist() for n in ("hi", "lo", "first", "data")), strict=True):
                for p in range(len(data) - length + 1):
                    rows.append((hi, lo, first + p))
                    digests.append(xxhash.xxh3_128_digest(data[p : p + length]))
            both = np.frombuffer(b"".join(digests), ">i8").astype("<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.int32()))), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["hi", "lo", "first", "high", "low"])

    windows = pieces.where(F.col("different") > most_slices).mapInArrow(single, "hi long, lo long, first int, high long, low long")
    twice = windows.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    many = windows.join(twice, ["high", "low"], "left_semi").select("hi", "lo", "first", F.lit(1).alias("windows"))
    return resolved.unionByName(resolved_too).unionByName(few).unionByName(many)


def remove_long_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most_slices: int = MOST_SLICES, segment: int = SEGMENT, shard_bytes: int = SHARD_BYTES, queue_bytes: int = QUEUE_BYTES) -> DataFrame:
    """One row for each row of docs: id, n_bytes, n_removed, n_spans, removed (byte spans), kept (the bytes that stay).

    A byte goes if it lies in a string of `length` bytes that starts at another place too, in the same document or in
    any other, judged on the input. Matches never cross documents. Null text counts as empty; texts shorter than
    `length` lose nothing; rows that repeat an id, or have none, are documents of their own, and equal texts of
    `length` bytes or more all go. Identifiers are of any type. An empty table gives no rows. Other columns are not
    read. Exact up to collisions of 128-bit digests; all rows of one text have one digest and lose the same."""
    spark = docs.sparkSession
    ship(spark)
    root = shared_root(spark)
    texts = picked(docs, id=id_col, text=text_col).select("id", full_text().alias("text"))
    texts = texts.withColumns({"hi": F.xxhash64("text"), "lo": F.xxhash64(F.lit(1), "text")})
    runs = repeated_runs(texts.select("hi", "lo", "text"), root, length, most_slices, segment, shard_bytes, queue_bytes)
    runs = stored(runs, f"{root}/runs")
    release(spark, f"{root}/pieces", f"{root}/cores-joined", f"{root}/subs-joined", f"{root}/queues")
    # Written, so that adaptive execution can split a text with very many copies in the join.
    spans = stored(runs.distinct().groupBy("hi", "lo").agg(F.sort_array(F.collect_list(F.struct("first", "windows"))).alias("runs")), f"{root}/spans")
    remove(spark, f"{root}/runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            rows = []
            for text, found in zip(*(batch.column(n).to_pylist() for n in ("text", "runs")), strict=True):
                data, gone = text.encode("utf-8"), []
                for x in found or ():
                    start, stop = x["first"], x["first"] + x["windows"] - 1 + length
                    if gone and start <= gone[-1]["stop"]:
                        gone[-1]["stop"] = max(stop, gone[-1]["stop"])
                    else:
                        gone.append({"start": start, "stop": stop})
                parts, done = [], 0
                for x in gone:
                    parts.append(data[done : x["start"]])
                    done = x["stop"]
                kept = b"".join([*parts, data[done:]])
                rows.append((len(data), len(data) - len(kept), len(gone), gone, kept))
            span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
            kinds = [*[pa.int64()] * 3, span, pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=["id", "n_bytes", "n_removed", "n_spans", "removed", "kept"])

    joined = with_spans(texts, spans, ["hi", "lo"], "runs").select("id", "text", "runs")
    return joined.mapInArrow(run, f"id {kind_of(joined, 'id')}, n_bytes long, n_removed long, n_spans long, removed array<struct<start: int, stop: int>>, kept binary")
