"""Token ids in sorted-string-table shards.

A shard is one file: data blocks of prefix-compressed (key, value) entries in key order, a sparse index with the
last key of each block, a Bloom filter over the keys, and a fixed footer. Keys are document identifiers in an
order-preserving form (a null id is the empty key and comes first); a value holds the ids that precede the
document inside the shard, the number of its ids, and the ids. Spark partitions documents by identifier range; each
task streams its sorted range into one shard, a block at a time.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from twinspark.llm.shared import full_text, kind_of, picked, ship, small_batches, stored
from twinspark.llm.words import WordCache, encode_split

MAGIC = b"SSTIDS01"
FOOTER = struct.Struct("<QQQQQQ8s")  # index at, index size, filter at, filter size, entries, ids, MAGIC
BLOCK_BYTES = 1 << 16
RESTART = 16  # entries between two whole keys
BLOOM_BITS_PER_KEY, BLOOM_HASHES = 10, 7
MANIFEST = "shard_path string, n_docs long, n_ids long, first_key string, shard long"
#: Texts of about this many bytes go to a shard; there are at least as many shards as shuffle partitions.
SHARD_BYTES = 256 << 20


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes | memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def key_of(doc_id: int | str | None) -> bytes:
    """In the order of the identifiers; a byte in front tells a null (which has none) from an empty string."""
    if doc_id is None:
        return b""
    return b"s" + doc_id.encode("utf-8") if isinstance(doc_id, str) else b"n" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | str | None:
    if not key:
        return None
    return key[1:].decode("utf-8") if key[:1] == b"s" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def bloom_hashes(key: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1


def bloom_bits(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """The bits of each key, one row a hash function. first, second: its two hashes, unsigned 64-bit."""
    return (first + np.arange(BLOOM_HASHES, dtype=np.uint64)[:, None] * second) % np.uint64(size)


class ShardWriter:
    """Streams entries in key order to an output stream; holds one block, and 16 bytes a key for the filter."""

    def __init__(self, out):
        self.out, self.at, self.block, self.index = out, 0, bytearray(), []
        self.last, self.in_block, self.entries, self.ids, self.hashes = b"", 0, 0, 0, array("Q")

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.entries and key < self.last:
            raise ValueError("keys must not descend")
        shared = 0 if self.in_block % RESTART == 0 else len(os.path.commonprefix([key, self.last]))
        narrow = not len(ids) or int(ids.max()) < 1 << 16
        value = varint(self.ids) + varint(len(ids)) + (b"\2" if narrow else b"\4") + ids.astype("<u2" if narrow else "<u4").tobytes()
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.in_block, self.entries, self.ids = key, self.in_block + 1, self.entries + 1, self.ids + len(ids)
        self.hashes.extend(bloom_hashes(key))
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.block:
            self.index.append((self.last, self.at, len(self.block)))
            self.write(bytes(self.block))
            self.block, self.in_block = bytearray(), 0

    def close(self) -> None:
        self.flush()
        index_at = self.at
        self.write(b"".join(varint(len(k)) + k + varint(at) + varint(size) for k, at, size in self.index))
        filter_at, bits = self.at, max(64, self.entries * BLOOM_BITS_PER_KEY)
        marks, hashes = np.zeros(bits, bool), np.frombuffer(self.hashes, np.uint64).reshape(-1, 2)
        for at in range(0, len(hashes), 1 << 16):
            marks[bloom_bits(*hashes[at : at + (1 << 16)].T, bits).ravel()] = True
        self.write(struct.pack("<Q", bits) + np.packbits(marks).tobytes())
        self.write(FOOTER.pack(index_at, filter_at - index_at, filter_at, self.at - filter_at, self.entries, self.ids, MAGIC))


class ShardReader:
    """Reads a shard from a random-access file: footer, sparse index and filter first, then blocks as asked for."""

    def __init__(self, source):
        self.source, size = source, source.size()
        index_at, index_size, filter_at, filter_size, self.entries, self.ids, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw, at, self.index = self._at(index_at, index_size), 0, []
        while at < len(raw):
            n, at = read_varint(raw, at)
            key, at = raw[at : at + n], at + n
            start, at = read_varint(raw, at)
            length, at = read_varint(raw, at)
            self.index.append((key, start, length))
        raw = self._at(filter_at, filter_size)
        self.bits = struct.unpack("<Q", raw[:8])[0]
        self.filter = raw[8:]

    def _at(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def block(self, i: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        """(key, ids before it in the shard, its ids) of block i."""
        _, start, size = self.index[i]
        data, at, key = self._at(start, size), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            length, at = read_varint(data, at)
            key, at = key[:shared] + data[at : at + rest], at + rest
            end = at + length
            before, p = read_varint(data, at)
            n, p = read_varint(data, p)
            yield key, before, np.frombuffer(data, "<u2" if data[p] == 2 else "<u4", n, p + 1).astype("<u4")
            at = end

    def rows(self) -> Iterator[tuple[bytes, int, np.ndarray]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def lookup(self, doc_id: int | str | None) -> list[np.ndarray]:
        """The ids of each entry with this identifier; the filter rejects most absent ones without a read."""
        key = key_of(doc_id)
        marks = bloom_bits(*(np.array([h], np.uint64) for h in bloom_hashes(key)), self.bits).ravel().tolist()
        if not all(self.filter[b >> 3] >> (7 - (b & 7)) & 1 for b in marks):
            return []
        found, i = [], bisect_left([k for k, _, _ in self.index], key)
        while i < len(self.index):
            rows = list(self.block(i))
            found += [ids for k, _, ids in rows if k == key]
            if rows[-1][0] > key:
                break
            i += 1
        return found


def open_shard(path: str) -> ShardReader:
    fs, inner = pyarrow.fs.FileSystem.from_uri(path)
    return ShardReader(fs.open_input_file(inner))


def byte_alphabet() -> list[str]:
    """The character for each byte in byte-level models: printable Latin-1 stands for itself, others follow from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


#: Texts of nothing but these characters, where Arrow's lower case, its patterns and the library agree on each: line
#: feed, tab, printable ASCII and Latin letters and signs up to U+024F, without U+0130, whose lower case is two characters.
PLAIN = "^[\\n\\t -~\u00a1-\u012f\u0131-\u024f]*$"


@lru_cache(maxsize=2)
def text_encoder(tokenizer_path: str, end_id: int) -> Callable[[pa.Array], list[np.ndarray]]:
    """Encodes texts as the tokenizers library does for a tokenizer that lower-cases, drops white space and cuts texts
    by a pattern into parts that it encodes one by one; end_id follows each text.

    Plain texts are cut in Arrow, by the tokenizer's own pattern, and each distinct part is given to the library's model
    once. All other texts, and those with one of its special tokens, take the library's whole way. Null is empty. A
    Python worker keeps the encoder and its bounded cache from one task to the next."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path)
    with open(tokenizer_path, encoding="utf-8") as f:
        steps = json.load(f)
    normal = [x["type"] for x in (steps["normalizer"] or {}).get("normalizers", ())]
    cuts = (steps["pre_tokenizer"] or {}).get("pretokenizers", ())
    known = normal == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
    if not known or "|[\\p{L}]+|" not in cuts[0]["pattern"]["Regex"]:
        raise ValueError("the tokenizer is not one that lower-cases and drops white space")
    # Runs of letters are what is left between spaces once all other parts stand between two.
    others = cuts[0]["pattern"]["Regex"].replace("|[\\p{L}]+|", "|")
    special = "|".join(re.escape(t["content"]) for t in steps["added_tokens"]) or "$^"
    letters, tokenize = dict(enumerate(byte_alphabet())), tokenizer.model.tokenize

    def part_ids(parts: list[str]) -> list[bytes]:
        spelt = (p if p.isascii() else p.encode("utf-8").decode("latin-1").translate(letters) for p in parts)
        return [array("I", [t.id for t in tokenize(s)]).tobytes() if s else b"" for s in spelt]

    cache = WordCache(part_ids, most=600_000)

    def plain_ids(texts: pa.Array) -> list[np.ndarray]:
        cut = pc.replace_substring_regex(pc.utf8_lower(texts), others, r" \0 ")
        flat, stops = encode_split(pc.replace_substring(pc.replace_substring(cut, "\n", " "), "\t", " "), cache)
        return np.split(np.insert(flat, stops, end_id), (stops + np.arange(1, len(stops) + 1))[:-1])

    def encode(texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        plain = pc.and_(pc.match_substring_regex(texts, PLAIN), pc.invert(pc.match_substring_regex(texts, special)))
        done = iter(plain_ids(texts.filter(plain)) if pc.any(plain).as_py() else ())
        rest = iter(tokenizer.encode_batch_fast(texts.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False))
        return [next(done) if ok else np.array([*next(rest).ids, end_id], "<u4") for ok in plain.to_pylist()]

    return encode


def write_sstables(docs: DataFrame, root: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards under root and returns the manifest: path, n_docs, n_ids, first_key (in hexadecimal) of each.

    Identifiers are integers or strings. Null text counts as empty and gives the end id alone; rows that repeat an
    identifier are entries of their own, in the order of a hash of the text; rows without one come first. The
    ranges go by identifier, that hash and the row's place, so an identifier with very many rows, or none, is dealt to
    many shards. An empty table gives no shard. A retried task writes a new file; only files in the manifest count.
    Other columns are not read. Texts and not ids are shuffled: the ranges are found by a pass over the identifiers
    alone, and the ids would have to be stored for that, as much disk again."""
    spark: SparkSession = docs.sparkSession
    ship(spark)
    rows = picked(docs, id=id_col, text=text_col)
    if kind_of(rows, "id") != "string":
        rows = rows.withColumn("id", F.col("id").cast("long"))
    rows = rows.select("id", full_text().alias("text"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    if not shards:
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    ordered = rows.repartitionByRange(shards, "id", "tie", "row").sortWithinPartitions("id", "tie", "row").select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        encode, writer, first = text_encoder(tokenizer_path, end_id), None, b""
        for batch in small_batches(batches):
            ids = batch.column("id").to_pylist()
            if writer is None:
                fs.create_dir(base, recursive=True)
                name = f"{uuid.uuid4().hex}.sst"
                out = fs.open_output_stream(f"{base}/{name}")
                writer, first = ShardWriter(out), key_of(ids[0])
            for doc_id, codes in zip(ids, encode(batch.column("text")), strict=True):
                writer.add(key_of(doc_id), codes)
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((f"{root}/{name}", pa.string()), (writer.entries, pa.int64()), (writer.ids, pa.int64()), (first.hex(), pa.string()), (TaskContext.get().partitionId(), pa.int64()))], names=[x.split()[0] for x in MANIFEST.split(", ")])

    return stored(ordered.mapInArrow(run, MANIFEST), f"{root}/manifest")


def read_sstables(manifest: DataFrame, digest: bool = False, id_kind: str = "long") -> DataFrame:
    """doc_id, start (ids of all documents before it), ids, from the shards' files; a task reads whole shards.

    With digest: n_tokens and ids_crc32 (of the ids as little-endian unsigned 32-bit integers) in place of the ids.
    The window runs over one row a shard, not over documents. id_kind: "string" for string identifiers."""
    ship(manifest.sparkSession)
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    based = manifest.withColumn("base", F.coalesce(before, F.lit(0)))
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    based = based.select("shard_path", "base").repartition(n, "shard_path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                reader = open_shard(path)
                for i in range(len(reader.index)):
                    rows = list(reader.block(i))
                    columns = [pa.array([id_of(r[0]) for r in rows], pa.string() if id_kind == "string" else pa.int64()), pa.array([base + r[1] for r in rows], pa.int64())]
                    if digest:
                        columns += [pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([zlib.crc32(r[2]) for r in rows], pa.int64())]
                    else:
                        sizes = np.cumsum([0, *(len(r[2]) for r in rows)])
                        columns.append(pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate([r[2] for r in rows]).view("<i4"))))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "start", *(["n_tokens", "ids_crc32"] if digest else ["ids"])]
    return based.mapInArrow(run, f"doc_id {id_kind}, start long, " + ("n_tokens long, ids_crc32 long" if digest else "ids array<int>"))
