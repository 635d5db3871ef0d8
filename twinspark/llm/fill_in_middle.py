"""Fill-in-middle: a text is cut at two places, and the middle part is moved behind the other two.

Where to cut is given as a number of units, so units must be counted before a cut is known. A batch of texts is one
array of bytes, dealt into chunks of fixed size. Whether a unit begins at a byte is decided by that byte and the one
before it, so chunks overlap by one byte and are counted independently. Prefix sums over the chunks' counts give the
number of units of each text, and say which chunk holds a cut; only those chunks are looked at again.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinspark.llm.shared import full_text, kind_of, picked, ship, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = ("character", "word", "line")
CHUNK = 4096


def begins(data: np.ndarray, at: int, stop: int, unit: str) -> np.ndarray:
    """Whether a unit begins at each byte of data[at:stop], by that byte and the one before it: a code point, a word
    (what follows ASCII white space) or a line (what follows a line feed). What begins a text is for the caller."""
    if unit == "character":
        return (data[at:stop] & 0xC0) != 0x80
    before = data[max(at, 1) - 1 : stop - 1]
    if unit == "line":
        found = before == 10
    else:
        now, then = data[stop - len(before) : stop], before
        found = ((then == 32) | ((then >= 9) & (then <= 13))) & (now != 32) & ((now < 9) | (now > 13))
    return found if at else np.append(True, found)


class Chunks:
    """Texts that follow each other in data, cut into chunks, with the number of units that begin in each chunk."""

    def __init__(self, data: np.ndarray, ends: np.ndarray, unit: str, size: int = CHUNK):
        """ends: where each text begins, and where the last one ends."""
        self.data, self.unit, self.starts, self.stops = data, unit, ends[:-1], ends[1:]
        chunks = -(-(self.stops - self.starts) // size)
        owner = np.repeat(np.arange(len(chunks)), chunks)
        first = np.cumsum(chunks) - chunks
        self.at = self.starts[owner] + (np.arange(len(owner)) - first[owner]) * size
        self.until = np.minimum(self.at + size, self.stops[owner])
        marks = np.zeros(0, bool)
        if len(owner):
            low, high = int(self.at[0]), int(self.until[-1])
            marks = begins(data, low, high, unit)
            marks[self.starts[chunks > 0] - low] = True
            counts = np.add.reduceat(marks, self.at - low, dtype=np.int64)
        else:
            counts = np.zeros(0, np.int64)
        self.sums = np.concatenate([[0], np.cumsum(counts)])
        self.base = self.sums[first]  # units of all texts before
        self.n = self.sums[first + chunks] - self.base

    def place(self, text: int, rank: int) -> int:
        """The byte at which unit number `rank` of a text begins, its end if it has no more than `rank`."""
        if rank >= self.n[text]:
            return int(self.stops[text])
        wanted = int(self.base[text]) + rank
        chunk = int(np.searchsorted(self.sums, wanted, "right")) - 1
        at = int(self.at[chunk])
        marks = begins(self.data, at, int(self.until[chunk]), self.unit)
        marks[0] |= at == self.starts[text]
        return at + int(np.flatnonzero(marks)[wanted - int(self.sums[chunk])])


def draws(seed: str, name: str) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits from the seed and the identifier as text: the same in every run and on every machine."""
    return struct.unpack(">4I", hashlib.sha256(f"{seed}:{name}".encode()).digest()[:16])


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "character", seed: str = "1", rate: int = 90, spm: int = 20, chunk: int = CHUNK) -> DataFrame:
    """id, n (units of the text), form, prefix_chars, middle_chars (code points) and output for each row of docs.

    `rate` per cent of the texts are cut; of these `spm` per cent begin with the suffix, the others with the prefix.
    A text that is empty or holds a mark itself stays as it is (form plain, both counts null), so that every output can
    be undone, see restored. Null text counts as empty, a null id draws like an empty name, repeated rows are cut alike,
    an empty table gives no rows; other columns are not read."""
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    ship(docs.sparkSession)
    rows = picked(docs, id=id_col, text=text_col).select("id", F.coalesce(F.col("id").cast("string"), F.lit("")).alias("name"), full_text().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column("text").cast(pa.large_string())
            whole = texts.buffers()[2]
            data = np.frombuffer(whole, np.uint8) if whole else np.zeros(0, np.uint8)
            found = Chunks(data, np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1], unit, chunk)
            marked = np.any([pc.match_substring(texts, mark).to_numpy(zero_copy_only=False) for mark in (PREFIX, SUFFIX, MIDDLE)], axis=0)
            forms, before, inside, outputs = [], [], [], []
            for i, name in enumerate(batch.column("name").to_pylist()):
                h1, h2, h3, h4 = draws(seed, name)
                at, end, n = int(found.starts[i]), int(found.stops[i]), int(found.n[i])
                if at == end or marked[i] or h3 % 100 >= rate:
                    forms.append("plain"), before.append(None), inside.append(None), outputs.append(data[at:end].tobytes())
                    continue
                low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
                low, high = found.place(i, low), found.place(i, high)
                prefix, middle, suffix = data[at:low], data[low:high], data[high:end]
                pieces = (b"<S>", suffix, b"<P>", prefix, b"<M>", middle) if h4 % 100 < spm else (b"<P>", prefix, b"<S>", suffix, b"<M>", middle)
                forms.append("spm" if h4 % 100 < spm else "psm")
                before.append(int(np.count_nonzero((prefix & 0xC0) != 0x80))), inside.append(int(np.count_nonzero((middle & 0xC0) != 0x80)))
                outputs.append(b"".join(pieces))
            columns = [batch.column("id"), pa.array(found.n, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return rows.mapInArrow(run, f"id {kind_of(rows, 'id')}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Its parts hold no marks, and no mark overlaps itself or another one, so the
    first of each is the one that was put there."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    at = F.locate(SUFFIX, body)
    at = F.when(form == "psm", at).otherwise(F.locate(PREFIX, body))
    one = F.substr(body, F.lit(1), at - 1)
    rest = F.substr(body, at + F.length(second))
    until = F.locate(MIDDLE, rest)
    two, middle = F.substr(rest, F.lit(1), until - 1), F.substr(rest, until + len(MIDDLE))
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))
