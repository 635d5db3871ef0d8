"""SentencePiece BPE by vectorised merge rounds.

The symbols of many words lie in one flat numpy array. Each round looks up the rank of every adjacent pair, takes
the minimum of each word by segments, merges the pairs of that rank from the left in all words at once, and compacts
the array, until no pair is left. A sequential encoder takes the leftmost pair of the smallest rank: it would go on to
the next pair of that rank, unless the symbol just made has a pair of a smaller rank. Symbols for which the table has
such pairs are merged once a word and round, all others everywhere at once.

Between two characters that no piece has side by side nothing ever merges, so words are cut there first: a text
without spaces is many short words for the rounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from twinspark.llm.shared import kind_of, picked, ship, small_batches
from twinspark.llm.words import WordCache

SPACE = "\u2581"
NONE = np.iinfo(np.int64).max
ROUND_CHARS = 1 << 20  # words of about this many characters in sum go through the rounds together


class MergeTable:
    """Symbols, and for pairs of symbols the merged symbol and its rank, from the pieces of a model.

    Model requirements, checked here: no text normalisation but the escape of spaces and one leading space, and
    byte fallback. A character that is no piece becomes its UTF-8 bytes' pieces."""

    def __init__(self, processor):
        self.processor = processor
        n = processor.get_piece_size()
        probe = " \u00e9e\u0301 \ufb01  x"
        if processor.decode(processor.encode(probe)) != probe or processor.encode(""):
            raise ValueError("the model normalises text")
        mergeable = [i for i in range(n) if not (processor.is_byte(i) or processor.is_control(i) or processor.is_unknown(i) or processor.is_unused(i))]
        self.id_of = {processor.id_to_piece(i): i for i in mergeable}
        scores = {i: processor.get_score(i) for i in mergeable}
        dense = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.bytes = [processor.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.size, self.extra = n, {}
        for piece in self.id_of:
            for c in piece:
                if c not in self.id_of:
                    self.extra.setdefault(c, n + len(self.extra))
        symbols = self.id_of | self.extra
        pairs = {}
        for piece, i in self.id_of.items():
            for cut in range(1, len(piece)):
                a, b = symbols.get(piece[:cut]), symbols.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = (dense[scores[i]], i)
        self.pairs = pairs
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, NONE)
        self.ranks = np.array([*(pairs[k][0] for k in keys.tolist()), NONE], np.int64)
        self.merged = np.array([*(pairs[k][1] for k in keys.tolist()), -1], np.int64)
        chars = {ord(c): i for c, i in symbols.items() if len(c) == 1}
        self.by_code = np.full(max(chars, default=0) + 1, -1, np.int64)
        self.by_code[list(chars)] = list(chars.values())
        least = np.full(n + len(self.extra) + 1, NONE)  # the smallest rank of a pair with the symbol
        for side in (keys >> 32, keys & 0xFFFFFFFF):
            np.minimum.at(least, side, self.ranks[:-1])
        self.everywhere = np.append(self.ranks[:-1] < least[self.merged[:-1]], False)
        self.back = {i: c for c, i in self.extra.items()}
        beside = {symbols[a] << 32 | symbols[b] for piece in self.id_of for a, b in zip(piece, piece[1:], strict=False)}
        self.beside = np.append(np.array(sorted(beside), np.int64), NONE)
        # Words may be parted before a run of spaces, and around a line feed, if no piece spans such a place.
        self.parted = not any(SPACE in p.lstrip(SPACE) for p in self.id_of)
        self.words = re.compile(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+" if not any("\n" in p for p in self.id_of) else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def split(self, text: str) -> list[str]:
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        return self.words.findall(text) if self.parted else [text]

    def symbols(self, words: list[str]) -> np.ndarray:
        """A character outside the vocabulary is minus its code point less one, and merges with nothing."""
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        known = self.by_code[np.minimum(codes, len(self.by_code) - 1)]
        return np.where((codes < len(self.by_code)) & (known >= 0), known, -1 - codes)

    def final(self, symbols: list[int]) -> list[int]:
        """Pieces' ids; what is no piece becomes its bytes' pieces."""
        out: list[int] = []
        for s in symbols:
            if 0 <= s < self.size:
                out.append(s)
            else:
                out += (self.bytes[b] for b in (self.back[s] if s >= 0 else chr(-1 - s)).encode("utf-8"))
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word, of one character or more, as little-endian 32-bit integers."""
        out, at, chars = [], 0, np.cumsum([0, *map(len, words)])
        while at < len(words):
            stop = max(at + 1, int(np.searchsorted(chars, chars[at] + ROUND_CHARS, "right")) - 1)
            out += self._encode_some(words[at:stop])
            at = stop
        return out

    def _encode_some(self, words: list[str]) -> list[bytes]:
        symbols, lengths = self.symbols(words), np.fromiter(map(len, words), np.int64, len(words))
        pair = np.where((symbols[:-1] >= 0) & (symbols[1:] >= 0), symbols[:-1] << 32 | np.maximum(symbols[1:], 0), NONE - 1)
        first = np.append(True, self.beside[np.searchsorted(self.beside, pair)] != pair)  # of a part that merges on its own
        starts = np.cumsum(lengths) - lengths
        first[starts] = True
        parts = np.flatnonzero(first)
        flat, sizes = self._by_rounds(symbols, np.diff(np.append(parts, len(symbols))))
        sizes = np.add.reduceat(sizes, np.searchsorted(parts, starts))
        ends = np.cumsum(sizes)
        odd = np.unique(np.searchsorted(ends, np.flatnonzero((flat < 0) | (flat >= self.size)), "right")).tolist()
        data, stops = flat.astype("<i4").tobytes(), (ends * 4).tolist()
        out = [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]
        for k in odd:
            out[k] = np.array(self.final(flat[ends[k] - sizes[k] : ends[k]].tolist()), "<i4").tobytes()
        return out

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, NONE where the two don't merge, and its place in the table."""
        key = np.where((left >= 0) & (right >= 0), left << 32 | np.maximum(right, 0), NONE)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE), at

    def _by_rounds(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged symbols of all words, and how many each word has. sizes: at least one symbol a word."""
        count = len(sizes)
        pieces, owners = [], []
        which = np.arange(count)
        rank, entry = self.look_up(flat, np.append(flat[1:], -1))
        rank[np.cumsum(sizes) - 1] = NONE  # a word's last symbol has no right neighbour
        while len(which):
            starts = np.cumsum(sizes) - sizes
            best = np.minimum.reduceat(rank, starts)
            live = best < NONE
            if not live.all():  # words without a pair leave
                alive = np.repeat(live, sizes)
                pieces.append(flat[~alive])
                owners.append(np.repeat(which[~live], sizes[~live]))
                flat, rank, entry, which, sizes, best = flat[alive], rank[alive], entry[alive], which[live], sizes[live], best[live]
                if not len(which):
                    break
                starts = np.cumsum(sizes) - sizes
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            word = np.searchsorted(starts, hits, "right") - 1
            leftmost = np.append(True, word[1:] != word[:-1])
            begins = np.append(True, np.diff(hits) != 1)  # of pairs that overlap each other, every second one merges
            order = np.arange(len(hits))
            chosen = leftmost | self.everywhere[entry[hits]] & ((order - np.maximum.accumulate(np.where(begins, order, 0))) % 2 == 0)
            hits, word = hits[chosen], word[chosen]
            flat[hits] = self.merged[entry[hits]]
            keep = np.ones(len(flat), bool)
            keep[hits + 1] = False
            rank[hits] = NONE
            at = hits - np.arange(len(hits))  # where the merged symbols are after the compaction
            flat, rank, entry, sizes = flat[keep], rank[keep], entry[keep], sizes - np.bincount(word, minlength=len(sizes))
            ends = np.cumsum(sizes)
            for left, valid in ((at, at < ends[word] - 1), (at - 1, at > ends[word] - sizes[word])):  # only their pairs are new
                left = left[valid]
                rank[left], entry[left] = self.look_up(flat[left], flat[left + 1])
        owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return (np.concatenate(pieces) if pieces else flat)[order], np.bincount(owner, minlength=count)


def load(model_path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path)


@lru_cache(maxsize=2)
def encoder(model_path: str) -> tuple[MergeTable, WordCache]:
    """A Python worker keeps the table and its bounded cache of words from one task to the next."""
    table = MergeTable(load(model_path))
    return table, WordCache(table.encode_words)


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """id and ids, one row for each row of docs: what the sentencepiece library's encode() gives for the whole text.
    With decode also `decoded`, as decode_pieces adds it, in the same pass and worker.

    Null text counts as empty and gives no ids; repeated rows are encoded each; an empty table gives no rows.
    Words are encoded once a task and kept in a cache of bounded size. Other columns are not read."""
    ship(docs.sparkSession)
    rows = picked(docs, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, cache = encoder(model_path)
        for batch in small_batches(batches, most=1 << 20):
            split = [table.split(t or "") for t in batch.column("text").to_pylist()]
            parts = cache.get([w for words in split for w in words])
            ends = np.cumsum([len(words) for words in split])
            sizes = np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))]) // 4
            offsets = np.concatenate([[0], sizes[ends]]).astype(np.int32)
            flat = np.frombuffer(b"".join(parts), "<i4")
            columns = [batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]
            if decode:
                columns.append(pa.array([table.processor.decode(flat[a:b].tolist()) if b > a else "" for a, b in zip(offsets, offsets[1:], strict=False)], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "ids", *(["decoded"] if decode else [])]
    return rows.mapInArrow(run, f"id {kind_of(rows, 'id')}, ids array<int>" + ", decoded string" * decode)


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """id, ids and `decoded`: the library's decode(ids). Null or no ids give the empty text; other columns are not read."""
    ship(encoded.sparkSession)
    rows = picked(encoded, id="id", ids="ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor = load(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                batch = whole.slice(at, 200)
                texts = [processor.decode(ids) if ids else "" for ids in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=["id", "ids", "decoded"])

    return rows.mapInArrow(run, f"id {kind_of(rows, 'id')}, ids array<int>, decoded string")
