"""Word-wise encoding with a bounded cache: natural text repeats its words, so each is encoded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class WordCache:
    """Maps words to what encode() gives for a list of new words.

    Two generations of half of `most` words each: when the young one is full it takes the old one's place, and words
    that are met again come back from there, so frequent words stay. The default takes about 70 MB."""

    def __init__(self, encode: Callable[[list[str]], Iterable], most: int = 300_000, longest: int = 256):
        self.encode, self.half, self.longest, self.young, self.old = encode, most // 2, longest, {}, {}

    def get(self, words: list[str]) -> list:
        """One value for each of words, in order."""
        found = list(map(self.young.get, words))
        missing = dict.fromkeys([w for w, value in zip(words, found, strict=True) if value is None])
        if not missing:
            return found
        new = dict(zip(missing, map(self.old.get, missing), strict=True)) if self.old else missing
        unknown = [w for w, value in new.items() if value is None]
        if unknown:
            new.update(zip(unknown, self.encode(unknown), strict=True))
        kept = new if max(map(len, new)) <= self.longest else {w: v for w, v in new.items() if len(w) <= self.longest}
        if len(self.young) + len(kept) > self.half:
            self.old, self.young = self.young, {}
        if len(kept) <= self.half:
            self.young.update(kept)
        return [new[w] if value is None else value for w, value in zip(words, found, strict=True)]


def chosen(parts: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of parts[which[0]], parts[which[1]], ... in one array, and where each of them ends. parts: ids as
    little-endian 32-bit integers."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    flat, starts = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
    taken = sizes[which]
    ends = np.cumsum(taken)
    return flat[np.repeat(starts[which] - ends + taken, taken) + np.arange(ends[-1] if len(ends) else 0)], ends


def encode_split(texts: pa.Array, cache: WordCache) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words of the texts, which spaces part, in one array, and where each text ends; null is empty.

    Words are told apart in Arrow, so Python sees each distinct word of the batch once."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    split = pc.split_pattern(texts, " ")
    words = split.flatten().dictionary_encode()
    flat, ends = chosen(cache.get(words.dictionary.to_pylist()), words.indices.to_numpy())
    stops = np.concatenate([[0], ends])[np.cumsum(pc.list_value_length(split).to_numpy())]
    return flat, stops
