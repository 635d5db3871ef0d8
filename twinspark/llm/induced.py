"""Suffix sorting with common prefixes by induction, for the texts of one shard.

A suffix is of type S if it is smaller than the one behind it, else of type L. The leftmost S suffixes of each run are
sorted first: their substrings up to the next one get names by their order, and the string of names, about a third as
long, is sorted by recursion. All other suffixes follow by induction: a suffix taken from the queue of its first symbol
in ascending order puts the suffix before it, if that is of type L, into the queue of that one's first symbol; then the
same in descending order for type S. The queues are monotone, so a priority queue is one first-in first-out queue a
symbol, and what a symbol's queue holds is moved as arrays. Common prefixes travel along: two suffixes put into a queue
one behind the other share one symbol more than the smallest prefix between the two that put them there.

The queues are regions of two arrays, suffixes and prefixes. Shards beyond a budget of bytes keep them, level by
level, in files that the system maps, so memory holds the text and what is in use.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

import numpy as np

#: Names are spelt with two symbols from this number on, so that a level has few queues.
MOST_SYMBOLS = 1 << 12


def backed(folder: str | None, budget: int) -> Callable[[int], np.ndarray]:
    """Makes zeroed int32 arrays: in memory up to `budget` bytes in sum, beyond it in files of the folder that are
    deleted at once, so that they go when the arrays do."""
    left = [budget]

    def array(n: int) -> np.ndarray:
        left[0] -= 4 * n
        if left[0] >= 0 or folder is None or not n:
            return np.zeros(n, np.int32)
        os.makedirs(folder, exist_ok=True)
        path = os.path.join(folder, uuid.uuid4().hex)
        found = np.memmap(path, np.int32, "w+", shape=(n,))
        os.unlink(path)
        return found

    return array


def common_prefixes(data: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """How many bytes the suffixes at a and at b share, up to `most`. data: uint8, its last byte occurs nowhere else."""
    padded = np.append(data, np.zeros(most + 8, np.uint8))
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    out, open_ = np.full(len(a), most, np.int32), np.arange(len(a))
    for at in range(0, most, 8):
        differ = words[a[open_] + at] ^ words[b[open_] + at]
        ended = differ != 0
        low = differ[ended]
        out[open_[ended]] = np.minimum(most, at + np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int32) // 8)
        open_ = open_[~ended]
        if not len(open_):
            break
    return out


def _names(t: np.ndarray, s_type: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """For each leftmost S position the number of such substrings that are smaller. A substring ends with the next such
    position; symbols compare with their types, so that none is a prefix of another."""
    n = len(t)
    stop = np.append(lms[1:], n - 1)
    coded = t.astype(np.int64) * 2 + s_type
    bits = int(coded.max()).bit_length()
    per = 62 // bits
    rank, active, at = np.zeros(len(lms), np.int64), np.arange(len(lms)), 0
    while len(active):
        key = np.zeros(len(active), np.int64)
        for k in range(at, at + per):
            p = lms[active] + k
            key = key << bits | np.where(p <= stop[active], coded[np.minimum(p, n - 1)], 0)
        order = np.lexsort((key, rank[active])) if at else np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        old = rank[active]
        new_group, new_part = np.append(True, old[1:] != old[:-1]), np.append(True, key[1:] != key[:-1])
        new_part |= new_group
        place = np.arange(len(active))
        group, part = np.maximum.accumulate(np.where(new_group, place, 0)), np.maximum.accumulate(np.where(new_part, place, 0))
        rank[active] = old + part - group
        at += per
        alone = new_part & np.append(new_part[1:], True)
        active = active[~alone & (stop[active] - lms[active] >= at)]
    return rank


def _pushed(prefixes: np.ndarray, chosen: np.ndarray, most: int) -> np.ndarray:
    """The prefixes of neighbours among the chosen ones of a sequence, one symbol longer; prefixes[0] counts for the first."""
    return np.minimum(np.minimum.reduceat(prefixes[: chosen[-1] + 1], np.append(0, chosen[:-1] + 1)) + 1, most)


def sort_suffixes(t: np.ndarray, most: int = 0, array: Callable[[int], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """The suffixes of t in order, and with `most` how much each shares with the one before it, up to `most` symbols.

    t: symbols from 0 to 65535; the last one is 0 and occurs nowhere else. For `most` they must fit into uint8."""
    array = array or backed(None, 0)
    n, t = len(t), t.astype(np.uint16)
    if n == 1:
        return np.zeros(1, np.int64), np.zeros(1, np.int32) if most else None
    last = np.flatnonzero(t[:-1] != t[1:])  # of each run of equal symbols
    spans = np.diff(np.append(-1, last))
    s_type = np.append(np.repeat(t[last] < t[last + 1], spans), True)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    rank = _names(t, s_type, lms)
    used = np.zeros(len(lms), bool)
    used[rank] = True
    if used.all():
        sorted_lms = np.empty(len(lms), np.int64)
        sorted_lms[rank] = lms
    else:
        name = (np.cumsum(used) - 1)[rank[:-1]]
        base = MOST_SYMBOLS if name.max() < MOST_SYMBOLS else int(name.max() ** 0.5) + 1
        width = 1 if name.max() < MOST_SYMBOLS else 2
        spelt = (name[:, None] // base ** np.arange(width - 1, -1, -1) % base + 1).ravel()
        inner, _ = sort_suffixes(np.append(spelt, 0), 0, array)
        inner = inner[inner % width == 0] // width
        sorted_lms = lms[inner]

    sizes = np.bincount(t)
    heads = np.append(0, np.cumsum(sizes))
    l_sizes = np.bincount(t[~s_type], minlength=len(sizes))
    found, shared = array(n), array(n + 1) if most else None
    if most:
        runs = np.append(np.repeat(last, spans) - np.arange(n - 1) + 1, 1)
        at_lms = np.append(0, common_prefixes(t.astype(np.uint8), sorted_lms[:-1], sorted_lms[1:], most))
    bounds = np.searchsorted(t[sorted_lms], np.arange(len(sizes) + 1))
    symbols = np.flatnonzero(sizes).tolist()

    def put(seq: np.ndarray, taken: np.ndarray, prefixes: np.ndarray | None, sign: int, tails: np.ndarray) -> None:
        """The suffixes before the taken ones of a symbol's sequence into their queues; sign: 1 ascending, -1 descending."""
        if not len(taken):
            return
        before = seq[taken] - 1
        first = t[before]
        target = first[order := np.argsort(first, kind="stable")]
        before = before[order]
        groups = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
        lengths = np.diff(np.append(groups, len(target)))
        place = np.arange(len(target)) - np.repeat(groups, lengths)
        where = tails[target] + sign * place
        found[where] = before
        if prefixes is not None:
            for at, size in zip(groups.tolist(), lengths.tolist(), strict=True):
                shared[where[at : at + size] + (sign < 0)] = _pushed(prefixes, taken[order[at : at + size]], most)
        tails[target[groups]] += sign * lengths

    tails = heads[:-1].copy()
    for c in symbols:
        begin, a, b, depth = heads[c], heads[c], tails[c], 1
        if most:
            shared[begin] = 0
        while a < b:  # those of runs of the symbol come one batch a length
            batch = found[a:b]
            chosen = np.flatnonzero((batch > 0) & (t[batch - 1] == c))
            found[b : b + len(chosen)] = batch[chosen] - 1
            if most and len(chosen):
                shared[b : b + len(chosen)] = _pushed(shared[a:b], chosen, most)
                shared[b] = min(depth, most)
            a, b, depth = b, b + len(chosen), depth + 1
        own = sorted_lms[bounds[c] : bounds[c + 1]]
        seq, prefixes = np.concatenate([found[begin:b], own]).astype(np.int64), None
        if most and len(seq):
            prefixes = np.concatenate([shared[begin:b], at_lms[bounds[c] : bounds[c + 1]]])
            if b > begin and len(own):
                prefixes[b - begin] = min(runs[found[b - 1]], runs[own[0]], most)
            prefixes[0] = 0
        put(seq, np.flatnonzero((seq > 0) & (t[seq - 1] > c)), prefixes, 1, tails)

    tails = heads[1:] - 1
    found[0] = n - 1
    tails[0] -= 1
    for c in reversed(symbols):
        end, a, b, depth = heads[c + 1] - 1, heads[c + 1] - 1, tails[c], 1
        while a > b:
            batch = found[b + 1 : a + 1][::-1]
            chosen = np.flatnonzero((batch > 0) & (t[batch - 1] == c))
            found[b - len(chosen) + 1 : b + 1] = (batch[chosen] - 1)[::-1]
            if most and len(chosen):
                shared[b - len(chosen) + 2 : b + 2] = _pushed(shared[b + 2 : a + 2][::-1], chosen, most)[::-1]
                shared[b + 1] = min(depth, most)
            a, b, depth = b, b - len(chosen), depth + 1
        begin = heads[c]
        edge = begin + l_sizes[c]  # the first of type S
        if most:
            shared[end + 1] = 0
            if begin < edge <= end:
                shared[edge] = min(runs[found[edge - 1]], runs[found[edge]], most)
        seq = found[begin : end + 1][::-1].astype(np.int64)
        put(seq, np.flatnonzero((seq > 0) & (t[seq - 1] < c)), shared[begin + 1 : end + 2][::-1] if most else None, -1, tails)
    return np.asarray(found).astype(np.int64), np.asarray(shared)[:n] if most else None
