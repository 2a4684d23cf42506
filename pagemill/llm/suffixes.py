"""Suffix arrays by two-stage sorting, up to a bounded depth, and the common prefixes of neighbours.

Stage one sorts only suffixes that do not begin with a descent (first byte not larger than the second); stage two
scans the buckets of first bytes in rising order and puts the predecessor of every suffix met, if it begins with a
descent, at the next free place of its own bucket, where those suffixes come before the directly sorted ones.
"""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15)


def powers(n: int) -> np.uint64:
    """BASE to the n, modulo 2**64."""
    return np.uint64(pow(int(BASE), n, 1 << 64))


def hashes(data: np.ndarray, length: int) -> np.ndarray:
    """Polynomial hashes of all runs of ``length`` bytes, joined from runs of powers of two."""
    have, width, out, done = data.astype(np.uint64) + np.uint64(1), 1, None, 0
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    while True:
        if length & width:  # the lowest remaining bits make the run's tail
            tail = have[length - done - width : length - done - width + n]
            out = tail.copy() if out is None else tail * powers(done) + out
            done += width
            if done == length:
                return out
        have = have[: len(have) - width] * powers(width) + have[width:]
        width *= 2


def words(data: np.ndarray, depth: int) -> np.ndarray:
    """At each position the next eight bytes as a number, big-endian; beyond the end there are zeros."""
    padded = np.concatenate([data, np.zeros(depth + 8, np.uint8)]).astype(np.uint64)
    for width in (1, 2, 4):
        padded = (padded[: len(padded) - width] << np.uint64(8 * width)) | padded[width:]
    return padded


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Positions of ``data`` (uint8) in the order of their suffixes; equal ones up to ``depth`` bytes stay in any order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    following = np.append(data[1:], 0)
    descends = data > following  # the last suffix counts as followed by the least byte
    order = _sorted_directly(data, np.flatnonzero(~descends), depth)
    size = np.bincount(data, minlength=256)
    firsts = data[order]
    cut = np.searchsorted(firsts, np.arange(257))
    begin = np.cumsum(size) - size
    induced = np.zeros(257, np.int64)
    out = np.empty(n, np.int64)
    # The end of the text precedes every suffix; it induces the last one if that descends.
    if descends[n - 1]:
        out[begin[data[n - 1]]] = n - 1
        induced[data[n - 1]] = 1
    for c in np.flatnonzero(size).tolist():
        direct = order[cut[c] : cut[c + 1]]
        start = int(begin[c])
        out[start + size[c] - len(direct) : start + size[c]] = direct
        before = out[start : start + size[c]] - 1
        before = before[before >= 0]
        before = before[data[before] > c]
        into = data[before]
        before = before[np.argsort(into, kind="stable")]
        counts = np.bincount(into, minlength=256)
        at = 0
        for b in np.flatnonzero(counts).tolist():
            to = int(begin[b] + induced[b])
            out[to : to + counts[b]] = before[at : at + counts[b]]
            induced[b] += counts[b]
            at += counts[b]
    return out


def _sorted_directly(data: np.ndarray, positions: np.ndarray, depth: int) -> np.ndarray:
    """Positions by their next ``depth`` bytes: groups that are still tied are parted five bytes at a time.

    Where all of a group go on alike, which hashes of stretches tell, it moves on by that stretch without sorting.
    """
    word = words(data, depth)
    padded = np.concatenate([data, np.zeros(2 * depth, np.uint8)])
    stretches = [(n, hashes(padded, n)) for n in (128, 64, 32, 16, 8) if n <= depth]
    whole = hashes(padded, depth)
    order = positions[np.argsort(word[positions], kind="stable")]
    key = word[order]
    group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1 if len(order) else np.zeros(0, np.int64)
    places, at = np.arange(len(order)), np.full(len(order), 8)
    while len(places):
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        size = np.diff(np.append(first, len(group)))
        same_group = group[1:] == group[:-1]

        def mixed(h: np.ndarray, first: np.ndarray = first, same_group: np.ndarray = same_group) -> np.ndarray:
            return np.maximum.reduceat(np.r_[False, (h[1:] != h[:-1]) & same_group], first)

        keep = np.repeat((size > 1) & mixed(whole[order[places]]) & (at[first] < depth), size)
        if not keep.all():
            places, group, at = places[keep], group[keep], at[keep]
            group = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1 if len(group) else group
            if not len(places):
                break
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            size = np.diff(np.append(first, len(group)))
            same_group = group[1:] == group[:-1]
        here = order[places]
        for n, h in stretches:
            go = ~mixed(h[here + at], first, same_group) & (at[first] + n <= depth)
            at = at + np.repeat(np.where(go, n, 0), size)
        key = (group.astype(np.uint64) << np.uint64(40)) | (word[np.minimum(here + at, len(word) - 1)] >> np.uint64(24))
        by = np.argsort(key)
        order[places], key = here[by], key[by]
        group = np.cumsum(np.r_[True, key[1:] != key[:-1]]) - 1
        at = at + 5
    return order


def adjacent_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Of each suffix in ``order`` the bytes it shares with the one before it, ``depth`` at most; the first shares none."""
    word = words(data, depth)
    out = np.zeros(len(order), np.int64)
    left = np.arange(1, len(order))
    for at in range(0, depth, 8):
        if not len(left):
            break
        a, b = order[left - 1] + at, order[left] + at
        differ = word[np.minimum(a, len(word) - 1)] ^ word[np.minimum(b, len(word) - 1)]
        end = len(data) - np.maximum(a, b)  # what lies past the end is shared by none
        same = np.where(differ == 0, 8, 0)
        some = np.flatnonzero(differ)
        same[some] = (63 - np.floor(np.log2(differ[some].astype(np.float64))).astype(np.int64).clip(0, 63)) // 8
        same = np.minimum(same, np.clip(end, 0, 8))
        out[left] += same
        left = left[same == 8]
    return np.minimum(out, depth)
