"""Deep-shallow ordering of suffixes up to a fixed depth.

Multikey quicksort over eight bytes at a time orders the suffixes to a shallow
depth; what still shares that prefix is ordered by blind tries, built for all
groups at once: a node keeps only the depth at which its suffixes part, found
against one of them, and the byte there.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16


def eights(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a big-endian number; zeros follow the end."""
    padded = np.zeros(len(text) + 8, np.uint64)
    padded[: len(text)] = text
    out = np.zeros(len(text) + 1, np.uint64)
    for i in range(8):
        out = (out << np.uint64(8)) | padded[i : i + len(text) + 1]
    return out


def _leading(x: np.ndarray) -> np.ndarray:
    """Zero bytes at the front."""
    out = np.zeros(len(x), np.int64)
    for shift in range(8, 72, 8):
        out += x < np.uint64(1 << (64 - shift)) if shift < 64 else x == 0
    return out


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Number of the run of equal keys that each place belongs to."""
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def order(text: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of ``starts`` in order of their first ``depth`` bytes, and for each place the number of its run of equals."""
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    eight = eights(text)

    def word(which: np.ndarray, at: int) -> np.ndarray:
        x = eight[np.minimum(starts[which] + at, len(text))]
        return x & ~np.uint64((1 << (8 * (at + 8 - depth))) - 1) if at + 8 > depth else x

    perm = np.argsort(word(np.arange(n), 0), kind="stable")
    group = _groups(word(perm, 0))
    for at in range(8, min(SHALLOW, depth), 8):  # multikey quicksort: the next characters of what is still equal
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        key = word(perm[tied], at)
        again = np.lexsort((key, group[tied]))
        perm[tied] = perm[tied][again]
        full = np.zeros(n, np.uint64)
        full[tied] = key[again]
        group = _groups(group, full)
    size = np.bincount(group)
    tied = np.flatnonzero(size[group] > 1)
    known = np.full(len(tied), min(SHALLOW, depth))  # depth to which each group is equal
    part = np.zeros(n, np.int64)
    sub = np.zeros(n, np.int64)
    sub[:] = group
    while len(tied):  # one level of all blind tries a turn
        g = sub[tied]
        head = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        of = np.cumsum(np.r_[False, g[1:] != g[:-1]])
        lcp = np.full(len(tied), depth)
        open_ = np.arange(len(tied))
        first = perm[tied[head]][of]
        for at in range(int(known.min()) // 8 * 8, depth, 8):
            if not len(open_):
                break
            differ = word(perm[tied[open_]], at) ^ word(first[open_], at)
            hit = differ != 0
            lcp[open_[hit]] = np.minimum(depth, at + _leading(differ[hit]))
            open_ = open_[~hit]
        branch = np.minimum.reduceat(lcp, head)[of]
        live = branch < depth
        if not live.any():
            break
        tied, branch, g = tied[live], branch[live], g[live]
        byte = text[np.minimum(starts[perm[tied]] + branch, len(text) - 1)].astype(np.int64)
        again = np.lexsort((byte, g))
        perm[tied] = perm[tied][again]
        byte, branch = byte[again], branch[again]
        part[:] = 0
        part[tied] = byte
        sub = _groups(sub, part)
        size = np.bincount(sub)
        more = size[sub[tied]] > 1
        known = branch[more]
        tied = tied[more]
    return perm, sub
