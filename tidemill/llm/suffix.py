"""Suffix arrays in numpy: Larsson-Sadakane refinement and Kasai's common prefixes."""

from __future__ import annotations

import numpy as np


def pack(text: np.ndarray, bits: int) -> tuple[np.ndarray, int]:
    """Each position's next symbols, as many as fit one number (the second result); 0 stands for the end."""
    n, h = len(text), max(1, 63 // bits)
    packed = np.zeros(n, np.int64)
    for k in range(h):
        packed <<= bits
        packed[: max(0, n - k)] += text[k:].astype(np.int64) + 1
    return packed, h


def suffix_array(text: np.ndarray, depth: int | None = None, bits: int = 62, packed: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorts all suffixes of an array of integers from 0; a suffix that ends first is smaller.

    The first sort is by pack(text, bits), where symbols + 1 have so many bits. Each round then doubles the sorted depth
    and touches only slots of groups that are still unsorted. With depth, rounds end once that many symbols are compared.
    Returns (sa, rank); rank is the first slot of a suffix's group.
    """
    n, h = len(text), max(1, 63 // bits)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    packed = pack(text, bits)[0] if packed is None else packed
    sa = np.argsort(packed)
    ordered = packed[sa]
    first = np.empty(n + 1, bool)
    first[0] = first[n] = True
    np.not_equal(ordered[1:], ordered[:-1], out=first[1:n])
    rank = np.empty(n, np.int64)
    starts = np.flatnonzero(first[:n])
    rank[sa] = np.repeat(starts, np.diff(np.append(starts, n)))
    slots = np.flatnonzero(~(first[:n] & first[1:]))
    while slots.size and (depth is None or h < depth):
        suffix = sa[slots]
        group = rank[suffix]
        after = suffix + h
        key = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        order = np.argsort(group * (n + 1) + key)  # groups lie side by side, so each stays in its own slots
        suffix, group, key = suffix[order], group[order], key[order]
        sa[slots] = suffix
        new = np.empty(slots.size, bool)
        new[0] = True
        new[1:] = (group[1:] != group[:-1]) | (key[1:] != key[:-1])
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, slots.size))
        rank[suffix] = np.repeat(slots[begin], sizes)
        slots = slots[np.repeat(sizes > 1, sizes)]
        h *= 2
    return sa, rank


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int | None = None, bits: int = 62, packed: np.ndarray | None = None) -> np.ndarray:
    """Kasai's lcp[i] of the suffixes in slots i-1 and i (lcp[0] = 0), in blocks of text positions.

    Kasai's bound (a suffix shares at least one symbol less than the suffix before it) holds inside runs whose neighbour
    moves along by one; such runs are compared once, from their end, as many symbols at a time as pack() joins. With
    most, longer prefixes count as most.
    """
    n = len(text)
    lcp = np.zeros(n, np.int64)
    if n < 2:
        return lcp
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    same = np.zeros(n, bool)
    has = before >= 0
    i = np.flatnonzero(has)
    same[i] = text[i] == text[before[i]]
    # plcp[i] = plcp[i+1] + 1 where both symbols are equal and i+1's neighbour is before[i]+1
    follows = np.zeros(n, bool)
    follows[:-1] = same[:-1] & (before[1:] == before[:-1] + 1)
    plcp = np.zeros(n, np.int64)
    ends = np.flatnonzero(has & ~follows)  # compared directly
    packed, h = (packed, max(1, 63 // bits)) if packed is not None else pack(text, bits)
    live, length = ends[same[ends]], 0
    cap = n if most is None else most
    while live.size and length < cap:
        a, b = live + length, before[live] + length
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        differ = packed[a] ^ packed[b]
        equal = np.zeros(len(live), np.int64)
        for k in range(1, h + 1):
            equal += differ >> (bits * (h - k)) == 0
        plcp[live] += equal
        live = live[equal == h]
        length += h
    # positions of a run add their distance from its end
    run_end = np.where(follows, n, np.arange(n))
    run_end = np.minimum.accumulate(run_end[::-1])[::-1]
    run_end = np.minimum(run_end, n - 1)
    plcp = np.where(follows, plcp[run_end] + run_end - np.arange(n), plcp)
    np.minimum(plcp, cap, out=plcp)
    lcp[1:] = plcp[sa[1:]]
    return lcp
