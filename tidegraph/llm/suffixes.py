"""Suffix arrays by induced sorting and permuted common prefixes, on arrays.

Suffixes are larger (L) or smaller (S) than their successor; the leftmost S of a run
start the LMS substrings. These are put in order, named, and the string of names
gives the order of the LMS suffixes; from them the order of all suffixes is induced
in two passes over the buckets of first symbols. Each pass takes a bucket's entries
together, wave by wave, so its work is done by array operations, linear in all.
"""

from __future__ import annotations

import numpy as np


def smaller_types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; ``s`` ends with its only smallest symbol."""
    n = len(s)
    types = np.zeros(n, bool)
    types[-1] = True
    differs = np.flatnonzero(s[1:] != s[:-1])
    rises = s[differs + 1] > s[differs]
    # Equal neighbours have the type of the next difference.
    types[: differs[-1] + 1] = np.repeat(rises, np.diff(np.r_[-1, differs]))
    return types


def _induce(s: np.ndarray, types: np.ndarray, lms: np.ndarray, symbols: int) -> np.ndarray:
    """The suffix array that the given order of the LMS suffixes induces."""
    n = len(s)
    sizes = np.bincount(s, minlength=symbols)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    array = np.full(n, -1, np.int32)
    first = s[lms]
    by_symbol = lms[np.argsort(first, kind="stable")]
    lms_ends = np.cumsum(np.bincount(first, minlength=symbols))
    used = np.flatnonzero(sizes)

    def push(before, fill, step):
        """Put suffixes into their buckets, in order, at the places that are next."""
        symbol = s[before]
        order = np.argsort(symbol, kind="stable")
        count = np.bincount(symbol, minlength=symbols)
        rank = np.arange(len(before)) - np.repeat(np.cumsum(count) - count, count)
        symbol = symbol[order]
        array[fill[symbol] + step * rank] = before[order]
        fill += step * count

    fill = starts.copy()
    for c in used:
        at = starts[c]
        while at < fill[c]:
            wave = array[at : fill[c]]
            at = fill[c]
            before = wave[wave > 0] - 1
            before = before[~types[before]]
            if len(before):
                push(before, fill, 1)
        wave = by_symbol[lms_ends[c - 1] if c else 0 : lms_ends[c]]
        before = wave[wave > 0] - 1
        if len(before):
            push(before, fill, 1)
    larger_ends = fill
    fill = ends - 1
    array[0] = n - 1  # The last symbol is the smallest suffix.
    for c in used[::-1]:
        at = ends[c] - 1
        while at > fill[c]:
            wave = array[fill[c] + 1 : at + 1][::-1]
            at = fill[c]
            before = wave[wave > 0] - 1
            before = before[types[before]]
            if len(before):
                push(before, fill, -1)
        wave = array[starts[c] : larger_ends[c]][::-1] if c else array[:1]
        before = wave[wave > 0] - 1
        before = before[types[before]]
        if len(before):
            push(before, fill, -1)
    array[0] = n - 1
    return array


def _same_as_previous(s: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each stretch equals the one before it in the list."""
    same = np.r_[False, length[1:] == length[:-1]]
    open_ = np.flatnonzero(same)
    step = 0
    while len(open_):
        equal = s[at[open_] + step] == s[at[open_ - 1] + step]
        same[open_[~equal]] = False
        step += 1
        open_ = open_[equal & (length[open_] > step)]
    return same


def _ranked(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string over many symbols, by doubling what is ranked."""
    n, width = len(names), 1
    open_, key = np.arange(n), names.astype(np.int64)
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    base = np.zeros(n, np.int64)  # Where in the order the group of each open suffix begins.
    while len(open_):
        order = np.argsort(key, kind="stable")
        open_, key, base = open_[order], key[order], base[order]
        fresh = np.r_[True, key[1:] != key[:-1]]
        # A suffix ranks by the place of the first of its group.
        index = np.arange(len(open_))
        group = np.r_[True, base[1:] != base[:-1]]
        inside = np.maximum.accumulate(np.where(fresh, index, 0)) - np.maximum.accumulate(np.where(group, index, 0))
        rank[open_] = base + inside
        alone = fresh & np.r_[fresh[1:], True]
        open_ = open_[~alone]
        base = rank[open_]
        key = base * (n + 2) + rank[np.minimum(open_ + width, n)] + 1
        width *= 2
    order = np.empty(n, np.int64)
    order[rank[:n]] = np.arange(n)
    return order


# Reduced strings over more symbols are ranked by doubling: a bucket each is no array operation any more.
MANY_SYMBOLS = 2_048


def suffix_array(s: np.ndarray, symbols: int) -> np.ndarray:
    """The suffixes of ``s`` in order; its last symbol must be its only 0."""
    n = len(s)
    if n <= 2:
        return np.arange(n - 1, -1, -1, dtype=np.int32)
    types = smaller_types(s)
    lms = np.flatnonzero(types[1:] & ~types[:-1]) + 1
    if len(lms) > 1:
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        order = _induce(s, types, lms, symbols)
        order = order[is_lms[order]]
        length = np.zeros(n, np.int32)
        length[lms] = np.diff(np.r_[lms, n - 1]) + 1
        name = np.cumsum(~_same_as_previous(s, order, length[order])) - 1
        names = np.zeros(n, np.int32)
        names[order] = name
        if name[-1] + 1 < len(lms):
            reduced = names[lms]
            small = name[-1] + 1 <= MANY_SYMBOLS
            lms = lms[suffix_array(reduced, int(name[-1]) + 1) if small else _ranked(reduced)]
        else:
            lms = order
    return _induce(s, types, lms, symbols)


def permuted_prefixes(s: np.ndarray, order: np.ndarray, enough: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each place: the suffix before its own in order, and how much both share.

    Only where the symbols before both differ must anything be compared; along other
    places the common prefix shrinks by one a step. With ``enough``, whatever is at
    least that long may be given as that long. Symbols are 16-bit numbers.
    """
    n = len(s)
    before = np.empty(n, np.int32)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    place = np.arange(n, dtype=np.int32)
    compared = np.ones(n, bool)
    if enough is None:
        inner = (place > 0) & (before > 0)
        compared[inner] = s[place[inner] - 1] != s[before[inner] - 1]
    padded = np.zeros(n + 4, np.uint64)
    padded[:n] = s
    four = padded[:n] | padded[1 : n + 1] << np.uint64(16) | padded[2 : n + 2] << np.uint64(32)
    four |= padded[3 : n + 3] << np.uint64(48)
    shared = np.zeros(n, np.int32)
    most = n if enough is None else enough
    step = 0
    open_ = np.flatnonzero(compared & (before >= 0)).astype(np.int32)
    tail = []
    while len(open_) and step < most:
        a, b = open_ + np.int32(step), before[open_] + np.int32(step)
        inside = np.maximum(a, b) < n
        if not inside.all():
            open_, a, b = open_[inside], a[inside], b[inside]
        equal = four[a] == four[b]
        tail.append((open_[~equal], step))
        open_ = open_[equal]
        step += 4
        shared[open_] = step
    for places, step in tail:
        for extra in range(3):
            a, b = places + np.int32(step + extra), before[places] + np.int32(step + extra)
            inside = np.maximum(a, b) < n
            places, a, b = places[inside], a[inside], b[inside]
            places = places[s[a] == s[b]]
            shared[places] = step + extra + 1
    if enough is not None:
        return before, shared
    last = np.maximum.accumulate(np.where(compared, place, 0))
    shared = np.maximum(shared[last] - (place - last), 0)
    shared[before < 0] = 0
    return before, shared
