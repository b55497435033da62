"""Suffix arrays of many small collections of strings at once, by linear grouping.

After Baier's construction. The first phase groups suffixes by their longest
Lyndon prefix: groups are taken from the greatest down, every suffix of a group
looks for the nearest place before it that is in a smaller group (its previous
smaller suffix), and the places so found move up within their own group, those
found more often further. The second phase goes through the order from the
smallest suffix up and puts the chain of previous smaller suffixes before it
in the next free places of their groups. Nothing is renamed and nothing recurses.

All collections go through these steps side by side: one step takes the
greatest group left in each of them, as arrays. So the number of steps is that of the largest
collection's groups, and the work that of all bytes.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for so many of each."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _grouped(codes: np.ndarray, base: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each suffix, its previous smaller suffix). A group is named by its first place in the order."""
    n = len(codes)
    unit = np.repeat(np.arange(len(base)), end - base)
    key = unit * 258 + codes[1:]
    sa = np.r_[0, np.argsort(key, kind="stable") + 1]
    ordered = key[sa[1:] - 1]
    heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) + 1
    sizes = np.diff(np.r_[heads, n])
    group, isa, group_end = np.zeros(n, np.int64), np.empty(n, np.int64), np.zeros(n + 1, np.int64)
    group[sa[1:]] = np.repeat(heads, sizes)
    group_end[heads] = heads + sizes
    isa[sa] = np.arange(n)
    prev, moved = np.arange(-1, n - 1), np.zeros(n, bool)
    prev[0] = 0
    bound, low = end.copy(), base.copy()
    live = bound > low + 1
    bound, low = bound[live], low[live]
    while len(bound):
        g = group[sa[bound - 1]]
        sizes = bound - g
        i = sa[_ranges(g, sizes)]
        own = np.repeat(g, sizes)
        p = i - 1
        todo = np.flatnonzero(group[p] >= own)  # taken already or in the same group: jump on
        while len(todo):
            p[todo] = prev[p[todo]]
            prev[i[todo]] = p[todo]
            todo = todo[group[p[todo]] >= own[todo]]
        found, count = np.unique(p[p >= np.repeat(low, sizes)], return_counts=True)
        if len(found):
            of = group[found]
            order = np.lexsort((count, of))
            found, count, of = found[order], count[order], of[order]
            first = np.r_[True, of[1:] != of[:-1]]
            at = np.flatnonzero(first)
            many = np.diff(np.r_[at, len(of)])
            old_end = group_end[of[at]]
            cut = old_end - many
            place = _ranges(cut, many)
            moved[found] = True
            there = sa[place]
            out = there[~moved[there]]
            was = isa[found]
            free = was[was < np.repeat(cut, many)]
            sa[free], isa[out] = out, free
            sa[place], isa[found] = found, place
            moved[found] = False
            group_end[of[at]] = cut
            head = np.flatnonzero(first | np.r_[True, count[1:] != count[:-1]])
            runs = np.diff(np.r_[head, len(of)])
            group[found] = np.repeat(place[head], runs)
            group_end[place[head]] = place[head] + runs
        left = g > low + 1
        bound, low = g[left], low[left]
    return group, prev


def _emitted(group: np.ndarray, prev: np.ndarray, base: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The suffix array from groups and previous smaller suffixes."""
    n = len(group)
    sa, free, placed = np.zeros(n, np.int64), np.arange(n), np.zeros(n, bool)
    sa[base] = end - 1
    placed[end - 1] = True
    at, low, high = base.copy(), base, end
    j = sa[at] - 1
    while len(at):
        fits = (j >= low) & ~placed[j]
        k = j[fits]
        if len(k):
            g = group[k]
            sa[free[g]] = k
            free[g] += 1
            placed[k] = True
            j[fits] = prev[k]
        else:
            fits = np.zeros(len(at), bool)
        on = np.flatnonzero(~fits)
        at[on] += 1
        if (at[on] == high[on]).any():
            left = at < high
            at, low, high, j = at[left], low[left], high[left], j[left]
            on = on[left[on]]
            on = np.cumsum(left)[on] - 1
        j[on] = sa[at[on]] - 1
    return sa


def suffix_array(codes: np.ndarray, base: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The order of all suffixes, each collection's in its own part [base, end).

    ``codes`` starts with one 0 that belongs to none; every collection ends
    with its only 0 and has codes 1 to 257 before it.
    """
    return _emitted(*_grouped(codes, base, end), base, end)


def laid_out(strings: list[bytes], units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, base, end, start of each string). ``units`` ascend: the collection of each string. Strings end with a 1."""
    sizes = np.array([len(s) for s in strings])
    last = np.r_[units[1:] != units[:-1], True]
    widths = sizes + 1 + last
    starts = 1 + np.cumsum(widths) - widths
    codes = np.zeros(1 + widths.sum(), np.int64)
    codes[_ranges(starts, sizes)] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 2
    codes[starts + sizes] = 1
    first = np.r_[True, last[:-1]]
    return codes, starts[first], (starts + widths)[last], starts
