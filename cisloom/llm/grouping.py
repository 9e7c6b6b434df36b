"""Suffix arrays by linear grouping: suffixes are grouped by their Lyndon prefixes, then each group is put in order."""

from __future__ import annotations

from itertools import repeat

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` (integers) in lexicographic order, a suffix before those that it begins.

    Phase 1 takes the groups from the highest down.  Each of a group's suffixes finds, along pointers to previous smaller ones, the
    nearest suffix to its left in a lower group; that one's prefix is followed by this group's, and where a group's members have
    different numbers of such followers it splits.  A group that has been taken is final: its members share their Lyndon prefix.
    Phase 2 emits the suffixes in ascending order: each emitted one settles, along the same pointers, those whose Lyndon prefix ends where
    it starts, at the next free place of their groups.  No ranks are renamed and nothing is sorted recursively.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    order = np.argsort(text, kind="stable")
    new = np.ones(n, bool)
    new[1:] = text[order][1:] != text[order][:-1]
    starts = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    start_of = np.empty(n, np.int64)
    start_of[order] = starts[which]
    place_of = np.empty(n, np.int64)
    place_of[order] = np.arange(n)
    count = np.zeros(n, np.int64)
    count[starts] = np.diff(np.append(starts, n))
    sa, group, place, size = order.tolist(), start_of.tolist(), place_of.tolist(), count.tolist()
    before = list(repeat(-1, n))
    end = n
    while end:
        first = group[sa[end - 1]]
        if end - first == 1:
            i = sa[first]
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = before[p]
            before[i] = p
            if p >= 0:
                g = group[p]
                k = size[g]
                if k > 1:  # p is the only one with a follower: it goes to a group of its own above the others
                    t = g + k - 1
                    a, q = place[p], sa[t]
                    sa[a], sa[t] = q, p
                    place[q], place[p] = a, t
                    group[p] = t
                    size[g], size[t] = k - 1, 1
            end = first
            continue
        members = sorted(sa[first:end])
        followers: dict[int, int] = {}
        for i in members:
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = before[p]
            before[i] = p
            if p >= 0:
                followers[p] = followers.get(p, 0) + 1
        touched: dict[int, dict[int, list[int]]] = {}
        for p, c in followers.items():
            touched.setdefault(group[p], {}).setdefault(c, []).append(p)
        for g, by_count in touched.items():
            t = g + size[g]
            for c in sorted(by_count, reverse=True):
                upper = t
                for p in by_count[c]:
                    t -= 1
                    a, q = place[p], sa[t]
                    sa[a], sa[t] = q, p
                    place[q], place[p] = a, t
                for p in by_count[c]:
                    group[p] = t
                size[t] = upper - t
            if t > g:
                size[g] = t - g
        end = first
    out = list(repeat(-1, n))
    free = list(range(n))
    done = bytearray(n)
    s, k = n - 1, 0
    while True:
        while s >= 0 and not done[s]:
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            done[s] = 1
            s = before[s]
        if k == n:
            break
        s = out[k] - 1
        k += 1
    return np.array(out, np.int64)
