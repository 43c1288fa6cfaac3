"""Suffix arrays by linear grouping.

Phase 1 takes groups of suffixes, at first by first symbol, in descending order. Each suffix of the group points
to the nearest suffix before it that is in a lower group (previous smaller). The suffixes pointed at have a context that goes on
with the group's context, as many times as they are pointed at, and split off upward from their groups: most pointers highest.
At the end groups are ordered by the longest Lyndon word that begins each suffix.
Phase 2 emits: in suffix-array order, the suffix before each emitted one, and those its pointers lead to, take the
next places of their groups. No symbols are renamed and nothing recurs.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a list of integers; a suffix that is a prefix of another is smaller."""
    n = len(text)
    if not n:
        return []
    order = np.argsort(np.asarray(text), kind="stable")
    symbols = np.asarray(text)[order]
    first = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
    bounds = [*first.tolist(), n]
    group = [0] * n  # of each suffix: the first place of its group
    members: dict[int, list[int]] = {}
    begin = [0] * n  # of a group, by its last place
    placed = order.tolist()
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        members[a] = own = placed[a:b]
        begin[b - 1] = a
        for s in own:
            group[s] = a
    end = {a: b - 1 for a, b in zip(bounds[:-1], bounds[1:], strict=True)}
    before = [-1] * n  # previous smaller
    last = n - 1
    while last >= 0:
        g = begin[last]
        own = sorted([s for s in members.pop(g) if group[s] == g])
        pointed: dict[int, int] = {}
        for s in own:
            p = s - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[s] = p
            if p >= 0:
                pointed[p] = pointed.get(p, 0) + 1
        by_count: dict[int, dict[int, list[int]]] = {}
        for p, k in pointed.items():
            by_count.setdefault(k, {}).setdefault(group[p], []).append(p)
        for k in sorted(by_count, reverse=True):
            for low, moving in by_count[k].items():
                top = end[low]
                new = top - len(moving) + 1
                if new == low:
                    continue
                end[low] = new - 1
                begin[new - 1] = low
                begin[top] = new
                end[new] = top
                members[new] = moving
                for p in moving:
                    group[p] = new
        last = g - 1
    out = [-1] * n
    free = list(range(n))  # by group: its next place
    done = [False] * n

    def emit(s: int) -> None:
        while s >= 0 and not done[s]:
            done[s] = True
            g = group[s]
            out[free[g]] = s
            free[g] += 1
            s = before[s]

    emit(n - 1)
    for i in range(n):
        emit(out[i] - 1)
    return out


def common_prefixes(text: list[int], array: list[int]) -> list[int]:
    """Entry i: the number of symbols that the suffixes at i - 1 and i of the suffix array have in common at their start; 0 at 0."""
    n = len(text)
    rank, out, k = [0] * n, [0] * n, 0
    for i, s in enumerate(array):
        rank[s] = i
    for s in range(n):
        r = rank[s]
        if r == 0:
            k = 0
            continue
        t = array[r - 1]
        most = n - max(s, t)
        while k < most and text[s + k] == text[t + k]:
            k += 1
        out[r] = k
        if k:
            k -= 1
    return out
