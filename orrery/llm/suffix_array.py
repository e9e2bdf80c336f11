"""Suffix arrays by linear grouping.

Suffixes start grouped by their first symbol. Groups are taken from the greatest down; each member's
previous smaller suffix is found by pointers, and those suffixes, whose known prefix now goes on into
the group at hand, move to groups of their own right behind the ones they leave, those that go on
more often further back. In the end a group holds the suffixes with one longest Lyndon prefix, and
groups are in order. A suffix is its Lyndon prefix followed by the next smaller suffix, so going
through the suffix array in ascending order, each suffix places the ones that it is the next smaller
of at the front of what is free in their groups. Nothing is renamed and nothing recurs.
"""

from __future__ import annotations

from collections.abc import Sequence


def suffix_array(text: Sequence[int]) -> list[int]:
    """Start positions of the suffixes of a sequence of integers, in ascending order; a suffix that
    is a prefix of another comes first."""
    n = len(text)
    symbols = {c: g for g, c in enumerate(sorted(set(text)))}
    group = [symbols[c] for c in text]
    members: list[list[int]] = [[] for _ in symbols]
    for i, g in enumerate(group):
        members[g].append(i)
    before, after = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    previous, taken = list(range(-1, n - 1)), bytearray(n)

    at = len(members) - 1
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        members[at] = own
        for i in own:
            taken[i] = 1
        times: dict[int, int] = {}
        for i in own:
            p = previous[i]
            while p >= 0 and taken[p]:
                p = previous[p]
            previous[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            if len(own) == 1 or max(times.values()) == 1:
                rounds = [times]
            else:
                by_count: dict[int, list[int]] = {}
                for p, k in times.items():
                    by_count.setdefault(k, []).append(p)
                rounds = [by_count[k] for k in sorted(by_count, reverse=True)]
            for moving in rounds:
                fresh: dict[int, int] = {}
                for p in moving:
                    left = group[p]
                    new = fresh.get(left)
                    if new is None:
                        new = fresh[left] = len(members)
                        members.append([])
                        nxt = after[left]
                        before.append(left)
                        after.append(nxt)
                        after[left] = new
                        before[nxt] = new
                    group[p] = new
                    members[new].append(p)
        first, at = at, before[at]

    free, start, g = [0] * len(members), 0, first if n else -1
    while g >= 0:
        free[g] = start
        start += len(members[g])
        g = after[g]
    order, placed = [0] * n, bytearray(n)
    p = n - 1
    for r in range(-1, n):
        if r >= 0:
            p = order[r] - 1
        while p >= 0 and not placed[p]:
            placed[p] = 1
            g = group[p]
            order[free[g]] = p
            free[g] += 1
            p = previous[p]
    return order
