"""Suffix arrays by linear grouping of Lyndon prefixes.

Suffixes start out grouped by their first byte. Groups are taken from the
greatest to the least. For a group's members the nearest smaller suffix before
each is found; these are what the group's context extends, so they move to a
new group right above their old one, those that are met more often further up.
When all groups are done, each holds the suffixes with one Lyndon prefix. The
second pass walks the growing suffix array: what ends at a suffix in order goes
to the front of its group, found through the pointers to smaller suffixes.
Neither pass renames the text or calls itself, and both are linear.
"""

from __future__ import annotations

import numpy as np


def _grouped(codes: np.ndarray) -> tuple[list[int], list[int], list[int], list[int]]:
    """The group of each suffix, the groups' sizes and the next higher group, and
    for each suffix the nearest one before it in a lower group (-1: none)."""
    n = len(codes)
    order = np.argsort(codes, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], codes[order][1:] != codes[order][:-1]]))
    members = [part.tolist() for part in np.split(order, starts[1:])]
    first = np.empty(n, np.int64)
    first[order] = np.repeat(np.arange(len(members)), np.diff(np.append(starts, n)))
    group, size = first.tolist(), [len(m) for m in members]
    below, above = list(range(-1, len(members) - 1)), [*range(1, len(members)), -1]
    smaller, done = list(range(-1, n - 1)), bytearray(n)

    def opened(old: int) -> int:
        """A new, empty group right above ``old``."""
        new, up = len(size), above[old]
        size.append(0)
        members.append([])
        above[old] = below[up] = new
        below.append(old)
        above.append(up)
        return new

    g = len(members) - 1
    while g >= 0:
        held, members[g] = members[g], None
        if size[g] and len(held) != size[g]:  # some have moved up since
            held = [i for i in held if group[i] == g]
        elif not size[g]:
            held = []
        held.sort()
        for i in held:
            done[i] = 1
        times: dict[int, int] = {}
        for i in held:
            j = i - 1
            while j >= 0 and done[j]:
                j = smaller[j]
            smaller[i] = j
            if j >= 0:
                times[j] = times.get(j, 0) + 1
        if times:
            most = max(times.values())
            by_times: list[list[int]] = [list(times)] if most == 1 else [[] for _ in range(most)]
            if most > 1:
                for j, t in times.items():
                    by_times[t - 1].append(j)
            for these in reversed(by_times):
                fresh: dict[int, int] = {}
                for j in these:
                    old = group[j]
                    new = fresh.get(old)
                    if new is None:
                        if size[old] == 1:  # its only member would move to the same place
                            continue
                        new = fresh[old] = opened(old)
                    size[old] -= 1
                    size[new] += 1
                    members[new].append(j)
                    group[j] = new
        g = below[g]
    return group, size, above, smaller


def suffix_array(text: bytes) -> list[int]:
    """The starts of the suffixes in ascending order; the end of the text comes before every byte."""
    n = len(text)
    if not n:
        return []
    group, size, above, smaller = _grouped(np.frombuffer(text, np.uint8))
    free, at, g = [0] * len(size), 0, 0
    while g >= 0:
        free[g] = at
        at += size[g]
        g = above[g]
    out, placed = [-1] * n, bytearray(n)
    for i in range(-1, n):
        j = (n if i < 0 else out[i]) - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = smaller[j]
    return out
