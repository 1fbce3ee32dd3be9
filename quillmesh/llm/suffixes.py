"""Suffix array of an integer sequence by linear grouping (Baier's algorithm), and its LCP array.

Phase one finds the groups of suffixes with equal Lyndon prefix. Groups, at first those of equal first
symbol, are processed in descending order. The previous-smaller pointer of a member leads to the
nearest position before it that is in a lower group; the positions so found have prefixes that the
group's prefix continues, once per member that points at them, so they move to new groups just above
their own, those reached more often higher. When a group is processed its prefix is final.

Phase two emits the order. A suffix is its group's prefix followed by the suffix at the next smaller
position, and that one is smaller; so walking the array from its start and appending to their groups
all suffixes whose prefix ends where the current one begins orders every group, with no renaming and
no recursion.
"""

from __future__ import annotations

from collections.abc import Sequence


def by_first(s: Sequence[int]) -> list[int]:
    """Positions by their symbol, equal ones in order, by counting; symbols are small numbers."""
    before = [0] * (max(s, default=-1) + 2)
    for x in s:
        before[x + 1] += 1
    for x in range(1, len(before)):
        before[x] += before[x - 1]
    out = [0] * len(s)
    for i, x in enumerate(s):
        out[before[x]] = i
        before[x] += 1
    return out


def suffix_array(s: Sequence[int]) -> list[int]:
    n = len(s)
    sa = by_first(s)
    place = [0] * n  # of a suffix in sa
    group = [0] * n  # of a suffix: where its group begins in sa
    size = [0] * n  # of the group that begins at an index
    length = [1] * n  # of that group's prefix
    start = 0
    for at, i in enumerate(sa):
        if s[i] != s[sa[start]]:
            start = at
        place[i], group[i] = at, start
        size[start] += 1
    smaller = [-1] * n  # the previous-smaller pointers
    end = n
    while end:
        first = group[sa[end - 1]]
        reached: dict[int, int] = {}
        for i in sorted(sa[first:end]):
            p = i - 1
            while p >= 0 and group[p] >= first:
                p = smaller[p]
            smaller[i] = p
            if p >= 0:
                reached[p] = reached.get(p, 0) + 1
        if reached:
            more = length[first]
            by_times: dict[int, list[int]] = {}
            for p, k in reached.items():
                by_times.setdefault(k, []).append(p)
            for k in sorted(by_times, reverse=True):
                moved: dict[int, list[int]] = {}
                for p in by_times[k]:
                    g = group[p]
                    # To the end of what is left of its group.
                    size[g] -= 1
                    at, last = place[p], g + size[g]
                    q = sa[last]
                    sa[at], sa[last], place[q], place[p] = q, p, at, last
                    moved.setdefault(g, []).append(p)
                for g, ps in moved.items():
                    new = g + size[g]
                    size[new], length[new] = len(ps), length[g] + k * more
                    for p in ps:
                        group[p] = new
        end = first
    ends = [i + length[group[i]] for i in range(n)]
    free = list(range(n))  # of a group: its next place
    out = [0] * n
    for at in range(-1, n):
        j = n if at < 0 else out[at]
        i = j - 1
        while i >= 0 and ends[i] == j:
            g = group[i]
            out[free[g]] = i
            free[g] += 1
            i = smaller[i]
    return out


def lcp_array(s: Sequence[int], sa: Sequence[int]) -> list[int]:
    """For each place in ``sa`` the length of the common prefix with the suffix before it."""
    n = len(s)
    rank = [0] * n
    for at, i in enumerate(sa):
        rank[i] = at
    out, h = [0] * n, 0
    for i in range(n):
        r = rank[i]
        if r:
            j = sa[r - 1]
            while i + h < n and j + h < n and s[i + h] == s[j + h]:
                h += 1
            out[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return out


def repeated_grams(strings: Sequence[Sequence[int]], sizes: Sequence[int]) -> list[list[bool]]:
    """For each string and each start of so many symbols in it as ``sizes`` says: do they start anywhere else
    too? Strings that share a symbol have one size. One suffix array of all strings; each ends in a separator
    of its own, so no match crosses an end."""
    text: list[int] = []
    need: list[int] = []
    starts = []
    for i, (t, d) in enumerate(zip(strings, sizes)):
        starts.append(len(text))
        text.extend(x + len(strings) for x in t)
        text.append(i)
        need.extend([d] * (len(t) + 1))
    sa = suffix_array(text)
    lcp = lcp_array(text, sa)
    seen = bytearray(len(text))
    for at in range(1, len(sa)):
        if lcp[at] >= need[sa[at]]:
            seen[sa[at]] = seen[sa[at - 1]] = 1
    return [[bool(x) for x in seen[b : b + max(0, len(t) - d + 1)]] for b, t, d in zip(starts, strings, sizes)]
