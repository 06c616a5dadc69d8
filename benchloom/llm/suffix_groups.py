"""A linear suffix array construction by grouping.

Suffixes are grouped by their longest Lyndon prefix. Groups are processed in descending order: the
members of a group point at their previous smaller suffixes, and the suffixes pointed at move to new
groups directly above the ones they leave, the more pointers the higher. When the lowest group is
done, groups are sorted and final. The members of a group are settled in any order, along their own
pointers, so nothing is sorted but the few different counts of pointers. A single pass from the smallest suffix then emits the order
inside each group along the same pointers; no names are assigned and no recursion is needed.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of text (non-negative ints) in ascending order.

    A shorter suffix comes before a longer one that it begins. Empty text: an empty array.
    """
    n = len(text) + 1
    if n == 1:
        return np.empty(0, np.int64)
    symbols = np.empty(n, np.int64)
    symbols[:-1] = np.asarray(text, np.int64) + 1
    symbols[-1] = 0
    first = np.argsort(symbols, kind="stable")
    order = symbols[first]
    new = np.ones(n, bool)
    new[1:] = order[1:] != order[:-1]
    begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    group_np = np.empty(n, np.int64)
    group_np[first] = begin
    where_np = np.empty(n, np.int64)
    where_np[first] = np.arange(n)
    held, group, where = first.tolist(), group_np.tolist(), where_np.tolist()
    end = [0] * (n + 1)
    starts = np.flatnonzero(new)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), n]):
        end[s] = e
    before = [-2] * n  # -2: not known yet
    top = n
    while top > 1:
        g = group[held[top - 1]]
        if top - g == 1:
            i = held[g]
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                h = group[j]
                e = end[h] - 1
                if e > h:
                    end[h] = e
                    k = held[e]
                    w = where[j]
                    held[w] = k
                    where[k] = w
                    held[e] = j
                    where[j] = e
                    group[j] = e
                    end[e] = e + 1
        else:
            pointers: dict[int, int] = {}
            for i in held[g:top]:
                if before[i] != -2:
                    continue
                j = i - 1
                while j >= 0 and group[j] >= g:
                    k = before[j]
                    if k == -2:
                        break
                    j = k
                else:
                    before[i] = j
                    if j >= 0:
                        pointers[j] = pointers.get(j, 0) + 1
                    continue
                # members of this group on the way down are settled first
                waiting = [i]
                while waiting:
                    while j >= 0 and group[j] >= g and before[j] != -2:
                        j = before[j]
                    if j >= 0 and group[j] >= g:
                        waiting.append(j)
                        j -= 1
                    else:
                        before[waiting.pop()] = j
                        if j >= 0:
                            pointers[j] = pointers.get(j, 0) + 1
            if len(pointers) == 1:
                (j,) = pointers
                h = group[j]
                e = end[h] - 1
                if e > h:
                    end[h] = e
                    k = held[e]
                    w = where[j]
                    held[w] = k
                    where[k] = w
                    held[e] = j
                    where[j] = e
                    group[j] = e
                    end[e] = e + 1
                top = g
                continue
            levels: dict[int, list[int]] = {}
            for j, count in pointers.items():
                levels.setdefault(count, []).append(j)
            for count in sorted(levels, reverse=True):
                left: dict[int, list[int]] = {}
                for j in levels[count]:
                    left.setdefault(group[j], []).append(j)
                for h, members in left.items():
                    e = end[h]
                    at = e - len(members)
                    if at == h:
                        continue
                    end[h] = at
                    to = e
                    for j in members:
                        to -= 1
                        w = where[j]
                        k = held[to]
                        held[w] = k
                        where[k] = w
                        held[to] = j
                        where[j] = to
                        group[j] = at
                    end[at] = e
        top = g
    # emit: where each group's next suffix goes
    free = list(range(n + 1))
    out = [0] * n
    out[0] = n - 1
    placed = bytearray(n)
    placed[n - 1] = 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not placed[j]:
            placed[j] = 1
            h = group[j]
            out[free[h]] = j
            free[h] += 1
            j = before[j]
    return np.array(out[1:], np.int64)
