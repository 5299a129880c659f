"""Suffix arrays of many short strings at once, by linear grouping (Baier, CPM 2016).

Phase one sorts suffixes by their Lyndon prefix, the stretch up to the next
smaller suffix. Groups start as those of equal first symbols. They are taken
in descending order: each suffix of the group points to the previous suffix
that lies in a lower group, and the suffixes pointed at move to new groups
right above what is left of their own, those pointed at more often higher.
Phase two runs through the ranks in ascending order: a placed suffix puts
each suffix of which it is the next smaller one at the front of that one's
group. Nothing is renamed and nothing recurses.

The strings of a batch advance together: a step takes the highest open group
(phase one) or the next rank (phase two) of every string, so that numpy works
on thousands of them in one call. A string of n symbols needs at most n steps
of either kind; each step costs in proportion to the suffixes it moves.
"""

from __future__ import annotations

import numpy as np


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ..., then those of first[1], each `count` long."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - count - first, count)


def suffix_arrays(symbols: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all suffixes, string after string, each string's in ascending order.

    `symbols` holds the strings one after the other, `sizes` their lengths.
    Symbols are numbers from 0; a string that is a prefix of another one is
    the smaller (an end mark below all symbols is added here and left out of
    the result).
    """
    sizes = np.asarray(sizes, np.int64)
    if not len(sizes) or not sizes.sum():
        return np.zeros(0, np.int64)
    body = np.ones(int(sizes.sum() + len(sizes)), bool)
    ends = np.cumsum(sizes + 1) - 1
    body[ends] = False
    text = np.zeros(len(body), np.int64)
    text[body] = symbols.astype(np.int64) + 1
    placed = _phase_two(len(text), *_phase_one(text, sizes + 1), np.cumsum(sizes + 1) - sizes - 1, sizes + 1)
    back = np.cumsum(body) - 1
    return back[placed[body[placed]]]


def _phase_one(text: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place of each suffix's group, length of its Lyndon prefix)."""
    n = len(text)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    base = np.cumsum(sizes) - sizes
    order = np.argsort(owner * (int(text.max()) + 1) + text, kind="stable")  # suffix at each place
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    key = owner[order] * (int(text.max()) + 1) + text[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = np.empty(n + 1, np.int64)  # of a suffix: first place of its group; the last entry stands for "no suffix"
    group[order] = np.repeat(begins, np.diff(np.append(begins, n)))
    group[n] = -1
    size = np.zeros(n, np.int64)  # by first place
    size[begins] = np.diff(np.append(begins, n))
    length = np.ones(n, np.int64)  # of the prefix that a suffix's group shares
    before = np.arange(-1, n)[:n]  # nothing between before[i] and i lies in a group below that of i
    grown = np.zeros(len(sizes), np.int64)  # by string: length of its open group's prefix
    last = base + sizes - 1
    live = last > base  # the end mark is the lowest group; nothing lies before it that is lower
    last, base = last[live], base[live]
    while len(last):
        first = group[order[last]]
        member = order[_ranges(first, last - first + 1)]
        own = group[member]
        at = before[member]
        open_ = np.flatnonzero(group[at] >= own)  # -1 reads the last entry
        while len(open_):
            at[open_] = before[at[open_]]
            open_ = open_[group[at[open_]] >= own[open_]]
        before[member] = at
        grown[owner[order[last]]] = length[order[last]]
        inside = at >= np.repeat(base, last - first + 1)
        goal = at[inside]
        if len(goal):
            goal = np.sort(goal)
            head = np.flatnonzero(np.concatenate([[True], goal[1:] != goal[:-1]]))
            times = np.diff(np.append(head, len(goal)))
            goal = goal[head]
            rank = np.lexsort((times, group[goal]))
            goal, times = goal[rank], times[rank]
            old = group[goal]
            head = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
            moved = np.diff(np.append(head, len(old)))
            tail = _ranges(old[head] + size[old[head]] - moved, moved)  # where they go
            from_ = np.sort(place[goal])
            stay = tail[~_in_sorted(tail, from_)]  # places in the tail that are held by others
            free = from_[~_in_sorted(from_, tail)]  # places that they can have
            displaced = order[stay]
            order[free] = displaced
            place[displaced] = free
            order[tail] = goal
            place[goal] = tail
            size[old[head]] -= moved
            cut = np.flatnonzero(np.concatenate([[True], (old[1:] != old[:-1]) | (times[1:] != times[:-1])]))
            count = np.diff(np.append(cut, len(goal)))
            group[goal] = np.repeat(tail[cut], count)
            size[tail[cut]] = count
            length[goal] += times * grown[owner[goal]]
        last = first - 1
        live = last > base
        last, base = last[live], base[live]
    return group[:n], length


def _in_sorted(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    at = np.searchsorted(among, values)
    return among[np.minimum(at, len(among) - 1)] == values


def _phase_two(n: int, group: np.ndarray, length: np.ndarray, base: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Suffix at each place."""
    follows = np.arange(n) + length  # the next smaller suffix; that of an end mark is another string's
    child = np.argsort(follows, kind="stable")
    count = np.bincount(follows, minlength=n + 1)
    first = np.cumsum(count) - count
    marks = base + sizes - 1
    ends = np.zeros(n, bool)
    ends[marks] = True
    out = np.full(n, -1, np.int64)
    front = np.arange(n)
    out[base] = marks
    for step in range(int(sizes.max())):
        live = sizes > step
        if not live.all():
            base, sizes = base[live], sizes[live]
        now = out[base + step]
        j = child[_ranges(first[now], count[now])]
        j = j[~ends[j]]
        at = group[j]
        out[front[at]] = j
        front[at] += 1
    return out
