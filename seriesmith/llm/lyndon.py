"""Suffix arrays by linear grouping, for many texts in step.

Phase one sorts the suffixes of a text into groups of equal Lyndon prefix: groups are processed from the highest to
the lowest, each suffix points to the previous suffix of a lower group, and the suffixes pointed to move up within
their own groups by the number of pointers they got. Phase two walks the finished order from its lowest suffix: a
suffix is its Lyndon prefix followed by the next smaller suffix, so every suffix whose next smaller one has just been
emitted is appended to its group. No group is renamed again.

All texts advance together, one group (or one rank) of each per step, so that a step is a few array operations.
"""

from __future__ import annotations

import numpy as np


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1 ... for each run, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def lyndon_groups(text: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each suffix's group in the order of its text, and the length of its Lyndon prefix.

    ``text`` holds all texts; each ends with its only 0. ``bounds`` has one entry more than texts.
    """
    n = len(text)
    base = np.repeat(bounds[:-1], np.diff(bounds))
    # first groups: equal first symbols of a text
    layout = np.lexsort((text, base))
    place = np.empty(n, np.int64)
    place[layout] = np.arange(n)
    start = np.ones(n, bool)
    start[1:] = (text[layout][1:] != text[layout][:-1]) | (base[layout][1:] != base[layout][:-1])
    first = np.flatnonzero(start)
    size = np.zeros(n, np.int64)
    size[first] = np.diff(np.append(first, n))
    group = np.empty(n, np.int64)
    group[layout] = np.repeat(first, size[first])
    length = np.ones(n, np.int64)
    before = np.full(n, -1, np.int64)
    end = bounds[1:].copy()
    low = bounds[:-1]
    live = np.flatnonzero(end > low)
    while live.size:
        head = group[layout[end[live] - 1]]
        many = end[live] - head
        members = layout[spread(head, many)]
        heads = np.repeat(head, many)
        floor = np.repeat(low[live], many)
        # the previous suffix of a lower group: finished suffixes lead on, suffixes of this group are stepped over
        p = members - 1
        open_ = np.flatnonzero(p >= floor)
        while open_.size:
            q = p[open_]
            g = group[q]
            up = g >= heads[open_]
            open_, q, g = open_[up], q[up], g[up]
            if not open_.size:
                break
            p[open_] = np.where(g > heads[open_], before[q], q - 1)
            open_ = open_[p[open_] >= floor[open_]]
        p[p < floor] = -1
        before[members] = p
        hit = p >= 0
        if hit.any():
            order = np.argsort(p[hit], kind="stable")
            ps = p[hit][order]
            new = np.ones(len(ps), bool)
            new[1:] = ps[1:] != ps[:-1]
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(ps)))
            step = length[members[hit]][order][at]
            ps = ps[at]
            length[ps] += count * step
            old = group[ps]
            by = np.lexsort((count, old))
            ps, old, count = ps[by], old[by], count[by]
            split = np.ones(len(ps), bool)
            split[1:] = old[1:] != old[:-1]
            at = np.flatnonzero(split)
            moved = np.diff(np.append(at, len(ps)))
            all_of = size[old[at]]
            region = old[at] + all_of - moved  # where the moved ones go: the end of their group
            target = spread(region, moved)
            there = layout[target]
            came = place[ps]
            stays = group[there] == np.repeat(old[at], moved)
            lo = np.repeat(region, moved)
            outside = came < lo
            mark = np.zeros(len(ps), bool)
            inside = np.flatnonzero(~outside)
            # an element of the region that isn't itself moved takes the place that a moved one leaves
            slot = np.repeat(np.cumsum(moved) - moved, moved)
            mark[(slot + came - lo)[inside]] = True
            away = there[stays & ~mark]
            layout[came[outside]] = away
            place[away] = came[outside]
            layout[target] = ps
            place[ps] = target
            split[1:] |= count[1:] != count[:-1]
            sub = np.flatnonzero(split)
            width = np.diff(np.append(sub, len(ps)))
            size[old[at]] = all_of - moved
            size[target[sub]] = width
            group[ps] = np.repeat(target[sub], width)
        end[live] = head
        live = live[end[live] > low[live]]
    return group, length


def suffix_order(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffixes of each text (as places in ``text``) in lexicographic order, text by text."""
    group, length = lyndon_groups(text, bounds)
    n = len(text)
    # suffixes by their next smaller suffix
    after = np.arange(n) + length
    children = np.argsort(after, kind="stable")
    child_bounds = np.searchsorted(after[children], np.arange(n + 2))
    order = np.full(n, -1, np.int64)
    fill = group.copy()  # by group start: the next free place
    free = np.arange(n)
    sizes = np.diff(bounds)
    filled = bounds[:-1][sizes > 0]
    order[filled] = bounds[1:][sizes > 0] - 1
    longest = int(sizes.max()) if len(sizes) else 0
    by_size = np.argsort(-sizes, kind="stable")
    begins, left = bounds[:-1][by_size], -sizes[by_size]
    for r in range(longest):
        k = int(np.searchsorted(left, -r, "left"))
        now = order[begins[:k] + r]
        a = child_bounds[now]
        kids = children[spread(a, child_bounds[now + 1] - a)]
        # the end of a text is the next smaller suffix of nothing but its 0, which stands already
        g = fill[kids]
        order[free[g]] = kids
        free[g] += 1
    return order
