"""Suffix arrays by linear grouping.

Phase 1 sorts the suffixes into groups by their longest Lyndon prefix. Groups are processed in descending
order; for every member the pointer to the previous smaller suffix (the nearest position to the left whose
group is lower) is found by jumping along the pointers that are already known, and the suffixes pointed to
leave their groups for new ones just above, those pointed to more often higher. Phase 2 emits the order: in one
pass over the growing suffix array, from the smallest suffix on, the position before each suffix and the chain of its
previous-smaller pointers take the next free places of their groups. Nothing is renamed recursively.

Two forms of the same algorithm: ``grouped`` works on one text, in Python; ``grouped_many`` works on many short texts in
lockstep, one numpy step for the current group of all of them. A text is a sequence of integers >= 0 that
ends with its unique smallest one.
"""

from __future__ import annotations

import numpy as np


def grouped(text) -> list[int]:
    """The suffix array of one text."""
    text = list(map(int, text))
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    group, size, top, at = [0] * n, [0] * (n + 1), [0] * (n + 1), [0] * n
    start = 0
    for k, i in enumerate(order):
        if k and text[i] != text[order[k - 1]]:
            top[k] = start
            start = k
        group[i], at[i] = start, k
        size[start] += 1
    top[n] = start
    before = list(range(-1, n - 1))
    end = n
    while end > 0:
        low = top[end]
        found: dict[int, int] = {}
        for i in order[low:end]:
            p = before[i]
            while p >= 0 and group[p] >= low:
                p = before[p]
            before[i] = p
            if p >= 0:
                found[p] = found.get(p, 0) + 1
        if found:
            classes: dict[int, list[int]] = {}
            for p, times in found.items():
                classes.setdefault(times, []).append(p)
            for times in sorted(classes, reverse=True):
                moved = classes[times]
                homes = [group[p] for p in moved]
                ends = {a: a + size[a] for a in homes}
                for p, a in zip(moved, homes, strict=True):
                    size[a] -= 1
                    place, other = a + size[a], order[a + size[a]]
                    order[at[p]], at[other] = other, at[p]
                    order[place], at[p] = p, place
                new = {a: a + size[a] for a in ends}
                for p, a in zip(moved, homes, strict=True):
                    group[p] = new[a]
                for a, e in ends.items():
                    s = new[a]
                    size[s] = e - s
                    top[e] = s
                    if s > a:
                        top[s] = a
        end = low
    out, free, placed = [-1] * n, list(range(n)), [False] * n
    out[0], placed[n - 1] = n - 1, True
    free[group[n - 1]] += 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            placed[j] = True
            j = before[j]
    return out


def grouped_many(texts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Suffix arrays of the rows of ``texts`` (int32, padded at the right), each with its own length; padding is -1."""
    rows, width = texts.shape
    inside = np.arange(width)[None, :] < lengths[:, None]
    keyed = np.where(inside, texts, np.iinfo(np.int32).max)
    by = np.argsort(keyed, axis=1, kind="stable")
    ordered = np.take_along_axis(keyed, by, axis=1)
    fresh = np.ones((rows, width), dtype=bool)
    fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    starts = np.maximum.accumulate(np.where(fresh, np.arange(width)[None, :], 0), axis=1)
    kind = np.int16 if width < 30000 else np.int32
    group = np.empty((rows, width), dtype=kind)
    np.put_along_axis(group, by, starts.astype(kind), axis=1)
    group[~inside] = -1
    # Row-wise tables, addressed flat: r * stride + position.
    stride = width + 1
    size, top = np.zeros(rows * stride, dtype=np.int32), np.zeros(rows * stride, dtype=np.int32)
    r0 = np.repeat(np.arange(rows), width).reshape(rows, width)
    np.add.at(size, (r0 * stride + group)[inside], 1)
    r, s = np.nonzero(fresh & inside)
    top[r * stride + s + size[r * stride + s]] = s
    before = np.broadcast_to(np.arange(-1, width - 1, dtype=np.int32), (rows, width)).copy().reshape(-1)
    flat = group.reshape(-1)

    end = lengths.astype(np.int64).copy()
    alive = np.arange(rows)
    view = group
    while len(alive):
        low = top[alive * stride + end[alive]]
        line, i = np.nonzero(view == low.astype(kind)[:, None])
        row, least = alive[line], low[line]
        base = row * width
        p = before[base + i].astype(np.int64)
        go = np.flatnonzero((p >= 0) & (flat[base + np.maximum(p, 0)] >= least))
        while len(go):
            q = before[base[go] + p[go]].astype(np.int64)
            p[go] = q
            go = go[(q >= 0) & (flat[base[go] + np.maximum(q, 0)] >= least[go])]
        before[base + i] = p
        hit = base[p >= 0] + p[p >= 0]
        if len(hit):
            hit.sort()
            first = np.flatnonzero(np.concatenate(([True], hit[1:] != hit[:-1])))
            times = np.diff(np.append(first, len(hit)))
            hit = hit[first]
            own = hit // width
            home = own * stride + flat[hit]
            rank = np.argsort(home * np.int64(stride) + (stride - 1 - times), kind="stable")
            hit, own, home, times = hit[rank], own[rank], home[rank], times[rank]
            new_home = np.concatenate(([True], home[1:] != home[:-1]))
            new_class = np.flatnonzero(new_home | np.concatenate(([True], times[1:] != times[:-1])))
            held = np.diff(np.append(new_class, len(hit)))  # members of each class
            at = home[new_class]
            opens = np.flatnonzero(new_home[new_class])  # the first class of each old group
            total = np.cumsum(held)
            taken = total - np.repeat(np.append(0, total)[opens], np.diff(np.append(opens, len(held))))
            begin = at + size[at] - taken  # as flat addresses
            lasts = np.append(opens[1:], len(held)) - 1
            size[at[lasts]] -= taken[lasts]
            rest = begin[lasts] > at[lasts]
            size[begin] = held
            local = begin - own[new_class] * stride
            top[begin + held] = local
            top[begin[lasts][rest]] = (at[lasts] - own[new_class][lasts] * stride)[rest]
            flat[hit] = np.repeat(local, held)
        end[alive] = low
        left = low > 0
        if not left.all():
            alive = alive[left]
        view = group if len(alive) == rows else group[alive]

    out = np.full((rows, width), -1, dtype=np.int32)
    out_flat, free, placed = out.reshape(-1), np.zeros(rows * stride, dtype=np.int32), np.zeros(rows * width, dtype=bool)
    free.reshape(rows, stride)[:] = np.arange(stride)
    last = np.arange(rows) * width + lengths - 1
    out[:, 0] = lengths - 1
    placed[last] = True
    free[np.arange(rows) * stride + flat[last]] += 1
    for k in range(width):
        row = np.flatnonzero(lengths > k)
        j = out[row, k].astype(np.int64) - 1
        while True:
            spot = row * width + j
            go = (j >= 0) & ~placed[np.maximum(spot, 0)]
            row, j, spot = row[go], j[go], spot[go]
            if not len(row):
                break
            g = row * stride + flat[spot]
            out_flat[row * width + free[g]] = j
            free[g] += 1
            placed[spot] = True
            j = before[spot].astype(np.int64)
    return out
