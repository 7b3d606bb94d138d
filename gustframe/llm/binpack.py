"""Best-fit decreasing over length classes, and lower bounds of the number of bins by dual-feasible functions."""

from __future__ import annotations

import numpy as np

#: Largest k of the rounding functions u(k).
MOST_K = 64


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item, and the number of bins. Items go by falling length, each into the open bin with the
    least room that holds it. Items of one length take a bin as often as it holds them, which is what one item at a time
    does: a bin that got one has less room than before, so it stays the best fit while it fits."""
    order = np.argsort(-lengths, kind="stable")
    by_length = lengths[order]
    cuts = np.flatnonzero(np.diff(by_length)) + 1
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = np.zeros(capacity + 1, bool)
    used = 0
    for items in np.split(order, cuts) if len(order) else []:
        size, at = int(lengths[items[0]]), 0
        while at < len(items):
            room = size + int(np.argmax(rooms[size:]))
            if not rooms[room]:                                     # none is open that holds it
                room = capacity
                fresh = -(-(len(items) - at) // (capacity // size))
                open_bins[room].extend(range(used, used + fresh))
                used += fresh
                rooms[room] = True
            fits = room // size
            whole = min(len(open_bins[room]), (len(items) - at) // fits)
            count = fits if whole else len(items) - at              # items of each bin taken now
            whole = whole or 1
            ids = open_bins[room][-whole:][::-1]
            del open_bins[room][-whole:]
            rooms[room] = bool(open_bins[room])
            now = items[at:at + whole * count]
            bins[now] = np.repeat(ids, count)
            offsets[now] = capacity - room + np.tile(np.arange(count) * size, whole)
            at += whole * count
            left = room - count * size
            open_bins[left].extend(ids)
            rooms[left] = True
    return bins, offsets, used


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing of ``counts[length]`` items can go below: the largest sum of a dual-feasible
    function over the items, rounded up, in integers. Functions: x / C; U(e), which counts items above C - e as whole bins and
    leaves out those below e; u(k), which rounds (k + 1)x / C down to parts of 1 / k; and the one that gives items of
    at least e a share of 1 / floor(C / e)."""
    sizes = np.flatnonzero(counts)
    n = counts[sizes].astype(np.int64)
    if not len(sizes):
        return 0
    best = -(-int((n * sizes).sum()) // capacity)
    for k in range(1, MOST_K + 1):
        share, rest = np.divmod((k + 1) * sizes, capacity)
        best = max(best, -(-int((n * np.where(rest == 0, share * k, share * (k + 1))).sum()) // (k * (k + 1))))
    small = np.unique(sizes[sizes <= capacity // 2])
    for e in np.unique(np.concatenate([small, capacity - sizes[sizes > capacity // 2] + 1])):
        if not 1 <= e <= capacity // 2:
            continue
        whole, middle = sizes > capacity - e, (sizes >= e) & (sizes <= capacity - e)
        best = max(best, int(n[whole].sum()) - (-int((n * sizes)[middle].sum()) // capacity))
        unit = capacity // int(e)
        parts = np.where(sizes > capacity // 2, unit - (capacity - sizes) // e, np.where(sizes >= e, 1, 0))
        best = max(best, -(-int((n * parts).sum()) // unit))
    return best
