"""Sums over all subtrees of a forest of parent edges, by centroid decomposition."""

from __future__ import annotations

import numpy as np


def _preorder(parent: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each node, its place in an order where a subtree is one run, and its subtree's size."""
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1)
    size = np.ones(len(parent), np.int64)
    for level in reversed(levels):
        held = level[parent[level] >= 0]
        np.add.at(size, parent[held], size[held])
    tops = np.flatnonzero(parent < 0)
    place = np.zeros(len(parent), np.int64)
    place[tops] = np.cumsum(size[tops]) - size[tops]
    for level in levels:
        kids = level[parent[level] >= 0]
        kids = kids[np.argsort(parent[kids], kind="stable")]
        before = np.cumsum(size[kids]) - size[kids]
        start = np.ones(len(kids), bool)
        start[1:] = parent[kids][1:] != parent[kids][:-1]
        place[kids] = place[parent[kids]] + 1 + before - before[np.maximum.accumulate(np.where(start, np.arange(len(kids)), 0))]
    return place, size


def subtree_sums(parent: np.ndarray, depth: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each node, the sums of ``values`` (n x m, integers) over its subtree.

    ``parent`` is -1 at tops, and a child is deeper than its parent. All components are split at once:
    each at its centroid, the deepest node with half of the component below it. What lies below a
    centroid is summed as one component's total and added to all nodes from the centroid to the
    component's top; then the centroid goes, its children head components of their own, and what is
    left above keeps its top. A component halves each time, so n nodes take about log2(n) rounds.
    """
    n = len(parent)
    if not n:
        return values.copy()
    place, full = _preorder(parent, depth)
    node = np.empty(n, np.int64)
    node[place] = np.arange(n)
    up = np.where(parent[node] >= 0, place[parent[node]], -1)
    full, values = full[node], values[node]
    size, sums = full.copy(), np.zeros_like(values)
    top = np.maximum.accumulate(np.where(up < 0, np.arange(n), 0))
    centre, live = np.full(n, -1, np.int64), np.arange(n)
    while len(live):
        of = top[live]
        heavy = live[2 * size[live] >= size[of]]
        np.maximum.at(centre, top[heavy], heavy)  # heavy nodes of a component form one path down
        mid = centre[of]
        below = (live >= mid) & (live < mid + full[mid])
        totals = np.zeros_like(values)
        np.add.at(totals, of[below], values[live[below]])
        tops = live[of == live]
        at, amount, less = centre[tops], totals[tops], size[centre[tops]]
        while len(at):
            sums[at] += amount
            size[at] -= less
            on = at != tops
            at, tops, amount, less = up[at[on]], tops[on], amount[on], less[on]
        kid = below & (up[live] == mid)
        key = of * n + live
        heads = np.sort(key[kid])
        rest = below & (live != mid)
        centre[of] = -1
        top[live[rest]] = heads[np.searchsorted(heads, key[rest], "right") - 1] % n
        live = live[live != mid]
    return sums[place]
