"""Isolation trees over small samples (numpy kernel for grouped maps and scoring)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_EULER = 0.5772156649015329
# a few MB, so that a step's arrays stay in the processor's cache
_ROWS = 50_000


def expected_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3)
    out = 2 * (np.log(safe - 1) + _EULER) - 2 * (safe - 1) / safe
    return np.where(n > 2, out, np.where(n == 2, 1.0, 0.0))


def grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> dict[str, np.ndarray]:
    """One tree as flat arrays; a leaf has feature -1 and ``value`` = depth + expected rest."""
    feature, value, left, right = [], [], [], []
    stack = [(np.arange(len(points)), 0, -1, False)]
    while stack:
        rows, depth, parent, is_right = stack.pop()
        node = len(feature)
        if parent >= 0:
            (right if is_right else left)[parent] = node
        feature.append(-1)
        value.append(depth + float(expected_depth(len(rows))))
        left.append(-1)
        right.append(-1)
        if depth >= limit or len(rows) < 2:
            continue
        low, high = points[rows].min(axis=0), points[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if not len(usable):
            continue
        f = int(rng.choice(usable))
        cut = float(rng.uniform(low[f], high[f]))
        feature[node], value[node] = f, cut
        goes_left = points[rows, f] <= cut
        stack.append((rows[~goes_left], depth + 1, node, True))
        stack.append((rows[goes_left], depth + 1, node, False))
    return {
        "feature": np.array(feature), "value": np.array(value),
        "left": np.array(left), "right": np.array(right),
    }


def grow_forest(points: np.ndarray, trees: int = 100, sample: int = 256, seed: int = 42) -> tuple[list[dict], int]:
    """Trees over samples without replacement; returns them with the sample size."""
    size = min(sample, len(points))
    limit = int(np.ceil(np.log2(max(size, 2))))
    rng = np.random.default_rng(seed)
    forest = [
        grow(points[rng.choice(len(points), size, replace=False)], rng, limit) for _ in range(trees)
    ]
    return forest, size


def anomaly_score(points: np.ndarray, forest: list[dict], size: int) -> np.ndarray:
    """Score in 0..1, larger is more isolated."""
    depth = np.zeros(len(points))
    for tree in forest:
        node = np.zeros(len(points), dtype=int)
        while True:
            f = tree["feature"][node]
            inner = f >= 0
            if not inner.any():
                break
            at = node[inner]
            goes_left = points[inner, f[inner]] <= tree["value"][at]
            node[inner] = np.where(goes_left, tree["left"][at], tree["right"][at])
        depth += tree["value"][node]
    scale = float(expected_depth(size)) or 1.0
    return 2.0 ** (-depth / (len(forest) * scale))


def own_scores(points: np.ndarray, trees: int = 100, seed: int = 42) -> np.ndarray:
    """Scores of a few points in a forest over those same points."""
    return own_scores_each(points[None], trees, seed)[0]


def own_scores_each(sets: np.ndarray, trees: int = 100, seed: int = 42) -> np.ndarray:
    """Scores of the points of every set (set, point, column) in a forest of its own over its at most 256 points.

    Every set takes the same random numbers, so its scores don't depend on the
    others.  Sets are grown together, some ``_ROWS`` (set, tree, point) at a time.
    """
    count, n, _ = sets.shape
    if n > 256:
        forests = [grow_forest(points, trees, 256, seed) for points in sets]
        return np.array([anomaly_score(points, *grown) for points, grown in zip(sets, forests)]).reshape(count, n)
    step = max(1, _ROWS // max(1, trees * n))
    depths = [_own_depths(sets[at : at + step], trees, seed) for at in range(0, count, step)]
    mean_depth = np.concatenate(depths) if depths else np.zeros((0, n))
    return 2.0 ** (-mean_depth / (float(expected_depth(n)) or 1.0))


@lru_cache(maxsize=64)
def _random(seed: int, many: int) -> np.ndarray:
    return np.random.default_rng(seed).random(many)


def _own_depths(sets: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Mean depth of every point of every set.

    All trees of all sets grow together, one level per step.  A row is one (set,
    tree, point); rows stay ordered by node, and rows of finished nodes leave.  A
    level takes random numbers for all nodes of a set in their order, finished
    ones included: ``slot`` is a node's place among them, ``nodes`` their number.
    """
    count, n, dims = sets.shape
    levels = int(np.ceil(np.log2(max(n, 2))))
    luck = _random(seed, trees * (dims + 1) * sum(min(2**level, n) for level in range(levels)))
    x = [np.repeat(sets[:, :, d], trees, axis=0).ravel() for d in range(dims)]
    row = np.arange(len(x[0]))
    depth = np.zeros(len(row))
    sizes = np.full(count * trees, n)
    owner, slot = np.repeat(np.arange(count), trees), np.tile(np.arange(trees), count)
    nodes, used = np.full(count, trees), np.zeros(count, dtype=int)
    for level in range(levels):
        starts = np.cumsum(sizes) - sizes
        low = np.column_stack([np.minimum.reduceat(v, starts) for v in x])
        high = np.column_stack([np.maximum.reduceat(v, starts) for v in x])
        usable = high > low
        splits = usable.any(axis=1)
        if not splits.all():
            inside = np.repeat(splits, sizes)
            depth[row[~inside]] = np.repeat((level + expected_depth(sizes))[~splits], sizes[~splits])
            kept = np.flatnonzero(inside)
            x, row = [v[kept] for v in x], row[kept]
            sizes, owner, slot, low, high, usable = (v[splits] for v in (sizes, owner, slot, low, high, usable))
            if not len(sizes):
                return depth.reshape(count, trees, n).mean(axis=1)
            starts = np.cumsum(sizes) - sizes
        first = used[owner] + slot * dims
        feature = np.argmax(np.where(usable, luck[first[:, None] + np.arange(dims)], -1.0), axis=1)
        at = np.arange(len(sizes))
        cut = low[at, feature] + luck[used[owner] + nodes[owner] * dims + slot] * (high[at, feature] - low[at, feature])
        node = np.repeat(at, sizes)
        value, column = x[0], feature[node]
        for d in range(1, dims):
            value = np.where(column == d, x[d], value)
        right = value > cut[node]
        # rows go to their side of the node, in their order
        rights = np.cumsum(right)
        earlier = rights - right - (rights[starts] - right[starts])[node]
        many = np.add.reduceat(right, starts, dtype=int)
        place = np.where(right, (starts + sizes - many)[node] + earlier, np.arange(len(row)) - earlier)
        source = np.empty_like(place)
        source[place] = np.arange(len(row))
        x, row = [v[source] for v in x], row[source]
        # a node with two sides shifts the later ones of its set by one
        both = (many > 0) & (many < sizes)
        total = np.cumsum(both)
        own_first = np.searchsorted(owner, owner)
        shift = total - both - (total[own_first] - both[own_first])
        used += nodes * (dims + 1)
        nodes = nodes + np.bincount(owner, both, count).astype(int)
        sides = np.column_stack([sizes - many, many]).ravel()
        kept = sides > 0
        slot = (np.column_stack([slot + shift, slot + shift + both])).ravel()[kept]
        owner, sizes = np.repeat(owner, 2)[kept], sides[kept]
    depth[row] = np.repeat(levels + expected_depth(sizes), sizes)
    return depth.reshape(count, trees, n).mean(axis=1)
