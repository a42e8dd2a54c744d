"""One isolation tree from a small sample, and the path lengths of many rows through all trees."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

EULER_GAMMA = 0.5772156649015329
SAMPLE_LIMIT = 256  # rows per tree; no leaf lies deeper than its logarithm


def expected_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def grow_tree(points: np.ndarray, seed: int) -> list[tuple[int, int, float, int, int, float]]:
    """Nodes (number, feature, threshold, left, right, path length at a leaf); a leaf's feature is -1."""
    rng = np.random.default_rng(seed)
    limit = math.ceil(math.log2(min(max(len(points), 2), SAMPLE_LIMIT)))
    nodes: list[tuple[int, int, float, int, int, float]] = []
    waiting, next_number = [(0, points, 0)], 1
    while waiting:
        number, rows, depth = waiting.pop()
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(points.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            nodes.append((number, -1, 0.0, -1, -1, depth + float(expected_path([len(rows)])[0])))
            continue
        feature = int(rng.choice(usable))
        low, high = rows[:, feature].min(), rows[:, feature].max()
        threshold = float(rng.uniform(low, high))
        goes_left = rows[:, feature] <= threshold
        left, right = next_number, next_number + 1
        next_number += 2
        nodes.append((number, feature, threshold, left, right, 0.0))
        waiting.append((left, rows[goes_left], depth + 1))
        waiting.append((right, rows[~goes_left], depth + 1))
    return nodes


@dataclass(frozen=True)
class Nodes:
    """All trees in flat arrays. A leaf points to itself, so every row can take the same number of steps."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    children: np.ndarray
    path: np.ndarray
    depth: int


def pack(tree: np.ndarray, nodes: dict[str, np.ndarray], n_trees: int) -> Nodes:
    """Flat arrays from node rows (tree, node, feature, threshold, left, right, path)."""
    width = int(nodes["node"].max()) + 1
    place = tree * width + nodes["node"]
    leaf = nodes["feature"] < 0
    size = n_trees * width
    feature, threshold, path = np.zeros(size, np.int32), np.full(size, np.inf), np.zeros(size)
    children = np.repeat(np.arange(size, dtype=np.int32), 2)
    feature[place] = np.where(leaf, 0, nodes["feature"])
    threshold[place] = np.where(leaf, np.inf, nodes["threshold"])
    path[place] = nodes["path"]
    inner = place[~leaf]
    children[2 * inner] = (tree * width + nodes["left"])[~leaf]
    children[2 * inner + 1] = (tree * width + nodes["right"])[~leaf]
    deepest = math.ceil(math.log2(SAMPLE_LIMIT))
    return Nodes(np.arange(n_trees, dtype=np.int32) * width, feature, threshold, children, path, deepest)


def mean_path(points: np.ndarray, nodes: Nodes, chunk: int = 2048) -> np.ndarray:
    """Average leaf path length over all trees; all rows and trees of a chunk go down together."""
    width = points.shape[1]
    out = np.empty(len(points))
    for begin in range(0, len(points), chunk):
        part = np.ascontiguousarray(points[begin:begin + chunk])
        flat, row = part.ravel(), np.arange(len(part), dtype=np.int32)[:, None] * width
        at = np.broadcast_to(nodes.roots, (len(part), len(nodes.roots)))
        for _ in range(nodes.depth):
            right = flat.take(row + nodes.feature.take(at)) > nodes.threshold.take(at)
            at = nodes.children.take(2 * at + right)
        out[begin:begin + chunk] = nodes.path.take(at).mean(axis=1)
    return out
