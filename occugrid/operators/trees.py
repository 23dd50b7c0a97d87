"""Growing a block of classification trees side by side, one histogram per level, and walking them.

All trees of a block take a level at a time: the rows of every open node are counted by feature
value in one pass over arrays, each node takes its best split, and its rows move to the children.
Every random choice follows from the tree's own key, so a tree is the same in any block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = -1
_U = np.uint64


@dataclass
class Nodes:
    """Nodes of trees, by tree and number; the root is 0. A leaf has feature -1 and no children."""

    tree: np.ndarray
    node: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    p: np.ndarray


def mixed(*parts) -> np.ndarray:
    """A 64-bit hash of whole numbers, array by array (splitmix64)."""
    with np.errstate(over="ignore"):
        state = _U(0)
        for part in parts:
            state = (state ^ np.asarray(part, np.int64).astype(_U)) + _U(0x9E3779B97F4A7C15)
            state = (state ^ (state >> _U(30))) * _U(0xBF58476D1CE4E5B9)
            state = (state ^ (state >> _U(27))) * _U(0x94D049BB133111EB)
            state = state ^ (state >> _U(31))
    return state


def bootstrap(key: int, rows: np.ndarray, n: int) -> np.ndarray:
    """How often each of ``n`` rows is drawn when as many as there are ``rows`` are drawn from them."""
    drawn = mixed(key, np.arange(len(rows))) % _U(max(len(rows), 1))
    return np.bincount(rows[drawn.astype(np.int64)], minlength=n)


def coded(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """``(codes, values)``: each feature's values numbered from the least, and the values."""
    codes, values = np.empty(x.shape, np.int64), []
    for j in range(x.shape[1]):
        found, codes[:, j] = np.unique(x[:, j], return_inverse=True)
        values.append(found)
    return codes, values


def feature_order(keys: np.ndarray, nodes: np.ndarray, n_features: int) -> np.ndarray:
    """A random order of the features for every node."""
    draws = mixed(keys[:, None], nodes[:, None], np.arange(n_features)[None, :])
    return np.argsort(draws, axis=1, kind="stable")


def impurity_left(w: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """What Gini impurity takes from a node's weight; splits want the most of it left."""
    return (positive * positive + (w - positive) * (w - positive)) / w


def grow(
    x: np.ndarray,
    y: np.ndarray,
    weights: np.ndarray,
    keys: np.ndarray,
    candidates: int,
    max_depth: int | None = None,
) -> Nodes:
    """Trees over the rows ``x`` with 0/1 labels ``y``, one for each row of ``weights`` and ``keys``.

    A node looks at the first ``candidates`` features of its random order that vary in it, and
    takes the split with the least Gini impurity, halfway between two values that occur in it;
    among equals the earlier feature, then the smaller value. It is a leaf if one class is left,
    nothing varies or ``max_depth`` is reached.
    """
    codes, values = coded(x)
    n_features = codes.shape[1]
    tree, row = np.nonzero(weights)
    weight = weights[tree, row].astype(np.float64)
    positive = weight * y[row]
    at = tree  # the open node of each drawn row; rows stay in the order of nodes
    node_tree, node_id = np.arange(len(keys)), np.zeros(len(keys), np.int64)
    next_id = np.ones(len(keys), np.int64)
    parts: list[tuple[np.ndarray, ...]] = []
    depth = 0
    while len(node_tree):
        n = len(node_tree)
        total = np.bincount(at, weight, n)
        of_class = np.bincount(at, positive, n)
        starts = np.searchsorted(at, np.arange(n))
        seen = codes[row]
        varies = np.minimum.reduceat(seen, starts) < np.maximum.reduceat(seen, starts)
        split = (of_class > 0) & (of_class < total) & varies.any(axis=1)
        if max_depth is not None and depth >= max_depth:
            split[:] = False
        order = feature_order(keys[node_tree], node_id, n_features)
        place = np.argsort(order, axis=1)
        ordered = np.take_along_axis(varies, order, 1)
        looked_at = np.take_along_axis(ordered & (np.cumsum(ordered, axis=1) <= candidates), place, 1)
        looked_at &= split[:, None]

        best = np.full(n, -np.inf)
        best_place = np.full(n, n_features)
        feature, cut, after = np.full(n, LEAF), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for j in range(n_features):
            used = np.flatnonzero(looked_at[at, j])
            if not len(used):
                continue
            found = _best_cuts(at[used], seen[used, j], weight[used], positive[used], total, of_class)
            where, score, low, high = found
            better = (score > best[where]) | ((score == best[where]) & (place[where, j] < best_place[where]))
            where, score, low, high = where[better], score[better], low[better], high[better]
            best[where], best_place[where] = score, place[where, j]
            feature[where], cut[where], after[where] = j, low, high

        parents = np.flatnonzero(split)
        rank = np.arange(len(parents)) - np.searchsorted(node_tree[parents], node_tree[parents])
        left = np.full(n, LEAF)
        left[parents] = next_id[node_tree[parents]] + 2 * rank
        threshold = np.zeros(n)
        for j in range(n_features):
            here = np.flatnonzero(feature == j)
            low, high = values[j][cut[here]], values[j][after[here]]
            middle = low + (high - low) / 2
            threshold[here] = np.where(middle < high, middle, low)
        parts.append(
            (node_tree, node_id, feature, threshold, left, np.where(split, left + 1, LEAF), of_class / total)
        )

        next_id += 2 * np.bincount(node_tree[parents], minlength=len(keys))
        number = np.zeros(n, np.int64)
        number[parents] = np.arange(len(parents))
        kept = np.flatnonzero(split[at])
        parent = at[kept]
        right = codes[row[kept], feature[parent]] > cut[parent]
        child = 2 * number[parent] + right
        moved = np.argsort(child, kind="stable")
        at, row = child[moved], row[kept][moved]
        weight, positive = weight[kept][moved], positive[kept][moved]
        node_tree = np.repeat(node_tree[parents], 2)
        node_id = (left[parents][:, None] + np.arange(2)).ravel()
        depth += 1
    columns = [np.concatenate(column) for column in zip(*parts, strict=True)]
    by_tree = np.lexsort((columns[1], columns[0]))
    return Nodes(*[column[by_tree] for column in columns])


def _best_cuts(at, code, weight, positive, total, of_class):
    """``(node, score, code below, code above)`` of the best cut of one feature in each node."""
    width = int(code.max()) + 1
    key = at * width + code
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    group = key[first]
    node, value = group // width, group % width
    w = np.cumsum(np.add.reduceat(weight[order], first))
    p = np.cumsum(np.add.reduceat(positive[order], first))
    begins = np.concatenate([[True], node[1:] != node[:-1]])
    # Sums of the nodes before, to be taken off: whole numbers, so nothing is lost.
    heads = np.flatnonzero(begins)
    back = np.cumsum(begins) - 1
    w -= np.concatenate([[0.0], w[heads[1:] - 1]])[back]
    p -= np.concatenate([[0.0], p[heads[1:] - 1]])[back]
    inner = np.flatnonzero(~np.concatenate([begins[1:], [True]]))
    of = node[inner]
    score = impurity_left(w[inner], p[inner]) + impurity_left(total[of] - w[inner], of_class[of] - p[inner])
    firsts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    top = np.maximum.reduceat(score, firsts)
    block = np.repeat(np.arange(len(firsts)), np.diff(np.append(firsts, len(of))))
    winners = np.flatnonzero(score == top[block])
    chosen = winners[np.concatenate([[True], block[winners][1:] != block[winners][:-1]])]
    i = inner[chosen]
    return node[i], score[chosen], value[i], value[i + 1]


def walk(nodes: Nodes, n_trees: int, x: np.ndarray) -> np.ndarray:
    """Sum of the leaf shares of every row of ``x`` over the trees, added tree by tree."""
    roots = np.searchsorted(nodes.tree, np.arange(n_trees))
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for root in roots.tolist():
        at = np.full(len(x), root)
        moving = rows
        while len(moving):
            here = at[moving]
            moving = moving[nodes.feature[here] != LEAF]
            here = at[moving]
            right = x[moving, nodes.feature[here]] > nodes.threshold[here]
            at[moving] = root + np.where(right, nodes.right[here], nodes.left[here])
        total += nodes.p[at]
    return total
