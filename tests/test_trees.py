"""Trees grown a level at a time are those that a plain program grows node by node."""

import numpy as np
import pytest

from occugrid.operators import trees


def impurity_left(w, y):
    total, positive = float(w.sum()), float((w * y).sum())
    return (positive**2 + (total - positive) ** 2) / total


def plain_tree(x, y, w, key, candidates, max_depth):
    nodes, next_id = {}, 1
    level, depth = [(0, np.flatnonzero(w))], 0
    while level:
        below = []
        for node, rows in level:
            p = float((w[rows] * y[rows]).sum() / w[rows].sum())
            varying = [j for j in range(x.shape[1]) if len(set(x[rows, j])) > 1]
            if p in (0.0, 1.0) or not varying or depth == max_depth:
                nodes[node] = (-1, 0.0, -1, -1, p)
                continue
            order = trees.feature_order(np.array([key]), np.array([node]), x.shape[1])[0]
            best = None
            for j in [j for j in order if j in varying][:candidates]:
                found = sorted(set(x[rows, j]))
                for low, high in zip(found, found[1:]):
                    left, right = rows[x[rows, j] <= low], rows[x[rows, j] > low]
                    score = impurity_left(w[left], y[left]) + impurity_left(w[right], y[right])
                    if best is None or score > best[0]:
                        best = (score, j, low + (high - low) / 2, left, right)
            _, j, threshold, left, right = best
            nodes[node] = (int(j), threshold, next_id, next_id + 1, p)
            below += [(next_id, left), (next_id + 1, right)]
            next_id += 2
        level, depth = below, depth + 1
    return nodes


def plain_walk(nodes, row):
    at = 0
    while nodes[at][0] >= 0:
        at = nodes[at][3] if row[nodes[at][0]] > nodes[at][1] else nodes[at][2]
    return nodes[at][4]


def table(n, seed):
    rng = np.random.default_rng(seed)
    columns = [rng.integers(0, 9, n), rng.integers(-4, 4, n), rng.normal(size=n), rng.integers(0, 2, n), np.ones(n)]
    return np.column_stack(columns).astype(float), rng.integers(0, 2, n), rng


@pytest.mark.parametrize(("n", "max_depth", "candidates"), [(1, None, 2), (30, None, 2), (60, 3, 1), (80, None, 5), (40, 0, 2)])
def test_against_plain_growth(n, max_depth, candidates):
    x, y, rng = table(n, n)
    rows = np.flatnonzero(rng.random(n) < 0.8) if n > 1 else np.array([0])
    keys = trees.mixed(7, np.arange(6)).view(np.int64)
    weights = np.stack([trees.bootstrap(key, rows, n) for key in keys])
    grown = trees.grow(x, y, weights, keys, candidates, max_depth)
    total = np.zeros(n)
    for i, key in enumerate(keys):
        mine = grown.tree == i
        columns = (grown.feature, grown.threshold, grown.left, grown.right, grown.p)
        found = {
            int(node): (int(f), float(t), int(left), int(right), float(p))
            for node, f, t, left, right, p in zip(grown.node[mine], *[c[mine] for c in columns], strict=True)
        }
        expected = plain_tree(x, y, weights[i], key, candidates, max_depth)
        assert found == expected
        total += [plain_walk(expected, row) for row in x]
    assert trees.walk(grown, 6, x) == pytest.approx(total, abs=1e-12)


def test_a_tree_is_the_same_in_any_block():
    x, y, _ = table(50, 1)
    keys = trees.mixed(7, np.arange(5)).view(np.int64)
    weights = np.stack([trees.bootstrap(key, np.arange(50), 50) for key in keys])
    together = trees.grow(x, y, weights, keys, 2)
    alone = [trees.grow(x, y, weights[i : i + 1], keys[i : i + 1], 2) for i in range(5)]
    assert together.threshold.tolist() == np.concatenate([one.threshold for one in alone]).tolist()
    assert together.p.tolist() == np.concatenate([one.p for one in alone]).tolist()


def test_bootstrap_draws_as_many_rows_as_there_are():
    rows = np.arange(100, 400)
    drawn = np.array([trees.bootstrap(key, rows, 500) for key in range(200)])
    assert (drawn.sum(axis=1) == 300).all() and not drawn[:, :100].any() and not drawn[:, 400:].any()
    assert (drawn[:, 100:400] > 0).mean() == pytest.approx(1 - np.exp(-1), abs=0.01)
    assert len({tuple(one) for one in drawn.tolist()}) == 200


def test_full_trees_have_pure_leaves_and_know_their_rows():
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(200, 3)), rng.integers(0, 2, 200)
    keys = trees.mixed(1, np.arange(3)).view(np.int64)
    grown = trees.grow(x, y, np.ones((3, 200), int), keys, 1)
    assert set(grown.p[grown.feature == trees.LEAF]) == {0.0, 1.0}
    assert (trees.walk(grown, 3, x) / 3 == y).all()
