"""Singular values and right singular vectors of a small square matrix by a qd solver.

Householder reflections make the matrix upper bidiagonal, ``B``. Its squared singular values are
the eigenvalues of ``B'B``; differential qd sweeps with shifts find them one after another without
ever forming ``B'B``, each to high relative accuracy. Twisted factorisations of ``B'B - value``
give the vectors, and the reflections carry them back.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(float).eps)
#: An off-diagonal square below this share of the value is nothing.
_NOTHING = (10 * _EPS) ** 2
_TINY = float(np.finfo(float).tiny)
#: Values closer than this share need their vectors made orthogonal to each other.
_CLOSE = 1e-3


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """``(diagonal, above, right)``: ``B`` and the unit vectors of the reflections from the right."""
    a = np.array(matrix, float)
    n = a.shape[1]
    right: list[np.ndarray] = []
    for k in range(n):
        _reflect(a[k:, k:])
        if k < n - 2:
            right.append(_reflect(a[k:, k + 1 :].T))
    return np.diag(a).copy(), np.diag(a, 1).copy(), right


def _reflect(a: np.ndarray) -> np.ndarray:
    """Reflect the rows of ``a`` in place so that its first column is zero below the first entry."""
    v = a[:, 0].copy()
    size = float(np.linalg.norm(v))
    if len(v) > 1 and np.any(v[1:]):
        v[0] += size if v[0] >= 0 else -size
        v /= np.linalg.norm(v)
        a -= np.outer(2 * v, v @ a)
        a[1:, 0] = 0.0
    else:
        v[:] = 0.0
    return v


def squared_singular_values(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Eigenvalues of ``B'B``, falling, by dqds."""
    found: list[float] = []
    blocks = [((diagonal**2).tolist(), (above**2).tolist(), 0.0)]
    while blocks:
        q, e, shift = blocks.pop()
        blocks += _deflated(q, e, shift, found)
    return np.sort(np.array(found, float))[::-1]


def _deflated(q: list[float], e: list[float], shift: float, found: list[float]) -> list[tuple]:
    """Sweep until the block splits or is used up; what it splits into."""
    while q:
        n = len(q)
        if n == 1:
            found.append(max(q[0] + shift, 0.0))
            return []
        if e[-1] <= _NOTHING * (shift + q[-1]) or e[-1] <= _TINY:
            found.append(max(q[-1] + shift, 0.0))
            q, e = q[:-1], e[:-1]
            continue
        cut = next((i for i in range(n - 1) if e[i] <= _NOTHING * (shift + min(q[i], q[i + 1])) or e[i] <= _TINY), None)
        if cut is not None:
            return [(q[: cut + 1], e[:cut], shift), (q[cut + 1 :], e[cut + 1 :], shift)]
        step = _safe_shift(q, e)
        swept = _sweep(q, e, step)
        while swept is None:
            # Rounding put the shift above the least value.
            step = 0.0 if step < _TINY else step * (1 - 1e-3) if step > 0.99 * min(q) else step / 2
            swept = _sweep(q, e, step)
        q, e = swept
        shift += step
    return []


def _safe_shift(q: list[float], e: list[float]) -> float:
    """A bound from below of the least eigenvalue: one over the trace of the inverse."""
    if min(q) <= _TINY:
        return 0.0
    column = total = 1.0 / q[0]
    for i in range(1, len(q)):
        column = (1.0 + e[i - 1] * column) / q[i]
        total += column
    return (1.0 - 4 * _EPS * len(q)) / total if total < 1 / _TINY else 0.0


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One differential qd sweep; none if the shift was too great."""
    d = q[0] - shift
    new_q, new_e = [], []
    for i, off in enumerate(e):
        if d < 0:
            return None
        top = d + off
        ratio = q[i + 1] / top
        new_q.append(top)
        new_e.append(off * ratio)
        d = d * ratio - shift
    if d < 0:
        return None
    new_q.append(d)
    return new_q, new_e


def _twisted(diagonal: np.ndarray, above: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """``(vector, defect)`` of ``B'B - value`` by the twisted factorisation with the least pivot.

    The stationary factorisation runs from the top, the progressive one from the bottom; they meet
    at the twist, whose pivot is the defect of the vector with 1 at that place.
    """
    n = len(diagonal)
    d = diagonal**2
    ratio = above / diagonal[:-1] if n > 1 else above
    coupled = d[:-1] * ratio
    small = _TINY / _EPS

    def pivot(x: float) -> float:
        return x if abs(x) > small else small

    s, down = np.empty(n), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        down[i] = coupled[i] / pivot(s[i] + d[i])
        s[i + 1] = down[i] * ratio[i] * s[i] - value
    p, up = np.empty(n), np.empty(max(n - 1, 0))
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        t = pivot(coupled[i] * ratio[i] + p[i + 1])
        up[i] = coupled[i] / t
        p[i] = p[i + 1] * (d[i] / t) - value
    gamma = s + p + value
    twist = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -up[i] * z[i]
    size = float(np.linalg.norm(z))
    return z / size, float(gamma[twist]) / size**2


def _vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of ``B'B`` for its falling nonzero ``values``, as columns."""
    n = len(diagonal)
    whole = np.diag(diagonal) + np.diag(above, 1)
    gram = whole.T @ whole
    out = np.zeros((n, len(values)))
    for k, value in enumerate(values):
        near = [j for j in range(k) if values[j] - value <= _CLOSE * values[j]]
        z = np.zeros(n)
        if np.all(diagonal != 0) and np.all(np.isfinite(above)):
            at = float(value)
            for _ in range(3):
                z, defect = _twisted(diagonal, above, at)
                if abs(defect) <= _EPS * value:
                    break
                # The Rayleigh quotient of the vector; far steps would leave for another value.
                at += defect if abs(defect) < 1e-6 * value else 0.0
        if near or not np.all(np.isfinite(z)) or not z.any():
            z = _orthogonal_to(gram, float(value), z, out[:, near])
        out[:, k] = z
    return out


def _orthogonal_to(gram: np.ndarray, value: float, z: np.ndarray, others: np.ndarray) -> np.ndarray:
    """A vector of a close group, by inverse iteration kept orthogonal to the group's others."""
    n = len(gram)
    shifted = gram - (value * (1 + 8 * _EPS)) * np.eye(n)
    best, best_left = z, np.inf
    for start in [z, *np.eye(n)]:
        x = start
        for _ in range(3):
            x = x - others @ (others.T @ x)
            x = x - others @ (others.T @ x)
            size = np.linalg.norm(x)
            if not np.isfinite(size) or size < 1e-8:
                break
            x = x / size
            left = float(np.linalg.norm(gram @ x - value * x))
            if left < best_left:
                best, best_left = x, left
            if left <= 16 * n * _EPS * value:
                return x
            try:
                x = np.linalg.solve(shifted, x)
            except np.linalg.LinAlgError:
                shifted = shifted - 64 * _EPS * value * np.eye(n)
                x = np.linalg.solve(shifted, x)
            x = x / np.linalg.norm(x)
    return best


def right_singular(matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(squared, vectors)``: all squared singular values, falling, and unit right vectors.

    Vectors are the columns for the ``k`` greatest values, fewer where the matrix has a lower
    rank: a value within rounding of zero has no direction of its own.
    """
    n = matrix.shape[1]
    if n == 0:
        return np.zeros(0), np.zeros((0, 0))
    # Scaled by a power of two, which changes no digit.
    top = float(np.abs(matrix).max(initial=0.0))
    scale = 2.0 ** np.floor(np.log2(top)) if top > 0 else 1.0
    diagonal, above, right = bidiagonal(matrix / scale)
    squared = squared_singular_values(diagonal, above)
    limit = (n * _EPS) ** 2 * squared[0] * 64
    used = squared[: min(k, n)]
    vectors = _vectors(diagonal, above, used[used > limit])
    for i in range(len(right) - 1, -1, -1):
        v = right[i]
        vectors[i + 1 :] -= np.outer(2 * v, v @ vectors[i + 1 :])
    return squared * scale**2, vectors
