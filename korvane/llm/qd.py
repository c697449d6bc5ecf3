"""Singular values and right singular vectors of a small upper triangular matrix.

Householder reflections make the matrix bidiagonal, dqds (the differential qd algorithm with
shifts) finds the eigenvalues of its Gram matrix to high relative accuracy without forming it, and
twisted factorisations give a vector per eigenvalue. The matrix is as wide as one vector, whatever
the number of rows it stands for.
"""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny / EPS


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, superdiagonal, V): ``U.T @ r @ V`` is upper bidiagonal for some orthogonal U."""
    a = np.array(r, float)
    d = a.shape[0]
    v = np.eye(d)

    def reflector(x):
        w, size = x.copy(), np.linalg.norm(x)
        if size == 0 or np.linalg.norm(x[1:]) == 0:
            return None
        w[0] += np.copysign(size, x[0])
        return w / np.linalg.norm(w)

    for k in range(d):
        w = reflector(a[k:, k])
        if w is not None:
            a[k:, k:] -= 2 * np.outer(w, w @ a[k:, k:])
        if k < d - 2:
            w = reflector(a[k, k + 1:])
            if w is not None:
                a[k:, k + 1:] -= 2 * np.outer(a[k:, k + 1:] @ w, w)
                v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds_step(q, e, shift):
    """One transform; ``None`` if the shift is above the smallest eigenvalue."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return None
        new_q[i] = d + e[i]
        t = q[i + 1] / new_q[i] if new_q[i] > 0 else 1.0
        new_e[i] = e[i] * t
        d = d * t - shift
    if d < 0:
        return None
    new_q[n - 1] = d
    return new_q, new_e


def _least_of_two(q0, e0, q1):
    """The smaller eigenvalue of the Gram matrix of a bidiagonal 2 x 2 matrix."""
    s = q0 + e0 + q1
    if s == 0:
        return 0.0
    root = np.sqrt(max((q0 - q1 + e0) ** 2 + 4 * q1 * e0, 0.0))
    return q0 / ((s + root) / 2) * q1


def gram_eigenvalues(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Eigenvalues of ``B.T @ B`` for an unreduced upper bidiagonal B, by dqds, falling."""
    found, stack = [], [(diagonal ** 2, above ** 2, 0.0)]
    while stack:
        q, e, base = stack.pop()
        if len(q) and q[0] < q[-1]:               # the small end belongs at the bottom
            q, e = q[::-1].copy(), e[::-1].copy()
        while len(q):
            if len(q) == 1:
                found.append(base + q[0])
                break
            if e[-1] <= EPS * EPS * (base + q[-1]) or e[-1] < TINY:
                found.append(base + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            cut = np.flatnonzero(e[:-1] <= EPS * EPS * (base + q[1:-1]) + TINY)
            if len(cut):                          # two independent parts
                at = cut[-1] + 1
                stack.append((q[:at].copy(), e[:at - 1].copy(), base))
                q, e = q[at:], e[at:]
                continue
            shift = 0.98 * min(_least_of_two(q[-2], e[-1], q[-1]), q.min())
            step = _dqds_step(q, e, shift)
            for _ in range(8):
                if step is not None:
                    break
                shift /= 4
                step = _dqds_step(q, e, shift)
            if step is None:
                shift = 0.0
                step = _dqds_step(q, e, shift)
            q, e = step
            base += shift
    return np.sort(np.array(found))[::-1]


def twisted(q: np.ndarray, ratio: np.ndarray, value: float, rank: int = 0):
    """(vector, residual) for an eigenvalue of ``L D L.T`` with D = q and L's subdiagonal ``ratio``.

    The stationary transform runs down and the progressive one up; they meet at the twist, where
    the residual is smallest (``rank`` 1 takes the second smallest, and so on).
    """
    n = len(q)
    down, s = np.empty(n - 1), np.empty(n)
    up, p = np.empty(n - 1), np.empty(n)
    least = EPS * EPS * max(float(np.max(q)), TINY)
    s[0] = -value
    for i in range(n - 1):
        top = s[i] + q[i]
        top = top if abs(top) > least else least
        down[i] = q[i] * ratio[i] / top
        s[i + 1] = down[i] * ratio[i] * s[i] - value
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        low = q[i] * ratio[i] ** 2 + p[i + 1]
        low = low if abs(low) > least else least
        t = q[i] / low
        up[i] = ratio[i] * t
        p[i] = p[i + 1] * t - value
    gamma = s + p + value
    k = int(np.argsort(np.abs(gamma), kind="stable")[min(rank, n - 1)])
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -up[i] * z[i]
    size = z @ z
    return z / np.sqrt(size), gamma[k] / size


def _parts(diagonal, above):
    """Where the bidiagonal matrix falls into independent parts."""
    size = np.abs(diagonal)
    whole = max(float(size.max(initial=0)), float(np.abs(above).max(initial=0)))
    cut = np.flatnonzero(np.abs(above) <= EPS * (size[:-1] + size[1:]) + EPS * EPS * whole)
    return [0, *(cut + 1).tolist(), len(diagonal)]


def leading(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of ``r.T @ r``, falling, and their unit vectors as columns.

    Values that the matrix cannot tell from 0 are left out. Where values lie so close that their
    vectors do not come out orthogonal, the vectors are made so inside their group.
    """
    diagonal, above, v = bidiagonal(r)
    whole = max(np.abs(diagonal).max(initial=0), np.abs(above).max(initial=0))
    if whole == 0:
        return np.zeros(0), np.zeros((len(r), 0))
    # a zero on the diagonal would divide by zero; this moves no value by more than rounding does
    diagonal = np.where(np.abs(diagonal) < EPS * EPS * whole, EPS * EPS * whole, diagonal)
    cuts = _parts(diagonal, above)
    values = []
    for lo, hi in zip(cuts, cuts[1:]):
        values += [(x, lo, hi) for x in gram_eigenvalues(diagonal[lo:hi], above[lo:hi - 1])]
    values.sort(key=lambda x: (-x[0], x[1]))
    floor = (EPS * len(r) * whole) ** 2 + EPS * values[0][0] * 1e-3
    values = [x for x in values if x[0] > floor]
    chosen = values[:most]
    out, vectors = [], []
    done: dict[int, list[tuple[float, np.ndarray]]] = {}
    for value, lo, hi in chosen:
        q = diagonal[lo:hi] ** 2
        ratio = above[lo:hi - 1] / diagonal[lo:hi - 1]
        near = [z for x, z in done.get(lo, []) if x - value <= 1e-3 * value]
        z = np.ones(1)
        if hi - lo > 1:
            for rank in range(hi - lo):
                z, off = twisted(q, ratio, value, rank)
                for _ in range(2):
                    if rank == 0 and 0 < abs(off) < 1e-6 * value:
                        z, off = twisted(q, ratio, value + off, rank)
                for other in near + near:
                    z = z - other * (other @ z)
                size = np.linalg.norm(z)
                if size > 0.1:
                    z = z / size
                    break
        done.setdefault(lo, []).append((value, z))
        full = np.zeros(len(r))
        full[lo:hi] = z
        out.append(value)
        vectors.append(v @ full)
    return np.array(out), np.array(vectors).T.reshape(len(r), len(out))
