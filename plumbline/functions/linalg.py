"""Small dense algebra, and conjugate gradients for symmetric systems of level size."""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np


def dependent_columns(gram: np.ndarray, raw: np.ndarray | None = None, tol: float = 1e-10) -> list[int]:
    """Columns that a pivoted Cholesky factorisation finds dependent on the others.

    raw: the columns' sums of squares before anything was projected out, against which "nothing left" is judged.
    """
    n = len(gram)
    a, scale = gram.astype(float).copy(), np.maximum(np.diag(gram) if raw is None else raw, 1e-300)
    left, bad = list(range(n)), []
    unit = np.sqrt(scale)
    a = a / unit[:, None] / unit[None, :]
    first = np.diag(a).copy()
    for j in range(n):  # what absorption removed entirely
        if first[j] <= tol:
            left.remove(j)
            bad.append(j)
    norm = {j: a[j, j] for j in left}
    while left:
        j = max(left, key=lambda k: (a[k, k] / norm[k], -k))
        if a[j, j] / norm[j] <= max(tol, n * np.finfo(float).eps):
            bad += left
            break
        left.remove(j)
        for k in left:
            a[k, left] -= a[k, j] / a[j, j] * a[j, left]
    return sorted(bad)


def inverse_without(gram: np.ndarray, bad: list[int]) -> np.ndarray:
    """The inverse over the columns that are not bad, NaN elsewhere."""
    good = [k for k in range(len(gram)) if k not in bad]
    out = np.full(gram.shape, np.nan)
    if good:
        out[np.ix_(good, good)] = np.linalg.inv(gram[np.ix_(good, good)])
    return out


def pinv(a: np.ndarray, cutoff: float = 1e-10) -> tuple[np.ndarray, int]:
    """Pseudo-inverse and rank of a symmetric positive semidefinite matrix."""
    if not len(a):
        return a, 0
    value, vector = np.linalg.eigh((a + a.T) / 2)
    keep = value > cutoff * max(value.max(), 1e-300)
    return (vector[:, keep] / value[keep]) @ vector[:, keep].T, int(keep.sum())


def cgsolve(a: np.ndarray | Callable, b: np.ndarray, eps: float = 1e-10, init: np.ndarray | None = None, diagonal: np.ndarray | None = None, rounds: int = 20_000, symmetric: bool = False) -> np.ndarray:
    """Solves a x = b for a symmetric positive semidefinite matrix or operator, all right sides together.

    eps is relative to the right side's norm, and absolute if negative. A right side that is done leaves the
    block. diagonal: for Jacobi preconditioning. symmetric: test the operator's symmetry on random vectors.
    """
    apply = a if callable(a) else lambda v: a @ v
    b = np.asarray(b, float)
    flat = b.ndim == 1
    b = b.reshape(len(b), -1)
    if symmetric:
        rng = np.random.default_rng(0)
        u, v = rng.normal(size=(2, len(b), 1))
        p, q = float((u * apply(v)).sum()), float((v * apply(u)).sum())
        if abs(p - q) > 1e-8 * max(abs(p), abs(q), 1):
            warnings.warn("the matrix does not look symmetric", stacklevel=2)
    scale = np.ones((len(b), 1)) if diagonal is None else np.where(diagonal > 0, 1 / np.where(diagonal > 0, diagonal, 1), 0)[:, None]
    x = np.zeros_like(b) if init is None else np.array(init, float).reshape(b.shape)
    r = b - apply(x) if init is not None else b.copy()
    goal = np.full(b.shape[1], -eps) if eps < 0 else eps * np.maximum(np.linalg.norm(b, axis=0), 1e-300)
    live = np.flatnonzero(np.linalg.norm(r, axis=0) > goal)
    z = scale * r
    p, rz = z.copy(), (r * z).sum(0)
    for _ in range(rounds):
        if not len(live):
            break
        q = apply(p[:, live])
        pq = (p[:, live] * q).sum(0)
        step = np.where(pq > 0, rz[live] / np.where(pq > 0, pq, 1), 0)
        for j, c in enumerate(live):  # column by column, as large vectors are not copied then
            x[:, c] += step[j] * p[:, c]
            r[:, c] -= step[j] * q[:, j]
        z = scale * r[:, live]
        new = (r[:, live] * z).sum(0)
        more = new / np.maximum(rz[live], 1e-300)
        for j, c in enumerate(live):
            p[:, c] = z[:, j] + more[j] * p[:, c]
        rz[live] = new
        live = live[(np.linalg.norm(r[:, live], axis=0) > goal[live]) & (pq > 0)]
    else:
        warnings.warn("conjugate gradients did not converge", stacklevel=2)
    return x[:, 0] if flat else x


def mctrace(a: np.ndarray | Callable, n: int | None = None, tol: float = 1e-3, most: int = 10_000, seed: int = 1, diagonal: np.ndarray | None = None) -> float:
    """The trace: the diagonal's sum of a matrix, or of an operator whose diagonal is given, else the mean of x'Ax over random signs to a relative tolerance (absolute if negative)."""
    if diagonal is not None:
        return float(np.sum(diagonal))
    if not callable(a):
        return float(np.trace(a))
    rng = np.random.default_rng(seed)
    seen: list[float] = []
    while len(seen) < most:
        x = rng.choice([-1.0, 1.0], size=(n, 8))
        seen += (x * a(x)).sum(0).tolist()
        mean, sd = float(np.mean(seen)), float(np.std(seen, ddof=1) / np.sqrt(len(seen)))
        if sd <= (-tol if tol < 0 else tol * abs(mean)):
            break
    return mean
