"""Singular values and right singular vectors of a small matrix: Householder bidiagonalisation, dqds, twisted factorisations."""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(float).eps


def bidiagonalised(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal a, superdiagonal b, V) of an upper bidiagonal B with r'r = V B'B V'; V is the product of the right reflectors."""
    m = np.array(r, np.float64)
    d = m.shape[1]
    v = np.eye(d)
    for k in range(d):
        _reflect(m[k:, k:])
        if k < d - 2:
            h, beta = _reflect(m[k:, k + 1 :].T)
            v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ h, beta * h)
    return np.diag(m).copy(), np.diag(m, 1).copy(), v


def _reflect(part: np.ndarray) -> tuple[np.ndarray, float]:
    """Reflect the rows of `part` in place so that its first column becomes a multiple of the first unit vector."""
    x = part[:, 0].copy()
    size = np.linalg.norm(x)
    if size == 0 or len(x) == 1:
        return np.zeros(len(x)), 0.0
    x[0] += math.copysign(size, x[0])
    beta = 2 / (x @ x)
    part -= np.outer(beta * x, x @ part)
    return x, beta


def _sweep(q: list[float], e: list[float], s: float) -> tuple[list[float], list[float], list[float]] | None:
    """One differential quotient-difference transform with shift s; None if s is above the smallest eigenvalue."""
    d = q[0] - s
    p, f, ds = [], [], [d]
    for i in range(len(e)):
        if d < 0:
            return None
        a = d + e[i]
        if a == 0:
            return None
        t = q[i + 1] / a
        p.append(a)
        f.append(e[i] * t)
        d = d * t - s
        ds.append(d)
    if d < 0:
        return None
    return [*p, d], f, ds


def squared_values(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The eigenvalues of B'B, falling, each to high relative accuracy: dqds on the squares, which never subtracts but for the shifts.

    Shifts: close below the smallest pivot of the last transform, half of it, then 1 / sum(1 / pivots), a lower bound of the smallest
    eigenvalue; a transform that turns a pivot negative is refused and tried with the next."""
    top = float(np.max(np.abs(a), initial=0.0)) ** 2 + float(np.max(np.abs(b), initial=0.0)) ** 2
    if top == 0:
        return np.zeros(len(a))
    least = top * 1e-60
    todo = [([max(float(x) ** 2, least) for x in a], [float(x) ** 2 for x in b], 0.0)]
    found: list[float] = []
    while todo:
        q, e, sigma = todo.pop()
        while q:
            if len(q) == 1:
                found.append(sigma + q[0])
                break
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= (8 * EPS) ** 2 * (sigma + min(q[i], q[i + 1]))), None)
            if cut is not None:  # the blocks on both sides have nothing to do with each other
                todo.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            plain = _sweep(q, e, 0.0)
            if plain is None:
                q = [max(x, least) for x in q]
                continue
            low = min(plain[2])
            bound = 1 / sum(1 / max(x, least) for x in plain[2])
            q, e = plain[0], plain[1]
            for s in (low * (1 - 1e-3), low / 2, bound * (1 - 1e-10)):
                step = _sweep(q, e, s) if s > 0 else None
                if step is not None:
                    q, e, sigma = step[0], step[1], sigma + s
                    break
            q = [max(x, least) for x in q]
    return np.sort(np.array(found))[::-1]


def twisted(a: np.ndarray, b: np.ndarray, value: float) -> tuple[np.ndarray, float]:
    """(unit eigenvector of B'B for an eigenvalue near `value`, the eigenvalue corrected by its Rayleigh quotient).

    B'B = L D L' with D = a^2 and L's entries b / a. The stationary transform factors L D L' - value from the top, the progressive one
    from the bottom; where the two meet with the smallest pivot, both halves of the vector follow without a division of small numbers."""
    n = len(a)
    tiny = max(float(np.max(np.abs(a))) ** 2, 1e-300) * EPS**2
    sure = lambda x: x if abs(x) > tiny else tiny
    d = [sure(float(x) ** 2) for x in a]
    low = [float(b[i]) * math.copysign(1, float(a[i])) / math.sqrt(d[i]) for i in range(n - 1)]
    s, plus = [-value], []
    for i in range(n - 1):
        f = d[i] * low[i] / sure(s[i] + d[i])
        plus.append(f)
        s.append(f * low[i] * s[i] - value)
    p, minus = [0.0] * n, [0.0] * (n - 1)
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        t = d[i] / sure(d[i] * low[i] ** 2 + p[i + 1])
        minus[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    gamma = [s[i] + p[i] + value for i in range(n)]
    r = min(range(n), key=lambda i: abs(gamma[i]))
    z = np.zeros(n)
    z[r] = 1.0
    for i in range(r - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(r, n - 1):
        z[i + 1] = -minus[i] * z[i]
    z = np.nan_to_num(z, posinf=0.0, neginf=0.0)
    size = float(np.linalg.norm(z))
    return z / size, value + gamma[r] / size**2


def right_vectors(a: np.ndarray, b: np.ndarray, values: np.ndarray, most: int) -> np.ndarray:
    """The unit eigenvectors of B'B for the first `most` of its falling eigenvalues, as columns, orthogonal to double precision. What
    a vector has left of those before it, as in clusters of eigenvalues, is taken out; if little remains, inverse iteration finds another."""
    n = len(a)
    out = np.zeros((n, most))
    full = np.diag(a) + np.diag(b, 1)
    rng = np.random.default_rng(n)
    for k in range(most):
        z, better = twisted(a, b, float(values[k]))
        z, _ = twisted(a, b, better) if abs(better - values[k]) <= 1e-8 * values[0] else (z, better)
        if k:
            others = out[:, :k]
            rest = z - others @ (others.T @ z)
            if np.linalg.norm(rest) < 0.5:  # one vector for two eigenvalues: inverse iteration beside those found
                shifted = full.T @ full - (values[k] + 16 * EPS * values[0]) * np.eye(n)
                rest = rng.normal(size=n)
                for _ in range(4):
                    rest = rest - others @ (others.T @ rest)
                    rest = np.linalg.solve(shifted, rest / np.linalg.norm(rest))
            rest = rest - others @ (others.T @ rest)
            z = rest / np.linalg.norm(rest)
            z = z - others @ (others.T @ z)
            z /= np.linalg.norm(z)
        out[:, k] = z
    return out


def decomposed(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(all eigenvalues of r'r, falling; unit eigenvectors of the first `most` as columns, the largest entry of each positive)."""
    r = np.vstack([r, np.zeros((max(0, r.shape[1] - len(r)), r.shape[1]))])
    scale = float(np.max(np.abs(r), initial=0.0))
    if scale == 0:
        return np.zeros(r.shape[1]), np.eye(r.shape[1])[:, :most]
    a, b, v = bidiagonalised(r / scale)
    values = squared_values(a, b)
    vectors = v @ right_vectors(a, b, values, most)
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(most)])
    return values * scale**2, vectors * sign
