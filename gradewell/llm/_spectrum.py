"""Eigenvalues and eigenvectors of a scatter matrix that takes up one weighted vector at a time.

The scatter of k rows around their mean is U diag(d) U'. A further row x of weight w
moves it by k w / (k + w) times the square of its distance from the mean: a rank-one
update, whose eigenvalues are the roots of the secular equation
1 + rho sum z_j^2 / (d_j - t) = 0 between the poles d_j.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z2: np.ndarray, rho: float) -> np.ndarray:
    """Matrix of d_j - t_i for the roots t_i of 1 + rho sum z2_j / (d_j - t), d rising and distinct, z2 and rho positive.

    Every root is sought from its nearer pole, so the differences keep their digits. The step fits one pole at
    each end of the interval; a step that leaves the bracket is replaced by its midpoint.
    """
    n, w = len(d), rho * z2
    ends = np.append(d[1:], d[-1] + w.sum())
    half = (ends - d) / 2
    middle = 1 + (w[:, None] / (d[:, None] - (d + half)[None, :])).sum(0)
    right = (middle < 0) & (np.arange(n) < n - 1)
    base = np.where(right, ends, d)
    gaps = d[:, None] - base[None, :]
    low, high = np.where(right, -half, 0.0), np.where(right, 0.0, half)
    last_up = middle[-1] < 0
    if last_up:
        low[-1], high[-1] = half[-1], 2 * half[-1]
    left_pole, right_pole = d - base, ends - base
    left_w = w[:, None] * (np.arange(n)[:, None] <= np.arange(n)[None, :])
    t = (low + high) / 2
    for _ in range(80):
        inverse = 1 / (gaps - t)
        square = inverse * inverse
        f = 1 + w @ inverse
        done = np.abs(f) <= 4 * EPS * n * (1 + w @ np.abs(inverse))
        if done.all():
            break
        low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
        psi, all_slope = (left_w * square).sum(0), w @ square
        a_, b_ = left_pole - t, right_pole - t
        c = f - a_ * psi - b_ * (all_slope - psi)
        a = (a_ + b_) * f - a_ * b_ * all_slope
        b = a_ * b_ * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0.0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c))
        new = t + step
        t = np.where(done, t, np.where((new > low) & (new < high), new, (low + high) / 2))
        if (done | (high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)))).all():
            break
    return gaps - t


@dataclass
class Spectrum:
    """Weight, mean and scatter (eigenvalues rising, vectors in columns) of the rows seen so far; at most `rank` eigenpairs are kept."""

    dim: int
    rank: int
    weight: int = 0

    def __post_init__(self):
        self.mean, self.values, self.vectors = np.zeros(self.dim), np.zeros(0), np.zeros((self.dim, 0))

    def add(self, x: np.ndarray, weight: int = 1) -> None:
        """One more row, as often as weight says, by a centred rank-one update."""
        gap, total = x - self.mean, self.weight + weight
        if self.weight:
            self._update(gap, self.weight * weight / total)
        self.mean = self.mean + gap * (weight / total)
        self.weight = total

    def merge(self, other: Spectrum) -> None:
        """The rows of another spectrum: one update for each of its eigenpairs and one for the distance of the means."""
        if not other.weight:
            return
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            self._update(vector, float(value))
        total = self.weight + other.weight
        gap = other.mean - self.mean
        if self.weight:
            self._update(gap, self.weight * other.weight / total)
        self.mean = self.mean + gap * (other.weight / total)
        self.weight = total

    def _update(self, v: np.ndarray, rho: float) -> None:
        length = float(v @ v)
        if not rho * length > 0:
            return
        z = self.vectors.T @ v
        rest = v - self.vectors @ z
        again = self.vectors.T @ rest
        z, rest = z + again, rest - self.vectors @ again
        d, u = self.values, self.vectors
        outside = float(np.sqrt(rest @ rest))
        if len(d) < self.dim and outside > 64 * EPS * np.sqrt(length):
            # a direction not seen before enters with the eigenvalue nought
            d, u, z = np.concatenate([[0.0], d]), np.column_stack([rest / outside, u]), np.concatenate([[outside], z])
            order = np.argsort(d, kind="stable")
            d, u, z = d[order], u[:, order], z[order]
        norm2 = float(z @ z)
        rho, z = rho * norm2, z / np.sqrt(norm2)
        small = 8 * EPS * max(float(d[-1]), rho)
        d, u, z = self._rotated(d, u, z, small)
        moved = rho * np.abs(z) > small
        if moved.any():
            dm, zm = d[moved], z[moved]
            diff = secular_roots(dm, zm * zm, rho)  # pole j, root i
            poles = dm[None, :] - dm[:, None]
            np.fill_diagonal(poles, 1.0)
            exact = np.sqrt(np.abs(np.prod(-diff / poles, axis=1))) * np.sign(zm)
            turn = exact[:, None] / diff
            turn /= np.sqrt((turn * turn).sum(0))
            d, u = d.copy(), u.copy()
            d[moved], u[:, moved] = dm - np.diag(diff), u[:, moved] @ turn
        order = np.argsort(d, kind="stable")[-self.rank :]
        self.values, self.vectors = d[order], u[:, order]

    @staticmethod
    def _rotated(d, u, z, small):
        """Deflation of poles that lie together: a rotation puts the weight of the pair on one of them."""
        near = np.diff(d) * np.abs(z[1:] * z[:-1]) <= small * np.maximum(z[1:] ** 2 + z[:-1] ** 2, 1e-300)
        if not near.any():
            return d, u, z
        d, u, z = d.copy(), u.copy(), z.copy()
        last = None  # the last pole that still has weight
        for j in range(len(d)):
            if abs(z[j]) == 0:
                continue
            if last is not None:
                r = np.hypot(z[last], z[j])
                c, s = z[j] / r, z[last] / r
                if abs((d[j] - d[last]) * c * s) <= small:
                    z[j], z[last] = r, 0.0
                    a, b = u[:, last].copy(), u[:, j].copy()
                    u[:, last], u[:, j] = c * a - s * b, s * a + c * b
                    d[last], d[j] = d[last] * c * c + d[j] * s * s, d[last] * s * s + d[j] * c * c
            last = j
        order = np.argsort(d, kind="stable")
        return d[order], u[:, order], z[order]
