"""Leading eigenpairs of a symmetric matrix by spectrum slicing.

The factors LDLᵀ of the matrix less a shift have as many positive pivots as there are eigenvalues above the shift (Sylvester's law of
inertia). Counts at trial shifts isolate each leading eigenvalue in an interval of its own; Rayleigh quotient iteration, started with
the interval's midpoint, converges cubically; counts just below and just above the value found certify that it is the k-th largest.
Every factorisation that the iteration makes is a count as well and narrows the interval. Vectors are kept orthogonal to those already
found, so that repeated eigenvalues get a basis of their space.
"""

from __future__ import annotations

import numpy as np

ALPHA = (1 + 17**0.5) / 8
"""Bunch and Kaufman's bound for the choice between pivots of one and two rows."""
ROUNDS = 20


class Factors:
    """P A Pᵀ = L D Lᵀ with pivots of one or two rows (Bunch and Kaufman), for symmetric indefinite ``A``."""

    def __init__(self, matrix: np.ndarray, tiny: float):
        a = matrix.copy()
        n = self.n = len(a)
        self.order = np.arange(n)
        self.blocks: list[tuple[int, np.ndarray]] = []
        self.above = at = 0
        while at < n:
            width = 1
            if at + 1 < n:
                column = np.abs(a[at + 1 :, at])
                r = int(column.argmax()) + at + 1
                largest = column[r - at - 1]
                if abs(a[at, at]) < ALPHA * largest:
                    other = np.abs(a[at:, r])
                    other[r - at] = 0
                    beside = other.max()
                    if abs(a[at, at]) * beside < ALPHA * largest**2:
                        if abs(a[r, r]) >= ALPHA * beside:
                            self._swap(a, at, r)
                        else:
                            width = 2
                            self._swap(a, at + 1, r)
            block, below = a[at : at + width, at : at + width].copy(), a[at + width :, at : at + width].copy()
            if width == 1 and abs(block[0, 0]) < tiny:
                block[0, 0] = tiny
            lower = below / block[0, 0] if width == 1 else below @ np.linalg.inv(block)
            a[at + width :, at + width :] -= lower @ below.T
            a[at + width :, at : at + width] = lower
            self.above += int(block[0, 0] > 0) if width == 1 else int((np.linalg.eigvalsh(block) > 0).sum())
            self.blocks.append((at, block))
            at += width
        self.lower = a

    def _swap(self, a: np.ndarray, i: int, j: int) -> None:
        if i != j:
            a[[i, j]] = a[[j, i]]
            a[:, [i, j]] = a[:, [j, i]]
            self.order[[i, j]] = self.order[[j, i]]

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = b[self.order].astype(float)
        for at, block in self.blocks:
            end = at + len(block)
            x[end:] -= self.lower[end:, at:end] @ x[at:end]
        for at, block in self.blocks:
            end = at + len(block)
            x[at:end] = x[at:end] / block[0, 0] if len(block) == 1 else np.linalg.solve(block, x[at:end])
        for at, block in reversed(self.blocks):
            end = at + len(block)
            x[at:end] -= self.lower[end:, at:end].T @ x[end:]
        out = np.empty_like(x)
        out[self.order] = x
        return out


class Spectrum:
    def __init__(self, matrix: np.ndarray):
        self.matrix = (matrix + matrix.T) / 2
        self.n = len(matrix)
        self.norm = float(np.abs(self.matrix).sum(1).max()) if self.n else 0.0
        self.least = 16 * max(self.n, 1) * 2.0**-52 * self.norm
        """Differences up to here are rounding."""
        edge = 1.01 * self.norm + self.least
        self.counts = {-edge: self.n, edge: 0}

    def factors(self, shift: float) -> Factors:
        made = Factors(self.matrix - shift * np.eye(self.n), 2.0**-52 * self.norm)
        self.counts[shift] = made.above
        return made

    def interval(self, k: int) -> tuple[float, float]:
        """The nearest shifts known to lie below and above the k-th largest eigenvalue."""
        return max(s for s, c in self.counts.items() if c >= k), min(s for s, c in self.counts.items() if c < k)

    def isolate(self, k: int) -> tuple[float, float]:
        """An interval that holds the k-th largest eigenvalue alone, or is as narrow as rounding allows."""
        while True:
            low, high = self.interval(k)
            alone = self.counts[low] == k and self.counts[high] == k - 1
            if alone or high - low <= self.least:
                return low, high
            self.factors((low + high) / 2)

    def certified(self, value: float, k: int) -> bool:
        return self.factors(value - self.least).above >= k > self.factors(value + self.least).above

    def pair(self, k: int, found: np.ndarray, draw: np.random.Generator) -> tuple[float, np.ndarray]:
        """The k-th largest eigenvalue and a unit vector for it, orthogonal to the rows of ``found``."""

        def unit(x: np.ndarray) -> np.ndarray:
            for _ in range(2):
                x = x / np.linalg.norm(x)
                x = x - found.T @ (found @ x)
            return x / np.linalg.norm(x)

        while True:
            low, high = self.isolate(k)
            value, x, before = (low + high) / 2, unit(draw.standard_normal(self.n)), np.inf
            factors = self.factors(value)
            for _ in range(2):
                x = unit(factors.solve(x))
            for _ in range(ROUNDS):
                value = float(x @ self.matrix @ x)
                residual = float(np.linalg.norm(self.matrix @ x - value * x))
                if residual >= before / 2 and residual <= self.least:
                    break
                before = residual
                x = unit(self.factors(value).solve(x))
            if residual <= self.least and low - self.least <= value <= high + self.least and self.certified(value, k):
                return value, x
            low, high = self.interval(k)
            if high - low <= self.least:
                raise ArithmeticError(f"eigenvalue {k} was not found")
            self.factors((low + high) / 2)


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` eigenvalues from the largest down, and unit vectors as rows; those not above rounding are left out."""
    spectrum = Spectrum(matrix)
    count = min(most, spectrum.factors(spectrum.least).above) if spectrum.norm else 0
    values, vectors, draw = [], np.zeros((0, spectrum.n)), np.random.default_rng(1)
    for k in range(1, count + 1):
        value, x = spectrum.pair(k, vectors, draw)
        values.append(value)
        vectors = np.vstack([vectors, x])
    return np.array(values), vectors
