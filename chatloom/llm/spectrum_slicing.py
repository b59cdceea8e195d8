"""Leading eigenpairs of a symmetric matrix by slicing its spectrum.

The inertia of LDL^T of the matrix minus a shift tells how many eigenvalues lie above the shift. Bisection by these
counts isolates each wanted eigenvalue in an interval of its own; Rayleigh quotient iteration started inside
converges cubically; counts at both sides of what it finds certify that it is the eigenvalue of that number.
Eigenvalues that rounding cannot tell apart share an interval, and their vectors are kept orthogonal.
"""

from __future__ import annotations

import numpy as np

#: Bunch and Kaufman's bound of pivot growth.
ALPHA = (1 + 17**0.5) / 8
EPS = np.finfo(np.float64).eps


def count_above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues greater than ``shift``: the positive ones of D in LDL^T, with 1x1 and 2x2 pivots."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, above = len(a), 0, 0
    while k < n:
        own, column = abs(a[k, k]), np.abs(a[k + 1 :, k])
        off = column.max(initial=0.0)
        if max(own, off) == 0:
            k += 1
            continue
        wide = False
        if own < ALPHA * off:
            r = k + 1 + int(column.argmax())
            row = np.abs(a[r, k:])
            row[r - k] = 0
            if own * row.max() < ALPHA * off * off:
                wide = abs(a[r, r]) < ALPHA * row.max()
                to = k + 1 if wide else k
                a[[to, r]] = a[[r, to]]
                a[:, [to, r]] = a[:, [r, to]]
        if wide:
            above += 1  # such a block has a negative determinant: one eigenvalue of either sign
            left = a[k + 2 :, k : k + 2]
            a[k + 2 :, k + 2 :] -= left @ np.linalg.solve(a[k : k + 2, k : k + 2], left.T)
            k += 2
        else:
            above += a[k, k] > 0
            left = a[k + 1 :, k]
            a[k + 1 :, k + 1 :] -= np.outer(left, left / a[k, k])
            k += 1
    return int(above)


def _solve(matrix: np.ndarray, shift: float, x: np.ndarray, scale: float) -> np.ndarray:
    for nudge in (0.0, EPS, 16 * EPS):
        try:
            y = np.linalg.solve(matrix - (shift + nudge * scale) * np.eye(len(matrix)), x)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all() and y.any():
            return y
    return x


def leading_eigenpairs(matrix: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit vectors as columns; the largest entry is positive."""
    matrix = (matrix + matrix.T) / 2
    n = len(matrix)
    wanted = min(wanted, n)
    radius = np.abs(matrix).sum(axis=1) - np.abs(np.diag(matrix))
    low, high = float((np.diag(matrix) - radius).min()), float((np.diag(matrix) + radius).max())
    scale = max(abs(low), abs(high))
    if scale == 0:
        return np.zeros(wanted), np.eye(n)[:, :wanted]
    tiny = n * EPS * scale
    known = {low - tiny: n, high + tiny: 0}  # shift to eigenvalues above it

    def counted(shift: float) -> int:
        if shift not in known:
            known[shift] = count_above(matrix, shift)
        return known[shift]

    values, vectors = np.zeros(wanted), np.zeros((n, 0))
    start = np.random.default_rng(7)
    for k in range(1, wanted + 1):
        under = max(s for s, c in known.items() if c >= k)
        over = min(s for s, c in known.items() if c < k)

        def halve() -> None:
            nonlocal under, over
            middle = (under + over) / 2
            if counted(middle) >= k:
                under = middle
            else:
                over = middle

        while (counted(under) != k or counted(over) != k - 1) and over - under > tiny:
            halve()
        while True:
            x = start.standard_normal(n)
            shift, at, found = (under + over) / 2, (under + over) / 2, False
            for step in range(60):
                x -= vectors @ (vectors.T @ x)
                x = _solve(matrix, shift, x / np.linalg.norm(x), scale)
                x -= vectors @ (vectors.T @ x)
                x -= vectors @ (vectors.T @ x)
                x /= np.linalg.norm(x)
                ahead = matrix @ x
                at = float(x @ ahead)
                left = float(np.linalg.norm(ahead - at * x))
                if left <= tiny / 4:
                    found = True
                    break
                # a quotient outside the interval belongs to another eigenvalue: its middle leads back
                shift = at if step and under <= at <= over else (under + over) / 2
            inside = under - tiny <= at <= over + tiny
            if found and inside and counted(at + 2 * tiny) < k <= counted(at - 2 * tiny):
                break
            if over - under <= tiny:
                if inside:
                    break
                raise ArithmeticError(f"eigenvalue {k} could not be told from its neighbours")
            halve()
        x *= np.sign(x[np.abs(x).argmax()])
        values[k - 1] = at
        vectors = np.column_stack([vectors, x])
    return values, vectors
