"""NumPy kernels over blocks of vectors; they run inside Arrow batches and on bounded samples."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def exact_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances from differences, without cancellation; rows of q by rows of x."""
    out = np.empty((len(q), len(x)))
    for i, row in enumerate(q):
        d = x - row
        out[i] = np.sqrt((d * d).sum(axis=1))
    return out


def rough_squares(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by one matrix product, and a bound on their rounding error."""
    qq, xx = (q * q).sum(axis=1), (x * x).sum(axis=1)
    square = qq[:, None] + xx[None, :] - 2 * (q @ x.T)
    return square, 1e-12 * (qq[:, None] + xx[None, :]) + 1e-300


def paired_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances to about twelve digits: by one matrix product, and from differences where that would cancel."""
    qq, xx = (q * q).sum(axis=1), (x * x).sum(axis=1)
    square = q @ (-2 * x.T)
    square += qq[:, None]
    square += xx
    r, c = np.nonzero(square < 1e-3 * (qq.max() + xx.max()))
    for at in range(0, len(r), 1 << 16):
        i, j = r[at:at + (1 << 16)], c[at:at + (1 << 16)]
        d = q[i] - x[j]
        square[i, j] = (d * d).sum(axis=1)
    return np.sqrt(square, out=square)


def nearest(q: np.ndarray, ids: np.ndarray, x: np.ndarray, n: int, own: np.ndarray | None = None, allowed: np.ndarray | None = None) -> Iterable[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of q the places in x of its n nearest by (distance to nine digits, id), with the
    distances. The matrix product only shortlists; the order rests on exact distances. ``own``
    gives the ids that a query must not find, ``allowed`` (rows of q by rows of x) what it may find."""
    square, slack = rough_squares(q, x)
    open_to = np.ones(square.shape, dtype=bool) if allowed is None else allowed
    if own is not None:
        open_to = open_to & (own[:, None] != ids[None, :])
    if len(x) > n:
        edge = np.partition(np.where(open_to, square + slack, np.inf), n - 1, axis=1)[:, n - 1:n]
        open_to = open_to & (square - slack <= edge + 4e-9 * np.maximum(1.0, np.abs(edge)) ** 0.5 + 1e-17)
    r, c = np.nonzero(open_to)
    d = np.empty(len(r))
    for at in range(0, len(r), 1 << 16):
        gap = x[c[at:at + (1 << 16)]] - q[r[at:at + (1 << 16)]]
        d[at:at + (1 << 16)] = np.sqrt((gap * gap).sum(axis=1))
    order = np.lexsort((ids[c], np.round(d, 9), r))
    cuts = np.searchsorted(r, np.arange(len(q) + 1)).tolist()
    for i, (low, high) in enumerate(zip(cuts, cuts[1:])):
        if high > low:
            first = order[low:min(high, low + n)]
            yield i, c[first], d[first]


def assign(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row (the first of equals) and its squared distance. A matrix product settles
    most rows; where two centres are as near within its rounding, exact distances decide."""
    if not len(centres) or not len(x):
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    square, slack = rough_squares(x, centres)
    label = square.argmin(axis=1)
    rows = np.arange(len(x))
    edge = square[rows, label] + slack[rows, label]
    for i in np.flatnonzero((square - slack <= edge[:, None]).sum(axis=1) > 1).tolist():
        near = np.flatnonzero(square[i] - slack[i] <= edge[i])
        label[i] = near[((x[i] - centres[near]) ** 2).sum(axis=1).argmin()]
    d = x - centres[label]
    return label, (d * d).sum(axis=1)


def seed_centres(x: np.ndarray, draws: list[float]) -> list[int]:
    """k-means++: the first centre by the first draw, each further one with a probability in
    proportion to its squared distance from the nearest centre so far, by running sums in row
    order. Where all distances are zero the draw picks uniformly."""
    n = len(x)
    chosen = [min(n - 1, int(draws[0] * n))]
    best = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    for u in draws[1:]:
        running = np.cumsum(best)
        if running[-1] > 0:
            at = min(n - 1, int(np.searchsorted(running, u * running[-1], side="left")))
        else:
            at = min(n - 1, int(u * n))
        chosen.append(at)
        best = np.minimum(best, ((x - x[at]) ** 2).sum(axis=1))
    return chosen


def lloyd(x: np.ndarray, centres: np.ndarray, max_iters: int, tol: float, empty: str, by: list | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """(centres, labels of the last assignment, iterations that ran). ``by`` gets the centres that the last
    assignment went by."""
    labels, rounds = None, 0
    while rounds < max_iters:
        rounds += 1
        if by is not None:
            by[:] = [centres]
        found, gaps = assign(x, centres)
        unchanged = labels is not None and (found == labels).all()
        labels = found
        counts = np.bincount(labels, minlength=len(centres))
        new = centres.copy()
        far = np.lexsort((np.arange(len(x)), -gaps)).tolist() if empty == "farthest" and (counts == 0).any() else []
        for c in range(len(centres)):
            if counts[c]:
                new[c] = x[labels == c].sum(axis=0) / counts[c]
            elif far:
                new[c] = x[far.pop(0)]
        shift = np.sqrt(((new - centres) ** 2).sum(axis=1)).sum()
        centres = new
        if unchanged or shift < tol:
            break
    return centres, labels, rounds
