"""The nearest vectors of two blocks by cosine: a product in single precision finds what may count, double precision decides."""

from __future__ import annotations

import numpy as np

#: rows and columns of a product that is held at once; columns of the first look
ROWS, COLUMNS, FIRST = 1024, 1024, 1024
#: pairs whose similarity is computed at once
PAIRS = 1 << 16


class _Best:
    """The k best of each row so far, by similarity and then by place; ``floor`` is what a product must reach to be looked at."""

    def __init__(self, rows: int, k: int, least: float, error: float) -> None:
        self.k, self.least, self.error = k, least, error
        self.sims, self.places = np.full((rows, k), -np.inf), np.full((rows, k), -1, np.int64)
        self.floor = np.full(rows, least - error, np.float32)

    def add(self, row: np.ndarray, place: np.ndarray, sim: np.ndarray) -> None:
        good = (sim >= self.sims[row, -1]) & (sim >= self.least)
        if not good.any():
            return
        row, place, sim = row[good], place[good], sim[good]
        rows = np.unique(row)
        every = np.concatenate([np.repeat(rows, self.k), row])
        sims, places = np.concatenate([self.sims[rows].ravel(), sim]), np.concatenate([self.places[rows].ravel(), place])
        order = np.lexsort((places, -sims, every))
        first = order[np.searchsorted(every[order], rows)[:, None] + np.arange(self.k)]
        self.sims[rows], self.places[rows] = sims[first], places[first]
        self.floor[rows] = np.maximum(self.floor[rows], self.sims[rows, -1] - self.error)

    def found(self, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, other place, similarity) of rows whose places begin at ``start``."""
        row, n = np.nonzero(self.places >= 0)
        return row + start, self.places[row, n], self.sims[row, n]


def _by_component(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components as rows, and squared lengths, added in the order of the components."""
    turned, squared = np.ascontiguousarray(x.T), np.zeros(len(x))
    for component in turned:
        squared += component.astype(np.float64) ** 2
    return turned, squared


def _set(flags: np.ndarray) -> np.ndarray:
    """Where the few flags are that are set: looked for eight at a time; the length is a multiple of eight."""
    words = np.flatnonzero(flags.view(np.uint64))
    word, n = np.nonzero(flags.reshape(-1, 8)[words])
    return words[word] * 8 + n


def nearest(x: np.ndarray, y: np.ndarray, x_start: int, y_start: int, k: int, least: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place, other place, similarity) of the k nearest in ``y`` of each row of ``x``, and the other way round, of at least ``least``.

    Rows have places that count up from ``x_start`` and ``y_start``; of equal similarities
    the smaller place comes first. Blocks of the same start are one block, of which no row meets itself. Products of
    unit vectors in single precision differ from the cosine by less than ``error``, so
    pairs that miss a row's k-th best by more can't be among its best; all others are computed in double precision,
    component after component, so that equal vectors have equal similarities.
    """
    same, error = x_start == y_start, (x.shape[1] + 8) * 2.0**-23
    (xs, x2), (ys, y2) = _by_component(x), _by_component(y)
    u, v = ((m / np.sqrt(squared)[:, None]).astype(np.float32) for m, squared in ((x, x2), (y, y2)))
    sides = [(_Best(len(x), k, least, error), u, v)] + [] if same else [(_Best(len(x), k, least, error), u, v), (_Best(len(y), k, least, error), v, u)]
    for best, mine, theirs in sides:  # a first look gives the floors to begin with
        near = k + same
        some = theirs[:FIRST]
        if len(some) >= near:
            for at in range(0, len(mine), COLUMNS):
                kth = np.partition(mine[at : at + COLUMNS] @ some.T, len(some) - near, axis=1)[:, len(some) - near]
                best.floor[at : at + COLUMNS] = np.maximum(best.floor[at : at + COLUMNS], kth - 2 * error)
    # room that all products share
    product, hit, other = np.empty(ROWS * COLUMNS, np.float32), np.zeros(ROWS * COLUMNS, bool), np.empty(ROWS * COLUMNS, bool)
    for at in range(0, len(x), ROWS):
        for to in range(0, len(y), COLUMNS):
            a, b = u[at : at + ROWS], v[to : to + COLUMNS]
            size, shape = len(a) * len(b), (len(a), len(b))
            now, flags, more = (room[:size].reshape(shape) for room in (product, hit, other))
            np.matmul(a, b.T, out=now)
            np.greater_equal(now, sides[0][0].floor[at : at + ROWS, None], out=flags)
            if not same:
                np.greater_equal(now, sides[1][0].floor[None, to : to + COLUMNS], out=more)
                np.logical_or(flags, more, out=flags)
            hit[size : -(-size // 8) * 8] = False
            every = _set(hit[: -(-size // 8) * 8])
            for n in range(0, len(every), PAIRS):
                i, j = np.divmod(every[n : n + PAIRS], shape[1])
                i, j = i + at, j + to
                if same:
                    i, j = i[i != j], j[i != j]
                dot = np.zeros(len(i))
                for a, b in zip(xs, ys):
                    dot += a[i].astype(np.float64) * b[j]
                sim = np.clip(dot / np.sqrt(x2[i] * y2[j]), -1.0, 1.0)
                sides[0][0].add(i, j + y_start, sim)
                if not same:
                    sides[1][0].add(j, i + x_start, sim)
    return [best.found(start) for (best, _, _), start in zip(sides, (x_start, y_start))]
