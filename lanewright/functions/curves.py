"""Curves between lane ends that avoid polygons: the tries of a scene's connections as arrays, some at a time."""

from __future__ import annotations

import numpy as np

from lanewright.functions.triangles import _left, _meet, _spread

#: Connections whose tries are worked out together.
TOGETHER = 1024


def _cells(size: float, x0, x1, y0, y1) -> tuple[np.ndarray, np.ndarray]:
    """Rows and numbers of the cells that upright boxes touch; boxes without finite bounds touch none."""
    there = np.flatnonzero(np.isfinite(x0) & np.isfinite(x1) & np.isfinite(y0) & np.isfinite(y1))
    lo, hi = ([np.floor(v[there] / size).astype(np.int64) for v in side] for side in ((x0, y0), (x1, y1)))
    row, gx = _spread(lo[0], hi[0])
    again, gy = _spread(lo[1][row], hi[1][row])
    return there[row[again]], gx[again] * 1_000_003 + gy  # cells that share a number only cost a test


def _boxes(ax, ay, bx, by) -> tuple:
    return np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)


def _holding(x: np.ndarray, y: np.ndarray, poly: np.ndarray, px, py, qx, qy) -> np.ndarray:
    """Pairs (row, polygon) of points that lie in polygons, by the even-odd rule of their edges."""
    n = int(poly.max()) + 1
    low = [np.full(n, np.inf) for _ in range(2)]
    high = [np.full(n, -np.inf) for _ in range(2)]
    for k, v in enumerate((px, py)):
        np.minimum.at(low[k], poly, v)
        np.maximum.at(high[k], poly, v)
    extent = np.maximum(high[0] - low[0], high[1] - low[1])
    fine = extent[np.isfinite(extent)]
    size = max(float(fine.mean()) if len(fine) else 0.0, float(fine.max(initial=0.0)) / 64, 1e-6)
    mine, here = _cells(size, x, x, y, y)
    theirs, there = _cells(size, low[0], high[0], low[1], high[1])
    found = [np.empty((0, 2), int)]
    for i, j in _meet(here, there):
        i, j = mine[i], theirs[j]
        near = (x[i] >= low[0][j]) & (x[i] <= high[0][j]) & (y[i] >= low[1][j]) & (y[i] <= high[1][j])
        found.append(np.column_stack([i[near], j[near]]))
    pairs = np.unique(np.vstack(found), axis=0)
    odd = np.zeros(len(pairs), int)
    for i, e in _meet(pairs[:, 1], poly):
        p, q = x[pairs[i, 0]], y[pairs[i, 0]]
        spans = (py[e] > q) != (qy[e] > q)
        level = np.where(py[e] == qy[e], 1.0, qy[e] - py[e])
        odd += np.bincount(i[spans & (p < px[e] + (qx[e] - px[e]) * (q - py[e]) / level)], minlength=len(pairs))
    return pairs[odd % 2 == 1]


def freest(ends: np.ndarray, poly: np.ndarray, sides: np.ndarray, tries: int, points: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each connection (x, y, heading at both ends) the first try that meets no polygon, else the first of those that meet
    fewest, and how many it meets: those whose edges (``sides``: x1, y1, x2, y2) it crosses, or that it starts inside.

    Later tries are worked out only for connections whose earlier ones meet something.
    """
    best, met = np.zeros(len(ends), int), np.zeros(len(ends), int)
    if not len(poly) or not len(ends):
        return best, met
    px, py, qx, qy = sides.T
    box = _boxes(px, py, qx, qy)
    extent = np.maximum(box[1] - box[0], box[3] - box[2])
    fine = extent[np.isfinite(extent)]
    chord = np.hypot(ends[:, 3] - ends[:, 0], ends[:, 4] - ends[:, 1])
    chord = chord[np.isfinite(chord)]
    size = max(float(fine.mean()) if len(fine) else 0.0, float(chord.mean()) / (points - 1) if len(chord) else 0.0, float(fine.max(initial=0.0)) / 64, 1e-6)
    slack = 1e-9 * sum(np.abs(v) for v in box)
    edge, there = _cells(size, box[0] - slack, box[1] + slack, box[2] - slack, box[3] + slack)
    order = np.argsort(there, kind="stable")
    edge, there = edge[order], there[order]
    n = int(poly.max()) + 1
    inside = _holding(ends[:, 0], ends[:, 1], poly, px, py, qx, qy)
    t = np.arange(points) / (points - 1)
    u = 1 - t
    for begin in range(0, len(ends), TOGETHER):
        live = np.arange(begin, min(begin + TOGETHER, len(ends)))
        for k in range(tries):
            x0, y0, a, x1, y1, b = (ends[live, i, None] for i in range(6))
            d = np.sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) * (low + k * ((high - low) / max(1, tries - 1)))
            x, y = (u * u * u * p + 3 * u * u * t * c + 3 * u * t * t * e + t * t * t * q for p, c, e, q in ((x0, x0 - d * np.cos(a), x1 + d * np.cos(b), x1), (y0, y0 - d * np.sin(a), y1 + d * np.sin(b), y1)))
            ax, ay, bx, by = (v.ravel() for v in (x[:, :-1], y[:, :-1], x[:, 1:], y[:, 1:]))
            piece, here = _cells(size, *_boxes(ax, ay, bx, by))
            keys = [inside[np.isin(inside[:, 0], live)] @ np.array([n, 1])]
            for i, j in _meet(here, there):
                i, j = piece[i], edge[j]
                p, q, c, e = (ax[i], ay[i]), (bx[i], by[i]), (px[j], py[j]), (qx[j], qy[j])
                hit = (_left(*p, *c, *e) != _left(*q, *c, *e)) & (_left(*p, *q, *c) != _left(*p, *q, *e))
                keys.append(np.unique(live[i[hit] // (points - 1)] * n + poly[j[hit]]))
            count = np.bincount(np.unique(np.concatenate(keys)) // n - begin, minlength=TOGETHER)[live - begin]
            better = np.ones(len(live), bool) if k == 0 else count < met[live]
            best[live[better]], met[live[better]] = k, count[better]
            live = live[met[live] > 0]
            if not len(live):
                break
    return best, met
