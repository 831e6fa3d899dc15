"""Triangles of whole scenes judged, shown and linked as arrays: many small scenes, or one large one, at a time.

What a scene's triangles are compared with never leaves the scene, so nothing is shuffled for it. Distances, signs and
tests are those of ``geom``; keys that both sides share meet by sorting, in blocks of ``MOST`` pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from lanewright.functions import kernels

#: Pairs that are tested together, and edges of one roadway from which on cells are used.
MOST, LONG = 1 << 20, 64


@dataclass
class Edges:
    """Edges of roadways: their group's number, roadway's code, place in it, ends and direction."""

    group: np.ndarray
    road: np.ndarray
    k: np.ndarray
    px: np.ndarray
    py: np.ndarray
    qx: np.ndarray
    qy: np.ndarray
    angle: np.ndarray


@dataclass
class Triangles:
    """Corners as rows of points (n x 3), the group's number, the number in the group, and what was found out."""

    at: np.ndarray
    group: np.ndarray
    t: np.ndarray
    width: np.ndarray
    longest: np.ndarray
    roadways: np.ndarray
    size: np.ndarray
    crowded: np.ndarray
    parallel: np.ndarray
    rejected: np.ndarray  # 0: none, 1: size, 2: cluster, 3: parallel


def edges_of(group: np.ndarray, road: np.ndarray, x: np.ndarray, y: np.ndarray) -> Edges:
    """The edges between consecutive points of each roadway; points come in order, group by group."""
    order = np.lexsort((road, group))
    g, r = group[order], road[order]
    same = (g[1:] == g[:-1]) & (r[1:] == r[:-1])
    first = np.concatenate([[True], ~same])[: len(g)]
    start = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
    p, q = order[:-1][same], order[1:][same]
    return Edges(group[p], road[p], (np.arange(len(g)) - start)[:-1][same], x[p], y[p], x[q], y[q], np.arctan2(y[q] - y[p], x[q] - x[p]))


def _segment_distance(px, py, ax, ay, bx, by) -> np.ndarray:
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    short = square < 1e-12
    t = np.where(short, 0.0, np.minimum(1.0, np.maximum(0.0, ((px - ax) * dx + (py - ay) * dy) / np.where(short, 1.0, square))))
    u, v = px - (ax + t * dx), py - (ay + t * dy)
    return np.sqrt(u * u + v * v)


def _left(ax, ay, bx, by, cx, cy) -> np.ndarray:
    return (cy - ay) * (bx - ax) > (by - ay) * (cx - ax)


def _meet(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of left and right with equal keys, in blocks of some ``MOST`` pairs."""
    order = np.argsort(right, kind="stable")
    keys = right[order]
    lo, hi = np.searchsorted(keys, left, "left"), np.searchsorted(keys, left, "right")
    size = hi - lo
    total = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < len(left):
        end = max(at + 1, int(np.searchsorted(total, total[at] + MOST, side="right")) - 1)
        if count := int(total[end] - total[at]):
            i = np.repeat(np.arange(at, end), size[at:end])
            yield i, order[lo[i] + np.arange(count) - (total[i] - total[at])]
        at = end


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows, and every whole number from lo to hi of each."""
    n = hi - lo + 1
    row = np.repeat(np.arange(len(lo)), n)
    return row, lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _beside(roads: np.ndarray, box: tuple, e: Edges, e_roads: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and edges of one roadway that may be as near as ``reach``, some of them several times.

    Edges of short roadways meet all rows; those of long ones meet by cells of at least the edges' mean size.
    """
    count = np.bincount(e_roads, minlength=int(max(roads.max(initial=-1), e_roads.max(initial=-1))) + 1)
    long = count > LONG
    near, far = np.flatnonzero(~long[roads]), np.flatnonzero(~long[e_roads])
    for i, j in _meet(roads[near], e_roads[far]):
        yield near[i], far[j]
    near, far = np.flatnonzero(long[roads]), np.flatnonzero(long[e_roads])
    if not len(near) or not len(far):
        return
    ex0, ex1, ey0, ey1 = (f(a[far], b[far]) for a, b in ((e.px, e.qx), (e.py, e.qy)) for f in (np.minimum, np.maximum))
    extent = np.maximum(ex1 - ex0, ey1 - ey0)
    size = np.bincount(e_roads[far], np.maximum(extent, reach), len(count)) / np.maximum(1, count)
    largest = np.zeros(len(count))
    np.maximum.at(largest, e_roads[far], extent)
    size = np.maximum(size, largest / 64) + 1e-9

    def cells(road: np.ndarray, x0, x1, y0, y1) -> tuple[np.ndarray, np.ndarray]:
        s = size[road]
        lo, hi = (np.floor(x0 / s).astype(int), np.floor(y0 / s).astype(int)), (np.floor(x1 / s).astype(int), np.floor(y1 / s).astype(int))
        row, gx = _spread(lo[0], hi[0])
        again, gy = _spread(lo[1][row], hi[1][row])
        row, gx = row[again], gx[again]
        return row, np.column_stack([road[row], gx, gy])

    slack = reach + 1e-9 * (np.abs(ex0) + np.abs(ex1) + np.abs(ey0) + np.abs(ey1))
    a, one = cells(roads[near], *(v[near] for v in box))
    b, two = cells(e_roads[far], ex0 - slack, ex1 + slack, ey0 - slack, ey1 + slack)
    codes = np.unique(np.vstack([one, two]), axis=0, return_inverse=True)[1].ravel()
    for i, j in _meet(codes[: len(one)], codes[len(one) :]):
        yield near[a[i]], far[b[j]]


#: Groups of up to so many points are triangulated together, each triple against each other point.
FEW = 8


def _of_few(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of groups of n points each (m x n): which are decided, and group and triple (k x 3) of their Delaunay triangles.

    A group is undecided, and left to the kernel, if rounding could decide a sign: with equal points, or points on one
    line or one circle.
    """
    n = x.shape[1]
    triples = np.array(list(itertools.combinations(range(n), 3)))
    (ax, bx, cx), (ay, by, cy) = ([v[:, triples[:, k]] for k in range(3)] for v in (x, y))
    left, right = (bx - ax) * (cy - ay), (by - ay) * (cx - ax)
    unsure = (np.abs(left - right) <= kernels._CROSS_BOUND * (np.abs(left) + np.abs(right))).any(1)
    turn = np.sign(left - right)
    good = np.ones(turn.shape, bool)
    for p in range(n):
        others = np.flatnonzero((triples != p).all(1))
        if not len(others):
            continue
        (ux, vx, wx), (uy, vy, wy) = ([v[:, triples[others, k]] - v[:, [p]] for k in range(3)] for v in (x, y))
        la, lb, lc = ux * ux + uy * uy, vx * vx + vy * vy, wx * wx + wy * wy
        bc, cb, ac, ca, ab, ba = vx * wy, wx * vy, ux * wy, wx * uy, ux * vy, vx * uy
        found = la * (bc - cb) - lb * (ac - ca) + lc * (ab - ba)
        bound = kernels._CIRCLE_BOUND * (la * (np.abs(bc) + np.abs(cb)) + lb * (np.abs(ac) + np.abs(ca)) + lc * (np.abs(ab) + np.abs(ba)))
        unsure |= ~(np.abs(found) > bound).all(1)
        good[:, others] &= ~(found * turn[:, others] > 0)
    row, k = np.nonzero(good & ~unsure[:, None])
    return ~unsure, row, triples[k]


def triangulated(group: np.ndarray, x: np.ndarray, y: np.ndarray, last_of_equal: bool = False) -> np.ndarray:
    """The Delaunay triangles of every group's points as three ascending rows of points, sorted (``kernels.delaunay``)."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(group) else np.empty(0, int)
    sizes = np.diff(np.append(starts, len(group)))
    found, left = [np.empty((0, 3), int)], [starts[sizes > FEW]]
    for n in range(3, FEW + 1):
        lo = starts[sizes == n]
        if len(lo):
            at = lo[:, None] + np.arange(n)
            sure, row, triples = _of_few(x[at], y[at])
            found.append(lo[row][:, None] + triples)
            left.append(lo[~sure])
    ends = dict(zip(starts.tolist(), (starts + sizes).tolist(), strict=True))
    both = np.column_stack([x, y])
    for lo in np.concatenate(left).tolist():
        found.append(kernels.delaunay(both[lo : ends[lo]], last_of_equal) + lo)
    tri = np.vstack(found)
    return tri[np.lexsort(tri.T[::-1])]


def judge(group: np.ndarray, x: np.ndarray, y: np.ndarray, road: np.ndarray, e: Edges, config, last_of_equal: bool = False) -> Triangles:
    """The Delaunay triangles of every group's points, and the first test that rejects each; roads are codes."""
    tri = triangulated(group, x, y, last_of_equal)
    of = group[tri[:, 0]]
    first = np.concatenate([[True], of[1:] != of[:-1]])[: len(of)]
    t = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
    px, py, r = x[tri], y[tri], road[tri]
    height = [_segment_distance(px[:, (j + 2) % 3], py[:, (j + 2) % 3], px[:, j], py[:, j], px[:, (j + 1) % 3], py[:, (j + 1) % 3]) for j in range(3)]
    width = np.minimum(np.minimum(height[0], height[1]), height[2])
    for j in (2, 1, 0):
        width = np.where(r[:, j] == r[:, (j + 1) % 3], height[j], width)
    sides = [np.sqrt((px[:, (i + 1) % 3] - px[:, i]) ** 2 + (py[:, (i + 1) % 3] - py[:, i]) ** 2) for i in range(3)]
    longest = np.maximum(np.maximum(sides[0], sides[1]), sides[2])
    roadways = 1 + (r[:, 1] != r[:, 0]) + ((r[:, 2] != r[:, 0]) & (r[:, 2] != r[:, 1]))
    size = longest if config.by_longest_edge else width
    crowded = (np.bincount(tri.ravel(), minlength=len(x)) >= config.cluster_threshold)[tri].any(1)
    fits = (size >= config.min_width) & (size <= config.max_width)
    parallel = _alike(np.flatnonzero(fits & (roadways >= 2)), of, px, py, r, e, config)
    rejected = np.where(~fits, 1, np.where(crowded, 2, np.where((roadways < 2) | ~parallel, 3, 0)))
    return Triangles(tri, of, t, width, longest, roadways, size, crowded, parallel, rejected)


def _road_keys(group: np.ndarray, road: np.ndarray, e: Edges) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of (group, roadway), the same for rows and edges."""
    base = int(max(road.max(initial=0), e.road.max(initial=0))) + 1
    codes = np.unique(np.concatenate([group * base + road, e.group * base + e.road]), return_inverse=True)[1]
    return codes[: len(group)], codes[len(group) :]


def _alike(fit: np.ndarray, of: np.ndarray, px: np.ndarray, py: np.ndarray, r: np.ndarray, e: Edges, config) -> np.ndarray:
    """Whether triangles lie between two roadways that run alike, by each corner's nearest edge of its own roadway."""
    out = np.zeros(len(of), bool)
    if not len(fit):
        return out
    cx, cy = px[fit].ravel(), py[fit].ravel()
    mine, theirs = _road_keys(np.repeat(of[fit], 3), r[fit].ravel(), e)
    found = []
    for i, j in _beside(mine, (cx, cx, cy, cy), e, theirs, config.edge_reach):
        d = _segment_distance(cx[i], cy[i], e.px[j], e.py[j], e.qx[j], e.qy[j])
        near = np.flatnonzero(d < config.edge_reach)
        i, j, d = i[near], j[near], d[near]
        order = np.lexsort((e.angle[j], e.k[j], d, i))
        first = np.concatenate([[True], np.diff(i[order]) != 0])[: len(order)]
        found.append([v[order][first] for v in (i, j, d)])
    angle = np.full(len(cx), np.nan)
    if found:
        i, j, d = (np.concatenate(v) for v in zip(*found, strict=True))
        order = np.lexsort((e.angle[j], e.k[j], d, i))
        first = np.concatenate([[True], np.diff(i[order]) != 0])[: len(order)]
        angle[i[order][first]] = e.angle[j[order][first]]
    angle, roads = angle.reshape(-1, 3), r[fit]
    known = ~np.isnan(angle)
    total, n = np.zeros(angle.shape), np.zeros(angle.shape)
    for a in range(3):
        for b in range(3):
            counts = (roads[:, a] == roads[:, b]) & known[:, b]
            total[:, a] += np.where(counts, angle[:, b], 0.0)
            n[:, a] += counts
    mean = np.where(n > 0, total / np.maximum(n, 1), np.nan)
    limit = math.radians(config.parallel_degrees)
    for a, b in ((0, 1), (1, 2), (0, 2)):
        turn = mean[:, a] - mean[:, b]
        turn = np.abs(np.arctan2(np.sin(turn), np.cos(turn)))
        out[fit] |= (roads[:, a] != roads[:, b]) & ((turn < limit) | (turn > math.pi - limit))
    return out


def _sides(tri: Triangles) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """i, j, triangle of every side, sorted by its ends, then by triangle; and whether it is the side's first."""
    i, j = (np.concatenate([tri.at[:, a] for a in k]) for k in ((0, 1, 0), (1, 2, 2)))
    row = np.tile(np.arange(len(tri.t)), 3)
    order = np.lexsort((row, j, i))
    i, j, row = i[order], j[order], row[order]
    return i, j, row, np.concatenate([[True], (i[1:] != i[:-1]) | (j[1:] != j[:-1])])[: len(i)]


KINDS = ("clustered", "undersized", "oversized", "non_parallel", "valid")


def shown(tri: Triangles, config) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, j (rows of points), kind (a number of ``KINDS``) of each triangle edge, as the first triangle that has it is shown."""
    kind = np.select([tri.crowded, tri.size < config.min_width, tri.size > config.max_width, tri.roadways < 2, ~tri.parallel], [0, 1, 2, -1, 3], 4)
    i, j, row, first = _sides(tri)
    first &= kind[row] >= 0
    return i[first], j[first], kind[row[first]]


def linked(tri: Triangles, x: np.ndarray, y: np.ndarray, road: np.ndarray, e: Edges, config) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of triangles t and u that share a side and whose centres' link crosses no edge of their roadways; centres x, y."""
    i, j, row, first = _sides(tri)
    again = np.flatnonzero(~first)
    p, q = row[again - 1], row[again]
    mx, my = ((v[tri.at[:, 0]] + v[tri.at[:, 1]] + v[tri.at[:, 2]]) / 3 for v in (x, y))
    ok = (tri.rejected == 0) if config.valid_neighbour_only else ~tri.crowded & (tri.size <= config.max_width)
    dx, dy = mx[q] - mx[p], my[q] - my[p]
    good = (tri.rejected[p] == 0) & ok[q] & (np.sqrt(dx * dx + dy * dy) <= config.max_width / 2)
    p, q = p[good], q[good]
    if len(p):
        roads = np.sort(np.hstack([road[tri.at[p]], road[tri.at[q]]]), 1)
        new = np.hstack([np.ones((len(p), 1), bool), roads[:, 1:] != roads[:, :-1]])
        link, k = np.nonzero(new)
        ax, ay, bx, by = mx[p[link]], my[p[link]], mx[q[link]], my[q[link]]
        mine, theirs = _road_keys(tri.group[p[link]], roads[link, k], e)
        crossed = np.zeros(len(p), bool)
        for m, n in _beside(mine, (np.minimum(ax, bx), np.maximum(ax, bx), np.minimum(ay, by), np.maximum(ay, by)), e, theirs, 1e-9):
            a, b, c, d = (ax[m], ay[m]), (bx[m], by[m]), (e.px[n], e.py[n]), (e.qx[n], e.qy[n])
            hit = (_left(*a, *c, *d) != _left(*b, *c, *d)) & (_left(*a, *b, *c) != _left(*a, *b, *d))
            crossed[link[m[hit]]] = True
        p, q = p[~crossed], q[~crossed]
    return p, q, mx, my
