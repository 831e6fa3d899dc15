"""A lab of interpolating curves: one table of samples for every method, and the errors of those that fail."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewright.functions import kernels
from lanewright.plans.grouped import map_groups


def parameters(points: np.ndarray, kind: str = "centripetal") -> np.ndarray:
    """Parameters in [0, 1]: uniform, or by cumulative length (chord) or its square root (centripetal)."""
    points = np.asarray(points, float)
    if kind == "uniform":
        return np.linspace(0, 1, len(points))
    step = np.linalg.norm(np.diff(points, axis=0), axis=1) ** {"chord": 1.0, "centripetal": 0.5}[kind]
    run = np.concatenate([[0.0], np.cumsum(step)])
    return run / run[-1] if run[-1] > 0 else run


def hermite(t: np.ndarray, y: np.ndarray, slopes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic pieces from values and slopes at the knots."""
    i = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 2)
    h = (t[i + 1] - t[i])[:, None]
    s = (at - t[i])[:, None] / h
    return (1 + 2 * s) * (1 - s) ** 2 * y[i] + s * (1 - s) ** 2 * h * slopes[i] + s**2 * (3 - 2 * s) * y[i + 1] + s**2 * (s - 1) * h * slopes[i + 1]


def natural(t, y, at):
    return kernels.cubic_spline(t, y, at)


def not_a_knot(t, y, at):
    return kernels.cubic_spline(t, y, at, "not-a-knot")


def clamped(t, y, at):
    """End slopes are those of the first and last chord."""
    d = np.diff(y, axis=0) / np.diff(t)[:, None]
    return kernels.cubic_spline(t, y, at, "clamped", (d[0], d[-1]))


def pchip(t, y, at):
    """Monotone pieces: weighted harmonic means of neighbouring chord slopes, 0 where they change sign."""
    h = np.diff(t)[:, None]
    d = np.diff(y, axis=0) / h
    m = np.empty_like(y)
    if len(t) == 2:
        m[:] = d[0]
        return hermite(t, y, m, at)
    w1, w2 = 2 * h[1:] + h[:-1], h[1:] + 2 * h[:-1]
    same = d[:-1] * d[1:] > 0
    safe = np.where(same, w1 / np.where(d[:-1] == 0, 1, d[:-1]) + w2 / np.where(d[1:] == 0, 1, d[1:]), 1)
    m[1:-1] = np.where(same, (w1 + w2) / safe, 0)
    for end, h0, h1, d0, d1 in ((0, h[0], h[1], d[0], d[1]), (-1, h[-1], h[-2], d[-1], d[-2])):
        e = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        e = np.where(np.sign(e) != np.sign(d0), 0, e)
        m[end] = np.where((np.sign(d0) != np.sign(d1)) & (np.abs(e) > 3 * np.abs(d0)), 3 * d0, e)
    return hermite(t, y, m, at)


def akima(t, y, at, modified: bool = False):
    """Slopes weighted by how much the chords on the other side change; ``modified`` flattens plateaus."""
    d = np.diff(y, axis=0) / np.diff(t)[:, None]
    if len(d) == 1:
        return hermite(t, y, np.repeat(d, 2, 0), at)
    first, last = 2 * d[0] - d[1], 2 * d[-1] - d[-2]
    d = np.vstack([2 * first - d[0], first, d, last, 2 * last - d[-1]])
    a, b = np.abs(d[3:] - d[2:-1]), np.abs(d[1:-2] - d[:-3])
    if modified:
        a, b = a + np.abs(d[3:] + d[2:-1]) / 2, b + np.abs(d[1:-2] + d[:-3]) / 2
    flat = a + b < 1e-12
    return hermite(t, y, np.where(flat, (d[1:-2] + d[2:-1]) / 2, (a * d[1:-2] + b * d[2:-1]) / np.where(flat, 1, a + b)), at)


def b_spline(t, y, at, degree: int = 3, smoothing: float = 0.0):
    """A B-spline through the points (averaged knots); with ``smoothing`` a ridge on second differences of its controls."""
    k = min(degree, len(t) - 1)
    knots = np.concatenate([[t[0]] * (k + 1), [t[i : i + k].mean() for i in range(1, len(t) - k)], [t[-1]] * (k + 1)])

    def basis(u: np.ndarray) -> np.ndarray:
        n = len(knots) - 1
        i = np.clip(np.searchsorted(knots, u, side="right") - 1, k, n - k - 1)
        b = np.zeros((len(u), n))
        b[np.arange(len(u)), i] = 1
        for d in range(1, k + 1):
            left, right = knots[d : n + 0] - knots[: n - d], knots[d + 1 :][: n - d] - knots[1 : n - d + 1]
            l = np.divide(u[:, None] - knots[: n - d], left, out=np.zeros((len(u), n - d)), where=left != 0)
            r = np.divide(knots[d + 1 :][: n - d] - u[:, None], right, out=np.zeros((len(u), n - d)), where=right != 0)
            b = l * b[:, : n - d] + r * b[:, 1 : n - d + 1]
        return b

    a = basis(t)
    if smoothing:
        rough = np.diff(np.eye(a.shape[1]), 2, axis=0)
        c = np.linalg.solve(a.T @ a + smoothing * rough.T @ rough, a.T @ y)
    else:
        c = np.linalg.solve(a, y)
    return basis(np.asarray(at, float)) @ c


def catmull_rom(points: np.ndarray, alpha: float = 0.5, samples: int = 20, extend: bool = True) -> np.ndarray:
    """A curve through the points whose knots are spaced by length to the power ``alpha``; ends reflected or doubled."""
    p = np.asarray(points, float)
    ends = (2 * p[0] - p[1], 2 * p[-1] - p[-2]) if extend else (p[0], p[-1])
    q = np.vstack([ends[0], p, ends[1]])
    out = []
    for i in range(len(p) - 1):
        a, b, c, d = q[i : i + 4]
        s = np.cumsum([0.0, *(max(np.linalg.norm(v - u), 1e-12) ** alpha for u, v in ((a, b), (b, c), (c, d)))])
        u = np.linspace(s[1], s[2], samples)[:, None]
        mix = lambda x, y, lo, hi: (hi - u) / (hi - lo) * x + (u - lo) / (hi - lo) * y
        a1, a2, a3 = mix(a, b, s[0], s[1]), mix(b, c, s[1], s[2]), mix(c, d, s[2], s[3])
        b1, b2 = mix(a1, a2, s[0], s[2]), mix(a2, a3, s[1], s[3])
        out.append(mix(b1, b2, s[1], s[2])[int(i > 0) :])
    return np.vstack(out)


def composite_bezier(points: np.ndarray, tension: float = 0.33, total: int = 500) -> np.ndarray:
    """Cubic pieces with handles along differences of neighbours; at least 20 samples a piece."""
    p = np.asarray(points, float)
    tangent = np.gradient(p, axis=0) * np.where((np.arange(len(p)) > 0) & (np.arange(len(p)) < len(p) - 1), 2.0, 1.0)[:, None]
    u = np.linspace(0, 1, max(total // (len(p) - 1), 20))[:, None]
    out = []
    for i in range(len(p) - 1):
        size = np.linalg.norm(p[i + 1] - p[i])
        c1 = p[i] + tension * tangent[i] * size / np.linalg.norm(tangent[i] + 1e-12)
        c2 = p[i + 1] - tension * tangent[i + 1] * size / np.linalg.norm(tangent[i + 1] + 1e-12)
        out.append((1 - u) ** 3 * p[i] + 3 * (1 - u) ** 2 * u * c1 + 3 * (1 - u) * u**2 * c2 + u**3 * p[i + 1])
    return np.vstack(out)


def _by_parameter(fit: Callable) -> Callable[[np.ndarray, int], np.ndarray]:
    def run(points: np.ndarray, samples: int) -> np.ndarray:
        t = parameters(points)
        return fit(t, points, np.linspace(t[0], t[-1], samples))

    return run


METHODS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "natural": _by_parameter(natural),
    "not-a-knot": _by_parameter(not_a_knot),
    "clamped": _by_parameter(clamped),
    "pchip": _by_parameter(pchip),
    "akima": _by_parameter(akima),
    "modified akima": _by_parameter(lambda t, y, at: akima(t, y, at, True)),
    "b-spline": _by_parameter(b_spline),
    "catmull-rom": lambda p, n: catmull_rom(p, samples=max(10, n // max(1, len(p) - 1))),
    "bezier": lambda p, n: composite_bezier(p, total=n),
}


def _curve(method: str, points: np.ndarray, samples: int) -> tuple[np.ndarray, str | None]:
    """A method's samples, or none and its error."""
    try:
        return METHODS[method](points, samples), None
    except (ValueError, IndexError, ZeroDivisionError, np.linalg.LinAlgError) as e:
        return np.empty((0, 2)), str(e) or type(e).__name__


def compare(lines: DataFrame, samples: int = 500, methods: tuple[str, ...] = tuple(METHODS), scene: str = "scene_id") -> DataFrame:
    """scene, method, k, x, y, error of every method over each line (scene, ord, x, y); a method that fails is one row."""

    def work(key: tuple, c: dict[str, np.ndarray]):
        points = np.column_stack([c["x"], c["y"]])
        for m in methods:
            curve, error = _curve(m, points, samples)
            if error is not None:
                yield (key[0], m, None, None, None, error)
            for k, (x, y) in enumerate(curve):
                yield (key[0], m, k, float(x), float(y), None)

    return map_groups(lines.select(scene, "ord", "x", "y"), [scene], ["ord"], work, f"{scene} string, method string, k long, x double, y double, error string")


def tally(lines: DataFrame, samples: int = 500, methods: tuple[str, ...] = tuple(METHODS), scene: str = "scene_id") -> DataFrame:
    """method, samples, errors over all lines: what :func:`compare` gives, worked out whole but counted in the kernel."""

    def work(key: tuple, c: dict[str, np.ndarray]):
        points = np.column_stack([c["x"], c["y"]])
        for m in methods:
            curve, error = _curve(m, points, samples)
            yield (m, len(curve), int(error is not None))

    each = map_groups(lines.select(scene, "ord", "x", "y"), [scene], ["ord"], work, "method string, samples long, errors long")
    return each.groupBy("method").agg(F.sum("samples").alias("samples"), F.sum("errors").alias("errors"))
