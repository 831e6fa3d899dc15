"""Planar geometry as column expressions: points are struct<x,y>, polylines arrays of points in order.

Everything here stays in the JVM and takes columns (or names) and returns columns. ANSI mode is on, so divisions that
may meet a zero are guarded. Empty polylines have no box, mean or length 0; null in, null out.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str
POINT = "struct<x:double,y:double>"
AFFINE = "struct<a:double,b:double,tx:double,c:double,d:double,ty:double>"


def _c(x: ColumnLike | float | int) -> Column:
    return F.lit(float(x)) if isinstance(x, (int, float)) else F.col(x) if isinstance(x, str) else x


def point(x: ColumnLike | float, y: ColumnLike | float) -> Column:
    return F.struct(_c(x).alias("x"), _c(y).alias("y"))


def distance(p: ColumnLike, q: ColumnLike) -> Column:
    p, q = _c(p), _c(q)
    return length_of(q["x"] - p["x"], q["y"] - p["y"])


def length_of(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def wrap_angle(a: Column) -> Column:
    """An angle in (-pi, pi]."""
    return F.atan2(F.sin(a), F.cos(a))


def angle_difference(a: ColumnLike, b: ColumnLike) -> Column:
    return wrap_angle(_c(a) - _c(b))


def edge_angle(p: ColumnLike, q: ColumnLike) -> Column:
    p, q = _c(p), _c(q)
    return F.atan2(q["y"] - p["y"], q["x"] - p["x"])


def are_parallel(a: ColumnLike, b: ColumnLike, epsilon: float) -> Column:
    """Within ``epsilon`` radians of the same or the opposite direction."""
    d = F.abs(angle_difference(a, b))
    return (d < epsilon) | (d > math.pi - epsilon)


def point_segment_distance(p: ColumnLike, a: ColumnLike, b: ColumnLike) -> Column:
    """Distance of p from the segment a-b; from a where the segment has no length."""
    p, a, b = _c(p), _c(a), _c(b)
    dx, dy = b["x"] - a["x"], b["y"] - a["y"]
    square = dx * dx + dy * dy
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.when(square < 1e-12, 1.0).otherwise(square)))
    t = F.when(square < 1e-12, 0.0).otherwise(t)
    return length_of(p["x"] - (a["x"] + t * dx), p["y"] - (a["y"] + t * dy))


def turns_left(a: Column, b: Column, c: Column) -> Column:
    return (c["y"] - a["y"]) * (b["x"] - a["x"]) > (b["y"] - a["y"]) * (c["x"] - a["x"])


def segments_cross(a: ColumnLike, b: ColumnLike, c: ColumnLike, d: ColumnLike) -> Column:
    """Proper crossing by orientation; touching in line is not guaranteed to count."""
    a, b, c, d = map(_c, (a, b, c, d))
    return (turns_left(a, c, d) != turns_left(b, c, d)) & (turns_left(a, b, c) != turns_left(a, b, d))


# Affine transforms: the first two rows of a 3 x 3 matrix.


def affine(a, b, tx, c, d, ty) -> Column:  # noqa: ANN001
    return F.struct(*(_c(v).alias(k) for k, v in zip(("a", "b", "tx", "c", "d", "ty"), (a, b, tx, c, d, ty), strict=True)))


def identity() -> Column:
    return affine(1, 0, 0, 0, 1, 0)


def translation(tx: ColumnLike | float, ty: ColumnLike | float) -> Column:
    return affine(1, 0, tx, 0, 1, ty)


def rotation(angle: ColumnLike) -> Column:
    r = _c(angle)
    return affine(F.cos(r), -F.sin(r), 0, F.sin(r), F.cos(r), 0)


def scaling(sx: ColumnLike | float, sy: ColumnLike | float) -> Column:
    return affine(sx, 0, 0, 0, sy, 0)


def from_attributes(tx: ColumnLike, ty: ColumnLike, angle: ColumnLike, sx: ColumnLike, sy: ColumnLike) -> Column:
    """Scale, then rotate, then translate."""
    r, sx, sy = _c(angle), _c(sx), _c(sy)
    return affine(F.cos(r) * sx, -F.sin(r) * sy, tx, F.sin(r) * sx, F.cos(r) * sy, ty)


def compose(m: ColumnLike, n: ColumnLike) -> Column:
    """The product m n: n is applied first."""
    m, n = _c(m), _c(n)
    return affine(
        m["a"] * n["a"] + m["b"] * n["c"], m["a"] * n["b"] + m["b"] * n["d"], m["a"] * n["tx"] + m["b"] * n["ty"] + m["tx"],
        m["c"] * n["a"] + m["d"] * n["c"], m["c"] * n["b"] + m["d"] * n["d"], m["c"] * n["tx"] + m["d"] * n["ty"] + m["ty"],
    )


def apply_affine(m: ColumnLike, p: ColumnLike) -> Column:
    m, p = _c(m), _c(p)
    return point(m["a"] * p["x"] + m["b"] * p["y"] + m["tx"], m["c"] * p["x"] + m["d"] * p["y"] + m["ty"])


def apply_affine_all(m: ColumnLike, verts: ColumnLike) -> Column:
    m = _c(m)
    return F.transform(_c(verts), lambda p: apply_affine(m, p))


def heading(m: ColumnLike) -> Column:
    """Rotation of a transform after its x scale is removed; null where that scale is 0."""
    m = _c(m)
    scale = length_of(m["a"], m["c"])
    return F.when(scale > 0, F.atan2(m["c"], m["a"]))


# Boxes.


def bbox(verts: ColumnLike) -> Column:
    """xmin, ymin, xmax, ymax of the vertices; of none the empty box, whose minima are +inf and maxima -inf."""
    verts = _c(verts)
    inf = F.lit(math.inf)
    low = lambda k: F.coalesce(F.array_min(F.transform(verts, lambda p: p[k])), inf)
    high = lambda k: F.coalesce(F.array_max(F.transform(verts, lambda p: p[k])), -inf)
    return F.struct(low("x").alias("xmin"), low("y").alias("ymin"), high("x").alias("xmax"), high("y").alias("ymax"))


def bbox_union(a: ColumnLike, b: ColumnLike) -> Column:
    a, b = _c(a), _c(b)
    return F.struct(*(f(a[k], b[k]).alias(k) for f, k in ((F.least, "xmin"), (F.least, "ymin"), (F.greatest, "xmax"), (F.greatest, "ymax"))))


def bbox_is_valid(b: ColumnLike) -> Column:
    b = _c(b)
    return (b["xmin"] <= b["xmax"]) & (b["ymin"] <= b["ymax"])


def bbox_center(b: ColumnLike) -> Column:
    b = _c(b)
    return point((b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2)


def bbox_diagonal(b: ColumnLike) -> Column:
    b = _c(b)
    return length_of(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])


def mean_point(verts: ColumnLike) -> Column:
    """Arithmetic mean of the vertices; null for none."""
    verts = _c(verts)
    mean = lambda k: F.aggregate(verts, F.lit(0.0), lambda s, p: s + p[k]) / F.size(verts)
    return F.when(F.size(verts) > 0, point(mean("x"), mean("y")))


# Polylines.


def parse_vertices(text: ColumnLike) -> Column:
    """``x,y[,z];...`` as points; a token that is no pair of numbers makes the whole null."""
    tokens = F.filter(F.split(_c(text), ";"), lambda v: v != "")
    number = lambda v, i: F.get(F.split(v, ","), F.lit(i)).try_cast("double")
    points = F.transform(tokens, lambda v: point(number(v, 0), number(v, 1)))
    return F.when(~F.exists(points, lambda p: p["x"].isNull() | p["y"].isNull()), points)


def format_vertices(verts: ColumnLike) -> Column:
    return F.array_join(F.transform(_c(verts), lambda p: F.concat_ws(",", p["x"], p["y"])), ";")


def pairs(verts: ColumnLike) -> Column:
    """Consecutive points as struct<p,q>."""
    verts = _c(verts)
    n = F.greatest(F.size(verts) - 1, F.lit(0))
    return F.transform(F.slice(verts, F.lit(1), n), lambda p, i: F.struct(p.alias("p"), F.get(verts, i + 1).alias("q")))


def total_length(verts: ColumnLike) -> Column:
    return F.aggregate(pairs(verts), F.lit(0.0), lambda s, e: s + distance(e["p"], e["q"]))


def cubic_bezier(p0: ColumnLike, c1: ColumnLike, c2: ColumnLike, p1: ColumnLike, t: ColumnLike) -> Column:
    p0, c1, c2, p1, t = map(_c, (p0, c1, c2, p1, t))
    u = 1 - t
    at = lambda k: u * u * u * p0[k] + 3 * u * u * t * c1[k] + 3 * u * t * t * c2[k] + t * t * t * p1[k]
    return point(at("x"), at("y"))


def quadratic_bezier(p0: ColumnLike, c: ColumnLike, p1: ColumnLike, t: ColumnLike) -> Column:
    p0, c, p1, t = map(_c, (p0, c, p1, t))
    u = 1 - t
    at = lambda k: u * u * p0[k] + 2 * u * t * c[k] + t * t * p1[k]
    return point(at("x"), at("y"))


def interpolate_curve(anchors: ColumnLike, controls: ColumnLike, n: int = 10) -> Column:
    """Cubic pieces for two controls a segment, quadratic for one, else null; ``n`` points a piece, joints once."""
    anchors, controls = _c(anchors), _c(controls)
    segments = F.size(anchors) - 1

    def pieces(per: int):
        def piece(i: Column) -> Column:
            steps = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (i == 0) | (j > 0))
            p, q = F.get(anchors, i), F.get(anchors, i + 1)
            c = [F.get(controls, i * per + k) for k in range(per)]
            return F.transform(steps, lambda j: (cubic_bezier if per == 2 else quadratic_bezier)(p, *c, q, j.cast("double") / (n - 1)))

        return F.flatten(F.transform(F.sequence(F.lit(0), segments - 1), piece))

    return F.when(segments < 1, F.lit(None)).when(F.size(controls) == 2 * segments, pieces(2)).when(F.size(controls) == segments, pieces(1))


def composite_bezier(pts: ColumnLike, tension: float = 0.33, n: int = 20) -> Column:
    """A smooth curve through the points: handles along differences of neighbours; ``n`` points a segment.

    Built in three passes over the segments, so that each expression stays small. Null for fewer than two points.
    """
    pts = _c(pts)
    last = F.size(pts) - 1

    def tangent(i: Column) -> Column:
        a, b = F.get(pts, F.greatest(i - 1, F.lit(0))), F.get(pts, F.least(i + 1, last))
        return point(b["x"] - a["x"], b["y"] - a["y"])

    def ends(i: Column) -> Column:
        p, q = F.get(pts, i), F.get(pts, i + 1)
        return F.struct(i.alias("i"), p.alias("p"), q.alias("q"), tangent(i).alias("t0"), tangent(i + 1).alias("t1"), (distance(p, q) * tension).alias("h"))

    def handles(e: Column) -> Column:
        k0, k1 = (e["h"] / F.greatest(length_of(e[t]["x"] + 1e-12, e[t]["y"] + 1e-12), F.lit(1e-300)) for t in ("t0", "t1"))
        c1 = point(e["p"]["x"] + e["t0"]["x"] * k0, e["p"]["y"] + e["t0"]["y"] * k0)
        c2 = point(e["q"]["x"] - e["t1"]["x"] * k1, e["q"]["y"] - e["t1"]["y"] * k1)
        return F.struct(e["i"].alias("i"), e["p"].alias("p"), c1.alias("c1"), c2.alias("c2"), e["q"].alias("q"))

    def samples(h: Column) -> Column:
        steps = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: (h["i"] == 0) | (j > 0))
        return F.transform(steps, lambda j: cubic_bezier(h["p"], h["c1"], h["c2"], h["q"], j.cast("double") / (n - 1)))

    segments = F.transform(F.transform(F.sequence(F.lit(0), last - 1), ends), handles)
    return F.when(last >= 1, F.flatten(F.transform(segments, samples)))


def resample(verts: ColumnLike, step: float) -> Column:
    """Points at most ``step`` apart: longer edges are cut into equal parts, shorter ones keep their end."""
    verts = _c(verts)

    def counted(e: Column) -> Column:
        return F.struct(e["p"].alias("p"), e["q"].alias("q"), F.greatest(F.lit(1), F.ceil(distance(e["p"], e["q"]) / step).cast("int")).alias("n"))

    def parts(e: Column) -> Column:
        n = e["n"]
        lerp = lambda k, j: F.when(j == n, e["q"][k]).otherwise(e["p"][k] + (e["q"][k] - e["p"][k]) * j / n)
        return F.transform(F.sequence(F.lit(1), n), lambda j: point(lerp("x", j), lerp("y", j)))

    cut = F.flatten(F.transform(F.transform(pairs(verts), counted), parts))
    return F.when(F.size(verts) < 2, verts).otherwise(F.concat(F.slice(verts, 1, 1), cut))


def mean_curvature(verts: ColumnLike) -> Column:
    """Mean of the wrapped turn over the mean length of the two edges, in degrees; 0 for fewer than three points."""
    edges = F.transform(pairs(verts), lambda e: F.struct(edge_angle(e["p"], e["q"]).alias("angle"), distance(e["p"], e["q"]).alias("length")))
    n = F.size(edges) - 1
    turns = F.transform(
        F.slice(edges, F.lit(1), F.greatest(n, F.lit(0))),
        lambda e, i: F.struct(F.abs(wrap_angle(F.get(edges, i + 1)["angle"] - e["angle"])).alias("turn"), ((e["length"] + F.get(edges, i + 1)["length"]) / 2).alias("along")),
    )
    total = F.aggregate(turns, F.lit(0.0), lambda s, t: s + F.when(t["along"] > 0, t["turn"] / t["along"]).otherwise(0.0))
    return F.when(n < 1, 0.0).otherwise(F.degrees(total / n))


def close_ring(verts: ColumnLike, closed: ColumnLike) -> Column:
    """Append the first vertex to closed lines that do not end with it."""
    verts = _c(verts)
    first, last = F.get(verts, F.lit(0)), F.get(verts, F.size(verts) - 1)
    return F.when(_c(closed) & (F.size(verts) > 0) & (first != last), F.concat(verts, F.array(first))).otherwise(verts)


def nearly_closed(verts: ColumnLike, threshold: float = 0.25, by_diagonal: bool = False) -> Column:
    """Whether the gap between the ends is below ``threshold`` times the larger side (or the diagonal) of the box."""
    verts = _c(verts)
    b = bbox(verts)
    extent = bbox_diagonal(b) if by_diagonal else F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])
    return (F.size(verts) > 0) & (distance(F.get(verts, F.lit(0)), F.get(verts, F.size(verts) - 1)) < threshold * extent)


# Oriented boxes: struct<cx,cy,hw,hh,angle>.


def oriented_box(transform: ColumnLike, box: ColumnLike, center: ColumnLike) -> Column:
    m, b, c = _c(transform), _c(box), _c(center)
    sx, sy = length_of(m["a"], m["c"]), length_of(m["b"], m["d"])
    return F.struct(
        c["x"].alias("cx"), c["y"].alias("cy"), ((b["xmax"] - b["xmin"]) / 2 * sx).alias("hw"), ((b["ymax"] - b["ymin"]) / 2 * sy).alias("hh"), heading(m).alias("angle"),
    )


def box_corners(o: ColumnLike) -> Column:
    """The four corners, counter-clockwise from the lower left of the box's own frame."""
    o = _c(o)
    c, s = F.cos(o["angle"]), F.sin(o["angle"])
    corner = lambda i, j: point(o["cx"] + i * o["hw"] * c - j * o["hh"] * s, o["cy"] + i * o["hw"] * s + j * o["hh"] * c)
    return F.array(*(corner(i, j) for i, j in ((-1, -1), (1, -1), (1, 1), (-1, 1))))


def turned_box(o: ColumnLike) -> Column:
    """The box with the cosine and sine of its angle and half the width and height of its upright bounds: worked out
    once a box, for the tests of pairs below."""
    o = _c(o)
    c, s = F.cos(o["angle"]), F.sin(o["angle"])
    ex, ey = F.abs(c) * o["hw"] + F.abs(s) * o["hh"], F.abs(s) * o["hw"] + F.abs(c) * o["hh"]
    return F.struct(*(o[k].alias(k) for k in ("cx", "cy", "hw", "hh")), c.alias("c"), s.alias("s"), ex.alias("ex"), ey.alias("ey"))


def box_extent(o: ColumnLike, ax: Column, ay: Column) -> Column:
    """Half the length of a turned box's shadow on a unit axis."""
    o = _c(o)
    return F.abs(o["c"] * ax + o["s"] * ay) * o["hw"] + F.abs(o["c"] * ay - o["s"] * ax) * o["hh"]


def boxes_touch(p: ColumnLike, q: ColumnLike) -> Column:
    """Separating axes of turned boxes: on each of the four, the centres are no further apart than the shadows reach."""
    p, q = _c(p), _c(q)
    dx, dy = q["cx"] - p["cx"], q["cy"] - p["cy"]
    out = F.lit(True)
    for o in (p, q):
        for ax, ay in ((o["c"], o["s"]), (-o["s"], o["c"])):
            out = out & ~(F.abs(dx * ax + dy * ay) > box_extent(p, ax, ay) + box_extent(q, ax, ay))
    return out


def penetration(p: ColumnLike, q: ColumnLike) -> Column:
    """Overlap of turned boxes' shadows on the axis between the centres, at least 0; of concentric ones both half
    diagonals."""
    p, q = _c(p), _c(q)
    dx, dy = q["cx"] - p["cx"], q["cy"] - p["cy"]
    d = length_of(dx, dy)
    safe = F.when(d < 1e-6, 1.0).otherwise(d)
    overlap = box_extent(p, dx / safe, dy / safe) + box_extent(q, dx / safe, dy / safe) - d
    return F.when(d < 1e-6, length_of(p["hw"], p["hh"]) + length_of(q["hw"], q["hh"])).otherwise(F.greatest(F.lit(0.0), overlap))


# Poses: struct<x,y,theta>.


def slip_metrics(p: ColumnLike, q: ColumnLike) -> Column:
    """slip_angle, yaw_rate, path_curvature, heading_curvature, curvature_mismatch between two poses.

    The three curvatures are one expression, so the mismatch is always 0; poses closer than 1e-6 give zeros.
    """
    p, q = _c(p), _c(q)
    dx, dy = q["x"] - p["x"], q["y"] - p["y"]
    d = length_of(dx, dy)
    still = d < 1e-6
    slip = F.when(still, 0.0).otherwise(angle_difference(p["theta"], F.atan2(dy, dx)))
    yaw = F.when(still, 0.0).otherwise(angle_difference(q["theta"], p["theta"]) / F.when(still, 1.0).otherwise(d))
    return F.struct(slip.alias("slip_angle"), yaw.alias("yaw_rate"), yaw.alias("path_curvature"), yaw.alias("heading_curvature"), F.lit(0.0).alias("curvature_mismatch"))


def motion_phase(p: ColumnLike, q: ColumnLike, collided: Column | None = None, slip_limit: float = math.pi / 6, yaw_limit: float = 0.5) -> Column:
    m = slip_metrics(p, q)
    lost = (F.abs(m["slip_angle"]) > slip_limit) | (F.abs(m["yaw_rate"]) > yaw_limit)
    phase = F.when(lost, "loc").otherwise("normal")
    return phase if collided is None else F.when(collided, "post").otherwise(phase)


def freebody_score(p: ColumnLike, q: ColumnLike) -> Column:
    p, q = _c(p), _c(q)
    turn = 2.0 * F.abs(angle_difference(q["theta"], p["theta"]))
    d = distance(p, q)
    return F.sqrt(d * d + turn * turn)


def edge_score(p: ColumnLike, q: ColumnLike, distance_weight: float = 1.0, angle_weight: float = 0.5) -> Column:
    """Cost of going from one pose to the next: length, misalignment with the motion, and turning."""
    p, q = _c(p), _c(q)
    d = distance(p, q)
    align = F.abs(angle_difference(edge_angle(p, q), p["theta"])) / math.pi
    turn = F.abs(angle_difference(q["theta"], p["theta"])) / math.pi
    return d * (distance_weight + angle_weight * align + 0.5 * angle_weight * turn)


def bezier_handles(p: ColumnLike, theta_p: ColumnLike, q: ColumnLike, theta_q: ColumnLike, factor: float | Column = 0.4) -> Column:
    """The handles of a cubic from one lane end to another: back from the outward headings by ``factor`` of the gap."""
    p, q, a, b = map(_c, (p, q, theta_p, theta_q))
    d = distance(p, q) * factor
    return F.struct(point(p["x"] - d * F.cos(a), p["y"] - d * F.sin(a)).alias("c1"), point(q["x"] + d * F.cos(b), q["y"] + d * F.sin(b)).alias("c2"))


def bezier_between(p: ColumnLike, theta_p: ColumnLike, q: ColumnLike, theta_q: ColumnLike, factor: float | Column = 0.4, n: int = 50) -> Column:
    """A cubic from one lane end to another, as ``n`` points."""
    h = bezier_handles(p, theta_p, q, theta_q, factor)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: cubic_bezier(p, h["c1"], h["c2"], q, i.cast("double") / (n - 1)))


def end_heading(verts: ColumnLike, at_start: bool) -> Column:
    """The outward direction at an end of a polyline; 0 for fewer than two points."""
    verts = _c(verts)
    n = F.size(verts)
    p, q = (F.get(verts, F.lit(1)), F.get(verts, F.lit(0))) if at_start else (F.get(verts, n - 2), F.get(verts, n - 1))
    return F.when(n < 2, 0.0).otherwise(edge_angle(p, q))


def perpendicular_width(v: list[Column], roadway: list[Column]) -> Column:
    """Of a triangle: the distance of the vertex opposite the first edge that lies on one roadway, else the least altitude."""
    height = [point_segment_distance(v[(j + 2) % 3], v[j], v[(j + 1) % 3]) for j in range(3)]
    out = F.least(*height)
    for j in (2, 1, 0):
        out = F.when(roadway[j] == roadway[(j + 1) % 3], height[j]).otherwise(out)
    return out


# Similarity.


def cosine(a: ColumnLike, b: ColumnLike) -> Column:
    """Cosine of two numeric arrays; null where one has no length."""
    a, b = _c(a), _c(b)
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def patch_of(x: ColumnLike, y: ColumnLike, scale: float, columns: int, rows: int) -> Column:
    """The number of the image patch that holds a pixel; null outside the image."""
    px, py = F.floor(_c(x) * scale), F.floor(_c(y) * scale)
    return F.when(px.between(0, columns - 1) & py.between(0, rows - 1), (py * columns + px).cast("long"))
