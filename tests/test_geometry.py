"""Golden values of the geometry columns, and properties of the kernels."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanewright.functions import geom, kernels, triangles
from lanewright.operators import roads
from lanewright.operators.config import CenterlineConfig, SceneConfig


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def pts(*points):
    return F.array(*(geom.point(x, y) for x, y in points))


def near(row, want):
    assert np.allclose([float(v) for v in row], want, atol=1e-10)


def test_distance_and_transforms(spark):
    p = geom.point(5, 10)
    assert value(spark, geom.distance(geom.point(0, 0), geom.point(3, 4))) == 5
    near(value(spark, geom.apply_affine(geom.identity(), p)), (5, 10))
    near(value(spark, geom.apply_affine(geom.translation(10, 20), geom.point(5, 5))), (15, 25))
    near(value(spark, geom.apply_affine(geom.scaling(2, 3), p)), (10, 30))
    made = geom.from_attributes(F.lit(10.0), F.lit(20.0), F.lit(0.5), F.lit(2.0), F.lit(3.0))
    by_parts = geom.compose(geom.compose(geom.translation(10, 20), geom.rotation(F.lit(0.5))), geom.scaling(2, 3))
    near(value(spark, made), value(spark, by_parts))


def test_vertex_lists(spark):
    assert len(value(spark, geom.parse_vertices(F.lit("1.5,2.5,0;3.0,4.0,0;5.5,6.5,0")))) == 3
    assert len(value(spark, geom.parse_vertices(F.lit("1.0,2.0;3.0,4.0")))) == 2
    assert value(spark, geom.parse_vertices(F.lit("1.0,x"))) is None
    assert value(spark, geom.parse_vertices(F.lit(""))) == []


def test_curves(spark):
    a, b, c, d = (geom.point(x, y) for x, y in ((0, 0), (1, 2), (3, 2), (4, 0)))
    near(value(spark, geom.cubic_bezier(a, b, c, d, F.lit(0.0))), (0, 0))
    near(value(spark, geom.cubic_bezier(a, b, c, d, F.lit(1.0))), (4, 0))
    curve = value(spark, geom.interpolate_curve(pts((0, 0), (10, 0), (20, 0)), pts((3, 1), (7, 1), (13, 1), (17, 1)), 5))
    assert len(curve) == 9 and curve[0].x == 0 and curve[8].x == 20
    assert len(value(spark, geom.interpolate_curve(pts((0, 0), (10, 0)), pts((5, 1)), 10))) == 10
    assert value(spark, geom.interpolate_curve(pts((0, 0), (10, 0)), pts((5, 1), (6, 1), (7, 1)), 10)) is None
    smooth = value(spark, geom.composite_bezier(pts((0, 0), (5, 5), (10, 0))))
    assert len(smooth) == 39 and (smooth[0].x, smooth[-1].x) == (0, 10) and math.isclose(smooth[19].x, 5)


def test_boxes_and_resampling(spark):
    near(value(spark, geom.bbox(pts((1, 2), (5, 8), (3, 4)))), (1, 2, 5, 8))
    empty = value(spark, geom.bbox(F.array().cast(f"array<{geom.POINT}>")))
    assert empty.xmin == math.inf and empty.ymax == -math.inf
    r = value(spark, geom.resample(pts((0, 0), (10, 0)), 2.0))
    assert len(r) >= 5 and r[0].x == 0 and r[-1].x == 10 and all(q.x - p.x <= 2 for p, q in itertools.pairwise(r))


def test_predicates(spark):
    eps = math.radians(15)
    assert value(spark, geom.are_parallel(F.lit(0.0), F.lit(0.0), eps)) and value(spark, geom.are_parallel(F.lit(0.0), F.lit(math.pi), eps))
    assert not value(spark, geom.are_parallel(F.lit(0.0), F.lit(math.pi / 2), eps))
    assert value(spark, geom.point_segment_distance(geom.point(5, 5), geom.point(0, 0), geom.point(10, 0))) == 5
    a, b, c, d = (geom.point(*p) for p in ((0, 0), (10, 10), (0, 10), (10, 0)))
    assert value(spark, geom.segments_cross(a, b, c, d)) and not value(spark, geom.segments_cross(a, d, c, b))


def test_oriented_boxes(spark):
    box = lambda x, y, t: F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("cx", "cy", "hw", "hh", "angle"), (x, y, 2, 1, t), strict=True)))
    assert value(spark, geom.boxes_touch(geom.turned_box(box(0, 0, 0)), geom.turned_box(box(4, 0, 0))))  # touching counts
    assert not value(spark, geom.boxes_touch(geom.turned_box(box(0, 0, 0)), geom.turned_box(box(4.01, 0, 0))))
    assert value(spark, geom.penetration(geom.turned_box(box(0, 0, 0)), geom.turned_box(box(3, 0, 0)))) == 1
    assert math.isclose(value(spark, geom.penetration(geom.turned_box(box(0, 0, 0)), geom.turned_box(box(0, 0, 0)))), 2 * math.sqrt(5))


def test_configurations():
    assert SceneConfig(bezier_samples=20, closure_threshold=0.5).bezier_samples == 20
    c = CenterlineConfig.for_profile("rs", min_width=8, max_width=36)
    assert (c.min_width, c.max_width, c.link_distance, c.strict_link) == (8, 36, 8.0, True)
    with pytest.raises(ValueError):
        SceneConfig(profile="other")


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(0, 1000)), min_size=3, max_size=12, unique=True))
def test_triangulation_has_empty_circles(points):
    p = np.array(points, float)
    for t in kernels.delaunay(p):
        a, b, c = p[t]
        if kernels._cross(a, b, c) < 0:
            b, c = c, b
        assert all(kernels._in_circle(a, b, c, q) <= 1e-3 for i, q in enumerate(p) if i not in t)


@pytest.mark.parametrize("noise", [0.0, 1e-9, 1e-3])
def test_triangulation_of_nearly_collinear_points(noise):
    """Rows of a road, almost straight: circles are empty and the triangles fill the hull."""
    rng = np.random.default_rng(17)
    x = np.repeat(np.arange(300.0), 3)
    p = np.column_stack([x, np.tile([0.0, 7.0, 14.0], 300) + rng.uniform(-noise, noise, 900)])
    tri = kernels.delaunay(p)
    a, b, c = (p[tri[:, i]] for i in range(3))
    area = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (c[:, 0] - a[:, 0]) * (b[:, 1] - a[:, 1])).sum() / 2
    assert area == pytest.approx(299 * 14, rel=1e-6 + noise / 7) and (noise or len(tri) == 299 * 4)
    for t in tri[:: 1 if noise else 7]:
        i, j, k = t if kernels._cross(*p[t]) > 0 else t[[0, 2, 1]]
        near = np.flatnonzero(np.abs(p[:, 0] - p[i, 0]) < 20)
        assert all(kernels._in_circle(p[i], p[j], p[k], p[q]) <= 0 for q in near if q not in t)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 50), st.floats(0, 50), st.floats(-3, 3)), min_size=2, max_size=6))
def test_exact_order_is_never_worse_than_tours(poses):
    steps = kernels.edge_scores(np.array(poses))
    order, least = kernels.cheapest_order(steps, steps)
    assert least <= kernels.cheapest_order(steps, steps, exact=1)[1] + 1e-9
    assert least == pytest.approx(sum(steps[a, b] for a, b in itertools.pairwise(order)))


def test_clothoids_reach_their_ends():
    assert kernels.clothoid((0, 0), 0, (10, 0), 0) == pytest.approx((0, 0, 10))
    assert kernels.clothoid((0, 0), 0, (1, 1), math.pi / 2)[2] == pytest.approx(math.pi / 2)
    rng = np.random.default_rng(5)
    for _ in range(50):
        p, q, (a, b) = rng.random(2) * 9, rng.random(2) * 9 + 10, rng.uniform(-3, 3, 2)
        shape = kernels.clothoid(p, a, q, b)
        x, y, t = kernels.clothoid_points(p, a, shape, np.array([shape[2] / 2, shape[2]]))[-1]
        assert math.dist((x, y), q) < 1e-6 and abs(kernels._wrap(t - b)) < 1e-6


def test_splines():
    t = np.arange(6.0)
    line = np.column_stack([2 * t, 1 - t])
    for ends in ("natural", "not-a-knot"):
        assert np.allclose(kernels.cubic_spline(t, line, t + 0.25, ends), np.column_stack([2 * (t + 0.25), 1 - t - 0.25]))
    assert np.allclose(kernels.cubic_spline(t, t**3, t + 0.5, "not-a-knot")[:5, 0], (t[:5] + 0.5) ** 3)
    with pytest.raises(ValueError):
        kernels.cubic_spline([0, 0, 1], [1, 2, 3], [0.5])
    assert len(kernels.sliding_path([[0, 0, 0], [1, 0, 0]])) > 0 and kernels.driving_path([[0, 0, 0]]).shape == (0, 4)


def test_walks():
    p = np.column_stack([np.arange(0, 12, 0.5), np.zeros(24)])
    links = [(i, j) for i in range(24) for j in range(i + 1, 24) if p[j, 0] - p[i, 0] <= 2]
    assert kernels.connect(p, links, math.radians(15), 10.0) == [list(range(24))]
    assert kernels.connect(p[:1], [], 0.2, 10.0) == []
    assert np.array_equal(kernels.clean_ends(p[:4]), p[:4])


def test_triangles_of_many_groups_are_those_of_each():
    """Small groups are triangulated together; equal points, lines and circles among them are left to the kernel."""
    random = np.random.default_rng(5)
    parts = [random.random((n, 2)) * 50 for n in (1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 30)] * 3
    parts += [random.integers(0, 3, (n, 2)).astype(float) for n in (3, 4, 5, 6, 7, 8)] * 10
    group = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    both = np.vstack(parts)
    starts = np.cumsum([0, *map(len, parts)])
    want = np.vstack([kernels.delaunay(p) + at for p, at in zip(parts, starts, strict=False)])
    assert np.array_equal(triangles.triangulated(group, both[:, 0], both[:, 1]), want)


def test_long_roadways_meet_by_cells_as_by_all_pairs(monkeypatch):
    """Two roadways of some hundred points: what cells find is what all pairs find, for judged, shown and linked triangles."""
    k = np.arange(300.0)
    x, y = np.concatenate([k, k]), np.concatenate([np.sin(k / 20) * 9, np.sin(k / 20) * 9 + 7 + np.cos(k)])
    road, group = np.repeat([0, 1], 300), np.zeros(600, int)
    config = CenterlineConfig()

    def found():
        e = triangles.edges_of(group, road, x, y)
        tri = triangles.judge(group, x, y, road, e, config)
        return tri.rejected, tri.parallel, *triangles.shown(tri, config), *triangles.linked(tri, x, y, road, e, config)

    by_cells = found()
    monkeypatch.setattr(triangles, "LONG", 10_000)
    assert all(np.array_equal(a, b) for a, b in zip(by_cells, found(), strict=True))
    assert by_cells[1].any() and len(by_cells[5])


def test_roads_are_judged_by_one_shuffle_of_their_points(spark):
    """What triangles are compared with comes with them: one exchange of the points, no joins, nothing written."""
    points = spark.range(60).select(F.floor(F.col("id") / 20).alias("scene_id"), (F.col("id") % 20).alias("v"), (F.col("id") * 7 % 19).cast("double").alias("x"), (F.col("id") * 5 % 17).cast("double").alias("y"), (F.col("id") % 3).alias("roadway"))
    for found in (roads.judged_triangles, roads.display_edges, roads.skeleton):
        plan = found(points, None, CenterlineConfig(min_width=1.0), "long")._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("RepartitionByExpression") == 1


@pytest.mark.parametrize("how", [{}, {"millis": True}, {"cone": False, "fixed_back": True}])
def test_walks_that_ask_for_neighbours_are_those_over_all_links(how):
    """Points on a coarse grid and at random, so that many are as far: links of all pairs give the same walks."""
    random = np.random.default_rng(3)
    p = np.vstack([random.integers(0, 12, (150, 2)).astype(float), random.random((200, 2)) * 40])
    for strict, radius in ((False, 5.0), (True, 2.0)):
        near = lambda d: d < radius if strict else d <= radius
        links = [(i, j) for i, j in itertools.combinations(range(len(p)), 2) if near(math.sqrt(((p[j] - p[i]) ** 2).sum()))]
        want = kernels.connect(p, links, math.radians(50), radius, 1.0, 9.0, **how)
        assert want == kernels.connect(p, kernels.Around(p, radius, strict), math.radians(50), radius, 1.0, 9.0, **how)


def test_walks_list_no_pairs(spark):
    """Scenes of many points near one another would have all their pairs as rows."""
    mids = spark.range(30).select((F.col("id") % 2).cast("string").alias("scene_id"), F.col("id").alias("i"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"))
    assert "Join" not in roads.connect_midpoints(mids, CenterlineConfig())._jdf.queryExecution().optimizedPlan().toString()


def test_segments_are_counted_as_they_are_fitted():
    """Groups of poses at a time, with places that follow themselves: as the paths' own points, a group at a time."""
    random = np.random.default_rng(9)
    parts = [np.column_stack([random.random((n, 2)) * 60, random.random(n) * 6 - 3]) for n in (1, 2, 3, 5, 10, 10, 10)] * 4
    parts.append(np.array([[0, 0, 0.1], [0, 0, 0.2], [5, 0, 0.0], [9, 9, 3.0]]))
    group = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    found = kernels.hybrid_sizes(group, np.vstack(parts))
    got = sorted(zip(group[found[0]].tolist(), *(v.tolist() for v in found[1:3]), np.where(found[3], "normal", "post").tolist(), found[4].tolist(), strict=True))
    assert got == sorted((g, a, b, phase, len(path)) for g, p in enumerate(parts) for a, b, phase, path in kernels.hybrid_path(p))


def test_slides_stand_still():
    """Poses that follow themselves at one place take no time and stop nothing, wherever they are in a slide."""
    moving = np.array([[0, 0, 0.1], [9, 1, 0.5], [5, 8, 2.0], [9, 9, 3.0], [2, 4, 1.0]])
    want = kernels.sliding_path(moving)
    for k in range(len(moving)):
        still = np.insert(moving, k, moving[k] + [0, 0, 0.2], axis=0)
        assert np.allclose(kernels.sliding_path(still), want)
    assert kernels.sliding_path(moving[[0, 0, 0, 0]]).shape == (0, 4)
    parts = [np.vstack([[[-30, 0, 2.5]], moving[[0, 1, 1, 2, 3, 3, 4]]]), moving[[0, 0, 0, 0, 0]], moving[[0, 1, 1, 1]]]
    group = np.repeat(np.arange(3), [len(p) for p in parts])
    found = kernels.hybrid_sizes(group, np.vstack(parts))
    got = sorted(zip(group[found[0]].tolist(), *(v.tolist() for v in found[1:3]), np.where(found[3], "normal", "post").tolist(), found[4].tolist(), strict=True))
    assert got == sorted((g, a, b, phase, len(path)) for g, p in enumerate(parts) for a, b, phase, path in kernels.hybrid_path(p))


def test_clothoids_of_many_pairs_are_those_of_each():
    random = np.random.default_rng(2)
    p, q = random.random((60, 2)) * 50, random.random((60, 2)) * 50
    q[:3] = p[:3]
    s, t = random.random(60) * 6 - 3, random.random(60) * 6 - 3
    for row, a, b, c, d in zip(kernels.clothoids(p, s, q, t, most=7), p, s, q, t, strict=True):
        want = kernels.clothoid(a, b, c, d)
        assert np.isnan(row[2]) if want is None else np.allclose(row, want, rtol=1e-9, atol=1e-12)
