"""The spline lab: every method passes through its points, and failures are rows."""

from __future__ import annotations

import numpy as np
import pytest

from lanewright.operators import splines

POINTS = np.array([[0, 0], [1, 2], [3, 3], [4, 1], [6, 0], [7, 2.0]])


@pytest.mark.parametrize("method", sorted(splines.METHODS))
def test_methods_interpolate(method):
    curve = splines.METHODS[method](POINTS, 400)
    gap = np.linalg.norm(curve[:, None] - POINTS[None], axis=2).min(0)
    assert gap.max() < 0.05 and np.allclose(curve[[0, -1]], POINTS[[0, -1]])


def test_pieces():
    t = np.arange(6.0)
    assert np.allclose(splines.b_spline(t, POINTS, t), POINTS) and np.allclose(splines.akima(t, POINTS, t, True), POINTS)
    rising = splines.pchip(t, np.array([[0.0], [0], [1], [1], [5], [6]]), np.linspace(0, 5, 99))
    assert (np.diff(rising[:, 0]) >= -1e-12).all()
    assert splines.parameters(POINTS, "chord")[-1] == 1 and np.allclose(splines.parameters(POINTS, "uniform"), t / 5)


def test_compare_reports_failures(spark):
    rows = [("a", i, float(x), float(y)) for i, (x, y) in enumerate(POINTS)] + [("b", 0, 1.0, 1.0)]
    found = splines.compare(spark.createDataFrame(rows, "scene_id string, ord long, x double, y double"), 40, ("natural", "pchip")).collect()
    assert {(r.scene_id, r.error is None) for r in found} == {("a", True), ("b", False)}


def test_tally_counts_what_compare_gives(spark):
    from pyspark.sql import functions as F

    lines = spark.createDataFrame([("a", k, float(k), float(k * k % 5)) for k in range(6)] + [("b", 0, 1.0, 2.0)], "scene_id string, ord long, x double, y double")
    found = splines.compare(lines, 50).groupBy("method").agg(F.count("x"), F.count("error"))
    assert sorted(splines.tally(lines, 50).collect()) == sorted(found.collect()) and any(r.errors for r in splines.tally(lines, 50).collect())
