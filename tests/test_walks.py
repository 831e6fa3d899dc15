"""Walks over midpoints: in few and in crowded cells, and with the midpoints' places in place of their numbers."""

from __future__ import annotations

import itertools
import math

import numpy as np

from lanewright.functions import kernels
from lanewright.operators import roads
from lanewright.operators.config import CenterlineConfig


def test_walks_by_cells_are_those_over_all_links(monkeypatch):
    points = np.random.default_rng(3).random((300, 2)) * 25
    links = [(i, j) for i, j in itertools.combinations(range(len(points)), 2) if math.dist(points[i], points[j]) <= 6]
    expected = kernels.connect(points, links, math.radians(50), 6.0, 5.0, 10.0)
    for few in (0, 48, 1000):
        monkeypatch.setattr(kernels, "FEW_AROUND", few)
        assert kernels.connect(points, kernels.Around(points, 6.0), math.radians(50), 6.0, 5.0, 10.0) == expected


def test_walks_carry_places(spark):
    rows = [("a", i, float(i), float(i % 2) / 4, 2.0 + i) for i in range(12)] + [("b", i, 3.0 * i, 0.0, 1.0) for i in range(6)]
    mids = spark.createDataFrame(rows, "scene_id string, i long, x double, y double, width double")
    config = CenterlineConfig(max_mean_step=10.0, link_degrees=60.0)
    expected = roads.connect_midpoints(mids, config).join(mids, ["scene_id", "i"]).drop("i")
    found = roads.connect_midpoints(mids, config, places=True)
    assert found.columns == expected.columns and sorted(found.collect()) == sorted(expected.collect()) != []
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
