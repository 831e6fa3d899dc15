"""Scores that round as the C library's functions decide."""

from __future__ import annotations

import math

import pandas as pd

from lanewright.plans import polylines


def test_scores_of_close_steps():
    step = (1.25, 3.0, 0.4, 2.5, 7.0, -2.9)
    found = polylines._c_scores.func(*(pd.Series([v, None], dtype=float) for v in step))
    x, y, t, u, v, w = step
    d, turn = math.sqrt((u - x) ** 2 + (v - y) ** 2), math.atan2(math.sin(w - t), math.cos(w - t))
    assert found[1] is None and found[0][1] == math.sqrt(d * d + 4 * turn * turn) and found[0][3] == turn / d
