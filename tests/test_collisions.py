"""Collisions that are found without their pairs leaving the kernel, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewright.functions import kernels
from lanewright.operators import trajectories


@pytest.fixture(scope="module")
def boxes(spark):
    """Three scenes of crowded boxes, one of them far longer than the rest, and one box without a place."""
    k = F.col("id")
    box = F.struct(
        (k * 7 % 31).cast("double").alias("cx"), F.when(k == 50, float("nan")).otherwise(k * 11 % 17).cast("double").alias("cy"),
        F.when(k == 40, 30.0).otherwise(1.0 + k % 3).alias("hw"), F.lit(0.75).alias("hh"), (k * 5 % 628 / 100).alias("angle"),
    )
    return spark.range(180).select((k % 3).alias("scene_id"), F.floor(k / 3 % 4).alias("label"), F.floor(k / 12).alias("pos"), box.alias("box"))


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_first_of_each_vehicle(boxes):
    lengths = boxes.groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n"))
    assert rows(trajectories.first_of_vehicles(boxes)) == rows(trajectories.first_collision_per_vehicle(trajectories.collisions(boxes), lengths))


def test_first_of_each_scene(boxes):
    lengths = boxes.groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n"))
    assert rows(trajectories.first_of_scenes(boxes)) == rows(trajectories.first_collision(trajectories.collisions(boxes), lengths))


def test_hits_are_counted_where_they_are_found(boxes):
    want = trajectories.collision_indices(trajectories.collisions(boxes)).select("scene_id", "label", F.array_join(F.col("hits").cast("array<string>"), ","), "first")
    assert rows(trajectories.hit_texts(trajectories.collision_counts(boxes))) == rows(want)


def crowd(n: int, groups: int, angles: int, size: float = 1.0, place: float = 0.0):
    """Boxes at few places, in rows of groups and lower sides; with one angle many of them touch exactly."""
    k = np.arange(n)
    b = {"cx": k * 7 % 10 * size + place, "cy": k * 11 % 23 * size, "hw": (2.0 + k % 3) * size, "hh": np.full(n, 1.5) * size}
    angle = k * 5 % 628 / 100 if angles > 1 else np.zeros(n)
    b["c"], b["s"] = np.cos(angle), np.sin(angle)
    for axis, one, two in (("x", "c", "s"), ("y", "s", "c")):
        reach = np.abs(b[one]) * b["hw"] + np.abs(b[two]) * b["hh"]
        b[f"{axis}0"], b[f"{axis}1"] = b[f"c{axis}"] - reach, b[f"c{axis}"] + reach
    group = k * groups // n
    order = np.lexsort((b["y0"], group))
    return group[order], {f: v[order] for f, v in b.items()} | {"label": k[order] % 4}


@pytest.mark.parametrize(("n", "groups", "angles", "size", "place"), [(900, 1, 1, 1.0, 0.0), (900, 1, 628, 1.0, 0.0), (900, 3, 628, 1.0, 1e7), (900, 60, 628, 1.0, 0.0), (300, 1, 628, 1e-18, 0.0), (300, 1, 1, 1e20, 0.0)])
def test_tiles_find_all_pairs(n, groups, angles, size, place):
    group, b = crowd(n, groups, angles, size, place)

    def differ(p, q):
        return b["label"][p] != b["label"][q]

    want = {(i, j) for p, q in kernels.touching(group, b, differ) for i, j in zip(p.tolist(), q.tolist(), strict=True)}
    for most in (1 << 6, 1 << 11, 1 << 15):
        found = [(i, j) for p, q in kernels.touching_tiles(group, b, differ, most) for i, j in zip(p.tolist(), q.tolist(), strict=True)]
        assert len(found) == len(set(found)) and set(found) == want


def test_crowds_are_not_listed(monkeypatch):
    group, b = crowd(2000, 1, 628)
    monkeypatch.setattr(kernels, "_listed", None)
    assert sum(len(p) for p, _ in kernels.touching_tiles(group, b, lambda p, q: b["label"][p] != b["label"][q])) > 100_000


def test_pairs_in_whole_parts_from_many_tasks(spark, boxes):
    parts = trajectories.collisions(boxes, scale=1000)
    want = trajectories.collisions(boxes).withColumn("penetration", F.floor(F.col("penetration") * 1000 + 0.5))
    assert rows(parts) == rows(want) != []
    assert parts.rdd.getNumPartitions() >= 8 * spark.sparkContext.defaultParallelism
