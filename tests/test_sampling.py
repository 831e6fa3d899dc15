"""The curve queries sample as densely as their operators' defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewright.operators import splines, trajectories
from lanewright.plans import vehicles

SF = "/root/testdata/sf0.001"


def test_curve_queries_use_default_sampling(spark):
    total = lambda df, c: df.agg(F.sum(c)).first()[0]
    five, ten = (vehicles._runs(spark, SF, n) for n in (5, 10))
    walked = trajectories.connected(five.withColumnRenamed("ord", "pos"), vehicles.KEYS, vehicles.KINDS)
    assert total(vehicles.clothoid_path(spark, SF), "points") == walked.count()
    fitted = trajectories.fit_paths(ten.withColumnRenamed("ord", "pos"), vehicles.KEYS, vehicles.KINDS, "hybrid")
    assert total(vehicles.hybrid_path(spark, SF), "points") == total(fitted, F.size("path"))
    found = splines.compare(ten.withColumn("scene_id", F.concat_ws("-", "user_id", "run")))
    assert total(vehicles.spline_lab(spark, SF), "samples") == found.where("x IS NOT NULL").count()
