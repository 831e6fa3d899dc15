"""Kept tables: small as files, large in memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from lanewright.operators.kept import keep, kept


def test_kept_tables_are_not_broadcast(spark):
    """A file of repeated rows has few bytes, by which the planner would send it whole through the driver."""
    with kept():
        rows = keep(spark.range(1000).select(F.lit("a").alias("scene_id"), "id", F.lit("same").alias("name")))
        both = rows.join(rows.where("id > 3").select("scene_id", "id", F.length("name").alias("n")), ["scene_id", "id"], "left")
        assert "BroadcastHashJoin" not in both._jdf.queryExecution().executedPlan().toString()
        assert both.count() == 1000 and "BroadcastHashJoin" not in both._jdf.queryExecution().executedPlan().toString()
