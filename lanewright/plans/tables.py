"""The driver tables read as geometry: what each proxy means, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POLY_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(x: Column, scale: int = 1000) -> Column:
    """A number in whole thousandths, half up: the same in either engine."""
    return F.floor(x * scale + 0.5).cast("long")


def polylines(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    """id, verts (points in order) and roadways of each order's line items.

    ``stored``: points in the order of their rows in the files, in which SQL with one thread adds them up; for sums of
    doubles that are rounded, as exact ties hang on that order.
    """
    place = (F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")) if stored else ()
    rows = F.sort_array(F.collect_list(F.struct(*place, *POLY_ORDER)))
    poly = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(rows.alias("_r"))
    point = lambda r: F.struct(r["l_quantity"].alias("x"), (r["l_extendedprice"] / 2000).alias("y"))
    return poly.select("id", F.transform("_r", point).alias("verts"), F.transform("_r", lambda r: r["l_suppkey"] % 3).alias("roadways"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ord, x, y, roadway: the polylines, a row a point."""
    one = polylines(spark, sf_dir).select("id", F.posexplode(F.arrays_zip("verts", "roadways")).alias("ord", "_p"))
    return one.select("id", "ord", F.col("_p.verts.x").alias("x"), F.col("_p.verts.y").alias("y"), F.col("_p.roadways").alias("roadway"))


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, ord, x, y, theta: a user's events in order as poses."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events")
    return e.select(
        "user_id", (F.row_number().over(order) - 1).alias("ord"), F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"),
        ((F.col("event_id") * 37 % 628) / 100 - 3.14).alias("theta"),
    )


VERTICES = """verts AS (
    SELECT l_orderkey AS id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INTEGER) AS ord,
           l_quantity AS x, l_extendedprice / 2000 AS y, l_suppkey % 3 AS roadway FROM lineitem)"""
POSES = """poses AS (
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord, value AS x, CAST(event_id % 97 AS DOUBLE) AS y,
           CAST(event_id * 37 % 628 AS DOUBLE) / 100 - 3.14 AS theta FROM events)"""
#: DuckDB macros as text: whole thousandths, distance, wrapped angle.
Q = lambda e, scale=1000: f"CAST(floor(({e}) * {scale} + 0.5) AS BIGINT)"
WRAP = lambda e: f"atan2(sin({e}), cos({e}))"
