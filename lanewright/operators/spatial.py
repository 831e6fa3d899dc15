"""Joins by place: points and segments are dealt to the cells of a grid and meet in equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.functions import geom


def _cells(x: Column, y: Column, size: float) -> tuple[Column, Column]:
    return F.floor(x / size).cast("long"), F.floor(y / size).cast("long")


def _around(df: DataFrame, gx: Column, gy: Column) -> DataFrame:
    """A row for each of the nine cells around each row's own."""
    offsets = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    return df.withColumn("_o", F.explode(offsets)).withColumn("_gx", gx + F.col("_o.i")).withColumn("_gy", gy + F.col("_o.j")).drop("_o")


def radius_pairs(points: DataFrame, scene: list[str], radius: float, inclusive: bool = True, ordinal: str = "i") -> DataFrame:
    """scene, i, j, dist, angle of the pairs i < j of one scene within ``radius``; points have ``ordinal``, x, y.

    A pair meets in one cell only, so nothing has to be made distinct.
    """
    left = points.select(*scene, F.col(ordinal).alias("i"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    right = points.select(*scene, F.col(ordinal).alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    gx, gy = _cells(F.col("x1"), F.col("y1"), radius)
    hx, hy = _cells(F.col("x2"), F.col("y2"), radius)
    both = left.withColumn("_gx", gx).withColumn("_gy", gy).join(_around(right, hx, hy), [*scene, "_gx", "_gy"]).where("i < j")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    d = geom.length_of(dx, dy)
    return both.select(*scene, "i", "j", d.alias("dist"), F.atan2(dy, dx).alias("angle")).where(F.col("dist") <= radius if inclusive else F.col("dist") < radius)


def within_radius(left: DataFrame, right: DataFrame, scene: list[str], radius: float) -> DataFrame:
    """Rows of left (l, x, y) and right (r, x, y) of one scene closer than ``radius``: scene, l, r, dist."""
    a = left.select(*scene, "l", F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = right.select(*scene, "r", F.col("x").alias("x2"), F.col("y").alias("y2"))
    gx, gy = _cells(F.col("x1"), F.col("y1"), radius)
    hx, hy = _cells(F.col("x2"), F.col("y2"), radius)
    both = a.withColumn("_gx", gx).withColumn("_gy", gy).join(_around(b, hx, hy), [*scene, "_gx", "_gy"])
    d = geom.length_of(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return both.select(*scene, "l", "r", d.alias("dist")).where(F.col("dist") < radius)


def nearest_within(left: DataFrame, right: DataFrame, scene: list[str], radius: float) -> DataFrame:
    """For each l the nearest r closer than ``radius``, the least r of equals: scene, l, r, dist."""
    found = within_radius(left, right, scene, radius)
    return found.groupBy(*scene, "l").agg(F.min(F.struct("dist", "r")).alias("_b")).select(*scene, "l", F.col("_b.r").alias("r"), F.col("_b.dist").alias("dist"))


def crossing_pairs(left: DataFrame, right: DataFrame, scene: list[str], cell: float) -> DataFrame:
    """scene, l, r of properly crossing segments (x1, y1, x2, y2): boxes are dealt to the cells that they touch."""

    def dealt(df: DataFrame, name: str) -> DataFrame:
        span = lambda a, b: F.sequence(F.floor(F.least(a, b) / cell).cast("long"), F.floor(F.greatest(a, b) / cell).cast("long"))
        seg = F.struct(geom.point("x1", "y1").alias("p"), geom.point("x2", "y2").alias("q"))
        cells = df.select(*scene, name, seg.alias(f"_{name}"), F.explode(span("x1", "x2")).alias("_gx"), "y1", "y2")
        return cells.withColumn("_gy", F.explode(span("y1", "y2"))).drop("y1", "y2")

    both = dealt(left, "l").join(dealt(right, "r"), [*scene, "_gx", "_gy"])
    hit = geom.segments_cross(F.col("_l.p"), F.col("_l.q"), F.col("_r.p"), F.col("_r.q"))
    return both.where(hit).select(*scene, "l", "r").distinct()


def overlapping(left: DataFrame, right: DataFrame, scene: str, left_box: str, right_box: str) -> DataFrame:
    """Rows of left and right of one scene whose upright boxes (struct x0, y0, x1, y1) overlap or touch, with all columns.

    A row is dealt to the cells that its box touches. A scene's cells have the mean size of its boxes, or a 16th of the
    largest if that is more, so one long box costs it some hundred cells and other scenes nothing. Two boxes meet in the
    first cell that they share. Boxes without finite bounds overlap nothing. Names of columns must differ, but for scene.
    """

    def size(b: str) -> Column:
        return F.greatest(F.col(f"{b}.x1") - F.col(f"{b}.x0"), F.col(f"{b}.y1") - F.col(f"{b}.y0"))

    finite = lambda b: sum((F.abs(f"{b}.{k}") for k in ("x0", "y0", "x1", "y1")), F.lit(0.0)) < float("inf")
    left, right = left.where(finite(left_box)), right.where(finite(right_box))
    sizes = left.select(scene, size(left_box).alias("_size")).unionByName(right.select(scene, size(right_box).alias("_size")))
    cells = sizes.groupBy(scene).agg(F.greatest(F.avg("_size"), F.max("_size") / 16, F.lit(1e-6)).alias("_cell"))

    def dealt(df: DataFrame, b: str, side: str) -> DataFrame:
        slack = 1e-9 * (F.abs(f"{b}.x0") + F.abs(f"{b}.x1") + F.abs(f"{b}.y0") + F.abs(f"{b}.y1"))  # rounding must not part boxes that touch
        cell = lambda v: F.floor(v / F.col("_cell")).cast("long")
        rows = df.join(cells, scene)
        for k in "xy":
            rows = rows.withColumn(f"_{side}{k}", cell(F.col(f"{b}.{k}0") - slack)).withColumn(f"_g{k}", F.explode(F.sequence(f"_{side}{k}", cell(F.col(f"{b}.{k}1") + slack))))
        return rows.drop("_cell")

    met = dealt(left, left_box, "l").join(dealt(right, right_box, "r"), [scene, "_gx", "_gy"])
    first = (F.col("_gx") == F.greatest("_lx", "_rx")) & (F.col("_gy") == F.greatest("_ly", "_ry"))
    return met.where(first).drop("_gx", "_gy", "_lx", "_ly", "_rx", "_ry")
