"""Queries of the polyline operators, each with its DuckDB twin."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lanewright.functions import geom, kernels
from lanewright.operators import roads
from lanewright.plans.grouped import map_groups
from lanewright.plans.tables import POSES, VERTICES, WRAP, Q, polylines, poses, q, table, vertices

EDGES = "edges AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(roadway) OVER w AS roadway2 FROM verts WINDOW w AS (PARTITION BY id ORDER BY ord))"


def polyline_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive points as edges with length and direction."""
    edges = polylines(spark, sf_dir).select("id", F.posexplode(geom.pairs("verts")).alias("ord", "_e"))
    return edges.select("id", "ord", q(geom.distance("_e.p", "_e.q")).alias("length"), q(geom.edge_angle("_e.p", "_e.q")).alias("angle"))


def polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points, length and mean curvature of each polyline."""
    p = polylines(spark, sf_dir)
    return p.select("id", F.size("verts").cast("long").alias("points"), q(geom.total_length("verts")).alias("length"), q(geom.mean_curvature("verts"), 100).alias("curvature"))


def polyline_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box, its diagonal and centre, and the mean of the vertices."""
    b = polylines(spark, sf_dir, stored=True).select("id", geom.bbox("verts").alias("b"), geom.mean_point("verts").alias("m"))
    center = geom.bbox_center("b")
    return b.select(
        "id", *(q(F.col(f"b.{k}")).alias(k) for k in ("xmin", "ymin", "xmax", "ymax")), q(geom.bbox_diagonal("b")).alias("diagonal"),
        q(center["x"]).alias("cx"), q(center["y"]).alias("cy"), q(F.col("m.x"), 100).alias("mx"), q(F.col("m.y"), 100).alias("my"),
    )


def global_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of all points and half the larger range."""
    v = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 2000).alias("y"))
    b = v.agg(F.min("x").alias("xmin"), F.max("x").alias("xmax"), F.min("y").alias("ymin"), F.max("y").alias("ymax"))
    return b.select(*(q(F.col(c)).alias(c) for c in b.columns), q(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")) / 2).alias("half"))


def affine_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each polyline scaled, turned and moved; the sums of its new coordinates."""
    m = geom.from_attributes(F.lit(1.0), F.lit(2.0), F.col("id") % 7 * 0.1, F.lit(2.0), F.lit(3.0))
    t = polylines(spark, sf_dir, stored=True).select("id", geom.apply_affine_all(m, "verts").alias("v"))
    total = lambda k: F.aggregate("v", F.lit(0.0), lambda s, p: s + p[k])
    return t.select("id", q(total("x"), 100).alias("sx"), q(total("y"), 100).alias("sy"))


def vertex_list_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vertex lists written as text and read back."""
    rows = F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("a"), "l_partkey")))
    text = F.array_join(F.transform("_r", lambda r: F.concat_ws(",", r["a"], r["l_partkey"], F.lit("0"))), ";")
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(rows.alias("_r")).select("id", geom.parse_vertices(F.concat(text, F.lit(";"))).alias("v"))
    total = lambda k: F.aggregate("v", F.lit(0.0), lambda s, p: s + p[k]).cast("long")
    return t.select("id", F.size("v").cast("long").alias("points"), total("x").alias("sx"), total("y").alias("sy"))


def resample_polyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polylines resampled so that points are at most 1 apart."""
    r = polylines(spark, sf_dir).select("id", geom.resample("verts", 1.0).alias("v"))
    # the first point is added to the sum of the others, as the SQL adds up its two halves: exact ties hang on that
    total = lambda k: F.aggregate(F.slice("v", F.lit(2), F.size("v")), F.lit(0.0), lambda s, p: s + p[k]) + F.col("v")[0][k]
    return r.select("id", F.size("v").cast("long").alias("points"), q(total("x"), 10).alias("sx"), q(total("y"), 10).alias("sy"))


def bezier_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubic pieces between consecutive points, controls at thirds shifted by 1: ten points a piece, joints once."""
    p = polylines(spark, sf_dir).where(F.size("verts") >= 2)
    third = lambda e, w: geom.point(e["p"]["x"] + (e["q"]["x"] - e["p"]["x"]) * w + 1, e["p"]["y"] + (e["q"]["y"] - e["p"]["y"]) * w)
    controls = F.flatten(F.transform(geom.pairs("verts"), lambda e: F.array(third(e, 0.25), third(e, 0.75))))
    c = p.withColumn("controls", controls).select("id", geom.interpolate_curve("verts", "controls", 10).alias("v"))
    total = lambda k: F.aggregate("v", F.lit(0.0), lambda s, x: s + x[k])
    return c.select("id", F.size("v").cast("long").alias("points"), q(total("x"), 10).alias("sx"), q(total("y"), 10).alias("sy"))


def auto_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a polyline nearly closes, by the larger side and by the diagonal, and its points once closed."""
    p = polylines(spark, sf_dir).withColumn("by_side", geom.nearly_closed("verts")).withColumn("by_diagonal", geom.nearly_closed("verts", by_diagonal=True))
    return p.select("id", "by_side", "by_diagonal", F.size(geom.close_ring("verts", "by_side")).cast("long").alias("points"))


def moving_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred mean of seven poses; the first and last three, and short lines, stay. Points that move get a width of 15."""
    found = roads.smooth(poses(spark, sf_dir).withColumn("width", F.lit(8.0)), 3, 15.0, ["user_id"])
    return found.select("user_id", F.col("ord").cast("long").alias("ord"), q(F.col("x"), 100).alias("x"), q(F.col("y"), 100).alias("y"), q(F.col("width")).alias("width"))


def tangent_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit normals of each user's line of poses, by central differences inside and one-sided ones at the ends."""
    found = roads.normals(poses(spark, sf_dir), ["user_id"])
    return found.select("user_id", F.col("ord").cast("long").alias("ord"), q(F.col("_nx")).alias("nx"), q(F.col("_ny")).alias("ny"))


def wide_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a median width of 22 in two, of 32 in three offset lines; here a pose's width is 15 + ord % 30."""
    lines = poses(spark, sf_dir).withColumn("width", 15.0 + F.col("ord") % 30 + F.col("user_id") % 11)
    found = roads.split_wide(lines, 22.0, 32.0, ["user_id"])
    return found.select("user_id", F.col("ord").cast("long").alias("ord"), F.col("lane").cast("long").alias("lane"), q(F.col("x"), 100).alias("x"), q(F.col("y"), 100).alias("y"), q(F.col("width")).alias("width"))


def edge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs and slip between consecutive poses, and their phase."""
    m = geom.slip_metrics("p", "q")
    e = _steps(spark, sf_dir).withColumns({"score": geom.edge_score("p", "q"), "freebody": geom.freebody_score("p", "q"), "slip": m["slip_angle"], "yaw": m["yaw_rate"], "mismatch": m["curvature_mismatch"]})
    # where the last bit of a sine decides how a value is rounded or which phase it has, the C library's decides, as in SQL
    parts = lambda v, scale: F.abs(F.col(v) * scale + 0.5 - F.round(F.col(v) * scale + 0.5)) < 1e-6
    beside = lambda v, limit: F.abs(F.abs(F.col(v)) - limit) < 1e-9
    close = parts("score", 100) | parts("freebody", 100) | parts("slip", 1000) | parts("yaw", 1000) | beside("slip", math.pi) | beside("slip", math.pi / 6) | beside("yaw", 0.5)
    e = e.withColumn("_c", _c_scores(*(F.when(close, F.col(f"{p}.{k}")) for p in "pq" for k in ("x", "y", "theta"))))
    e = e.withColumns({v: F.coalesce(F.get("_c", F.lit(i)), F.col(v)) for i, v in enumerate(("score", "freebody", "slip", "yaw"))})
    lost = (F.abs("slip") > math.pi / 6) | (F.abs("yaw") > 0.5)
    return e.select(
        "user_id", F.col("ord").cast("long").alias("ord"), q(F.col("score"), 100).alias("score"), q(F.col("freebody"), 100).alias("freebody"),
        q(F.col("slip")).alias("slip"), q(F.col("yaw")).alias("yaw"), q(F.col("mismatch")).alias("mismatch"), F.when(lost, "loc").otherwise("normal").alias("phase"),
    )


@F.pandas_udf(ArrayType(DoubleType()))
def _c_scores(x: pd.Series, y: pd.Series, t: pd.Series, u: pd.Series, v: pd.Series, w: pd.Series) -> pd.Series:
    """score, freebody, slip, yaw of a step by the C library's functions; null where a pose is null."""
    wrap = lambda a: math.atan2(math.sin(a), math.cos(a))

    def one(x: float, y: float, t: float, u: float, v: float, w: float) -> list[float] | None:
        if math.isnan(x + y + t + u + v + w):
            return None
        d, turn, along = math.sqrt((u - x) * (u - x) + (v - y) * (v - y)), wrap(w - t), math.atan2(v - y, u - x)
        score = d * (1 + 0.5 * abs(wrap(along - t)) / math.pi + 0.25 * abs(turn) / math.pi)
        return [score, math.sqrt(d * d + 4 * turn * turn), *((0.0, 0.0) if d < 1e-6 else (wrap(t - along), turn / d))]

    return pd.Series([one(*row) for row in zip(x, y, t, u, v, w, strict=True)], dtype=object)


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ord")
    p = poses(spark, sf_dir).withColumn("p", F.struct("x", "y", "theta"))
    return p.withColumn("q", F.lead("p").over(w)).where("q IS NOT NULL")


def _of_user(spark: SparkSession, sf_dir: str, work, schema: str) -> DataFrame:
    """``work`` on each user's poses (x, y, theta) in order, as rows after the user."""
    each = lambda key, c: [(*key, *work(np.column_stack([c["x"], c["y"], c["theta"]])))]
    return map_groups(poses(spark, sf_dir).select("user_id", "ord", "x", "y", "theta"), ["user_id"], ["ord"], each, f"user_id long, {schema}")


def anomaly_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first step of each user's largest slip and yaw together, and how large it is."""

    def work(at: np.ndarray) -> tuple[int, float]:
        i = kernels.anomaly_index(at)
        return i, kernels.anomaly(at[i], at[i + 1]) if len(at) > i + 1 else 0.0

    found = _of_user(spark, sf_dir, work, "step long, amount double")
    return found.select("user_id", "step", q(F.col("amount")).alias("anomaly"))


def slide_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times along each user's poses as a slide that slows down."""
    found = _of_user(spark, sf_dir, lambda at: (len(at), float(kernels.slide_times(at[:, :2])[-1])), "poses long, last double")
    return found.select("user_id", "poses", q(F.col("last"), 10).alias("t"))


_TURN = f"abs({WRAP('angle2 - angle')})"
QUERIES = {f.__name__: f for f in (polyline_edges, polyline_length, polyline_bbox, global_bounds, affine_transform, vertex_list_roundtrip, resample_polyline, bezier_interpolate, auto_close, moving_average, tangent_normals, wide_split, edge_scores, anomaly_index, slide_times)}
_POSE_STEPS = f"""WITH {POSES}, steps AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(theta) OVER w AS theta2 FROM poses WINDOW w AS (PARTITION BY user_id ORDER BY ord)),
    d AS (SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS d FROM steps WHERE x2 IS NOT NULL),
    m AS (SELECT *, CASE WHEN d < 1e-6 THEN 0 ELSE {WRAP('theta - atan2(y2 - y, x2 - x)')} END AS slip, CASE WHEN d < 1e-6 THEN 0 ELSE {WRAP('theta2 - theta')} / d END AS yaw FROM d)"""
_NORMALS = f"""WITH {POSES}, t AS (SELECT *, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS tx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS ty
    FROM poses WINDOW w AS (PARTITION BY user_id ORDER BY ord)), n AS (SELECT *, greatest(sqrt(tx * tx + ty * ty), 1e-12) AS size FROM t)"""
ORACLE_SQL = {
    "polyline_edges": f"WITH {VERTICES}, {EDGES} SELECT id, ord, {Q('sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))')} AS length, {Q('atan2(y2 - y, x2 - x)')} AS angle FROM edges WHERE x2 IS NOT NULL",
    "polyline_length": f"""WITH {VERTICES}, {EDGES}, e AS (SELECT *, sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)) AS d, atan2(y2 - y, x2 - x) AS angle FROM edges),
        f AS (SELECT *, lead(angle) OVER w AS angle2, lead(d) OVER w AS d2 FROM e WINDOW w AS (PARTITION BY id ORDER BY ord))
        SELECT id, count(*) AS points, {Q('coalesce(sum(d ORDER BY ord), 0)')} AS length,
               {Q('coalesce(degrees(avg(CASE WHEN d2 IS NULL THEN NULL WHEN (d + d2) / 2 > 0 THEN ' + _TURN + ' / ((d + d2) / 2) ELSE 0 END)), 0)', 100)} AS curvature FROM f GROUP BY id""",
    "polyline_bbox": f"""WITH {VERTICES}, b AS (SELECT id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, avg(x) AS mx, avg(y) AS my FROM verts GROUP BY id)
        SELECT id, {Q('x0')} AS xmin, {Q('y0')} AS ymin, {Q('x1')} AS xmax, {Q('y1')} AS ymax, {Q('sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))')} AS diagonal,
               {Q('(x0 + x1) / 2')} AS cx, {Q('(y0 + y1) / 2')} AS cy, {Q('mx', 100)} AS mx, {Q('my', 100)} AS my FROM b""",
    "global_bounds": f"""WITH {VERTICES}, b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM verts)
        SELECT {Q('x0')} AS xmin, {Q('x1')} AS xmax, {Q('y0')} AS ymin, {Q('y1')} AS ymax, {Q('greatest(x1 - x0, y1 - y0) / 2')} AS half FROM b""",
    "affine_transform": f"""WITH {VERTICES}, r AS (SELECT *, id % 7 * 0.1 AS a FROM verts)
        SELECT id, {Q('sum(cos(a) * 2 * x - sin(a) * 3 * y + 1)', 100)} AS sx, {Q('sum(sin(a) * 2 * x + cos(a) * 3 * y + 2)', 100)} AS sy FROM r GROUP BY id""",
    "vertex_list_roundtrip": """SELECT l_orderkey AS id, count(*) AS points, CAST(sum(CAST(l_quantity AS INTEGER)) AS BIGINT) AS sx, CAST(sum(l_partkey) AS BIGINT) AS sy FROM lineitem GROUP BY 1""",
    "resample_polyline": f"""WITH {VERTICES}, {EDGES}, e AS (SELECT *, greatest(1, CAST(ceil(sqrt((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y))) AS INTEGER)) AS n FROM edges WHERE x2 IS NOT NULL),
        p AS (SELECT id, x, y FROM verts WHERE ord = 0 UNION ALL SELECT id, x + (x2 - x) * j / n, y + (y2 - y) * j / n FROM (SELECT *, unnest(range(1, n + 1)) AS j FROM e))
        SELECT id, count(*) AS points, {Q('sum(x)', 10)} AS sx, {Q('sum(y)', 10)} AS sy FROM p GROUP BY id""",
    "bezier_interpolate": f"""WITH {VERTICES}, {EDGES}, t AS (SELECT *, unnest(range(0, 10)) AS j FROM edges WHERE x2 IS NOT NULL), u AS (SELECT *, j / 9.0 AS t, 1 - j / 9.0 AS u FROM t WHERE ord = 0 OR j > 0),
        p AS (SELECT id, u * u * u * x + 3 * u * u * t * (x + (x2 - x) * 0.25 + 1) + 3 * u * t * t * (x + (x2 - x) * 0.75 + 1) + t * t * t * x2 AS px,
                     u * u * u * y + 3 * u * u * t * (y + (y2 - y) * 0.25) + 3 * u * t * t * (y + (y2 - y) * 0.75) + t * t * t * y2 AS py FROM u)
        SELECT id, count(*) AS points, {Q('sum(px)', 10)} AS sx, {Q('sum(py)', 10)} AS sy FROM p GROUP BY id""",
    "auto_close": f"""WITH {VERTICES}, b AS (SELECT id, count(*) AS n, max(x) - min(x) AS w, max(y) - min(y) AS h, arg_min(x, ord) AS x0, arg_min(y, ord) AS y0, arg_max(x, ord) AS x1, arg_max(y, ord) AS y1 FROM verts GROUP BY id),
        c AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS gap FROM b)
        SELECT id, gap < 0.25 * greatest(w, h) AS by_side, gap < 0.25 * sqrt(w * w + h * h) AS by_diagonal,
               n + CASE WHEN gap < 0.25 * greatest(w, h) AND (x0 <> x1 OR y0 <> y1) THEN 1 ELSE 0 END AS points FROM c""",
    "moving_average": f"""WITH {POSES}, a AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, avg(x) OVER w AS ax, avg(y) OVER w AS ay FROM poses WINDOW w AS (PARTITION BY user_id ORDER BY ord ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
        i AS (SELECT *, n > 7 AND ord >= 3 AND ord < n - 3 AS inner_ FROM a)
        SELECT user_id, ord, {Q('CASE WHEN inner_ THEN ax ELSE x END', 100)} AS x, {Q('CASE WHEN inner_ THEN ay ELSE y END', 100)} AS y,
               CASE WHEN inner_ AND (ax <> x OR ay <> y) THEN 15000 ELSE 8000 END AS width FROM i""",
    "tangent_normals": f"{_NORMALS} SELECT user_id, ord, {Q('-ty / size')} AS nx, {Q('tx / size')} AS ny FROM n",
    "wide_split": f"""{_NORMALS}, w AS (SELECT *, 15.0 + ord % 30 + user_id % 11 AS width FROM n), g AS (SELECT *, median(width) OVER (PARTITION BY user_id) AS med FROM w),
        l AS (SELECT *, unnest(CASE WHEN med >= 32 THEN [0, 1, 2] WHEN med >= 22 THEN [0, 1] ELSE [0] END) AS lane FROM g),
        o AS (SELECT *, CASE WHEN med >= 32 THEN width / 3 * (1 - lane) WHEN med >= 22 THEN width / 4 * (1 - 2 * lane) ELSE 0 END AS off FROM l)
        SELECT user_id, ord, CAST(lane AS BIGINT) AS lane, {Q('x + -ty / size * off', 100)} AS x, {Q('y + tx / size * off', 100)} AS y,
               {Q('width / CASE WHEN med >= 32 THEN 3 WHEN med >= 22 THEN 2 ELSE 1 END')} AS width FROM o""",
    "edge_scores": f"""{_POSE_STEPS} SELECT user_id, ord, {Q("d * (1 + 0.5 * abs(" + WRAP('atan2(y2 - y, x2 - x) - theta') + ") / pi() + 0.25 * abs(" + WRAP('theta2 - theta') + ") / pi())", 100)} AS score,
        {Q('sqrt(d * d + 4 * ' + WRAP('theta2 - theta') + ' * ' + WRAP('theta2 - theta') + ')', 100)} AS freebody, {Q('slip')} AS slip, {Q('yaw')} AS yaw, CAST(0 AS BIGINT) AS mismatch,
        CASE WHEN abs(slip) > pi() / 6 OR abs(yaw) > 0.5 THEN 'loc' ELSE 'normal' END AS phase FROM m""",
    "anomaly_index": f"""{_POSE_STEPS}, a AS (SELECT user_id, ord, abs(slip) + abs(yaw) AS amount FROM m UNION ALL SELECT user_id, 0, 0 FROM poses GROUP BY user_id HAVING count(*) = 1),
        r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, ord) AS k FROM a)
        SELECT user_id, CASE WHEN amount > 0 THEN ord ELSE 0 END AS step, {Q('amount')} AS anomaly FROM r WHERE k = 1""",
    "slide_times": f"""WITH RECURSIVE {POSES}, walk AS (SELECT user_id, ord, x, y, CAST(0 AS DOUBLE) AS t FROM poses WHERE ord = 0
        UNION ALL SELECT p.user_id, p.ord, p.x, p.y, w.t + sqrt((p.x - w.x) * (p.x - w.x) + (p.y - w.y) * (p.y - w.y)) / greatest(5.0, 20.0 - 7.0 * w.t)
        FROM walk w JOIN poses p ON p.user_id = w.user_id AND p.ord = w.ord + 1)
        SELECT user_id, count(*) AS poses, {Q('max(t)', 10)} AS t FROM walk GROUP BY user_id""",
}
