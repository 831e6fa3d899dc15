"""Road centerlines: triangulated roadway edges, filtered triangles, a skeleton of their centres, and smoothed lines.

Tables between the steps are relational; triangulation and the greedy walk run as kernels, a scene at a time. Triangles
are numbered by their sorted vertices, which fixes every "first".
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lanewright.functions import geom, kernels, triangles
from lanewright.operators.config import CenterlineConfig
from lanewright.operators.kept import keep
from lanewright.plans.grouped import map_chunks, map_groups


def road_edges(roadway: DataFrame) -> DataFrame:
    """scene_id, edge (numbered in a scene), roadway, p, q, angle of each roadway's consecutive vertices."""
    rows = roadway.where("size(verts) >= 2").select("scene_id", F.col("ord").alias("roadway"), F.posexplode(geom.pairs("verts")).alias("k", "e"))
    return rows.select("scene_id", "roadway", "k", F.col("e.p").alias("p"), F.col("e.q").alias("q"), geom.edge_angle("e.p", "e.q").alias("angle"))


def road_points(roadway: DataFrame, step: float = 1.0) -> DataFrame:
    """scene_id, v (numbered in a scene), x, y, roadway: the resampled vertices."""
    rows = roadway.where("size(verts) >= 2").select("scene_id", F.col("ord").alias("roadway"), F.posexplode(geom.resample("verts", step)).alias("k", "p"))
    order = Window.partitionBy("scene_id").orderBy("roadway", "k")
    return rows.select("scene_id", (F.row_number().over(order) - 1).alias("v"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), "roadway")


def triangulate(points: DataFrame, scene: str = "scene_id", kind: str = "string", last_of_equal: bool = False) -> DataFrame:
    """scene, t, a, b, c: Delaunay triangles of each scene's points (v, x, y), numbered in the order of their vertices."""

    def work(key: tuple, c: dict[str, np.ndarray]):
        ids = c["v"]
        for t, tri in enumerate(kernels.delaunay(np.column_stack([c["x"], c["y"]]), last_of_equal)):
            yield (key[0], t, *(int(ids[i]) for i in tri))

    return map_groups(points.select(scene, "v", "x", "y"), [scene], ["v"], work, f"{scene} {kind}, t long, a long, b long, c long")


def _corner(points: DataFrame, scene: str, name: str) -> DataFrame:
    return points.select(scene, F.col("v").alias(name), geom.point("x", "y").alias(f"p_{name}"), F.col("roadway").alias(f"r_{name}"))


def with_corners(triangles: DataFrame, points: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Triangles with their corners' places and roadways, perpendicular width, longest edge, and number of roadways."""
    both = reduce(lambda df, k: df.join(_corner(points, scene, k), [scene, k]), "abc", triangles)
    p, r = [F.col(f"p_{k}") for k in "abc"], [F.col(f"r_{k}") for k in "abc"]
    longest = F.greatest(*(geom.distance(p[i], p[(i + 1) % 3]) for i in range(3)))
    return both.select("*", geom.perpendicular_width(p, r).alias("width"), longest.alias("longest"), F.size(F.array_distinct(F.array(*r))).alias("roadways"))


def crowded_triangles(triangles: DataFrame, threshold: int, scene: str = "scene_id") -> DataFrame:
    """scene, t of the triangles at a vertex that ``threshold`` triangles or more share."""
    corner = triangles.select(scene, "t", F.explode(F.array("a", "b", "c")).alias("v"))
    busy = corner.groupBy(scene, "v").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= threshold)
    return corner.join(busy, [scene, "v"], "left_semi").select(scene, "t").distinct()


def neighbours(triangles: DataFrame, scene: str = "scene_id") -> DataFrame:
    """scene, t, u of the triangles t < u that share an edge."""
    sides = F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")), F.struct(F.col("b").alias("i"), F.col("c").alias("j")), F.struct(F.col("a").alias("i"), F.col("c").alias("j")))
    e = triangles.select(scene, "t", F.explode(sides).alias("e"))
    return e.join(e.select(scene, F.col("t").alias("u"), "e"), [scene, "e"]).where("t < u").select(scene, "t", "u")


def _in_scenes(points: DataFrame, edges: DataFrame | None, config: CenterlineConfig, kind: str, work: Callable, columns: str) -> DataFrame:
    """``work(triangles, table, x, y, roads, edges)`` on whole scenes; it gives arrays of ``columns`` and the rows of their scene.

    Points have scene_id, v, x, y, roadway; ``edges`` are as of :func:`road_edges`, or (without) between consecutive points of
    each roadway. What a scene's triangles are compared with lies in the scene, so all of it comes by one shuffle.
    """
    rows, between = points.select("scene_id", "v", "x", "y", "roadway"), edges is None
    if not between:
        none = F.lit(None).cast("double")
        more = edges.select("scene_id", F.col("k").cast(points.schema["v"].dataType).alias("v"), F.col("p.x").alias("x"), F.col("p.y").alias("y"), "roadway", F.col("q.x").alias("qx"), F.col("q.y").alias("qy"), "angle")
        rows = rows.select("*", none.alias("qx"), none.alias("qy"), none.alias("angle")).unionByName(more)

    def run(table: pa.Table, group: np.ndarray):
        road = table["roadway"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(int)
        v, x, y = (table[k].to_numpy() for k in ("v", "x", "y"))
        if between:
            points, e = np.arange(len(table)), triangles.edges_of(group, road, x, y)
        else:
            qx, qy, angle = (table[k].to_numpy() for k in ("qx", "qy", "angle"))
            is_edge = table["angle"].is_valid().to_numpy()
            points, at = np.flatnonzero(~is_edge), np.flatnonzero(is_edge)
            e = triangles.Edges(group[at], road[at], v[at], x[at], y[at], qx[at], qy[at], angle[at])
        group, road, x, y = group[points], road[points], x[points], y[points]
        found, of = work(triangles.judge(group, x, y, road, e, config), v[points], x, y, road, e)
        yield found | {"scene_id": table["scene_id"].take(pa.array(points[of]))}

    return map_chunks(rows, ["scene_id"], ["v"], run, f"scene_id {kind}, {columns}")


def _named(codes: np.ndarray, names: Sequence[str]) -> pa.Array:
    """Names by their numbers; null for negative ones."""
    return pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32(), mask=codes < 0), pa.array(names)).cast(pa.string())


def judged_triangles(points: DataFrame, edges: DataFrame | None, config: CenterlineConfig, kind: str = "string") -> DataFrame:
    """scene_id, t, a, b, c, width, longest, roadways, size, crowded, parallel and the first test that rejects each (null: none):
    size, cluster, then diversity or direction."""

    def work(tri: triangles.Triangles, v: np.ndarray, *_):
        found = {k: getattr(tri, k) for k in ("t", "width", "longest", "roadways", "size", "crowded", "parallel")}
        found |= {k: v[tri.at[:, i]] for i, k in enumerate("abc")}
        return found | {"rejected": _named(tri.rejected - 1, ("size", "cluster", "parallel"))}, tri.at[:, 0]

    return _in_scenes(points, edges, config, kind, work, "t long, a long, b long, c long, width double, longest double, roadways int, size double, crowded boolean, parallel boolean, rejected string")


def display_edges(points: DataFrame, edges: DataFrame | None, config: CenterlineConfig, kind: str = "string") -> DataFrame:
    """scene_id, i, j, kind: each triangle edge once, as the first triangle that has it is shown."""

    def work(tri: triangles.Triangles, v: np.ndarray, *_):
        i, j, kinds = triangles.shown(tri, config)
        return {"i": v[i], "j": v[j], "kind": _named(kinds, triangles.KINDS)}, i

    return _in_scenes(points, edges, config, kind, work, "i long, j long, kind string")


def skeleton(points: DataFrame, edges: DataFrame | None, config: CenterlineConfig, kind: str = "string") -> DataFrame:
    """scene_id, t, u, p, q, width: links between the centres of neighbouring triangles that cross no edge of their roadways.

    The second triangle only has to be uncrowded and not too wide (or, by configuration, valid itself).
    """

    def work(tri: triangles.Triangles, v: np.ndarray, x: np.ndarray, y: np.ndarray, road: np.ndarray, e: triangles.Edges):
        p, q, mx, my = triangles.linked(tri, x, y, road, e, config)
        return {"t": tri.t[p], "u": tri.t[q], "px": mx[p], "py": my[p], "qx": mx[q], "qy": my[q], "width": (tri.width[p] + tri.width[q]) / 2}, tri.at[p, 0]

    found = _in_scenes(points, edges, config, kind, work, "t long, u long, px double, py double, qx double, qy double, width double")
    return found.select("scene_id", "t", "u", geom.point("px", "py").alias("p"), geom.point("qx", "qy").alias("q"), "width")


def midpoints(links: DataFrame) -> DataFrame:
    """scene_id, i, x, y, width of the links' middles, numbered in the order of their triangles."""
    order = Window.partitionBy("scene_id").orderBy("t", "u")
    return links.select("scene_id", (F.row_number().over(order) - 1).alias("i"), ((F.col("p.x") + F.col("q.x")) / 2).alias("x"), ((F.col("p.y") + F.col("q.y")) / 2).alias("y"), "width")


def connect_midpoints(mids: DataFrame, config: CenterlineConfig, scene: str = "scene_id", kind: str = "string", places: bool = False) -> DataFrame:
    """scene, line, ord, i: walks over midpoints near one another, which a walk asks for as it goes; pairs are not listed.

    ``places``: x, y and width of the midpoints in place of i, so that nothing has to be joined to them.
    """
    def work(key: tuple, c: dict[str, np.ndarray]):
        points = np.column_stack([c["x"], c["y"]])
        paths = kernels.connect(
            points, kernels.Around(points, config.link_distance, config.strict_link), math.radians(config.link_degrees), config.link_distance, config.min_length, config.max_mean_step,
            cone=config.cone, millis=config.millis, fixed_back=config.fixed_back,
        )
        if places:
            x, y, width = (c[k].tolist() for k in ("x", "y", "width"))
            return ((key[0], line, k, x[n], y[n], width[n]) for line, path in enumerate(paths) for k, n in enumerate(path))
        ids = c["i"].tolist()
        return ((key[0], line, k, ids[n]) for line, path in enumerate(paths) for k, n in enumerate(path))

    found = "x double, y double, width double" if places else "i long"
    return map_groups(mids.select(scene, "i", "x", "y", *(["width"] if places else [])), [scene], ["i"], work, f"{scene} {kind}, line long, ord long, {found}")


def normals(points: DataFrame, keys: list[str]) -> DataFrame:
    """Add _nx, _ny: unit normals by central differences inside a line and one-sided ones at its ends."""
    w = Window.partitionBy(*keys).orderBy("ord")
    side = lambda k: F.coalesce(F.lead(k).over(w), F.col(k)) - F.coalesce(F.lag(k).over(w), F.col(k))
    t = points.withColumn("_tx", side("x")).withColumn("_ty", side("y"))
    size = F.greatest(geom.length_of(F.col("_tx"), F.col("_ty")), F.lit(1e-12))
    return t.withColumn("_nx", -F.col("_ty") / size).withColumn("_ny", F.col("_tx") / size).drop("_tx", "_ty")


def split_wide(lines: DataFrame, two: float, three: float, keys: list[str]) -> DataFrame:
    """Lines (keys, ord, x, y, width) of a median width of ``two`` in two lanes, of ``three`` in three; adds lane."""
    median = lines.groupBy(*keys).agg(F.median("width").alias("_median"))
    rows = normals(lines, keys).join(median, keys)
    share = F.when(F.col("_median") >= three, 3).when(F.col("_median") >= two, 2).otherwise(1)
    offsets = F.when(share == 3, F.array(*map(F.lit, (1 / 3, 0.0, -1 / 3)))).when(share == 2, F.array(F.lit(0.25), F.lit(-0.25))).otherwise(F.array(F.lit(0.0)))
    rows = rows.withColumn("_share", share).select("*", F.posexplode(offsets).alias("lane", "_o"))
    off = F.col("_o") * F.col("width")
    moved = rows.withColumns({"x": F.col("x") + F.col("_nx") * off, "y": F.col("y") + F.col("_ny") * off, "width": F.col("width") / F.col("_share")})
    return moved.drop("_median", "_nx", "_ny", "_share", "_o")


def smooth(lines: DataFrame, half: int, max_width: float, keys: list[str]) -> DataFrame:
    """Moving average over 2 half + 1 points; ends and short lines stay. Points that move get ``max_width``."""
    if not half:
        return lines
    w = Window.partitionBy(*keys)
    around = w.orderBy("ord").rowsBetween(-half, half)
    inner = (F.count(F.lit(1)).over(w) > 2 * half + 1) & (F.col("ord") >= half) & (F.col("ord") < F.count(F.lit(1)).over(w) - half)
    rows = lines.withColumns({"_in": inner, "_x": F.avg("x").over(around), "_y": F.avg("y").over(around)})
    moved = F.col("_in") & ((F.col("_x") != F.col("x")) | (F.col("_y") != F.col("y")))
    return rows.withColumn("width", F.when(moved, F.lit(max_width)).otherwise(F.col("width"))).withColumns({"x": F.when(F.col("_in"), F.col("_x")).otherwise(F.col("x")), "y": F.when(F.col("_in"), F.col("_y")).otherwise(F.col("y"))}).drop("_in", "_x", "_y")


def centerlines(roadway: DataFrame, config: CenterlineConfig = CenterlineConfig()) -> dict[str, DataFrame]:
    """From roadway objects (scene_id, ord, verts): centerlines (scene_id, line, lane, ord, x, y, width), skeleton,
    midpoints and triangles."""
    edges, points = keep(road_edges(roadway), "edges"), keep(road_points(roadway, config.resample_step), "points")
    judged = judged_triangles(points, edges, config)
    links = keep(skeleton(points, edges, config), "skeleton")
    mids = keep(midpoints(links), "midpoints")
    walked = keep(connect_midpoints(mids, config, places=True), "walks")
    lanes = split_wide(walked, config.split_two, config.split_three, ["scene_id", "line"]) if config.split else walked.withColumn("lane", F.lit(0))
    done = smooth(lanes, config.smooth, config.max_width, ["scene_id", "line", "lane"])
    return {"centerlines": done, "skeleton": links, "midpoints": mids, "triangles": judged}


def width_range(lines: DataFrame) -> DataFrame:
    """The least and the largest width of all centerline points: what a colour scale spans."""
    return lines.agg(F.min("width").alias("least"), F.max("width").alias("largest"))


def stats(found: dict[str, DataFrame], points: DataFrame) -> DataFrame:
    """A row a scene: points, triangles, valid ones, rejections by reason, links, midpoints, lines and their length."""
    t = found["triangles"].groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("triangles"), F.count_if(F.col("rejected").isNull()).alias("valid"), F.count_if(F.col("rejected") == "size").alias("rejected_size"),
        F.count_if(F.col("rejected") == "cluster").alias("rejected_cluster"), F.count_if(F.col("rejected") == "parallel").alias("rejected_parallel"),
    )
    n = points.groupBy("scene_id").agg(F.count(F.lit(1)).alias("points"))
    s = found["skeleton"].groupBy("scene_id").agg(F.count(F.lit(1)).alias("links"))
    c = found["centerlines"]
    w = Window.partitionBy("scene_id", "line", "lane").orderBy("ord")
    step = geom.length_of(F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y"))
    lines = c.withColumn("_d", step).groupBy("scene_id").agg(F.countDistinct("line", "lane").alias("lines"), F.coalesce(F.sum("_d"), F.lit(0.0)).alias("length"))
    return n.join(t, "scene_id", "left").join(s, "scene_id", "left").join(lines, "scene_id", "left").na.fill(0)


def merge_ends(lines: DataFrame, max_distance: float = 36.0, max_degrees: float = 30.0) -> DataFrame:
    """Lines (scene_id, line, ord, x, y) with ends that face each other joined by clothoids; off by default upstream."""

    def work(key: tuple, c: dict[str, np.ndarray]):
        groups = [np.column_stack([c["x"], c["y"]])[c["line"] == n] for n in dict.fromkeys(c["line"].tolist())]
        return [(key[0], n, k, float(x), float(y)) for n, line in enumerate(kernels.merge_polylines(groups, max_distance, math.radians(max_degrees))) for k, (x, y) in enumerate(line)]

    return map_groups(lines.select("scene_id", "line", "ord", "x", "y"), ["scene_id"], ["line", "ord"], work, "scene_id string, line long, ord long, x double, y double")


def clean_line_ends(lines: DataFrame) -> DataFrame:
    """Lines with sharply turning ends replaced by straight ones; off by default upstream."""

    def work(key: tuple, c: dict[str, np.ndarray]):
        return [(*key, k, float(x), float(y)) for k, (x, y) in enumerate(kernels.clean_ends(np.column_stack([c["x"], c["y"]])))]

    return map_groups(lines.select("scene_id", "line", "ord", "x", "y"), ["scene_id", "line"], ["ord"], work, "scene_id string, line long, ord long, x double, y double")
