"""Lane ends, connections proposed by a responder, and curves that avoid obstacles."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lanewright.functions import curves, geom
from lanewright.operators import spatial
from lanewright.plans.grouped import map_chunks

CONNECTIONS = "array<struct<`from`:int,`to`:int,confidence:double>>"


def lane_endpoints(lanes: DataFrame) -> DataFrame:
    """scene_id, id, x, y, heading, lane_idx: both ends of each lane of two points or more; ids follow the lanes."""
    long_enough = lanes.where("size(verts) >= 2")
    before = F.sum(F.lit(2)).over(_by_lane()) - 2
    ends = F.array(
        F.struct(F.lit(0).alias("end"), F.get("verts", F.lit(0)).alias("p"), geom.end_heading("verts", True).alias("heading")),
        F.struct(F.lit(1).alias("end"), F.element_at("verts", -1).alias("p"), geom.end_heading("verts", False).alias("heading")),
    )
    rows = long_enough.withColumn("_first", before).withColumn("_e", F.explode(ends))
    return rows.select("scene_id", (F.col("_first") + F.col("_e.end")).alias("id"), F.col("_e.p.x").alias("x"), F.col("_e.p.y").alias("y"), F.col("_e.heading").alias("heading"), "lane_idx")


def _by_lane() -> WindowSpec:
    return Window.partitionBy("scene_id").orderBy("lane_idx")


def at_intersections(endpoints: DataFrame, radius: float = 20.0) -> DataFrame:
    """scene_id, id of the ends at intersections: where a ball around an end holds two lanes, all ends in it count."""
    near = spatial.radius_pairs(endpoints, ["scene_id"], radius, ordinal="id").select("scene_id", "i", "j")
    both = near.union(near.select("scene_id", "j", "i")).union(endpoints.select("scene_id", "id", "id"))
    lane = endpoints.select("scene_id", F.col("id").alias("j"), "lane_idx")
    mixed = both.join(lane, ["scene_id", "j"]).groupBy("scene_id", "i").agg(F.countDistinct("lane_idx").alias("n")).where("n > 1")
    return both.join(mixed.select("scene_id", "i"), ["scene_id", "i"]).select("scene_id", F.col("j").alias("id")).distinct()


def build_prompt(endpoints: DataFrame, at: DataFrame) -> DataFrame:
    """scene_id, prompt: the marked ends of each scene with lane and heading, and what is asked of the responder."""
    degrees = F.pmod(F.degrees("heading"), F.lit(360.0))
    # the marker lines and the names of the turn types are fixed values: responders are asked in these words
    line = F.format_string("  - Marker %d: Lane %d, heading %.0f°", F.col("id"), F.col("lane_idx"), degrees)
    marked = endpoints.join(at, ["scene_id", "id"], "left_semi").groupBy("scene_id").agg(F.sort_array(F.collect_list(F.struct("id", line.alias("said")))).alias("_l"))
    head = "The picture is a road intersection: lane centerlines are blue, lane ends carry numbered red markers, and yellow arrows point into the intersection.\n\nMarkers:\n"
    task = (
        "\n\nWhich ends can legally be connected through the intersection? Follow realistic traffic flow without sharp turns back; leftmost lanes usually lead to leftmost lanes; "
        'one lane may lead to several. Answer with a JSON array of objects with "from" and "to" (marker numbers) and "type", one of "left_turn", "straight", "right_turn", "u_turn".'
    )
    return marked.select("scene_id", F.concat(F.lit(head), F.array_join(F.transform("_l", lambda r: r["said"]), "\n"), F.lit(task)).alias("prompt"))


def annotations(lanes: DataFrame, endpoints: DataFrame, at: DataFrame, arrow: float = 5.0) -> DataFrame:
    """scene_id, layer, id, path, text: what a picture for the responder shows: lanes as lines, and for each end at an
    intersection a numbered marker and an arrow along its heading."""
    shown = endpoints.join(at, ["scene_id", "id"], "left_semi")
    p = geom.point("x", "y")
    tip = geom.point(F.col("x") + arrow * F.cos("heading"), F.col("y") + arrow * F.sin("heading"))
    lines = lanes.select("scene_id", F.lit("lane").alias("layer"), F.col("lane_idx").alias("id"), F.col("verts").alias("path"), F.lit(None).cast("string").alias("text"))
    markers = shown.select("scene_id", F.lit("marker").alias("layer"), "id", F.array(p).alias("path"), F.col("id").cast("string").alias("text"))
    return lines.unionByName(markers).unionByName(shown.select("scene_id", F.lit("arrow").alias("layer"), "id", F.array(p, tip).alias("path"), F.lit(None).cast("string").alias("text")))


def parse_connections(responses: DataFrame, column: str = "response") -> DataFrame:
    """The responses' columns with from_id, to_id, confidence: the first array up to the first closing bracket.

    Confidence is 1 if missing, types are ignored; a text without such an array, or one that is no JSON, gives no row
    (see :func:`bad_responses`).
    """
    said = F.from_json(F.regexp_extract(column, r"(\[[\s\S]*?\])", 1), CONNECTIONS)
    rows = responses.select(*(c for c in responses.columns if c != column), F.inline(said).alias("from_id", "to_id", "confidence"))
    return rows.withColumn("confidence", F.coalesce("confidence", F.lit(1.0)))


def bad_responses(responses: DataFrame, column: str = "response") -> DataFrame:
    """scene_id, stage, error of the responses without a readable array."""
    found = F.regexp_extract(column, r"(\[[\s\S]*?\])", 1)
    error = F.when(found == "", "no JSON array").when(F.from_json(found, CONNECTIONS).isNull(), "no valid JSON")
    return responses.select("scene_id", F.lit("response").alias("stage"), error.alias("error")).where("error IS NOT NULL")


def valid_connections(connections: DataFrame, endpoints: DataFrame, at: DataFrame) -> DataFrame:
    """Those between known ends at intersections, of different lanes."""
    known = endpoints.join(at, ["scene_id", "id"], "left_semi")
    first = known.select("scene_id", F.col("id").alias("from_id"), F.col("lane_idx").alias("_from"))
    second = known.select("scene_id", F.col("id").alias("to_id"), F.col("lane_idx").alias("_to"))
    return connections.join(first, ["scene_id", "from_id"]).join(second, ["scene_id", "to_id"]).where("_from <> _to").drop("_from", "_to")


def identify_connections(lanes: DataFrame, responder: Callable[[DataFrame], DataFrame], radius: float = 20.0) -> DataFrame:
    """Ends, prompt, response and validation in one; ``responder`` turns scene_id, prompt into scene_id, response."""
    endpoints = lane_endpoints(lanes)
    at = at_intersections(endpoints, radius)
    return valid_connections(parse_connections(responder(build_prompt(endpoints, at)).select("scene_id", "response")), endpoints, at)


def recorded(responses: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A responder that answers from a table scene_id, response."""
    return lambda prompts: prompts.join(responses, "scene_id")


def closed_polygons(roadway: DataFrame) -> DataFrame:
    """scene_id, poly, verts of closed roadway objects of three points or more."""
    return roadway.where("closed AND size(verts) >= 3").select("scene_id", F.col("ord").alias("poly"), "verts")


def _inside(p: Column, verts: Column) -> Column:
    """Even-odd rule: the edges that a ray to the right meets are odd in number."""
    ring = F.concat(verts, F.slice(verts, 1, 1))

    def meets(e: Column) -> Column:
        a, b = e["p"], e["q"]
        spans = (a["y"] > p["y"]) != (b["y"] > p["y"])
        level = F.when(a["y"] == b["y"], 1.0).otherwise(b["y"] - a["y"])
        return spans & (p["x"] < a["x"] + (b["x"] - a["x"]) * (p["y"] - a["y"]) / level)

    return F.size(F.filter(geom.pairs(ring), meets)) % 2 == 1


def _edges(polygons: DataFrame) -> DataFrame:
    """scene_id, poly, x1, y1, x2, y2 of polygons' edges, the closing one too."""
    ring = F.concat("verts", F.slice("verts", 1, 1))
    rows = polygons.select("scene_id", "poly", F.explode(geom.pairs(ring)).alias("e"))
    return rows.select("scene_id", "poly", *(F.col(f"e.{p}.{k}").alias(f"{k}{n}") for p, n in (("p", 1), ("q", 2)) for k in "xy"))


def _upright(x1: str, y1: str, x2: str, y2: str) -> Column:
    return F.struct(F.least(x1, x2).alias("x0"), F.least(y1, y2).alias("y0"), F.greatest(x1, x2).alias("x1"), F.greatest(y1, y2).alias("y1"))


def _met(pieces: DataFrame, polygons: DataFrame, keys: list[str]) -> DataFrame:
    """scene_id, keys, poly: the polygons whose edges the pieces (scene_id, keys, ax, ay, bx, by) of a curve cross."""
    left = pieces.withColumn("_box", _upright("ax", "ay", "bx", "by"))
    right = _edges(polygons).withColumn("_bounds", _upright("x1", "y1", "x2", "y2"))
    near = spatial.overlapping(left, right, "scene_id", "_box", "_bounds")
    hit = geom.segments_cross(geom.point("ax", "ay"), geom.point("bx", "by"), geom.point("x1", "y1"), geom.point("x2", "y2"))
    return near.where(hit).select("scene_id", *keys, "poly").distinct()


def _around(points: DataFrame, polygons: DataFrame, keys: list[str]) -> DataFrame:
    """scene_id, keys, poly: the polygons that hold the points (scene_id, keys, x, y)."""
    at = points.withColumn("_box", _upright("x", "y", "x", "y"))
    bounds = geom.bbox("verts")
    held = polygons.withColumn("_bounds", F.struct(*(bounds[n].alias(k) for n, k in (("xmin", "x0"), ("ymin", "y0"), ("xmax", "x1"), ("ymax", "y1")))))
    near = spatial.overlapping(at, held, "scene_id", "_box", "_bounds")
    return near.where(_inside(geom.point("x", "y"), F.col("verts"))).select("scene_id", *keys, "poly")


def _straight(rows: DataFrame, polygons: DataFrame, pair: list[str]) -> DataFrame:
    """scene_id, pair, _b (_n, try): how many polygons the straight lines meet."""
    pieces = rows.select("scene_id", *pair, *(F.col(f"{p}.{k}").alias(f"{n}{k}") for p, n in (("_from", "a"), ("_to", "b")) for k in "xy"))
    inside = _around(rows.select("scene_id", *pair, F.col("_from.x").alias("x"), F.col("_from.y").alias("y")), polygons, pair)
    hits = _met(pieces, polygons, pair).union(inside).distinct().groupBy("scene_id", *pair).agg(F.count(F.lit(1)).alias("_n"))
    counted = rows.select("scene_id", *pair).join(hits, ["scene_id", *pair], "left")
    return counted.select("scene_id", *pair, F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), F.lit(0).alias("try")).alias("_b"))


def _freest(rows: DataFrame, polygons: DataFrame, pair: list[str], tries: int, points: int, low: float, high: float) -> DataFrame:
    """scene_id, pair, _b (_n, try): the first try that meets fewest polygons. One shuffle of connections and edges by scene."""
    ends = ("x1", "y1", "h1", "x2", "y2", "h2")
    asked = rows.select("scene_id", F.lit(None).cast(polygons.schema["poly"].dataType).alias("poly"), *pair, *(F.col(c).alias(k) for k, c in zip(ends, ("_from.x", "_from.y", "_from_heading", "_to.x", "_to.y", "_to_heading"), strict=True)))
    none = lambda k: F.lit(None).cast(rows.schema[k].dataType if k in pair else "double").alias(k)
    walls = _edges(polygons).select("scene_id", "poly", *map(none, pair), "x1", "y1", none("h1"), "x2", "y2", none("h2"))

    def run(table: pa.Table, group: np.ndarray):
        poly = table["poly"].combine_chunks().dictionary_encode().indices
        is_edge = poly.is_valid().to_numpy(zero_copy_only=False)
        poly = poly.fill_null(-1).to_numpy()
        at = np.column_stack([table[k].to_numpy() for k in ends])
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        best, met = np.zeros(len(group), int), np.zeros(len(group), int)
        for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(group)], strict=True):
            walls = lo + np.flatnonzero(is_edge[lo:hi])
            if len(walls) and len(walls) < hi - lo:
                mine = lo + np.flatnonzero(~is_edge[lo:hi])
                code = np.unique(poly[walls], return_inverse=True)[1]
                best[mine], met[mine] = curves.freest(at[mine], code, at[walls][:, [0, 1, 3, 4]], tries, points, low, high)
        own = pa.array(np.flatnonzero(~is_edge))
        yield {k: table[k].take(own) for k in ("scene_id", *pair)} | {"_n": met[~is_edge], "try": best[~is_edge]}

    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in ("scene_id", *pair))
    return map_chunks(asked.unionByName(walls), ["scene_id"], [], run, f"{kinds}, _n long, try int").select("scene_id", *pair, F.struct("_n", "try").alias("_b"))


def connection_curves(connections: DataFrame, endpoints: DataFrame, polygons: DataFrame, tries: int = 10, points: int = 50, low: float = 0.2, high: float = 0.8, straight: bool = False) -> DataFrame:
    """Each connection's curve and whether it is free: the first try that meets no polygon, else the one that meets fewest.

    A curve meets a polygon if it crosses one of its edges or starts inside it. Pieces of curves meet polygons' edges in
    cells, so a curve is held against what lies beside it, not against all of its scene; pieces never leave the kernel.
    """
    end = lambda k: endpoints.select("scene_id", F.col("id").alias(f"{k}_id"), geom.point("x", "y").alias(f"_{k}"), F.col("heading").alias(f"_{k}_heading"))
    once = connections.groupBy("scene_id", "from_id", "to_id").agg(F.min("confidence").alias("confidence"))
    rows = once.join(end("from"), ["scene_id", "from_id"]).join(end("to"), ["scene_id", "to_id"])
    factor = F.lit(low) + F.col("try") * ((high - low) / max(1, tries - 1))
    pair = ["from_id", "to_id"]
    best = _straight(rows, polygons, pair) if straight else _freest(rows, polygons, pair, tries, points, low, high)
    chosen = rows.join(best, ["scene_id", *pair]).withColumn("try", F.col("_b.try"))
    curve = F.array("_from", "_to") if straight else geom.bezier_between("_from", "_from_heading", "_to", "_to_heading", factor, points)
    return chosen.select("scene_id", *pair, "confidence", curve.alias("curve"), (F.col("_b._n") == 0).alias("free"))


def free_share(curves: DataFrame) -> DataFrame:
    """The number of curves, and the share of those that meet nothing."""
    return curves.agg(F.count(F.lit(1)).alias("curves"), (F.count_if("free") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("share"))
