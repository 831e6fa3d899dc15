"""Small scenes through the whole reader, in the profiles that disagree."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewright.functions import curves, geom
from lanewright.operators import lanes, roads, scene, trajectories
from lanewright.operators.config import CenterlineConfig, SceneConfig
from lanewright.operators.kept import kept
from lanewright.sources import scenes


def nodes_of(spark, *bodies):
    rows = [(f"s{i}", f"<far><scene>{b}</scene></far>") for i, b in enumerate(bodies)]
    return scenes.parse_scenes(spark.createDataFrame(rows, "path string, content string")).persist()


def objects(spark, body, profile="py", cache=None):
    found = scene.scene_objects(nodes_of(spark, body), cache or scenes.read_cache(spark, None), SceneConfig(profile=profile))
    return sorted(found.collect(), key=lambda r: r.ord)


NESTED = '<layer n="L"><item type="symbol" nam="Box" posx="10"><item type="symbol" posy="5"><item type="polyline" posx="100" vlist="0,0;2,0"/></item></item></layer>'


def test_items_in_symbols_have_no_transform_of_their_own(spark):
    nodes = nodes_of(spark, NESTED)
    for profile, x in (("py", 11.0), ("rs", 111.0)):
        c = SceneConfig(profile=profile)
        row = scene.primitives(scene.placed_nodes(nodes, c), c).first()
        assert (row.tcenter.x, row.tcenter.y) == (x, 5.0)
        assert row.name == ("Box" if profile == "py" else None)


def test_line_styles_and_arrows(spark):
    body = '<layer n="L"><item type="line" pntEx="4"><lndata lt="1" thickness="2"/></item><item type="line" pntEx="4"><lndata arrowshows="T"/></item><item type="ellipse" sizx="2" sizy="2"/></layer>'
    (line,) = objects(spark, body)
    assert line.dashed and line.thick and line.category == "roadway" and line.lndata.lt == 1
    kinds = [o.type for o in objects(spark, body, "rs")]
    assert kinds == ["line", "line", "ellipse"]


def test_names_classes_and_nested_vehicles(spark):
    body = '<layer n="L"><item type="symbol" nam="tree"><item type="symbol" vehicle2d="T"><item type="polyline" vlist="0,0;2,2"/></item></item><item type="symbol"><item type="symbol" vehicle2d="T"><item type="polyline" vlist="0,0;2,2"/></item></item></layer>'
    assert [o.category for o in objects(spark, body)] == ["misc", "vehicles"]
    assert [o.category for o in objects(spark, body, "rs")] == ["vehicles", "vehicles"]


def test_cache_decides_before_keywords(spark):
    cache = spark.createDataFrame([("Ambulance ", True, "vehicle", 0.9), ("Car", False, "background", 0.4)], "name string, is_vehicle boolean, predicted_class string, predicted_probability double")
    body = "".join(f'<layer n="L"><item type="symbol" nam="{n}"><item type="polyline" vlist="0,0;1,1"/></item></layer>' for n in ("Ambulance ", "Car", "Bus"))
    assert [o.category for o in objects(spark, body, cache=cache)] == ["vehicles", "misc", "vehicles"]


def test_texts_go_to_the_nearest_vehicle_or_to_all(spark):
    car = '<layer n="L"><item type="symbol" nam="car" posx="{}"><item type="polyline" vlist="-1,0;1,0"/></item></layer>'
    body = car.format(0) + car.format(4) + '<layer n="L"><item type="label" text="7" posx="1"/><item type="label" text="7" posx="1"/><item type="label" text="9" posx="9"/></layer>'
    assert [o.associated_text for o in objects(spark, body) if o.category == "vehicles"] == [["7", "7"], []]
    assert [o.associated_text for o in objects(spark, body, "rs") if o.category == "vehicles"] == [["7"], ["7"]]


def test_broken_files_are_quarantined(spark):
    rows = spark.createDataFrame([("a", "<far><scene/></far>"), ("b", "<far>"), ("c", "<far/>")], "path string, content string")
    bad = scenes.quarantine(scenes.parse_scenes(rows)).collect()
    assert sorted(r.scene_id for r in bad) == ["b", "c"]


def test_two_lane_road_has_a_centerline(spark):
    road = spark.createDataFrame([("s", 0, [(0.0, 0.0), (40.0, 0.3)]), ("s", 1, [(0.0, 10.0), (40.0, 10.2)])], "scene_id string, ord long, verts array<struct<x:double,y:double>>")
    found = roads.centerlines(road, CenterlineConfig(min_width=5, max_width=15))
    ys = [r.y for r in found["centerlines"].collect()]
    assert len(ys) > 10 and all(4 < y < 6.5 for y in ys)
    s = roads.stats(found, roads.road_points(road)).first()
    assert s.valid > 0 and s.lines == 1 and s.length > 20


def test_chronology_of_a_crash(spark, tmp_path):
    car = '<layer n="L"><item type="symbol" nam="car" posx="{}" posy="{}" oriz="{}"><item type="polyline" vlist="-1,-0.5;1,0.5"/></item><item type="label" text="{}" posx="{}" posy="{}"/></layer>'
    one = "".join(car.format(x, 0, 0, 1, x, 0) for x in (0, 4, 8, 12))
    two = "".join(car.format(12, y, 1.5708, 2, 12, y) for y in (-12, -8, -4, 0.2))
    nodes = nodes_of(spark, one + two, '<layer n="L"><item type="symbol" nam="car"><item type="polyline" vlist="0,0;1,1"/></item></layer>')
    scene.scene_objects(nodes, scenes.read_cache(spark, None)).where("category = 'vehicles'").drop("lndata").write.parquet(str(tmp_path / "v"))
    vehicles = spark.read.parquet(str(tmp_path / "v"))
    for early in (True, False):
        c = trajectories.chronology(vehicles, pre_crash_only=early)
        assert [r.scene_id for r in c["quarantine"].collect()] == ["s1"]
        order = {r.label: [] for r in c["trajectories"].collect()}
        for r in sorted(c["trajectories"].collect(), key=lambda r: r.pos):
            order[r.label].append(round(r.x if r.label == "1" else r.y))
        assert order["1"] == [0, 4, 8, 12] and order["2"] == [-12, -8, -4, 0]
        assert c["collisions"].count() >= 1 and c["first_collisions"].count() == 2 and c["segments"].count() >= 2
    with pytest.raises(ValueError):
        trajectories.chronology(vehicles, strict=True)


def test_lane_connections(spark):
    lane = lambda *p: [(float(x), float(y)) for x, y in p]
    l = spark.createDataFrame([("s", 0, lane((0, 0), (10, 0))), ("s", 1, lane((12, 0), (22, 0))), ("s", 2, lane((80, 80), (90, 90)))], "scene_id string, lane_idx long, verts array<struct<x:double,y:double>>")
    answer = 'ok ```[{"from": 1, "to": 2, "type": "straight"}, {"from": 1, "to": 0}, {"from": 1, "to": 5, "confidence": 0.5}]```'
    found = lanes.identify_connections(l, lanes.recorded(spark.createDataFrame([("s", answer)], "scene_id string, response string")), 5.0)
    assert [(r.from_id, r.to_id, r.confidence) for r in found.collect()] == [(1, 2, 1.0)]
    bad = spark.createDataFrame([("a", "none"), ("b", "[[1]]"), ("c", "[]")], "scene_id string, response string")
    assert sorted(r.scene_id for r in lanes.bad_responses(bad).collect()) == ["a", "b"]
    wall = spark.createDataFrame([("s", 9, lane((10.5, -5), (11.5, -5), (11.5, 5), (10.5, 5)))], "scene_id string, poly long, verts array<struct<x:double,y:double>>")
    ends = lanes.lane_endpoints(l)
    assert not lanes.connection_curves(found, ends, wall).first().free
    assert lanes.connection_curves(found, ends, wall.limit(0)).first().free


def test_cases_files_and_caches(spark, tmp_path):
    (tmp_path / "cases.json").write_text(json.dumps([{"caseId": "7"}, {"caseId": 8}, {"caseId": 9}]))
    cases = scenes.read_cases(spark, str(tmp_path / "cases.json"))
    assert [r.case_id for r in scenes.read_cases(spark, str(tmp_path / "cases.json"), 8).orderBy("ord").collect()] == [8, 9]
    assert scenes.read_cases(spark, str(tmp_path / "cases.json"), 1).count() == 3
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    status = scenes.file_status(cases, names("7_a.far", "8_b.far", "8_c.txt"), names("8_b.far"))
    assert {(r.case_id, r.status) for r in status.collect()} == {(7, "moved"), (8, "skipped"), (9, "not found")}
    cache = spark.createDataFrame([("b", True, "vehicle", 0.9), (" A", False, "background", 0.2)], "name string, is_vehicle boolean, predicted_class string, predicted_probability double")
    scenes.write_cache(cache, str(tmp_path / "cache"))
    assert {tuple(r) for r in scenes.read_cache(spark, str(tmp_path / "cache")).collect()} == {tuple(r) for r in cache.collect()}
    (tmp_path / "1_x.far").write_text("<far><scene><layer n='a'/></scene></far>")
    assert {r.scene_id for r in scenes.read_scenes(spark, str(tmp_path)).select(F.col("scene_id")).collect()} == {"1_x.far"}


def test_extras_and_curves_in_space(spark):
    body = "<far><properties a='1'><k>v</k></properties><scene><layer n='L'><item type='polycurve' pnts='0,1,2;;3,5,8;'/><item type='symbol' nam=''><item type='polycurve' pnts='9,9,9'/></item><item type='label'/><item type='label'/></layer></scene><thumb> QUJD </thumb></far>"
    files = spark.createDataFrame([("a", body), ("b", "<far>"), ("c", "<far><scene/></far>")], "path string, content string")
    extras = {r.scene_id: (r.properties, r.thumbnail) for r in scenes.parse_extras(files).collect()}
    assert extras == {"a": ({"a": "1", "k": "v"}, "QUJD"), "c": ({}, None)}
    nodes = scenes.parse_scenes(files)
    assert [[tuple(p) for p in r.verts] for r in scenes.space_curves(nodes).collect()] == [[(0, 1, 2), (3, 5, 8)]]
    assert scenes.space_bounds(scenes.space_curves(nodes)).first().half == 3
    assert [(r.scene_id, r.type, r["items"]) for r in scenes.other_items(nodes).collect()] == [("a", "label", 2)]


def test_documents_folders_and_annotations(spark, tmp_path):
    body = '<layer n="L"><item type="symbol" nam="car"><item type="polyline" vlist="0,0;1,1"/></item><item type="polyline" vlist="0,0;9,0"/></layer>'
    with kept():
        found = scene.scene_objects(nodes_of(spark, body, body), scenes.read_cache(spark, None))
        scenes.write_json(scenes.scene_documents(found), str(tmp_path / "json"), folders=3)
    rows = spark.read.json(str(tmp_path / "json")).collect()
    assert {r.scene_id for r in rows} == {"s0", "s1"} and all(len(r.vehicles) == len(r.roadway) == 1 and not r.texts for r in rows)
    lane = [(0.0, 0.0), (10.0, 0.0)]
    l = spark.createDataFrame([("s", 0, lane), ("s", 1, [(12.0, 0.0), (22.0, 0.0)])], "scene_id string, lane_idx long, verts array<struct<x:double,y:double>>")
    ends = lanes.lane_endpoints(l)
    shown = lanes.annotations(l, ends, lanes.at_intersections(ends, 5.0)).collect()
    assert sorted((r.layer, r.id) for r in shown) == [("arrow", 1), ("arrow", 2), ("lane", 0), ("lane", 1), ("marker", 1), ("marker", 2)]
    assert [tuple(p) for r in shown if (r.layer, r.id) == ("arrow", 1) for p in r.path] == [(10.0, 0.0), (15.0, 0.0)]


def test_trees_of_any_depth(spark):
    rows = [(i, i - 1 if i else None, 1.0) for i in range(200)] + [(500, 999, 1.0)]
    t = spark.createDataFrame(rows, "node long, parent long, x double").withColumn("scene", F.lit(0)).withColumn("local", geom.translation("x", F.lit(0.0)))
    world = {r.node: r.world.tx for r in scene.compose_down(t, ["scene"]).collect()}
    assert world == {i: i + 1.0 for i in range(200)}
    nested = '<item type="symbol"><item type="symbol" nam="tree"><item type="symbol" vehicle2d="T"><item type="polyline" vlist="0,0;1,1"/></item></item>{}</item>'
    deep = '<item type="symbol"><item type="symbol">{}</item></item>'.format('<item type="symbol" vehicle2d="T"><item type="polyline" vlist="0,0;1,1"/></item>')
    assert [o.category for o in objects(spark, f'<layer n="L">{nested.format("")}{nested.format(deep)}</layer>')] == ["misc", "vehicles"]


def test_freest_tries_are_those_of_all_tries_against_all_edges():
    """Connections across a yard of squares, some identical and one large: every piece of every try against every edge."""
    random = np.random.default_rng(4)
    ends = np.column_stack([random.random(60) * 40, random.random(60) * 40, random.random(60) * 6 - 3, random.random(60) * 40, random.random(60) * 40, random.random(60) * 6 - 3])
    at = np.vstack([np.repeat(random.random((12, 2)) * 40, 2, 0), [[5.0, 5.0]]])
    half = np.append(np.ones(24), 9.0)
    corners = at[:, None] + half[:, None, None] * np.array([(-1, -1), (1, -1), (1, 1), (-1, 1)])
    sides = np.concatenate([corners, np.roll(corners, -1, 1)], 2).reshape(-1, 4)
    poly = np.repeat(np.arange(25), 4)
    left = lambda a, b, c: (c[1] - a[1]) * (b[0] - a[0]) > (b[1] - a[1]) * (c[0] - a[0])
    t = np.arange(20) / 19
    want = []
    for x, y, a, u, v, b in ends:
        inside = {k for k in range(25) if (abs(x - at[k, 0]) < half[k]) and (abs(y - at[k, 1]) < half[k])}
        found = []
        for n in range(4):
            d = np.hypot(u - x, v - y) * (0.2 + n * 0.2)
            c = [(1 - t) ** 3 * p + 3 * (1 - t) ** 2 * t * r + 3 * (1 - t) * t**2 * s + t**3 * q for p, r, s, q in ((x, x - d * np.cos(a), u + d * np.cos(b), u), (y, y - d * np.sin(a), v + d * np.sin(b), v))]
            c = list(zip(*c, strict=True))
            met = {k for p, q in zip(c, c[1:], strict=False) for k, (i, j, m, o) in zip(poly, sides, strict=True) if left(p, (i, j), (m, o)) != left(q, (i, j), (m, o)) and left(p, q, (i, j)) != left(p, q, (m, o))}
            found.append((len(met | inside), n))
        want.append(min(found))
    best, met = curves.freest(ends, poly, sides, 4, 20, 0.2, 0.8)
    assert list(zip(met.tolist(), best.tolist(), strict=True)) == want
    assert len(set(best.tolist())) > 1 and met.any() and not met.all()


def test_pieces_of_curves_are_no_rows(spark):
    ends = spark.createDataFrame([("s", 0, 0.0, 0.0, 3.0), ("s", 1, 9.0, 0.0, 0.0)], "scene_id string, id long, x double, y double, heading double")
    asked = spark.createDataFrame([("s", 0, 1, 1.0)], "scene_id string, from_id long, to_id long, confidence double")
    walls = spark.createDataFrame([("s", 1, [(4.0, -1.0), (5.0, -1.0), (5.0, 1.0)])], "scene_id string, poly long, verts array<struct<x:double,y:double>>")
    plan = lanes.connection_curves(asked, ends, walls)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") <= 1
