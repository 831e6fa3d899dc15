"""Scene files are read once, in batches of whole files."""

from __future__ import annotations

from lanewright.operators import kept, scene
from lanewright.sources import scenes

FILE = '<far><scene><layer n="L"><item type="symbol" nam="car"><item type="polyline" vlist="0,0;4,2"><lndata lt="1"/></item></item></layer></scene></far>'


def test_files_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)
    files = spark.createDataFrame([(f"s{i}", FILE) for i in range(6)], "path string, content string")

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    nodes = scenes.parse_scenes(files)
    with kept.kept():
        objects = scene.scene_objects(nodes.mapInArrow(counted, nodes.schema), scenes.read_cache(spark, None))
        assert objects.count() == 6
    assert seen.value == 6 * 4


def test_files_that_are_none(spark):
    files = spark.createDataFrame([("a", FILE), ("b", "<far/>"), ("c", None), ("d", "<far>")], "path string, content string")
    rows = scenes.parse_scenes(files).collect()
    assert {r.scene_id: r.error for r in rows if r.error} == {"b": "no scene element", "c": "no element found: line 1, column 0", "d": "no element found: line 1, column 5"}
    assert [(r.node_id, r.parent_id, r.path, r.attrs.get("nam"), r.lndata) for r in rows if r.scene_id == "a"] == [
        (0, None, [0], None, None), (1, 0, [0, 1], None, None), (2, 1, [0, 1, 2], "car", None), (3, 2, [0, 1, 2, 3], None, {"lt": "1"}),
    ]
