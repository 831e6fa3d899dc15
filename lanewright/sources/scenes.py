"""Scene files, case lists and name caches as tables; scenes, summaries and draw lists back to files.

Files that cannot be read are rows too: their error goes to a quarantine table instead of failing the job.
"""

from __future__ import annotations

import contextlib
import io
from collections.abc import Iterator
from types import SimpleNamespace
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NODES = "scene_id string, node_id long, parent_id long, depth int, path array<long>, ord long, tag string, type string, layer string, attrs map<string,string>, lndata map<string,string>, error string"
#: Rows of nodes that are passed on together; those of one file stay together.
MOST_ROWS = 10_000


def scene_nodes(content: bytes, scene_id: str) -> list[tuple]:
    """The scene's layers and items as rows, parents before children, numbered in document order.

    A scan without a tree: elements are told as they begin and end, so a large file never stands in memory; only its
    rows do. ``path``: the numbers from the scene down to the node itself, so that what goes down a tree needs no loop.
    """
    rows: list[tuple] = []
    styles: dict[int, dict] = {}
    open_: list[tuple[str, list[int] | None, str | None]] = []  # tag, path (None: no node) and layer of what has begun

    def start(tag: str, attributes: dict[str, str]) -> None:
        path = None
        parent, above, layer = open_[-1] if open_ else ("", None, None)
        is_scene = tag == "scene" and not rows and len(open_) < 2
        if is_scene or above is not None and tag != "lndata" and (parent != "item" or tag == "item"):
            number = len(rows)
            layer, path = attributes.get("n") if tag == "layer" else layer, [*(above or ()), number]
            rows.append((scene_id, number, above[-1] if above else None, len(path) - 1, path, number, tag, attributes.get("type"), layer, attributes))
        elif above is not None and tag == "lndata":
            styles.setdefault(above[-1], attributes)
        open_.append((tag, path, layer))

    parser = ElementTree.XMLParser(target=SimpleNamespace(start=start, end=lambda _: open_.pop(), close=lambda: None))
    parser.feed(content or b"")
    parser.close()
    if not rows:
        raise ValueError("no scene element")
    return [(*r, styles.get(r[1]), None) for r in rows]


def scene_extras(content: bytes) -> tuple[dict, str | None]:
    """Properties of a scene file (attributes and children's texts of its ``properties``) and its thumbnail's text."""
    properties: dict[str, str] = {}
    thumb, open_ = None, []
    for event, element in ElementTree.iterparse(io.BytesIO(content), ("start", "end")):
        if event == "start":
            open_.append(element.tag)
            continue
        if open_[1:] == ["properties"]:
            properties |= element.attrib
        elif len(open_) == 3 and open_[1] == "properties":
            properties.setdefault(element.tag, element.text or "")
        elif open_[1:] == ["thumb"] and thumb is None:
            thumb = (element.text or "").strip()
        if len(open_) == 2 or len(open_) > 3 or open_[1:2] == ["scene"]:
            element.clear()
        open_.pop()
    return properties, thumb


def parse_scenes(files: DataFrame, id_column: str = "path", content_column: str = "content") -> DataFrame:
    """NODES of every file; a file that is no scene gives one row with its error."""

    target = to_arrow_schema(StructType.fromDDL(NODES))

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        for k, f in enumerate(target):
            if pa.types.is_map(f.type):
                columns[k] = [None if v is None else list(v.items()) for v in columns[k]]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target, strict=True)], schema=target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for scene, content in zip(b["scene_id"].to_pylist(), b["content"], strict=True):
                try:
                    rows += scene_nodes(content.as_py(), scene)
                except (ElementTree.ParseError, ValueError) as e:
                    rows.append((scene, *[None] * 10, str(e)))
                if len(rows) >= MOST_ROWS:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    return files.select(F.col(id_column).alias("scene_id"), F.col(content_column).cast("binary").alias("content")).mapInArrow(run, NODES)


def parse_extras(files: DataFrame, id_column: str = "path", content_column: str = "content") -> DataFrame:
    """scene_id, properties (map), thumbnail of every readable file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for scene, content in zip(frame["scene_id"], frame["content"], strict=True):
                with contextlib.suppress(ElementTree.ParseError):
                    rows.append((scene, *scene_extras(content)))
            yield pd.DataFrame(rows, columns=["scene_id", "properties", "thumbnail"]).astype(object)

    return files.select(F.col(id_column).alias("scene_id"), F.col(content_column).cast("binary").alias("content")).mapInPandas(run, "scene_id string, properties map<string,string>, thumbnail string")


def space_curves(nodes: DataFrame) -> DataFrame:
    """scene_id, ord, layer, verts (x, y, z) of the polycurves that lie in layers: the minimal reading in three dimensions."""
    said = F.filter(F.split(F.coalesce(F.col("attrs")["pnts"], F.lit("")), ";"), lambda p: p != "")
    number = lambda p, k: F.get(F.split(p, ","), F.lit(k)).cast("double")
    verts = F.transform(said, lambda p: F.struct(*(number(p, k).alias(n) for k, n in enumerate("xyz"))))
    return nodes.where("tag = 'item' AND type = 'polycurve' AND depth = 2 AND layer IS NOT NULL").select("scene_id", "ord", "layer", verts.alias("verts"))


def other_items(nodes: DataFrame) -> DataFrame:
    """scene_id, type, items: the layers' items that are neither polycurves nor symbols, by type."""
    return nodes.where("tag = 'item' AND depth = 2 AND type NOT IN ('polycurve', 'symbol')").groupBy("scene_id", "type").agg(F.count(F.lit(1)).alias("items"))


def space_bounds(curves: DataFrame) -> DataFrame:
    """The bounds of all curves' points in three dimensions, and half the largest range."""
    p = curves.select(F.explode("verts").alias("p")).select("p.*")
    sides = p.agg(*(f(k).alias(f"{k}{n}") for k in "xyz" for f, n in ((F.min, "min"), (F.max, "max"))))
    return sides.withColumn("half", F.greatest(*(F.col(f"{k}max") - F.col(f"{k}min") for k in "xyz")) / 2)


def batch_summary(results: DataFrame, column: str = "message") -> DataFrame:
    """total, successful, failed: a batch's files by whether their message begins with "Success"."""
    good = F.coalesce(F.startswith(column, F.lit("Success")), F.lit(False))
    return results.agg(F.count(F.lit(1)).alias("total"), F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"))


def read_scenes(spark: SparkSession, path: str, suffix: str = "*.far") -> DataFrame:
    """NODES of all files below a path; the scene id is the file's name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).load(path)
    return parse_scenes(files.withColumn("name", F.element_at(F.split("path", "/"), -1)), "name")


def quarantine(nodes: DataFrame) -> DataFrame:
    """scene_id, stage, error of the files that could not be read."""
    return nodes.where("error IS NOT NULL").select("scene_id", F.lit("parse").alias("stage"), "error")


def random_scene(files: DataFrame, seed: int) -> DataFrame:
    """One file, the same for the same seed."""
    return files.orderBy(F.xxhash64(F.lit(seed), "path"), "path").limit(1)


def read_cases(spark: SparkSession, path: str, resume_from: int | None = None) -> DataFrame:
    """caseId and its ordinal in a JSON array of cases; from a given case on, or all if that is not there."""
    cases = spark.read.json(path, multiLine=True).select(F.col("caseId").cast("int").alias("case_id"), F.monotonically_increasing_id().alias("_at"))
    cases = cases.select("case_id", (F.row_number().over(Window.orderBy("_at")) - 1).alias("ord"))
    if resume_from is None:
        return cases
    first = cases.where(F.col("case_id") == resume_from).agg(F.min("ord").alias("_first"))
    return cases.crossJoin(F.broadcast(first)).where(F.col("ord") >= F.coalesce("_first", F.lit(0))).drop("_first")


def file_status(cases: DataFrame, files: DataFrame, existing: DataFrame) -> DataFrame:
    """case_id, name, status of each case's files ``{case_id}_*.far``: moved, skipped (it exists), or not found."""
    named = files.where(F.endswith("name", F.lit(".far"))).select("name", F.split("name", "_")[0].try_cast("int").alias("case_id"))
    known = existing.select("name", F.lit(True).alias("_there")).distinct()
    both = cases.select("case_id").join(named, "case_id", "left").join(known, "name", "left")
    status = F.when(F.col("name").isNull(), "not found").when(F.col("_there"), "skipped").otherwise("moved")
    return both.select("case_id", "name", status.alias("status"))


def downloadable(listing: DataFrame, existing: DataFrame) -> DataFrame:
    """Listed scene files (filename, objectid) worth fetching: of a known suffix, with an object, not there yet."""
    wanted = listing.where(F.endswith("filename", F.lit(".far")) | F.endswith("filename", F.lit(".blz"))).where("objectid IS NOT NULL")
    return wanted.join(existing.select(F.col("name").alias("filename")), "filename", "left_anti")


CACHE = "map<string,struct<is_vehicle:boolean,predicted_class:string,predicted_probability:double>>"


def read_cache(spark: SparkSession, path: str | None) -> DataFrame:
    """name, is_vehicle, predicted_class, predicted_probability of a JSON map of names; no path, no rows."""
    if path is None:
        return spark.createDataFrame([], "name string, is_vehicle boolean, predicted_class string, predicted_probability double")
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", CACHE)).alias("name", "_c")).select("name", "_c.*")


def write_cache(cache: DataFrame, path: str) -> None:
    """The map as one JSON object, sorted by name: names are few, as each distinct one is classified once."""
    entry = F.struct("name", F.struct("is_vehicle", "predicted_class", "predicted_probability").alias("value"))
    whole = cache.agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("m"))
    whole.select(F.to_json("m")).coalesce(1).write.text(path)


KINDS = ("vehicles", "roadway", "road_markings", "texts", "misc")


def scene_documents(objects: DataFrame) -> DataFrame:
    """A row a scene: scene_id and a list of its objects, in document order, for each category."""
    one = F.struct(*(F.col(f"`{c}`") for c in ["ord", *(c for c in objects.columns if c not in ("scene_id", "category", "ord"))]))
    return objects.groupBy("scene_id").agg(*(F.sort_array(F.collect_list(F.when(F.col("category") == k, one))).alias(k) for k in KINDS))


def write_json(df: DataFrame, path: str, folders: int = 64) -> None:
    """Rows as JSON lines, scenes dealt to ``folders`` folders by their hash, so that their number does not set that of files."""
    dealt = df.withColumn("folder", F.pmod(F.xxhash64("scene_id"), F.lit(folders)).cast("int"))
    dealt.repartition("folder").sortWithinPartitions("folder", "scene_id").write.partitionBy("folder").json(path)


def summary(objects: DataFrame) -> DataFrame:
    """Objects of each scene by category."""
    counted = objects.groupBy("scene_id").pivot("category", list(KINDS)).count()
    return counted.select("scene_id", *(F.coalesce(k, F.lit(0)).alias(k) for k in KINDS))


def summary_lines(vehicles: DataFrame) -> DataFrame:
    """A line for each vehicle with its centre."""
    return vehicles.select("scene_id", F.format_string("%s at (%.2f, %.2f)", F.coalesce("name", F.lit("unnamed")), "center.x", "center.y").alias("line"))


def draw_list(objects: DataFrame) -> DataFrame:
    """layer, path, style and color_key of what a renderer draws of each object."""
    style = F.when(F.coalesce("dashed", F.lit(False)), "dashed").otherwise("solid")
    label = F.coalesce(F.element_at(F.filter("associated_text", lambda t: t.rlike(r"^\s*\d+\s*$")), 1), F.lit("0"))
    return objects.select("scene_id", "ord", F.col("category").alias("layer"), F.col("verts").alias("path"), style.alias("style"), (F.trim(label).try_cast("int") % 5).alias("color_key"))


def base64_image(image: str = "content"):
    """Bytes of a rendered image as base64."""
    return F.base64(F.col(image))
