"""Scene trees to flat objects: transforms and names go down the tree, boxes and styles come up it.

A node carries the path of its ancestors, so transforms and names of any depth come from one join and one grouping.
In trees that are mere adjacency lists products double their reach (:func:`compose_down`). Document order (``ord``) is carried
everywhere and decides ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewright.functions import geom
from lanewright.operators import classify, spatial
from lanewright.operators.config import SceneConfig
from lanewright.operators.kept import keep
from lanewright.sources.shared import discard, materialize


def compose_down(nodes: DataFrame, scene: list[str]) -> DataFrame:
    """Add world, the product of the local transforms from the root down; nodes have node, parent, local.

    Each round doubles how far up a node's product reaches, so the number of joins grows with the logarithm of the
    depth. Nodes without a root above them have no row; nodes that hang on themselves raise.
    """
    state = materialize(nodes.withColumn("world", F.col("local")).withColumn("_up", F.col("parent")), "tree")
    for _ in range(64):
        if state.where("_up IS NOT NULL").isEmpty():
            return state.drop("_up")
        above = state.select(*scene, F.col("node").alias("_up"), F.col("world").alias("_above"), F.col("_up").alias("_next"))
        rest = state.where("_up IS NOT NULL").join(above, [*scene, "_up"]).withColumn("world", geom.compose("_above", "world"))
        before, state = state, materialize(state.where("_up IS NULL").unionByName(rest.drop("_up", "_above").withColumnRenamed("_next", "_up")), "tree")
        discard(before)
    raise ValueError("nodes hang on themselves")


def _number(attribute: str, default: float) -> Column:
    return F.coalesce(F.col("attrs")[attribute].try_cast("double"), F.lit(default))


def _flag(value: Column, wide: bool) -> Column:
    return F.coalesce(value.isin(*(("T", "t", "true") if wide else ("T",))), F.lit(False))


def local_transform(config: SceneConfig) -> Column:
    """Of an item's attributes; the rs profile knows other names for a scale of 1."""
    sx, sy = _number("scalex", 1.0), _number("scaley", 1.0)
    if config.profile == "rs":
        sx, sy = F.when(sx == 1.0, _number("sclx", 1.0)).otherwise(sx), F.when(sy == 1.0, _number("scly", 1.0)).otherwise(sy)
    return geom.from_attributes(_number("posx", 0.0), _number("posy", 0.0), _number("oriz", 0.0), sx, sy)


def placed_nodes(nodes: DataFrame, config: SceneConfig) -> DataFrame:
    """Nodes with world transform, name and whether a symbol holds them.

    In all profiles but rs an item inside a symbol has no transform of its own. Names: the nearest one that is not
    empty on the way up to the scene, or (rs) the item's own.
    """
    good = nodes.where("error IS NULL")
    parents = good.select("scene_id", F.col("node_id").alias("parent_id"), (F.col("type") == "symbol").alias("in_symbol"))
    both = good.join(parents, ["scene_id", "parent_id"], "left").withColumn("in_symbol", F.coalesce("in_symbol", F.lit(False)))
    own = F.col("tag") == "item"
    if config.profile != "rs":
        own = own & (~F.col("in_symbol") | (F.col("type") == "symbol"))
    local = F.when(own, local_transform(config)).otherwise(geom.identity())
    name = F.nullif(F.col("attrs")["nam"], F.lit(""))
    rows = both.withColumnsRenamed({"node_id": "node", "parent_id": "parent"}).withColumn("local", local).withColumn("name", name)
    own_rows = rows.select("scene_id", F.col("node").alias("above"), "depth", "local", F.col("name").alias("_name"))
    down = rows.select("scene_id", "node", F.explode("path").alias("above")).join(own_rows, ["scene_id", "above"])
    steps = F.sort_array(F.collect_list(F.struct("depth", "local")))
    placed = down.groupBy("scene_id", "node").agg(steps.alias("_s"), F.max(F.when(F.col("_name").isNotNull(), F.struct("depth", "_name"))).alias("_n"))
    world = F.aggregate("_s", geom.identity(), lambda m, s: geom.compose(m, s["local"]))
    placed = placed.select("scene_id", "node", world.alias("world"), F.col("_n._name").alias("_nearest"))
    out = rows.join(placed, ["scene_id", "node"])
    return (out if config.profile == "rs" else out.withColumn("name", F.col("_nearest"))).drop("_nearest")


def primitives(placed: DataFrame, config: SceneConfig) -> DataFrame:
    """Geometry, text and style of the items that are no symbols; items without vertices are gone.

    Polycurves: two controls a segment make cubic pieces, one makes quadratic ones, none a smooth curve (rs: the
    anchors in both these cases); other counts give nothing (rs, legacy, explore: the anchors).
    """
    rs = config.profile == "rs"
    items = placed.where("tag = 'item' AND type <> 'symbol'")
    attr = lambda k: F.col("attrs")[k]
    line = lambda k: F.col("lndata")[k]
    arrows = _flag(attr("arrowshows"), True) | _flag(attr("arrowshowe"), True) if rs else _flag(line("arrowshows"), False) | _flag(line("arrowshowe"), False)
    items = items.where((F.col("type") != "line") | ~arrows)
    anchors, controls = geom.parse_vertices(F.coalesce(attr("pnts"), F.lit(""))), geom.parse_vertices(F.coalesce(attr("ctrl"), F.lit("")))
    items = items.withColumn("_anchors", anchors).withColumn("_controls", F.coalesce(controls, F.array().cast(f"array<{geom.POINT}>")))
    items = items.withColumn("_given", _flag(attr("closed"), rs))
    near = geom.nearly_closed("_anchors", config.closure_threshold, by_diagonal=rs)
    closed = F.when(F.col("type") == "polycurve", F.col("_given") | near).otherwise(F.col("_given"))
    n, c = F.size("_anchors"), F.size("_controls")
    fitted = geom.interpolate_curve("_anchors", "_controls", config.bezier_samples)
    if rs:
        curve = F.when(c == 2 * (n - 1), fitted).otherwise(F.col("_anchors"))
    elif config.profile == "py":
        curve = F.when(c == 0, geom.composite_bezier("_anchors")).otherwise(fitted)
    else:
        curve = F.when(c == 2 * (n - 1), fitted).otherwise(F.col("_anchors"))
    items = items.withColumn("_curve", curve).withColumn("_closed", closed)
    curve, closed = F.col("_curve"), F.col("_closed")
    verts = (
        F.when(F.col("type") == "polyline", geom.parse_vertices(F.coalesce(attr("vlist"), F.lit(""))))
        .when(F.col("type") == "polycurve", curve if config.profile == "legacy" else geom.close_ring(curve, closed))
        .when(F.col("type") == "line", F.array(geom.point(_number("pntSx", 0.0), _number("pntSy", 0.0)), geom.point(_number("pntEx", 0.0), _number("pntEy", 0.0))))
        .when(F.col("type") == "label", F.array(geom.point(_number("sizex", 0.0) / 2, _number("sizey", 0.0) / 2)))
    )
    if rs:
        verts = verts.when(F.col("type") == "ellipse", F.array(geom.point(_number("sizx", 0.0) / 2, _number("sizy", 0.0) / 2)))
        verts = verts.when(F.col("type") == "flexconcretebarrier", F.col("_anchors"))
    style = (lambda k: attr(k)) if rs else line
    dashed, thick = F.coalesce(style("lt").try_cast("double") == 1, F.lit(False)), F.coalesce(style("thickness").try_cast("double") > 0, F.lit(False))
    if config.profile == "explore":
        thick = F.coalesce(style("thickness") > "0", F.lit(False))
    if config.profile == "legacy":
        thick = F.lit(False)
    text = F.when(F.col("type") == "label", attr("text") if rs else F.coalesce(attr("text"), F.lit("")))
    floats = [line(k).try_cast("double").alias(k) for k in ("lt", "thickness", "dshlen", "dshspc", "lnspc", "extrude", "dotradius", "dotspacing", "arrowsize")]
    flags = [_flag(line(k), False).alias(k) for k in ("dotfilled", "arrowshows", "arrowshowe")]
    # kept, as the optimizer would push the filter below and repeat every curve in it
    shaped = keep(items.withColumn("verts", verts).drop("_anchors", "_controls", "_curve"))
    out = shaped.where("size(verts) > 0").withColumn("center", geom.mean_point("verts"))
    return out.select(
        "scene_id", "node", "parent", "ord", "type", "name", "layer", "in_symbol", "verts", geom.apply_affine_all("world", "verts").alias("tverts"), "center",
        geom.apply_affine("world", "center").alias("tcenter"), geom.bbox("verts").alias("bbox"), F.col("world").alias("transform"), _flag(attr("vehicle2d"), rs).alias("vehicle2d"),
        text.alias("text"), dashed.alias("dashed"), thick.alias("thick"), F.col("_closed").alias("closed"), F.when(F.col("lndata").isNotNull(), F.struct(*floats, *flags)).alias("lndata"),
    )


def symbols(placed: DataFrame, parts: DataFrame, config: SceneConfig) -> DataFrame:
    """Symbols with the box of all that they hold, in untransformed coordinates, its centre, and whether any is dashed.

    An empty symbol has an empty box and no centre (rs drops it).
    """
    own = placed.where("type = 'symbol'").select("scene_id", "node", "parent", "ord", "name", "layer", "depth", "path", "in_symbol", F.col("world").alias("transform"), _flag(F.col("attrs")["vehicle2d"], config.profile == "rs").alias("vehicle2d"))
    sides = ("xmin", "ymin", "xmax", "ymax")
    held = parts.where("in_symbol").select("scene_id", "node", *(F.col(f"bbox.{k}").alias(k) for k in sides), "dashed")
    up = placed.where("tag = 'item' AND type <> 'symbol'").select("scene_id", "node", F.explode("path").alias("holder"))
    every = held.join(up, ["scene_id", "node"])
    boxes = every.groupBy("scene_id", F.col("holder").alias("node")).agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"), F.bool_or("dashed").alias("dashed"))
    both = own.join(boxes, ["scene_id", "node"], "inner" if config.profile == "rs" else "left")
    inf = float("inf")
    box = F.struct(*(F.coalesce(k, F.lit(inf if k.endswith("min") else -inf)).alias(k) for k in sides))
    center = F.when(F.col("xmin").isNotNull(), geom.bbox_center(box))
    out = both.withColumn("bbox", box).withColumn("center", center).withColumn("dashed", F.coalesce("dashed", F.lit(False)))
    return out.withColumn("tcenter", F.when(F.col("center").isNotNull(), geom.apply_affine("transform", "center"))).drop(*sides)


def classified_symbols(found: DataFrame, cache: DataFrame, config: SceneConfig, classifier=classify.by_keywords) -> DataFrame:
    """Add is_vehicle, predicted_class and predicted_probability: the vehicle flag, then the name, then nested symbols.

    A named symbol is judged by its name alone (rs: a name without a keyword leaves the matter to nested symbols).
    """
    if config.profile == "rs":
        kind, p = classify.keyword_class("name")
        said = found.withColumn("_kind", kind).withColumn("_p", p).withColumn("_is", kind == "vehicle").withColumn("_known", kind.isNotNull())
    else:
        table = classify.classify_names(found.where("NOT vehicle2d"), cache, classifier)
        said = found.join(table.select("name", F.col("is_vehicle").alias("_is"), F.col("predicted_class").alias("_kind"), F.col("predicted_probability").alias("_p")), "name", "left").withColumn("_known", F.col("name").isNotNull())
    first = said.select(
        *found.columns, F.when(F.col("vehicle2d"), True).when(F.col("_known"), F.col("_is")).alias("is_vehicle"),
        F.when(F.col("vehicle2d"), "vehicle").otherwise(F.col("_kind")).alias("predicted_class"), F.when(F.col("vehicle2d"), 1.0).otherwise(F.col("_p")).alias("predicted_probability"),
    )
    return _from_nested(first, config)


def _from_nested(found: DataFrame, config: SceneConfig) -> DataFrame:
    """Undecided symbols are vehicles if one that they hold is, and have its class: the first in document order that has
    only undecided symbols between. All depths at once, by the paths that symbols carry."""
    holders = found.select("scene_id", F.col("node").alias("holder"), F.col("depth").alias("_depth"), F.col("is_vehicle").isNull().alias("_open"), F.col("in_symbol").alias("_inner"))
    held = found.where("is_vehicle AND in_symbol").select("scene_id", "node", "ord", "predicted_class", "predicted_probability", F.explode(F.slice("path", 1, F.size("path") - 1)).alias("holder"))
    above = held.join(holders, ["scene_id", "holder"])
    stops = F.when(~F.col("_open"), F.col("_depth")).when(~F.col("_inner"), F.col("_depth") - 1)  # a decided symbol, or what holds an outermost one
    last = F.max(stops).over(Window.partitionBy("scene_id", "node"))
    reached = above.withColumn("_last", last).where("_open AND _depth > coalesce(_last, -1)")
    best = reached.groupBy("scene_id", F.col("holder").alias("node")).agg(F.min(F.struct("ord", "predicted_class", "predicted_probability")).alias("_b"))
    take = F.col("is_vehicle").isNull() & F.col("_b").isNotNull()
    found = found.join(best, ["scene_id", "node"], "left").select(
        *(c for c in found.columns if c not in ("is_vehicle", "predicted_class", "predicted_probability")),
        F.when(take, True).otherwise(F.col("is_vehicle")).alias("is_vehicle"),
        F.when(take, F.coalesce("predicted_class", F.col("_b.predicted_class"))).otherwise(F.col("predicted_class")).alias("predicted_class"),
        F.when(take, F.coalesce("predicted_probability", F.col("_b.predicted_probability"))).otherwise(F.col("predicted_probability")).alias("predicted_probability"),
    )
    rest = ("background", 0.5) if config.profile == "rs" else (None, None)
    return found.withColumns({
        "predicted_class": F.coalesce("predicted_class", F.lit(rest[0])), "predicted_probability": F.coalesce("predicted_probability", F.lit(rest[1]).cast("double")),
        "is_vehicle": F.coalesce("is_vehicle", F.lit(False)),
    })


def associated_texts(vehicles: DataFrame, texts: DataFrame, parts: DataFrame, config: SceneConfig) -> DataFrame:
    """scene_id, node, associated_text: the vehicle's own labels, then near texts.

    py: each text goes to its one nearest vehicle, repeats stay. rs: a vehicle takes every near text once.
    """
    v = vehicles.where("tcenter IS NOT NULL").select("scene_id", F.col("ord").alias("r"), F.col("tcenter.x").alias("x"), F.col("tcenter.y").alias("y"))
    t = texts.select("scene_id", F.col("ord").alias("l"), F.col("tcenter.x").alias("x"), F.col("tcenter.y").alias("y"))
    near = (spatial.within_radius if config.profile == "rs" else spatial.nearest_within)(t, v, ["scene_id"], config.text_distance)
    said = near.join(texts.select("scene_id", F.col("ord").alias("l"), "text"), ["scene_id", "l"]).select("scene_id", F.col("r").alias("ord"), F.lit(1).alias("_k"), F.col("l").alias("_at"), "text")
    own = parts.where("in_symbol AND type = 'label'").select("scene_id", F.col("parent").alias("node"), F.lit(0).alias("_k"), F.col("ord").alias("_at"), "text")
    own = own.join(vehicles.select("scene_id", "node", "ord"), ["scene_id", "node"]).select("scene_id", "ord", "_k", "_at", "text")
    every = said.unionByName(own).groupBy("scene_id", "ord").agg(F.sort_array(F.collect_list(F.struct("_k", "_at", "text"))).alias("_t"))
    out = F.transform("_t", lambda t: t["text"])
    return every.select("scene_id", "ord", (F.array_distinct(out) if config.profile == "rs" else out).alias("associated_text"))


def scalebars(placed: DataFrame) -> DataFrame:
    """The first scalebar of each scene: its position and size."""
    bars = placed.where("type = 'scalebar'").select("scene_id", "ord", geom.point(_number("px", 0.0), _number("py", 0.0)).alias("position"), geom.point(_number("szx", 0.0), _number("szy", 0.0)).alias("size"))
    return bars.groupBy("scene_id").agg(F.min_by("position", "ord").alias("position"), F.min_by("size", "ord").alias("size"))


def scene_objects(nodes: DataFrame, cache: DataFrame, config: SceneConfig = SceneConfig(), classifier=classify.by_keywords) -> DataFrame:
    """All objects of all scenes with their category: vehicles, roadway, road_markings, texts, misc.

    Objects are the symbols and primitives that no symbol holds; ``ord`` is the document order.
    """
    placed = keep(placed_nodes(keep(nodes, "nodes"), config))  # files are read once, not for each use of their nodes
    parts = keep(primitives(placed, config))
    found = classified_symbols(symbols(placed, parts, config), cache, config, classifier)
    top = found.where("NOT in_symbol")
    top = top.withColumn("category", classify.symbol_category(F.col("is_vehicle"), F.col("predicted_class"), F.col("predicted_probability"), config.profile == "rs"))
    loose = parts.where("NOT in_symbol").withColumn("category", classify.primitive_category(F.col("type"), F.col("layer") if config.profile == "legacy" else None))
    vehicles = top.where("category = 'vehicles'")
    texts = associated_texts(vehicles, loose.where("category = 'texts'"), parts, config)
    none = F.array().cast("array<string>")
    top = top.join(texts, ["scene_id", "ord"], "left").withColumn("type", F.lit("symbol")).withColumn("associated_text", F.when(F.col("category") == "vehicles", F.coalesce("associated_text", none)))
    return top.drop("depth", "path").unionByName(loose, allowMissingColumns=True)
