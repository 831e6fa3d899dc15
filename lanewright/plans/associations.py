"""Queries of names, associations and joins by place, each with its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewright.functions import geom
from lanewright.operators import classify, spatial
from lanewright.plans.tables import VERTICES, Q, polylines, q, table

REACH = 40.0


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as texts and suppliers as vehicles; a nation is a scene."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    texts = c.select(F.col("c_nationkey").alias("scene"), F.col("c_custkey").alias("l"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"))
    vehicles = s.select(F.col("s_nationkey").alias("scene"), F.col("s_suppkey").alias("r"), F.col("s_acctbal").alias("x"), (F.col("s_suppkey") % 100).cast("double").alias("y"))
    return texts, vehicles


def nearest_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's one nearest vehicle, if it is near."""
    found = spatial.nearest_within(*_sides(spark, sf_dir), ["scene"], REACH)
    return found.select("scene", F.col("l").alias("text"), F.col("r").alias("vehicle"), q(F.col("dist")).alias("dist"))


def range_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vehicle's distinct near texts (here: market segments), in the order of their first mention."""
    near = spatial.within_radius(*_sides(spark, sf_dir), ["scene"], REACH)
    said = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("l"), F.col("c_mktsegment").alias("said"))
    first = near.join(said, "l").groupBy("r", "said").agg(F.min("l").alias("at"))
    texts = first.groupBy("r").agg(F.sort_array(F.collect_list(F.struct("at", "said"))).alias("t"))
    return texts.select(F.col("r").alias("vehicle"), F.array_join(F.transform("t", lambda t: t["said"]), ",").alias("texts"))


def grid_radius_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of customers of one nation within 10 of one another."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("scene"), F.col("c_custkey").alias("i"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 100).cast("double").alias("y"))
    return spatial.radius_pairs(c, ["scene"], 10.0).select("scene", "i", "j", q(F.col("dist")).alias("dist"), q(F.col("angle")).alias("angle"))


def segment_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crossing edges of one polyline."""
    e = polylines(spark, sf_dir).select("id", F.posexplode(geom.pairs("verts")).alias("n", "e"))
    e = e.select("id", "n", F.col("e.p.x").alias("x1"), F.col("e.p.y").alias("y1"), F.col("e.q.x").alias("x2"), F.col("e.q.y").alias("y2"))
    found = spatial.crossing_pairs(e.withColumnRenamed("n", "l"), e.withColumnRenamed("n", "r"), ["id"], 10.0)
    return found.where("l < r").select("id", "l", "r")


def parallel_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of one polyline's edges within 15 degrees of parallel."""
    e = polylines(spark, sf_dir).select("id", F.posexplode(geom.pairs("verts")).alias("l", "e")).select("id", "l", geom.edge_angle("e.p", "e.q").alias("a"))
    other = e.select("id", F.col("l").alias("r"), F.col("a").alias("b"))
    return e.join(other, "id").where("l < r").where(geom.are_parallel("a", "b", 0.2617993877991494)).select("id", "l", "r")


def keyword_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names classified by keywords."""
    kind, p = classify.keyword_class("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(kind, F.lit("background")).alias("kind"), F.coalesce((p * 10).cast("long"), F.lit(5)).alias("tenths"))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache that knows the names whose first letter is before m."""
    kind, p = classify.keyword_class("name")
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().where("name < 'm'")
    return classify.by_keywords(names)


def class_cache_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names looked up in the cache; misses stay null."""
    found = classify.from_cache(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name")), _cache(spark, sf_dir))
    return found.select("p_partkey", "is_vehicle", "predicted_class")


def class_cache_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct part names that the cache lacks, as a text classifier sees them."""
    missing = classify.cache_misses(table(spark, sf_dir, "part").select(F.col("p_name").alias("name")), _cache(spark, sf_dir))
    return missing.select("name", classify.normal_name("name").alias("seen"))


def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene objects by category: parts are symbols, their brand is the scene."""
    kind, p = classify.keyword_class("p_name")
    c = table(spark, sf_dir, "part").select(F.col("p_brand").alias("scene"), classify.symbol_category(classify.is_vehicle(kind, p), F.when(kind == "road marking", "road marking").otherwise(kind), p).alias("category"))
    counted = c.groupBy("scene").pivot("category", ["vehicles", "road_markings", "misc"]).count()
    return counted.select("scene", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("vehicles", "road_markings", "misc")))


def case_file_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases (orders) by what becomes of their files (line items): moved, skipped as existing, or not found."""
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case"))
    names = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'R'").select(F.concat_ws("_", "l_orderkey", "l_linenumber").alias("name"), "l_linestatus")
    files = names.groupBy(F.split("name", "_")[0].cast("long").alias("case")).agg(F.max((F.col("l_linestatus") == "F").cast("int")).alias("exists"))
    status = cases.join(files, "case", "left").select(F.when(F.col("exists").isNull(), "not found").when(F.col("exists") == 1, "skipped").otherwise("moved").alias("status"))
    return status.groupBy("status").agg(F.count(F.lit(1)).alias("cases"))


def parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first JSON array in a text that surrounds it: lane connections with their confidence."""
    from lanewright.operators.lanes import parse_connections

    n = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").select("event_id", F.coalesce(n, F.lit(0)).alias("n"))
    said = F.concat(F.lit('Here: [{"from": '), F.col("n"), F.lit(', "to": '), F.col("event_id") % 10, F.lit(', "confidence": 0.5, "type": "x"}, {"from": '), F.col("event_id") % 7, F.lit(', "to": 3}] done'))
    return parse_connections(rows.select("event_id", said.alias("response")), "response").select("event_id", F.col("from_id").cast("long").alias("from_id"), F.col("to_id").cast("long").alias("to_id"), (F.col("confidence") * 10).cast("long").alias("tenths"))


def patch_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine similarity of every embedding with the first; one row is broadcast."""
    e = table(spark, sf_dir, "embeddings")
    query = e.orderBy("vec_id").limit(1).select(F.col("embedding").alias("asked"))
    return e.crossJoin(F.broadcast(query)).select("vec_id", q(geom.cosine("embedding", "asked"), 10000).alias("similarity"))


def affine_compose_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """World transforms of a tree whose node k hangs on node k div 2: customers, by key."""
    from lanewright.operators.scene import compose_down

    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2)).alias("parent"))
    k = F.col("node")
    local = geom.from_attributes((k % 5).cast("double"), (k % 3).cast("double"), (k % 4).cast("double") * 0.1, F.lit(1.0), F.lit(0.5) + (k % 2) * 0.5)
    world = compose_down(c.withColumn("scene", F.lit(0)).withColumn("local", local), ["scene"])
    return world.select("node", q(F.col("world.tx"), 100).alias("tx"), q(F.col("world.ty"), 100).alias("ty"), q(F.col("world.a"), 100).alias("a"), q(F.col("world.d"), 100).alias("d"))


_SIDES = """texts AS (SELECT c_nationkey AS scene, c_custkey AS l, c_acctbal AS x, CAST(c_custkey % 100 AS DOUBLE) AS y, c_mktsegment AS said FROM customer),
    vehicles AS (SELECT s_nationkey AS scene, s_suppkey AS r, s_acctbal AS x, CAST(s_suppkey % 100 AS DOUBLE) AS y FROM supplier),
    near AS (SELECT t.scene, l, r, said, sqrt((v.x - t.x) * (v.x - t.x) + (v.y - t.y) * (v.y - t.y)) AS dist FROM texts t JOIN vehicles v USING (scene) WHERE dist < 40)"""
_ANY = lambda words: "(" + " OR ".join(f"contains(lower(p_name), '{w}')" for w in words) + ")"
_KIND = f"CASE WHEN {_ANY(classify.VEHICLE_WORDS)} THEN 'vehicle' WHEN {_ANY(classify.MARKING_WORDS)} THEN 'road marking' WHEN {_ANY(classify.DIRECTION_WORDS)} THEN 'direction arrow' END"
_EDGES = "e AS (SELECT * FROM (SELECT id, ord AS n, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM verts WINDOW w AS (PARTITION BY id ORDER BY ord)) WHERE x2 IS NOT NULL)"
_LEFT = lambda a, b, c: f"(({c}y - {a}y) * ({b}x - {a}x) > ({b}y - {a}y) * ({c}x - {a}x))"

QUERIES = {f.__name__: f for f in (nearest_text, range_text, grid_radius_join, segment_crossings, parallel_pairs, keyword_class, class_cache_join, class_cache_miss, category_counts, case_file_status, parse_response, patch_similarity, affine_compose_recursive)}
ORACLE_SQL = {
    "nearest_text": f"WITH {_SIDES} SELECT scene, l AS text, r AS vehicle, {Q('dist')} AS dist FROM near QUALIFY row_number() OVER (PARTITION BY l ORDER BY dist, r) = 1",
    "range_text": f"""WITH {_SIDES}, first AS (SELECT r, said, min(l) AS at_ FROM near GROUP BY r, said)
        SELECT r AS vehicle, string_agg(said, ',' ORDER BY at_) AS texts FROM first GROUP BY r""",
    "grid_radius_join": f"""WITH p AS (SELECT c_nationkey AS scene, c_custkey AS i, c_acctbal AS x, CAST(c_custkey % 100 AS DOUBLE) AS y FROM customer),
        d AS (SELECT a.scene, a.i, b.i AS j, sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) AS dist, atan2(b.y - a.y, b.x - a.x) AS angle FROM p a JOIN p b ON a.scene = b.scene AND a.i < b.i)
        SELECT scene, i, j, {Q('dist')} AS dist, {Q('angle')} AS angle FROM d WHERE dist <= 10""",
    "segment_crossings": f"""WITH {VERTICES}, {_EDGES}, s AS (SELECT id, n, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS by_ FROM e)
        SELECT p.id, p.n AS l, s.n AS r FROM (SELECT id, n, ax, ay, bx, by_ FROM s) p JOIN s ON p.id = s.id AND p.n < s.n
        WHERE ((s.by_ - p.ay) * (s.ax - p.ax) > (s.ay - p.ay) * (s.bx - p.ax)) <> ((s.by_ - p.by_) * (s.ax - p.bx) > (s.ay - p.by_) * (s.bx - p.bx))
          AND ((s.ay - p.ay) * (p.bx - p.ax) > (p.by_ - p.ay) * (s.ax - p.ax)) <> ((s.by_ - p.ay) * (p.bx - p.ax) > (p.by_ - p.ay) * (s.bx - p.ax))""",
    "parallel_pairs": f"""WITH {VERTICES}, {_EDGES}, a AS (SELECT id, n, atan2(y2 - y1, x2 - x1) AS a FROM e),
        d AS (SELECT p.id, p.n AS l, s.n AS r, abs(atan2(sin(p.a - s.a), cos(p.a - s.a))) AS d FROM a p JOIN a s ON p.id = s.id AND p.n < s.n)
        SELECT id, l, r FROM d WHERE d < 0.2617993877991494 OR d > pi() - 0.2617993877991494""",
    "keyword_class": f"SELECT p_partkey, coalesce({_KIND}, 'background') AS kind, CAST(CASE {_KIND} WHEN 'vehicle' THEN 8 WHEN 'road marking' THEN 7 WHEN 'direction arrow' THEN 7 ELSE 5 END AS BIGINT) AS tenths FROM part",
    "class_cache_join": f"SELECT p_partkey, CASE WHEN p_name < 'm' THEN coalesce({_KIND}, '') = 'vehicle' END AS is_vehicle, CASE WHEN p_name < 'm' THEN coalesce({_KIND}, 'background') END AS predicted_class FROM part",
    "class_cache_miss": "SELECT DISTINCT p_name AS name, lower(replace(p_name, '_', ' ')) AS seen FROM part WHERE p_name >= 'm'",
    "category_counts": f"""SELECT p_brand AS scene, count(*) FILTER (WHERE k = 'vehicle') AS vehicles, count(*) FILTER (WHERE k = 'road marking') AS road_markings,
        count(*) FILTER (WHERE k NOT IN ('vehicle', 'road marking')) AS misc FROM (SELECT p_brand, coalesce({_KIND}, 'background') AS k FROM part) GROUP BY p_brand""",
    "case_file_status": """WITH f AS (SELECT l_orderkey AS c, bool_or(l_linestatus = 'F') AS e FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1)
        SELECT CASE WHEN e IS NULL THEN 'not found' WHEN e THEN 'skipped' ELSE 'moved' END AS status, count(*) AS cases FROM orders LEFT JOIN f ON c = o_orderkey GROUP BY 1""",
    "parse_response": """WITH n AS (SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), 0) AS n FROM events)
        SELECT event_id, n AS from_id, event_id % 10 AS to_id, CAST(5 AS BIGINT) AS tenths FROM n UNION ALL SELECT event_id, event_id % 7, CAST(3 AS BIGINT), CAST(10 AS BIGINT) FROM n""",
    "patch_similarity": f"""WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), a AS (SELECT v FROM e ORDER BY vec_id LIMIT 1)
        SELECT vec_id, {Q('list_cosine_similarity(e.v, a.v)', 10000)} AS similarity FROM e, a""",
    "affine_compose_recursive": f"""WITH RECURSIVE l AS (SELECT c_custkey AS node, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent, (c_custkey % 4) * 0.1 AS r, 1.0 AS sx, 0.5 + (c_custkey % 2) * 0.5 AS sy,
            CAST(c_custkey % 5 AS DOUBLE) AS px, CAST(c_custkey % 3 AS DOUBLE) AS py FROM customer),
        m AS (SELECT node, parent, cos(r) * sx AS a, -sin(r) * sy AS b, px AS tx, sin(r) * sx AS c, cos(r) * sy AS d, py AS ty FROM l),
        w AS (SELECT node, a, b, tx, c, d, ty FROM m WHERE parent IS NULL
            UNION ALL SELECT m.node, w.a * m.a + w.b * m.c, w.a * m.b + w.b * m.d, w.a * m.tx + w.b * m.ty + w.tx, w.c * m.a + w.d * m.c, w.c * m.b + w.d * m.d, w.c * m.tx + w.d * m.ty + w.ty
            FROM w JOIN m ON m.parent = w.node)
        SELECT node, {Q('tx', 100)} AS tx, {Q('ty', 100)} AS ty, {Q('a', 100)} AS a, {Q('d', 100)} AS d FROM w""",
}
