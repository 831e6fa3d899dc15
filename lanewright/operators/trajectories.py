"""Vehicle poses in order, collisions between vehicles, and paths fitted through them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lanewright.functions import geom, kernels
from lanewright.operators.kept import keep
from lanewright.plans.grouped import map_chunks, map_groups

DIGITS = r"^\s*\d+\s*$"


def unlabelled(vehicles: DataFrame) -> DataFrame:
    """scene_id, stage, error of the scenes with a vehicle that has no number among its texts."""
    bad = vehicles.where(~F.exists("associated_text", lambda t: t.rlike(DIGITS))).groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    return bad.select("scene_id", F.lit("labels").alias("stage"), F.format_string("%d unlabelled vehicles", "n").alias("error"))


def vehicle_poses(vehicles: DataFrame) -> DataFrame:
    """scene_id, label (the first number among the texts, verbatim), ord, x, y, theta, box of the labelled vehicles."""
    label = F.get(F.filter("associated_text", lambda t: t.rlike(DIGITS)), F.lit(0))
    v = vehicles.withColumn("label", label).where("label IS NOT NULL")
    return v.select("scene_id", "label", "ord", F.col("tcenter.x").alias("x"), F.col("tcenter.y").alias("y"), geom.heading("transform").alias("theta"), geom.oriented_box("transform", "bbox", "tcenter").alias("box"))


def order_poses(poses: DataFrame, keys: list[str], kinds: list[str], exact: int = 8, collided: str | None = None) -> DataFrame:
    """keys, pos, ord, score: each vehicle's poses (ord, x, y, theta) in the cheapest order.

    With ``collided``, an array column of positions, steps at those poses slide freely and others are scored by phase.
    """

    def work(key: tuple, c: dict[str, np.ndarray]):
        at = np.column_stack([c["x"], c["y"], c["theta"]])
        if collided is None:
            steps = kernels.edge_scores(at)
            order, score = kernels.cheapest_order(steps, steps, exact)
        else:
            hit = c[collided][0]
            order, score = kernels.cheapest_order(*kernels.crash_cost(at, set() if hit is None else {int(i) for i in hit}), exact)
        return [(*key, k, int(c["ord"][i]), float(score)) for k, i in enumerate(order)]

    columns = [*keys, "ord", "x", "y", "theta", *([collided] if collided else [])]
    schema = ", ".join(f"{k} {t}" for k, t in zip(keys, kinds, strict=True)) + ", pos long, ord long, score double"
    return map_groups(poses.select(*columns), keys, ["ord"], work, schema, spread=True)


TURNED = ("cx", "cy", "hw", "hh", "c", "s")
#: Pairs that are held before they are passed on.
BATCH = 1 << 15


def _meeting(placed: DataFrame, scene: str, label: str, work: Callable, schema: str, *more: str, all_pairs: bool = False) -> DataFrame:
    """``work(rows, boxes, pairs)`` over boxes that share a cell: ``pairs(wanted)`` gives those of different labels that
    touch, the lower label first, each pair in the first cell that both touch; ``all_pairs``: for work that wants them all.

    A scene's cells have twice the mean size of its boxes, or an eighth of the largest if that is more; boxes without
    finite bounds touch nothing. Pairs never leave the kernel unless ``work`` gives them out.
    """
    bounds = [(F.col(f"_b.c{k}") + sign * F.col(f"_b.e{k}")).alias(f"_{k}{i}") for i, sign in ((0, -1), (1, 1)) for k in "xy"]
    boxes = placed.where(f"{label} IS NOT NULL AND {scene} IS NOT NULL").select(scene, F.col(label).alias("label"), "pos", *more, geom.turned_box("box").alias("_b"))
    boxes = boxes.select(scene, "label", "pos", *more, *(F.col(f"_b.{k}").alias(f"_{k}") for k in TURNED), *bounds)
    sides = ("_x0", "_y0", "_x1", "_y1")
    reach = sum((F.abs(k) for k in sides), F.lit(0.0))
    boxes = boxes.where(reach < float("inf"))
    size = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"))
    cells = boxes.groupBy(scene).agg(F.greatest(2 * F.avg(size), F.max(size) / 8, F.lit(1e-6)).alias("_cell"))
    rows = boxes.join(cells, scene).withColumn("_slack", 1e-9 * reach)  # rounding must not part boxes that touch
    rows = rows.withColumns({k: F.col(k) + (F.col("_slack") if k.endswith("1") else -F.col("_slack")) for k in sides})
    for k in "xy":
        cell = lambda v: F.floor(F.col(v) / F.col("_cell")).cast("long")
        rows = rows.withColumn(f"_l{k}", cell(f"_{k}0")).withColumn(f"_g{k}", F.explode(F.sequence(f"_l{k}", cell(f"_{k}1"))))

    def run(table: pa.Table, group: np.ndarray):
        b = {k: table[f"_{k}"].to_numpy() for k in (*TURNED, "x0", "y0", "x1", "y1", "lx", "ly", "gx", "gy")}
        names, b["label"] = np.unique(table["label"].to_numpy(), return_inverse=True)

        def pairs(wanted: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None):
            def asked(p: np.ndarray, q: np.ndarray) -> np.ndarray:
                here = b["label"][p] != b["label"][q]
                if wanted is not None:
                    here &= wanted(p, q)
                at = np.flatnonzero(here)
                p, q = p[at], q[at]
                here[at] = (np.maximum(b["lx"][p], b["lx"][q]) == b["gx"][p]) & (np.maximum(b["ly"][p], b["ly"][q]) == b["gy"][p])
                return here

            for p, q in kernels.touching(group, b, asked):
                turn = b["label"][p] > b["label"][q]
                yield np.where(turn, q, p), np.where(turn, p, q)

        def every_pair():
            names, begins = b["label"].astype(np.int32), (b["lx"] == b["gx"]) + 2 * (b["ly"] == b["gy"]).astype(np.uint8)
            for p, q in kernels.touching_tiles(group, b, lambda p, q: (names[p] != names[q]) & (begins[p] | begins[q] == 3)):
                turn = names[p] > names[q]
                yield np.where(turn, q, p), np.where(turn, p, q)

        return work(table, b, every_pair if all_pairs else pairs)

    rows = rows.select(scene, "_gx", "_gy", "label", "pos", *more, *(f"_{k}" for k in TURNED), *sides, "_lx", "_ly")
    return map_chunks(rows, [scene, "_gx", "_gy"], ["_y0"], run, schema, spread=all_pairs)


def _types(placed: DataFrame, scene: str, label: str) -> tuple[str, str, str]:
    return tuple(placed.schema[k].dataType.simpleString() for k in (scene, label, "pos"))


def collisions(placed: DataFrame, scene: str = "scene_id", label: str = "label", scale: int | None = None) -> DataFrame:
    """scene, label1, label2, idx1, idx2, penetration of touching boxes of different vehicles; placed has label, pos, box.

    Boxes meet by the cells that their upright bounds touch, many cells at a time in one kernel. Blocks of pairs go out
    as batches of ``BATCH`` rows and more. ``scale``: penetrations are given in whole parts of so many, half up.
    """

    def work(table: pa.Table, b: dict[str, np.ndarray], pairs: Callable):
        of, names, place = (table[k].combine_chunks() for k in (scene, "label", "pos"))
        alike = np.cumsum(np.concatenate([[False], pc.not_equal(of[1:], of[:-1]).to_numpy(zero_copy_only=False)]))

        def out(blocks: list[tuple[np.ndarray, ...]]) -> dict:
            p, q = (np.concatenate(k) for k in zip(*blocks, strict=True))
            depth = np.concatenate([kernels.penetration(b, *block) for block in blocks])
            if scale:
                depth = np.floor(depth * scale + 0.5).astype(np.int64)
            one = alike[p.min()] == alike[p.max()]  # rows are in the order of scenes
            p, q, at = pa.array(p), pa.array(q), int(p[0])
            return {
                scene: pa.repeat(of[at], len(p)) if one else of.take(p), "label1": names.take(p), "label2": names.take(q),
                "idx1": place.take(p), "idx2": place.take(q), "penetration": depth,
            }

        blocks, held = [], 0
        for block in pairs():
            blocks.append(block)
            held += len(block[0])
            if held >= BATCH:
                yield out(blocks)
                blocks, held = [], 0
        if blocks:
            yield out(blocks)

    of, kind, place = _types(placed, scene, label)
    return _meeting(placed, scene, label, work, f"{scene} {of}, label1 {kind}, label2 {kind}, idx1 {place}, idx2 {place}, penetration {'long' if scale else 'double'}", all_pairs=True)


def collision_counts(placed: DataFrame, scene: str = "scene_id", label: str = "label") -> DataFrame:
    """scene, label, idx, n: in how many collisions each position is. Pairs are counted where they are found."""

    def work(table: pa.Table, b: dict[str, np.ndarray], pairs: Callable):
        n = np.zeros(len(table), int)
        for p, q in pairs():
            n += np.bincount(p, minlength=len(n)) + np.bincount(q, minlength=len(n))
        at = pa.array(np.flatnonzero(n))
        yield {scene: table[scene].take(at), "label": table["label"].take(at), "idx": table["pos"].take(at), "n": n[n > 0]}

    of, kind, place = _types(placed, scene, label)
    found = _meeting(placed, scene, label, work, f"{scene} {of}, label {kind}, idx {place}, n long")
    return found.groupBy(scene, "label", "idx").agg(F.sum("n").alias("n"))


def hit_texts(counts: DataFrame, scene: str = "scene_id") -> DataFrame:
    """scene, label, hits (positions in collisions as a text, one for each collision), first (the least) from counts.

    Lists of positions and counts are dealt out before the texts are written, which can have a hundred MB each.
    """
    lists = keep(counts.groupBy(scene, "label").agg(F.sort_array(F.collect_list(F.struct("idx", "n"))).alias("_h"), F.sum("n").alias("_n")), "hits")
    size, rows = lists.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count(F.lit(1))).first()
    one = lambda h: F.concat(F.repeat(F.concat(h["idx"].cast("string"), F.lit(",")), (h["n"] - 1).cast("int")), h["idx"].cast("string"))
    tasks = max(1, min(rows, size // 2_000_000 + 1))
    order = lists.select(scene, "label", (F.row_number().over(Window.orderBy(scene, "label")) % tasks).cast("int").alias("_task"))
    dealt = lists.join(order, [scene, "label"]).repartitionById(tasks, "_task") if tasks > 1 else lists
    return dealt.select(scene, "label", F.array_join(F.transform("_h", one), ",").alias("hits"), F.col("_h")[0]["idx"].alias("first"))


def _sides(found: DataFrame, scene: str) -> DataFrame:
    one = lambda k: found.select(scene, F.col(f"label{k}").alias("label"), F.col(f"idx{k}").alias("idx"), "label1", "label2", "idx1", "idx2", "penetration")
    return one(1).unionByName(one(2))


def collision_indices(found: DataFrame, scene: str = "scene_id") -> DataFrame:
    """scene, label, hits (positions in collisions), first (the least)."""
    return _sides(found, scene).groupBy(scene, "label").agg(F.sort_array(F.collect_list("idx")).alias("hits"), F.min("idx").alias("first"))


def first_collision_per_vehicle(found: DataFrame, lengths: DataFrame, scene: str = "scene_id") -> DataFrame:
    """Each vehicle's earliest collision by share of its path, then by penetration; lengths has label, n."""
    share = F.col("idx") / F.greatest(F.lit(1), F.col("n") - 1)
    rows = _sides(found, scene).join(lengths, [scene, "label"])
    best = rows.groupBy(scene, "label").agg(F.min(F.struct(share.alias("share"), "penetration", "label1", "label2", "idx1", "idx2")).alias("b"))
    return best.select(scene, "label", "b.*")


def _first(placed: DataFrame, scene: str, label: str, per_vehicle: bool, scale: int | None) -> DataFrame:
    of, kind, place = _types(placed, scene, label)
    lengths = placed.groupBy(scene, label).agg(F.greatest(F.lit(1), F.count(F.lit(1)) - 1).alias("_last"))
    boxes = placed.join(lengths, [scene, label]).withColumn("_f", F.col("pos") / F.col("_last"))

    def work(table: pa.Table, b: dict[str, np.ndarray], pairs: Callable):
        f, at = table["_f"].to_numpy(), b["label"]
        scenes = np.unique(table[scene].to_numpy(), return_inverse=True)[1]
        pos = table["pos"].to_numpy()
        key = scenes * (int(at.max()) + 1) + at if per_vehicle else scenes
        best = np.full(int(key.max()) + 1, np.inf)
        kept: list[np.ndarray] = []

        def rows(p: np.ndarray, q: np.ndarray) -> np.ndarray:
            """side's row (or p), p, q of what may still be first."""
            if not per_vehicle:
                ok = (f[p] + f[q]) / 2 <= best[key[p]]
                return np.array([p[ok], p[ok], q[ok]])
            one, two = f[p] <= best[key[p]], f[q] <= best[key[q]]
            return np.hstack([np.array([p[one], p[one], q[one]]), np.array([q[two], p[two], q[two]])])

        share = lambda r: f[r[0]] if per_vehicle else (f[r[1]] + f[r[2]]) / 2
        ask = (lambda p, q: (f[p] <= best[key[p]]) | (f[q] <= best[key[q]])) if per_vehicle else (lambda p, q: (f[p] + f[q]) / 2 <= best[key[p]])
        for p, q in pairs(ask):
            found = rows(p, q)
            np.minimum.at(best, key[found[0]], share(found))
            kept.append(found[:, share(found) <= best[key[found[0]]]])
        if not kept:
            return
        found = np.hstack(kept)
        found = found[:, share(found) <= best[key[found[0]]]]
        depth = kernels.penetration(b, found[1], found[2])
        if scale:
            depth = np.floor(depth * scale + 0.5)
        order = np.lexsort((pos[found[2]], pos[found[1]], at[found[2]], at[found[1]], depth, key[found[0]]))
        found, depth = found[:, order], depth[order]
        new = np.concatenate([[True], np.diff(key[found[0]]) != 0])
        r, (p, q), depth = found[0][new], found[1:, new], depth[new]
        yield {
            scene: table[scene].take(pa.array(r)), "label": table["label"].take(pa.array(r)), "share": share(found[:, new]), "penetration": depth,
            "label1": table["label"].take(pa.array(p)), "label2": table["label"].take(pa.array(q)), "idx1": table["pos"].take(pa.array(p)), "idx2": table["pos"].take(pa.array(q)),
        }

    found = _meeting(boxes, scene, label, work, f"{scene} {of}, label {kind}, share double, penetration double, label1 {kind}, label2 {kind}, idx1 {place}, idx2 {place}", "_f")
    if scale:
        found = found.withColumn("penetration", F.col("penetration").cast("long"))
    keys = [scene, "label"] if per_vehicle else [scene]
    return found.groupBy(*keys).agg(F.min(F.struct("share", "penetration", "label1", "label2", "idx1", "idx2")).alias("b")).select(*keys, "b.*")


def first_of_vehicles(placed: DataFrame, scene: str = "scene_id", label: str = "label", scale: int | None = None) -> DataFrame:
    """:func:`first_collision_per_vehicle` from boxes: pairs that come later than one found are not tested any further.

    ``scale``: penetrations are compared and given in whole parts of so many, half up.
    """
    return _first(placed, scene, label, True, scale)


def first_of_scenes(placed: DataFrame, scene: str = "scene_id", label: str = "label", scale: int | None = None) -> DataFrame:
    """:func:`first_collision` from boxes, as :func:`first_of_vehicles` finds them."""
    return _first(placed, scene, label, False, scale)


def distinct_events(first: DataFrame, scene: str = "scene_id") -> DataFrame:
    """The events among first collisions, each once."""
    return first.select(scene, "label1", "label2", "idx1", "idx2", "penetration").distinct()


def first_collision(found: DataFrame, lengths: DataFrame, scene: str = "scene_id") -> DataFrame:
    """The one earliest collision of a scene by the mean of both shares, then by penetration."""
    n = lambda k: lengths.select(scene, F.col("label").alias(f"label{k}"), F.greatest(F.lit(1), F.col("n") - 1).alias(f"n{k}"))
    rows = found.join(n(1), [scene, "label1"]).join(n(2), [scene, "label2"])
    share = (F.col("idx1") / F.col("n1") + F.col("idx2") / F.col("n2")) / 2
    return rows.groupBy(scene).agg(F.min(F.struct(share.alias("share"), "penetration", "label1", "label2", "idx1", "idx2")).alias("b")).select(scene, "b.*")


SEGMENT = "start_idx int, end_idx int, phase string, path array<struct<x:double,y:double,theta:double,t:double>>"


def fit_paths(placed: DataFrame, keys: list[str], kinds: list[str], how: str, first: str | None = None, dt: float = 0.1) -> DataFrame:
    """keys and SEGMENT: ``how`` is driving (one clothoid path) or hybrid (sliding from the first collision on).

    ``dt``: arc length between samples when driving, time between them when sliding.
    """

    def work(key: tuple, c: dict[str, np.ndarray]):
        at = np.column_stack([c["x"], c["y"], c["theta"]])
        if how == "driving":
            parts = [(0, len(at) - 1, "normal", kernels.driving_path(at, dt))]
        else:
            hit = None if first is None or c[first][0] is None or np.isnan(float(c[first][0])) else int(c[first][0])
            parts = kernels.hybrid_path(at, hit, dt)
        for a, b, phase, path in parts:
            yield (*key, a, b, phase, [dict(zip(("x", "y", "theta", "t"), map(float, r), strict=True)) for r in path])

    schema = ", ".join(f"{k} {t}" for k, t in zip(keys, kinds, strict=True)) + f", {SEGMENT}"
    return map_groups(placed.select(*keys, "pos", "x", "y", "theta", *([first] if first else [])), keys, ["pos"], work, schema)


def path_sizes(placed: DataFrame, keys: list[str], kinds: list[str], dt: float = 0.1) -> DataFrame:
    """keys, start_idx, end_idx, phase, points: the segments of hybrid :func:`fit_paths` and how many points each has."""

    def work(table: pa.Table, group: np.ndarray):
        at = np.column_stack([table[k].to_numpy() for k in ("x", "y", "theta")])
        rows, start, end, driving, points = kernels.hybrid_sizes(group, at, dt)
        yield {k: table[k].take(pa.array(rows)) for k in keys} | {"start_idx": start, "end_idx": end, "phase": pa.array(np.where(driving, "normal", "post").tolist(), pa.string()), "points": points}

    schema = ", ".join(f"{k} {t}" for k, t in zip(keys, kinds, strict=True)) + ", start_idx int, end_idx int, phase string, points long"
    return map_chunks(placed.select(*keys, "pos", "x", "y", "theta"), keys, ["pos"], work, schema)


KEYS, KINDS = ["scene_id", "label"], ["string", "string"]


def _labelled(vehicles: DataFrame, strict: bool) -> tuple[DataFrame, DataFrame]:
    """Scenes with an unlabelled vehicle, and the poses of the others."""
    bad = unlabelled(vehicles)
    if strict and (row := bad.first()):
        raise ValueError(f"{row.scene_id}: {row.error}")
    return bad, keep(vehicle_poses(vehicles.join(bad, "scene_id", "left_anti")))


def _in_order(poses: DataFrame) -> DataFrame:
    return keep(order_poses(poses, KEYS, KINDS).join(poses, [*KEYS, "ord"]))


def _again(poses: DataFrame, fixed: bool) -> DataFrame:
    """Poses in order, those of vehicles that collide in the order around their collisions. Which positions collide is
    all that is asked, so collisions are counted where they are found and each position comes once."""
    ordered = _in_order(poses)
    met = collision_counts(ordered)
    if fixed:
        meant = met.select(*KEYS, F.col("idx").alias("pos")).join(ordered.select(*KEYS, "pos", "ord"), [*KEYS, "pos"])
        met = meant.join(poses.select(*KEYS, "ord", (F.row_number().over(_document()) - 1).alias("idx")), [*KEYS, "ord"])
    again = keep(met.groupBy(*KEYS).agg(F.sort_array(F.collect_list("idx")).alias("hits")), "hits")
    crashed = order_poses(poses.join(again, KEYS), KEYS, KINDS, collided="hits").join(poses, [*KEYS, "ord"])
    return keep(crashed.unionByName(ordered.join(again, KEYS, "left_anti")))


def trajectories(vehicles: DataFrame, strict: bool = False, fixed: bool = False) -> DataFrame:
    """scene_id, label, pos, ord, x, y, theta, score: the trajectories of :func:`chronology` alone, without the collisions
    and paths that follow from them."""
    return _again(_labelled(vehicles, strict)[1], fixed).select(*KEYS, "pos", "ord", "x", "y", "theta", "score")


def chronology(vehicles: DataFrame, pre_crash_only: bool = False, strict: bool = False, fixed: bool = False) -> dict[str, DataFrame]:
    """Labels, order, collisions and fitted paths of all scenes.

    Scenes with an unlabelled vehicle go to ``quarantine`` (or raise, if ``strict``). When vehicles are ordered again
    around their collisions, positions of the first order are applied to the document order, as upstream does;
    ``fixed`` applies them to the poses that they mean. Tables that are read twice are kept (see ``operators.kept``).
    """
    bad, poses = _labelled(vehicles, strict)
    final = _in_order(poses) if pre_crash_only else _again(poses, fixed)
    lengths = final.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    hits = keep(collisions(final))
    placed = final.join(collision_indices(hits).select(*KEYS, "first"), KEYS, "left")
    if pre_crash_only:
        placed = placed.where("first IS NULL OR pos <= first")
        segments = fit_paths(placed, KEYS, KINDS, "driving")
    else:
        segments = fit_paths(placed, KEYS, KINDS, "hybrid", "first")
    rows = (placed if pre_crash_only else final).select(*KEYS, "pos", "ord", "x", "y", "theta", "score")
    return {"quarantine": bad, "collisions": hits, "first_collisions": first_collision_per_vehicle(hits, lengths), "trajectories": rows, "segments": segments}


def _document() -> WindowSpec:
    return Window.partitionBy("scene_id", "label").orderBy("ord")


def connected(placed: DataFrame, keys: list[str], kinds: list[str], samples: int = 100) -> DataFrame:
    """keys, k, x, y along the clothoids between a vehicle's ordered poses."""

    def work(key: tuple, c: dict[str, np.ndarray]):
        return [(*key, k, float(x), float(y)) for k, (x, y) in enumerate(kernels.connect_poses(np.column_stack([c["x"], c["y"], c["theta"]]), samples))]

    schema = ", ".join(f"{k} {t}" for k, t in zip(keys, kinds, strict=True)) + ", k long, x double, y double"
    return map_groups(placed.select(*keys, "pos", "x", "y", "theta"), keys, ["pos"], work, schema)
