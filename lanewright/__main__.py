"""python -m lanewright FILE [--json DIR] [--centerlines DIR] [--bezier N] [--road-width MIN MAX] [--profile NAME]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lanewright.operators import roads, scene
from lanewright.operators.config import PROFILES, CenterlineConfig, SceneConfig
from lanewright.operators.kept import keep, kept
from lanewright.sources import scenes


def number(text: str, default: float) -> float:
    """The number that a text says, or the default."""
    try:
        return float(text)
    except ValueError:
        return default


def main(args: list[str] | None = None) -> None:
    """Read scene files, print a summary, and write what is asked for."""
    p = argparse.ArgumentParser(prog="lanewright", description=__doc__)
    p.add_argument("path")
    p.add_argument("--json")
    p.add_argument("--centerlines")
    p.add_argument("--bezier", default="10")
    p.add_argument("--road-width", nargs=2, default=("5", "15"))
    p.add_argument("--profile", choices=PROFILES, default="py")
    p.add_argument("--cache")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("lanewright").getOrCreate()
    config = SceneConfig(profile=a.profile, bezier_samples=int(number(a.bezier, 10)))
    with kept():
        nodes = keep(scenes.read_scenes(spark, a.path))
        objects = keep(scene.scene_objects(nodes, scenes.read_cache(spark, a.cache), config))
        scenes.summary(objects).show(truncate=False)
        scenes.quarantine(nodes).show(truncate=False)
        if a.json:
            scenes.write_json(scenes.scene_documents(objects), a.json)
        if a.centerlines:
            low, high = number(a.road_width[0], 5.0), number(a.road_width[1], 15.0)
            lines = roads.centerlines(objects.where("category = 'roadway'"), CenterlineConfig.for_profile(a.profile, min_width=low, max_width=high))
            scenes.write_json(lines["centerlines"], a.centerlines)
            roads.width_range(lines["centerlines"]).show()


if __name__ == "__main__":
    main()
