"""Names to classes: a lookup table first, then a classifier for what it lacks; and categories of scene objects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in the order in which they decide (fixed values).
VEHICLE_WORDS = ("vehicle", "car", "truck", "suv", "pickup", "bus", "motorcycle")
MARKING_WORDS = ("lane", "marking", "arrow")
DIRECTION_WORDS = ("north", "south", "east", "west", "compass")
MARKINGS = ("road marking", "turn direction")
LINE_TYPES = ("polycurve", "polyline", "line", "flexconcretebarrier")
VEHICLE_LIMIT, MARKING_LIMIT = 0.7, 0.5


def normal_name(name: str | Column) -> Column:
    """Lower case, underscores as blanks: what a text classifier gets to see."""
    return F.lower(F.replace(F.col(name) if isinstance(name, str) else name, F.lit("_"), F.lit(" ")))


def _has(name: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(name, F.lit(w))
    return out


def keyword_class(name: str | Column) -> tuple[Column, Column]:
    """Class and probability by keywords, in the order vehicle, marking, direction; null for no hit or no name."""
    n = F.lower(F.col(name) if isinstance(name, str) else name)
    kind = F.when(_has(n, VEHICLE_WORDS), "vehicle").when(_has(n, MARKING_WORDS), "road marking").when(_has(n, DIRECTION_WORDS), "direction arrow")
    return kind, F.when(kind == "vehicle", 0.8).when(kind.isNotNull(), 0.7)


def is_vehicle(kind: Column, probability: Column) -> Column:
    return (kind == "vehicle") & (probability > VEHICLE_LIMIT)


def from_cache(names: DataFrame, cache: DataFrame) -> DataFrame:
    """names (name, ...) with the cache's columns; names are matched verbatim, misses get nulls."""
    return names.join(cache, "name", "left")


def cache_misses(names: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct names that the cache lacks."""
    return names.select("name").where("name IS NOT NULL").distinct().join(cache, "name", "left_anti")


def by_keywords(missing: DataFrame) -> DataFrame:
    """The default classifier: name, is_vehicle, predicted_class, predicted_probability."""
    kind, p = keyword_class("name")
    kind, p = F.coalesce(kind, F.lit("background")), F.coalesce(p, F.lit(0.5))
    return missing.select("name", (kind == "vehicle").alias("is_vehicle"), kind.alias("predicted_class"), p.alias("predicted_probability"))


def from_scores(scores: DataFrame) -> DataFrame:
    """name, is_vehicle, predicted_class, predicted_probability of each name: its label of the highest score.

    ``scores``: name, label, score, as a text classifier gives them for any set of labels. Of equal scores the label that
    comes first counts; null scores and labels do not. A name without a score has no row.
    """
    best = scores.where("score IS NOT NULL AND label IS NOT NULL").groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("least"), "label")).alias("_b"))
    kind, p = F.col("_b.label"), -F.col("_b.least")
    return best.select("name", is_vehicle(kind, p).alias("is_vehicle"), kind.alias("predicted_class"), p.alias("predicted_probability"))


def classify_names(names: DataFrame, cache: DataFrame, classifier: Callable[[DataFrame], DataFrame] = by_keywords) -> DataFrame:
    """The cache extended by what ``classifier`` says of its misses: each distinct name is classified once."""
    columns = ["name", "is_vehicle", "predicted_class", "predicted_probability"]
    return cache.select(*columns).unionByName(classifier(cache_misses(names, cache)).select(*columns))


def symbol_category(vehicle: Column, kind: Column, probability: Column, by_class_only: bool = False) -> Column:
    """vehicles, road_markings or misc; ``by_class_only`` skips the markings' probability limit."""
    marking = kind.isin(*MARKINGS)
    sure = F.lit(True) if by_class_only else probability > MARKING_LIMIT
    return F.when(F.coalesce(vehicle, F.lit(False)), "vehicles").when(F.coalesce(marking & sure, F.lit(False)), "road_markings").otherwise("misc")


def primitive_category(kind: Column, layer: Column | None = None) -> Column:
    """texts, roadway or misc; with ``layer``, only the line work layer is roadway."""
    line = kind.isin(*LINE_TYPES)
    if layer is not None:
        line = line & F.coalesce(layer == "Line Work", F.lit(False))
    return F.when(kind == "label", "texts").when(line, "roadway").otherwise("misc")
