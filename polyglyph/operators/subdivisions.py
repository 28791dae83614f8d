"""From polygons to subdivisions that can be written: outlines of countries, and second subdivisions below their parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.areas import fix_mojibake
from ..sources.scratch import written
from .boundaries import LEAST_AREAS, MOST_AREAS, child_areas
from .edges import held
from .geo import move_by_box, vertex_mean

# Codes that stand for none, and the box (west, south, east, north) whose polygons go from one country to another.
NO_CODE = "-99"
MOVED_BOX, MOVED_FROM, MOVED_TO = (32.0, 44.0, 37.0, 46.8), "RU", "UA"


def outline_code(code: Column, other: Column) -> Column:
    """The country code of an outline: the first of two that is there, the second where the first stands for none; upper case."""
    first, second = F.nullif(code, F.lit("")), F.coalesce(other, F.lit(""))
    return F.upper(F.when(F.coalesce(first, second) == NO_CODE, second).otherwise(F.coalesce(first, second)))


def country_outlines(shapes: DataFrame, countries: DataFrame) -> DataFrame:
    """countries (osm_id, name, iso, ...) with the polygons of the shapes (iso_a2, iso_a2_eh, polygons) of their code.

    A shape whose code no country has goes, as does a country without a shape. The polygons in MOVED_BOX change hands.
    """
    coded = shapes.select(outline_code(F.col("iso_a2"), F.col("iso_a2_eh")).alias("iso"), "polygons")
    return move_by_box(countries.join(coded.where("iso <> ''"), "iso"), MOVED_FROM, MOVED_TO, MOVED_BOX)


def assign_within(children: DataFrame, parents: DataFrame, by: str, *, within: float = 5.0, cell: float = 1.0) -> DataFrame:
    """(child_id, parent_id): as geo.assign(), among the parents that share the child's `by`.

    children (child_id, by, polygons), parents (parent_id, by, polygons); ids are unique.
    """
    mean = vertex_mean(F.flatten("polygons"))
    points = children.where(F.size(F.flatten("polygons")) > 0).select(F.col("child_id").alias("point_id"), F.col(by).alias("_of"), mean.alias("c")).select("point_id", "_of", "c.lon", "c.lat")
    pairs = held(points, parents.select(F.col("parent_id").alias("area_id"), F.explode("polygons").alias("rings")), cell)
    own = parents.select(F.col("parent_id").alias("area_id"), F.col(by).alias("_of"))
    inside = pairs.join(points.select("point_id", "_of"), "point_id").join(own, ["area_id", "_of"]).groupBy("point_id").agg(F.min("area_id").alias("area_id"))
    square = lambda c, d=0: F.floor(F.col(c) / within) + d
    centres = parents.where(F.size(F.flatten("polygons")) > 0).select(F.col("parent_id").alias("area_id"), F.col(by).alias("_of"), mean.alias("c"))
    centres = centres.select("area_id", "_of", F.col("c.lon").alias("_lon"), F.col("c.lat").alias("_lat")).withColumn("_x", square("_lon")).withColumn("_y", square("_lat"))
    around = F.explode(F.array(*[F.struct(square("lon", i).alias("_x"), square("lat", j).alias("_y")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    rest = points.join(inside, "point_id", "left_anti").withColumn("_s", around).select("point_id", "_of", "lon", "lat", "_s._x", "_s._y")
    far = F.pow(F.col("lon") - F.col("_lon"), 2) + F.pow(F.col("lat") - F.col("_lat"), 2)
    near = rest.join(centres, ["_of", "_x", "_y"]).withColumn("_d", far).where(F.col("_d") < within * within).groupBy("point_id").agg(F.min_by("area_id", F.struct("_d", "area_id")).alias("area_id"))
    return inside.unionByName(near).select(F.col("point_id").alias("child_id"), F.col("area_id").alias("parent_id"))


def second_subdivisions(children: DataFrame, parents: DataFrame, most: int = MOST_AREAS, least: int = LEAST_AREAS, cell: float = 1.0) -> DataFrame:
    """Second subdivisions with polygons, as sources.records.write_boundaries() writes them.

    children (shape_id, name, country, level, polygons), parents (osm_id, name, iso, country, polygons). A level of a
    country with more than `most` areas is too local and goes. A child belongs to the parent of its country around its
    mean, else to the nearest one close by; names are repaired and ids are stable numbers; parents with fewer than
    `least` children have none.
    """
    local = children.groupBy(F.col("country").alias("_c"), F.col("level").alias("_l")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= most)
    kept = children.join(local, (F.col("country") == F.col("_c")) & F.col("level").eqNullSafe(F.col("_l")), "left_semi").where(fix_mojibake(F.col("name")) != "")
    kept = written(kept.withColumn("child_id", F.monotonically_increasing_id()), "children")
    home = assign_within(kept, parents.withColumnRenamed("osm_id", "parent_id"), "country", cell=cell)
    rows = child_areas(kept.join(home, "child_id").withColumnRenamed("parent_id", "parent_osm_id"), parents)
    enough = rows.groupBy("parent_osm_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return rows.join(enough, "parent_osm_id", "left_semi")


def complete_children(children: DataFrame, members: DataFrame, parent: str = "parent_osm_id", least: int = LEAST_AREAS, share: float = 0.8) -> DataFrame:
    """children of the parents that have at least `least` of them and this share of their members (parent, ...)."""
    have = children.groupBy(parent).agg(F.count(F.lit(1)).alias("_have"))
    want = members.groupBy(parent).agg(F.count(F.lit(1)).alias("_want"))
    ok = have.join(want, parent, "left").where((F.col("_have") >= least) & (F.col("_have") >= F.coalesce("_want", F.lit(0)) * share))
    return children.join(ok, parent, "left_semi")
