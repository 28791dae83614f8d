"""Sites and names from binary map extracts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.areas import in_box
from ..functions.names import REGIONS, Region
from ..sources.extracts import read_extract, scan_wanted
from ..sources.scratch import written
from .geo import way_centroids
from .places import sites_of

WEBSITE_TAGS = ("website", "contact:website")


def extract_sites(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, region: Region | None = REGIONS["ukraine"], **options) -> DataFrame:
    """Site records of an extract's nodes and ways that have a website; relations are left out.

    One pass makes only elements with a website, a second one only the nodes of those ways; a way lies at the mean of its
    nodes that are found, and goes if none is. With a box (south, west, north, east) only sites inside it stay.
    """
    ways = written(read_extract(spark, path, WEBSITE_TAGS, kinds=("way",), **options).select(F.col("id").alias("way_id"), "tags", F.col("nodes").alias("node_ids")), "ways")
    wanted = ways.select(F.explode("node_ids").alias("id")).select(F.lit("node").alias("type"), "id")
    nodes = scan_wanted(spark, path, wanted, **options).select(F.col("id").alias("node_id"), "lat", "lon")
    placed = ways.drop("node_ids").join(way_centroids(ways, nodes), "way_id").select(F.lit("way").alias("type"), F.col("way_id").alias("id"), "tags", "lat", "lon")
    every = read_extract(spark, path, WEBSITE_TAGS, kinds=("node",), **options).select("type", "id", "tags", "lat", "lon").unionByName(placed)
    if box is not None:
        every = every.where(in_box(F.col("lat"), F.col("lon"), *(F.lit(float(b)) for b in box)))
    return sites_of(every, region)


def name_snapshots(spark: SparkSession, extracts: dict[str, str], wanted: DataFrame, region: Region, **options) -> DataFrame:
    """(stamp, type, id, name, primary, available): what the wanted (type, id) elements were called in each extract (stamp -> path)."""

    def one(stamp: str, path: str) -> DataFrame:
        found = scan_wanted(spark, path, wanted, **options)
        primary, available = region.languages(F.col("tags"))
        return found.select(F.lit(stamp).alias("stamp"), "type", "id", F.coalesce(F.try_element_at("tags", F.lit("name")), F.lit("")).alias("name"), primary.alias("primary"), available.alias("available"))

    return reduce(DataFrame.unionByName, [one(s, p) for s, p in sorted(extracts.items())])
