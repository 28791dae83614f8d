"""Queries from polygons to the subdivisions of countries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import subdivisions as S
from .record_plans import _points, table


def _square(x, y, width, height):
    corner = lambda a, b: F.array(x + a * width, y + b * height)
    return F.array(F.array(F.array(*[corner(a, b) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])))


def _parents(spark, sf_dir):
    """Nations as five bands of each of five countries that lie over each other."""
    n = F.col("n_nationkey")
    west = (F.floor(n / 5) * 60 - 150).cast("double")
    return table(spark, sf_dir, "nation").select(n.cast("long").alias("osm_id"), F.col("n_name").alias("name"), F.concat(F.lit("C"), n % 5, F.lit("-"), n).alias("iso"), (n % 5).alias("country"), _square(west, F.lit(-60.0), 60.0, 120.0).alias("polygons"))


def second_subdivisions(spark, sf_dir):
    """Customers' squares as second subdivisions of the band of their country that they lie in."""
    k = F.col("point_id")
    children = _points(spark, sf_dir).select(F.concat(F.lit("c"), k).alias("shape_id"), F.when(k % 13 == 0, "").otherwise(F.concat(F.lit("Ort "), k)).alias("name"), (F.col("c_nationkey") % 5).alias("country"), F.lit("ADM2").alias("level"), _square(F.col("lon"), F.col("lat"), 1.0, 1.0).alias("polygons"))
    made = S.second_subdivisions(children, _parents(spark, sf_dir), most=10**9, cell=10.0)
    return made.select("osm_id", "name", "kind", "parent_osm_id", "parent_name", "parent_iso", F.col("polygons")[0][0][0][0].alias("west"))


def country_outlines(spark, sf_dir):
    """Outlines with nations' codes, some in the second column, joined to nations."""
    n = F.col("n_nationkey")
    code = F.concat(F.lit("N"), F.chr(65 + n % 26))
    shapes = table(spark, sf_dir, "nation").select(F.when(n % 3 == 0, "-99").when(n % 3 == 1, "").otherwise(F.lower(code)).alias("iso_a2"), F.when(n % 7 != 0, code).alias("iso_a2_eh"), _square(n.cast("double"), n * 2.0, 1.0, 1.0).alias("polygons"))
    countries = table(spark, sf_dir, "nation").select((n + 1).cast("long").alias("osm_id"), F.col("n_name").alias("name"), code.alias("iso"))
    return S.country_outlines(shapes, countries).select("osm_id", "name", "iso", F.col("polygons")[0][0][0][0].alias("west"))


def complete_children(spark, sf_dir):
    """Parts as children of suppliers, of which all parts of up to forty sizes are members."""
    k, s = F.col("p_partkey"), F.col("p_size")
    parts = table(spark, sf_dir, "part").select(k.alias("osm_id"), (k % 50).alias("parent_osm_id"), s.alias("size"))
    return S.complete_children(parts.where(F.col("size") + F.col("parent_osm_id") % 9 < 45), parts).select("osm_id", "parent_osm_id")


QUERIES = {f.__name__: f for f in (second_subdivisions, country_outlines, complete_children)}

_NUMBER = "('0x' || substr(sha1({0}), 1, 8))::BIGINT % 900000000 + 100000000"
ORACLE_SQL = {
    "second_subdivisions": f"""WITH p AS (SELECT c_custkey AS k, c_nationkey % 5 AS country, c_custkey * 37 % 340 - 169.75::DOUBLE AS lon, c_custkey * 53 % 140 - 69.75::DOUBLE AS lat FROM customer WHERE c_custkey % 13 <> 0),
      h AS (SELECT p.*, n_nationkey::BIGINT AS parent, n_name FROM p JOIN nation ON n_nationkey % 5 = country AND floor((lon + 0.4 + 150) / 60) = n_nationkey // 5 WHERE lat + 0.4 >= -60 AND lat + 0.4 < 60 AND lon + 0.4 >= -150 AND lon + 0.4 < 150)
      SELECT {_NUMBER.format("'c' || k")} AS osm_id, 'Ort ' || k AS name, 'subdivision_2' AS kind, parent AS parent_osm_id, n_name AS parent_name, 'C' || country || '-' || parent AS parent_iso, lon AS west
      FROM h WHERE parent IN (SELECT parent FROM h GROUP BY 1 HAVING count(*) >= 2)""",
    "country_outlines": """WITH s AS (SELECT n_nationkey AS n, 'N' || chr(65 + n_nationkey % 26) AS code, CASE n_nationkey % 3 WHEN 2 THEN code ELSE CASE WHEN n_nationkey % 7 <> 0 THEN code ELSE '' END END AS iso FROM nation)
      SELECT n_nationkey::BIGINT + 1 AS osm_id, n_name AS name, iso, n::DOUBLE AS west FROM s JOIN nation ON iso = 'N' || chr(65 + n_nationkey % 26) WHERE iso <> ''""",
    "complete_children": """WITH p AS (SELECT p_partkey AS osm_id, p_partkey % 50 AS parent_osm_id, p_size AS size FROM part), c AS (SELECT * FROM p WHERE size + parent_osm_id % 9 < 45),
      w AS (SELECT parent_osm_id, count(*) AS want FROM p GROUP BY 1), h AS (SELECT parent_osm_id, count(*) AS have FROM c GROUP BY 1)
      SELECT osm_id, parent_osm_id FROM c WHERE parent_osm_id IN (SELECT h.parent_osm_id FROM h JOIN w USING (parent_osm_id) WHERE have >= 2 AND have >= want * 0.8)""",
}
