"""Queries that write binary map extracts of whole tables and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import REGIONS
from ..operators import extracts as X
from ..operators.history import name_intervals
from ..sources import extracts as S
from ..sources.scratch import scratch
from .record_plans import _RUNS_SQL, _points, table

MEMBERS = "array<struct<type: string, ref: long, role: string>>"


def _tags(*pairs):
    """A map of the tags that have a value."""
    each = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in pairs])
    return F.map_from_entries(F.filter(each, lambda p: p["v"].isNotNull()))


def _elements(spark, sf_dir):
    """Customers as nodes, orders as ways over customers, nations as relations of both."""
    p, k = _points(spark, sf_dir), F.col("point_id")
    none, no_members = F.lit(None).cast("array<bigint>"), F.lit(None).cast(MEMBERS)
    site = F.when(k % 3 == 0, F.concat(F.lit("http://é"), k))
    nodes = p.select(F.lit("node").alias("type"), k.alias("id"), _tags(("name", F.concat(F.lit("Nœud "), k)), ("website", site)).alias("tags"), "lat", "lon", none.alias("nodes"), no_members.alias("members"))
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    n = F.lit(None).cast("double")
    ways = table(spark, sf_dir, "orders").select(
        F.lit("way").alias("type"), o.alias("id"), _tags(("contact:website", F.when(o % 7 == 0, F.concat(F.lit("w"), o))), ("shop", F.when(o % 14 == 0, F.lower("o_orderpriority")))).alias("tags"),
        n.alias("lat"), n.alias("lon"), F.array(c, c + 1, c + 1_000_000, c).alias("nodes"), no_members.alias("members"),
    )
    a = F.col("n_nationkey").cast("long")
    member = lambda t, r, role: F.struct(F.lit(t).alias("type"), r.alias("ref"), F.lit(role).alias("role"))
    relations = table(spark, sf_dir, "nation").select(
        F.lit("relation").alias("type"), a.alias("id"), _tags(("name", F.col("n_name"))).alias("tags"), n.alias("lat"), n.alias("lon"), none.alias("nodes"),
        F.array(member("way", a * 3 + 5, "outer"), member("node", a - 7, ""), member("relation", a + 1, "label")).alias("members"),
    )
    return nodes.unionByName(ways).unionByName(relations)


def extract_elements(spark, sf_dir):
    """All elements, written to an extract and read back in small ranges."""
    path = scratch(spark, "extract")
    S.write_extract(_elements(spark, sf_dir), path, elements=700)
    read = S.read_extract(spark, path, range_bytes=40_000)
    members = F.array_join(F.transform("members", lambda m: F.concat_ws("/", m["type"], m["ref"], m["role"])), ",")
    return read.select("type", "id", F.try_element_at("tags", F.lit("name")).alias("name"), F.size("tags").alias("n_tags"), "lat", "lon", F.array_join(F.col("nodes").cast("array<string>"), ",").alias("nodes"), members.alias("members"))


def extract_sites(spark, sf_dir):
    """The sites of that extract: nodes, and ways at the mean of their nodes."""
    path = scratch(spark, "extract")
    S.write_extract(_elements(spark, sf_dir), path)
    sites = X.extract_sites(spark, path, (-60.0, -150.0, 60.0, 150.0))
    return sites.select("osm_type", "osm_id", "name", "website", "category", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


STAMPS = ("140101", "150101", "160101", "170101")


def extract_name_history(spark, sf_dir):
    """Names of parts in four yearly extracts, those wanted that suppliers or a customer share a number with, as intervals."""
    k, paths = F.col("p_partkey"), {}
    for i, stamp in enumerate(STAMPS):
        name = F.when((k + i) % 4 == 0, F.concat(F.lit("Siop "), k)).when((k + i) % 5 == 0, "").otherwise(F.concat(F.lit("The Shop "), k))
        here = table(spark, sf_dir, "part").where((k + i) % 9 != 0)
        n = F.lit(0.0)
        rows = here.select(F.when(k % 2 == 0, "node").otherwise("way").alias("type"), k.alias("id"), _tags(("name", name)).alias("tags"), n.alias("lat"), n.alias("lon"), F.array(k).alias("nodes"), F.lit(None).cast(MEMBERS).alias("members"))
        paths[stamp] = scratch(spark, f"extract{stamp}")
        S.write_extract(rows, paths[stamp], elements=300)
    wanted = table(spark, sf_dir, "customer").select(F.lit("node").alias("type"), F.col("c_custkey").alias("id")).unionByName(table(spark, sf_dir, "supplier").select(F.lit("way").alias("type"), F.col("s_suppkey").alias("id")))
    seen = X.name_snapshots(spark, paths, wanted, REGIONS["wales"])
    spans = name_intervals(seen, ["type", "id"], ["stamp"], "stamp")
    return spans.select("type", "id", "run", F.col("from").alias("first"), F.col("to").alias("last"), F.col("primary").alias("language"), "observations")


QUERIES = {f.__name__: f for f in (extract_elements, extract_sites, extract_name_history)}

_POINT = "c_custkey * 53 % 140 - 69.75::DOUBLE AS lat, c_custkey * 37 % 340 - 169.75::DOUBLE AS lon"
ORACLE_SQL = {
    "extract_elements": f"""SELECT 'node' AS type, c_custkey AS id, 'Nœud ' || c_custkey AS name, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS n_tags, {_POINT}, NULL AS nodes, NULL AS members FROM customer
      UNION ALL SELECT 'way', o_orderkey, NULL, CASE WHEN o_orderkey % 14 = 0 THEN 2 WHEN o_orderkey % 7 = 0 THEN 1 ELSE 0 END, NULL, NULL, concat_ws(',', o_custkey, o_custkey + 1, o_custkey + 1000000, o_custkey), NULL FROM orders
      UNION ALL SELECT 'relation', n_nationkey, n_name, 1, NULL, NULL, NULL, 'way/' || (n_nationkey * 3 + 5) || '/outer,node/' || (n_nationkey - 7) || '/,relation/' || (n_nationkey + 1) || '/label' FROM nation""",
    "extract_sites": f"""WITH p AS (SELECT c_custkey AS k, {_POINT} FROM customer),
      n AS (SELECT o_orderkey AS w, o_orderpriority AS pr, unnest([o_custkey, o_custkey + 1, o_custkey]) AS k FROM orders WHERE o_orderkey % 7 = 0),
      s AS (SELECT 'node' AS osm_type, k AS osm_id, 'Nœud ' || k AS name, 'http://é' || k AS website, 'unclassified' AS category, lat, lon FROM p WHERE k % 3 = 0
        UNION ALL SELECT 'way', w, '(unnamed)', 'w' || w, CASE WHEN w % 14 = 0 THEN 'shop=' || lower(any_value(pr)) ELSE 'unclassified' END, avg(lat), avg(lon) FROM n JOIN p USING (k) GROUP BY w)
      SELECT osm_type, osm_id, name, website, category, round(lat, 6) AS lat, round(lon, 6) AS lon FROM s WHERE lat BETWEEN -60 AND 60 AND lon BETWEEN -150 AND 150""",
    "extract_name_history": f"""WITH years AS (SELECT i, ['140101', '150101', '160101', '170101'][i + 1] AS stamp FROM range(4) t(i)),
      e AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'node' ELSE 'way' END AS type, p_partkey AS k, stamp AS ts, i AS id, stamp AS day, CASE WHEN (p_partkey + i) % 4 = 0 THEN 'welsh' ELSE 'english' END AS state
        FROM part, years WHERE (p_partkey + i) % 9 <> 0 AND ((p_partkey + i) % 4 = 0 OR (p_partkey + i) % 5 <> 0)
          AND (p_partkey % 2 = 0 AND p_partkey IN (SELECT c_custkey FROM customer) OR p_partkey % 2 = 1 AND p_partkey IN (SELECT s_suppkey FROM supplier))), {_RUNS_SQL}
      SELECT CASE WHEN k % 2 = 0 THEN 'node' ELSE 'way' END AS type, k AS id, run, first_day AS first, last_day AS last, state AS language, observations FROM spans""",
}
