"""Queries over names, map elements, children of areas and change-point searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import areas as A
from ..functions import names as N
from ..operators import classify as C
from ..operators import geo as G
from ..operators import history as Hi
from ..operators import places as P
from ..operators import records as R
from .page_plans import PACKS, table
from .record_plans import _AREAS_SQL, _CENTRE, _LOCATE_SQL, _POINTS_SQL, _RUNS_SQL, _areas, _points, _squares

FIRST_MONTH, LAST_MONTH = 1992 * 12, 1998 * 12 + 11


def doc_name_languages(spark, sf_dir):
    """Every document's text as if it were a name, in each region."""
    each = [r.classify(F.col("text")).alias(name) for name, r in N.REGIONS.items()]
    return table(spark, sf_dir, "documents").select("doc_id", *each)


def region_tags(spark, sf_dir):
    """Name tags made of nations and regions, read as Welsh or English."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    pairs = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey")
    name = F.when(k % 4 == 0, F.lit("12")).when(k % 4 == 1, F.concat(F.lit("Siop "), "n_name")).otherwise(F.col("n_name"))
    tags = F.create_map(F.lit("name"), name, F.lit("name:cy"), F.when(k % 3 == 0, name).otherwise(F.lit("")), F.lit("name:en"), F.when(k % 2 == 0, F.col("r_name")).otherwise(name))
    primary, available = N.REGIONS["wales"].languages(tags)
    out = pairs.select("n_nationkey", primary.alias("primary"), available.alias("available"))
    return out.select("n_nationkey", "primary", F.array_join("available", ",").alias("available"), F.array_join(N.site_languages(F.col("primary"), F.col("available")), ",").alias("languages"))


def folded_keys(spark, sf_dir):
    name = F.translate("n_name", "AEIOUC", "ÁÈÎÕÜÇ")
    return table(spark, sf_dir, "nation").select("n_nationkey", A.folded_key(name).alias("folded"), A.plain_key(name).alias("plain"))


def element_sites(spark, sf_dir):
    k = F.col("c_custkey")
    when = lambda n, v: F.when(k % n == 0, v)
    pairs = F.array(
        F.struct(F.lit("website").alias("k"), F.when(k % 5 == 0, "").otherwise(when(2, F.concat(F.lit("w"), k))).alias("v")),
        F.struct(F.lit("contact:website").alias("k"), when(3, F.concat(F.lit("c"), k)).alias("v")),
        F.struct(F.lit("building").alias("k"), when(4, F.lit("yes")).alias("v")),
        F.struct(F.lit("shop").alias("k"), when(6, F.lower("c_mktsegment")).alias("v")),
        F.struct(F.lit("name").alias("k"), F.when(k % 7 != 0, F.col("c_name")).alias("v")),
    )
    e = table(spark, sf_dir, "customer").select(
        F.when(k % 2 == 0, "node").otherwise("way").alias("type"), k.alias("id"), F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull())).alias("tags"),
        F.when(k % 11 != 0, k * 0.5).alias("lat"), (k * 0.25).alias("lon"),
    )
    return P.sites_of(e).select("name", "website", "category", "lat", "lon", "osm_type", "osm_id")


def _child_records(spark, sf_dir, keep):
    k, level = F.col("p_partkey"), F.col("p_size") % 8
    p = table(spark, sf_dir, "part").where(keep)
    return p.select((k % 13).alias("parent_id"), (k % 13 % 7).cast("int").alias("parent_level"), k.alias("child_id"), F.when(level < 7, (level + 3).cast("string")).otherwise("").alias("level"), k.alias("ord"))


def children_select(spark, sf_dir):
    return P.select_children(_child_records(spark, sf_dir, F.lit(True))).select("parent_id", "child_id", "level")


def children_choose(spark, sf_dir):
    k = F.col("p_partkey")
    members, denser = _child_records(spark, sf_dir, (k % 4 == 0) & (k % 13 < 9)), _child_records(spark, sf_dir, (k % 4 > 1) & (k % 13 > 3))
    listed = _child_records(spark, sf_dir, k % 4 == 1).withColumn("level", F.lit(""))
    return P.choose_children(members, denser, listed).select("parent_id", "child_id", "origin")


def children_served(spark, sf_dir):
    return P.children_ok(P.select_children(_child_records(spark, sf_dir, F.lit(True))))


def _shapes(spark, sf_dir):
    k = F.col("n_nationkey")
    name = F.when(k % 5 == 0, F.concat("n_name", F.lit(" Province"))).when(k % 5 == 1, F.lower("n_name")).when(k % 5 == 2, F.lit("Elsewhere")).otherwise(F.col("n_name"))
    iso = F.when(k % 5 == 2, F.concat(F.lit("ABC-"), k)).when(k % 5 == 3, F.concat(F.lit("ab."), k))
    shapes = table(spark, sf_dir, "nation").select(k.cast("long").alias("id"), name.alias("name"), iso.alias("iso"))
    areas = table(spark, sf_dir, "nation").select((k + 100).cast("long").alias("area_id"), F.col("n_name").alias("name"), F.concat(F.lit("AB-"), k).alias("iso"), k.cast("long").alias("ord"))
    return shapes, areas


def parent_match(spark, sf_dir):
    return P.match_parents(*_shapes(spark, sf_dir), {"brazil": 7})


def area_ids(spark, sf_dir):
    shapes, areas = _shapes(spark, sf_dir)
    return P.attach_ids(shapes.withColumn("iso", A.iso_code(F.coalesce("iso", F.lit("")))), areas, {"brazil": 7})


def child_assign(spark, sf_dir):
    p = _points(spark, sf_dir)
    corner = lambda x, y: F.array(F.col("lon") + x, F.col("lat") + y)
    ring = F.array(corner(-0.25, -0.25), corner(0.25, -0.25), corner(0.25, 0.25), corner(-0.25, 0.25))
    parents = _areas(spark).select(F.col("area_id").alias("parent_id"), F.array("rings").alias("polygons"))
    return G.assign(p.select(F.col("point_id").alias("child_id"), F.array(F.array(ring)).alias("polygons")), parents, within=12.0, cell=10.0)


def event_name_intervals(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    e = e.select("user_id", "ts", "event_id", "day", F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("primary"), F.when(F.col("event_id") % 3 == 0, F.array("event_type")).otherwise(F.array().cast("array<string>")).alias("available"))
    return Hi.name_intervals(e, ["user_id"], ["ts", "event_id"], "day").select("user_id", "run", F.col("from").alias("first_day"), F.col("to").alias("last_day"), "primary", F.array_join("available", ",").alias("available"), "observations")


def order_search_changes(spark, sf_dir):
    stamp = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), stamp.alias("snapshot"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("state"))
    return Hi.search_changes(s, "site", FIRST_MONTH, LAST_MONTH, coarse=24)


def page_early_languages(spark, sf_dir):
    found = C.early_languages(table(spark, sf_dir, "pages"), PACKS, "page_id", step=4096)
    return found.select("page_id", "n_chars", F.array_join("languages", ",").alias("languages"))


def ring_assemble(spark, sf_dir):
    """A square at every customer's point, some with holes, taken apart into rings and put together again."""
    r = _squares(spark, sf_dir).select(F.col("area_id").alias("relation_id"), F.posexplode("rings").alias("i", "ring"))
    rings = r.select("relation_id", F.when(F.col("i") == 0, "outer").otherwise("inner").alias("role"), F.when(F.col("i") == 0, 0).otherwise(F.col("i") - 1).alias("n"), "ring")
    made = G.assemble(rings)
    return made.select("relation_id", "n", F.size("rings").alias("n_rings"), F.col("rings")[0][0][0].alias("west"), F.col("rings")[0][0][1].alias("south"))


def extract_resolve(spark, sf_dir):
    """Nations ask for extracts that are regions or nations: by part, name or country."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    k = F.col("n_nationkey")
    none = F.array().cast("array<string>")
    wanted = n.select(k.cast("long").alias("id"), F.when(k % 3 == 0, F.lower("n_name")).alias("query"), F.when(k % 3 == 1, F.col("n_name")).alias("name"), F.concat(F.lit("c"), F.col("n_regionkey")).alias("country"), F.when(k % 5 == 0, F.array(F.concat(F.lit("p"), k))).otherwise(none).alias("iso2"))
    small = n.select(F.concat(F.lit("x/"), F.lower("n_name")).alias("extract"), F.lit("-").alias("name"), none.alias("iso1"), F.array(F.concat(F.lit("P"), k)).alias("iso2"), F.lit(2).alias("depth"), (k + 10).cast("long").alias("ord"))
    large = r.select(F.lower("r_name").alias("extract"), F.col("r_name").alias("name"), F.array(F.concat(F.lit("C"), "r_regionkey")).alias("iso1"), none.alias("iso2"), F.lit(1).alias("depth"), F.col("r_regionkey").cast("long").alias("ord"))
    return P.resolve_extract(wanted, small.unionByName(large))


def previous_language(spark, sf_dir):
    sites = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("url"), F.when(F.col("o_orderkey") % 3 == 0, F.array("o_orderstatus")).otherwise(F.array().cast("array<string>")).alias("languages"), F.col("o_orderkey").alias("row"))
    found = R.previous_labels(sites, "url", "languages", "row")
    merged = R.annotate(sites.where("row % 2 = 0").withColumn("languages", F.array().cast("array<string>")), found, "url", "languages")
    return merged.select("row", F.array_join("languages", ",").alias("languages"), R.unlabelled(F.col("languages")).alias("unlabelled"))


def nation_boxes(spark, sf_dir):
    return P.padded_boxes(_points(spark, sf_dir), "c_nationkey", 0.25)


def area_numbers(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k, P.area_number(F.when(k % 2 == 0, "way").otherwise("relation"), k).alias("area"))


QUERIES = {
    f.__name__: f
    for f in (doc_name_languages, region_tags, folded_keys, element_sites, children_select, children_choose, children_served, parent_match, area_ids, child_assign, event_name_intervals, order_search_changes, page_early_languages, ring_assemble, extract_resolve, previous_language, nation_boxes, area_numbers)
}


def _any(text, marks):
    return f"regexp_matches({text}, '[{marks}]')"


def _word(text, words):
    return f"regexp_matches({text}, '(?:^|[^\\p{{L}}''])(?:{'|'.join(words)})(?:[^\\p{{L}}'']|$)')"


def _count(text, marks):
    return f"(length({text}) - length(regexp_replace({text}, '[{marks}]', '', 'g')))"


_KK = f"({_count('t', N.KK_MARKS + N.KK_LATIN_MARKS)} + CASE WHEN contains(t, 'qazaq') THEN 3 ELSE 0 END)"
_UK = f"({_count('t', N.UK_MARKS)} + CASE WHEN contains(t, 'і') THEN 2 ELSE 0 END)"
_RU = _count("t", N.RU_MARKS)
_WALES = f"CASE WHEN {_any('t', N.WELSH_MARKS)} OR {_word('t', N.WELSH_WORDS)} THEN 'welsh' WHEN {_any('t', 'a-zàáâäéèêëîïóôöúùûü')} THEN 'english' END"


def _children_sql(keep: str) -> str:
    return f"""(WITH r AS (SELECT p_partkey % 13 AS parent_id, p_partkey % 13 % 7 AS pl, p_partkey AS child_id, CASE WHEN p_size % 8 < 7 THEN p_size % 8 + 3 END AS lv FROM part WHERE {keep}),
      f AS (SELECT * FROM r WHERE lv IS NULL OR pl <= 0 OR lv > pl),
      g AS (SELECT parent_id, pl, lv, count(*) AS n, min(child_id) AS first FROM f GROUP BY ALL),
      b AS (SELECT *, CASE WHEN pl <= 3 THEN 4 WHEN pl <= 5 THEN 6 ELSE 8 END AS best FROM g),
      t AS (SELECT *, list_position(list_filter([best, best + 2, best - 1, best + 1], lambda v: v >= 3 AND v <= 10 AND v > pl), lv) AS tried FROM b),
      o AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY CASE WHEN lv IS NULL THEN CASE WHEN n >= 2 THEN 2 ELSE 4 END WHEN n >= 3 AND tried > 0 THEN 0 WHEN n BETWEEN 3 AND 500 THEN 1 ELSE 3 END, CASE WHEN n >= 3 AND tried > 0 THEN tried ELSE -n END, first) AS rn FROM t)
      SELECT f.parent_id, f.child_id, coalesce(f.lv::VARCHAR, '') AS level FROM f JOIN o ON o.parent_id = f.parent_id AND o.lv IS NOT DISTINCT FROM f.lv WHERE rn = 1)"""


_SHAPES_SQL = """s AS (SELECT n_nationkey::BIGINT AS id, regexp_replace(lower(CASE n_nationkey % 5 WHEN 0 THEN n_name || ' Province' WHEN 2 THEN 'Elsewhere' ELSE n_name END), '[^a-z0-9]', '', 'g') AS key,
       CASE n_nationkey % 5 WHEN 2 THEN {two} WHEN 3 THEN {three} END AS code FROM nation),
      a AS (SELECT (n_nationkey + 100)::BIGINT AS area_id, regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS k, 'AB-' || n_nationkey AS iso, n_nationkey AS ord FROM nation)"""

ORACLE_SQL = {
    "doc_name_languages": f"""WITH d AS (SELECT doc_id, lower(trim(coalesce(text, ''))) AS t FROM documents)
      SELECT doc_id, CASE WHEN {_UK} > {_RU} THEN 'ukrainian' WHEN {_RU} > {_UK} THEN 'russian' END AS ukraine, {_WALES} AS wales,
      CASE WHEN {_word('t', N.GREENLANDIC_WORDS)} OR (contains(t, 'q') AND NOT {_any('t', N.DANISH_MARKS)}) THEN 'greenlandic' WHEN {_any('t', 'a-z' + N.DANISH_MARKS)} THEN 'danish' END AS greenland,
      CASE WHEN {_any('t', N.FRENCH_MARKS)} OR {_word('t', N.FRENCH_WORDS)} THEN 'french' WHEN {_any('t', 'a-z')} THEN 'english' END AS quebec,
      CASE WHEN {_KK} > {_RU} THEN 'kazakh' WHEN {_RU} > {_KK} THEN 'russian' WHEN {_KK} = 0 AND {_any('t', 'Ѐ-ӿ')} THEN 'russian' END AS kazakhstan,
      CASE WHEN {_any('t', 'Ѐ-ӿ')} THEN 'russian' WHEN {_any('t', 'a-z' + N.ESTONIAN_MARKS)} THEN 'estonian' END AS estonia FROM d""",
    "region_tags": f"""WITH x AS (SELECT n_nationkey, r_name, CASE n_nationkey % 4 WHEN 0 THEN '12' WHEN 1 THEN 'Siop ' || n_name ELSE n_name END AS name FROM nation JOIN region ON r_regionkey = n_regionkey),
      y AS (SELECT *, lower(name) AS t, CASE WHEN n_nationkey % 3 = 0 THEN name ELSE '' END AS cy, CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE name END AS en FROM x),
      z AS (SELECT *, {_WALES} AS c FROM y), p AS (SELECT *, coalesce(c, CASE WHEN name = cy THEN 'welsh' WHEN name = en THEN 'english' END) AS primary_ FROM z),
      v AS (SELECT *, list_sort(list_distinct(list_filter([CASE WHEN cy <> '' THEN 'welsh' END, CASE WHEN en <> '' THEN 'english' END, c], lambda q: q IS NOT NULL))) AS av FROM p)
      SELECT n_nationkey, primary_ AS primary, array_to_string(av, ',') AS available, CASE WHEN primary_ IS NOT NULL THEN array_to_string(list_prepend(primary_, list_filter(av, lambda q: q <> primary_)), ',') END AS languages FROM v""",
    "folded_keys": "WITH n AS (SELECT n_nationkey, lower(translate(n_name, 'AEIOUC', 'ÁÈÎÕÜÇ')) AS x FROM nation) SELECT n_nationkey, regexp_replace(strip_accents(x), '[^a-z0-9]', '', 'g') AS folded, regexp_replace(x, '[^a-z0-9]', '', 'g') AS plain FROM n",
    "element_sites": """SELECT CASE WHEN c_custkey % 7 <> 0 THEN c_name ELSE '(unnamed)' END AS name,
      CASE WHEN c_custkey % 2 = 0 AND c_custkey % 5 <> 0 THEN 'w' || c_custkey ELSE 'c' || c_custkey END AS website,
      CASE WHEN c_custkey % 6 = 0 THEN 'shop=' || lower(c_mktsegment) WHEN c_custkey % 4 = 0 THEN 'building=yes' ELSE 'unclassified' END AS category,
      c_custkey * 0.5::DOUBLE AS lat, c_custkey * 0.25::DOUBLE AS lon, CASE WHEN c_custkey % 2 = 0 THEN 'node' ELSE 'way' END AS osm_type, c_custkey AS osm_id
      FROM customer WHERE c_custkey % 11 <> 0 AND ((c_custkey % 2 = 0 AND c_custkey % 5 <> 0) OR c_custkey % 3 = 0)""",
    "children_select": f"SELECT parent_id, child_id, level FROM {_children_sql('true')}",
    "children_choose": f"""WITH e AS (SELECT *, 'members' AS origin FROM {_children_sql('p_partkey % 4 = 0 AND p_partkey % 13 < 9')} UNION ALL SELECT *, 'denser' FROM {_children_sql('p_partkey % 4 > 1 AND p_partkey % 13 > 3')}
      UNION ALL SELECT p_partkey % 13, p_partkey, '', 'listed' FROM part WHERE p_partkey % 4 = 1),
      n AS (SELECT parent_id, count(*) FILTER (WHERE origin = 'members') AS m, count(*) FILTER (WHERE origin = 'denser') AS d FROM e GROUP BY 1),
      c AS (SELECT parent_id, CASE WHEN m < 20 AND d > greatest(m, 2) THEN 'denser' WHEN m >= 2 THEN 'members' ELSE 'listed' END AS origin FROM n)
      SELECT parent_id, child_id, origin FROM e JOIN c USING (parent_id, origin)""",
    "children_served": f"SELECT parent_id, count(*) >= 2 AND (count(*) >= 20 OR count(*) FILTER (WHERE level <> '') >= greatest(2, count(*) // 2)) AS ok FROM {_children_sql('true')} GROUP BY 1",
    "parent_match": f"""WITH {_SHAPES_SQL.format(two="'AB-' || n_nationkey", three="'AB-' || n_nationkey")},
      x AS (SELECT id, CASE WHEN key = 'brazil' THEN 7 END AS p, (SELECT min(area_id) FROM a WHERE iso = code) AS i, (SELECT arg_min(area_id, ord) FROM a WHERE k = key) AS n,
       (SELECT arg_min(area_id, ord) FROM a WHERE (contains(key, k) OR contains(k, key)) AND least(length(k), length(key)) >= 5) AS c FROM s)
      SELECT id, coalesce(p, i, n, c)::BIGINT AS area_id, CASE WHEN p IS NOT NULL THEN 'pinned' WHEN i IS NOT NULL THEN 'iso' WHEN n IS NOT NULL THEN 'name' WHEN c IS NOT NULL THEN 'part' END AS how FROM x""",
    "area_ids": f"""WITH {_SHAPES_SQL.format(two="NULL", three="NULL")},
      x AS (SELECT id, CASE WHEN key = 'brazil' THEN 7 END AS p, (SELECT min(area_id) FROM a WHERE k = key HAVING count(*) = 1) AS n FROM s)
      SELECT id, coalesce(p, n)::BIGINT AS area_id, CASE WHEN p IS NOT NULL THEN 'pinned' WHEN n IS NOT NULL THEN 'name' END AS how FROM x""",
    "child_assign": _LOCATE_SQL + f""", c AS (SELECT area_id, {_CENTRE.format('x')} AS cx, {_CENTRE.format('y')} AS cy FROM areas),
      d AS (SELECT point_id, area_id, (lon - cx) * (lon - cx) + (lat - cy) * (lat - cy) AS d FROM p, c WHERE point_id NOT IN (SELECT point_id FROM l)),
      r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, area_id) AS rn FROM d WHERE d < 144)
      SELECT point_id AS child_id, area_id AS parent_id FROM l UNION ALL SELECT point_id, area_id FROM r WHERE rn = 1""",
    "event_name_intervals": "WITH e AS (SELECT user_id AS k, ts, event_id AS id, strftime(ts, '%Y-%m-%d') AS day, {'p': CASE WHEN event_id % 4 <> 0 THEN event_type END, 'a': CASE WHEN event_id % 3 = 0 THEN event_type ELSE '' END} AS state FROM events WHERE event_id % 4 <> 0 OR event_id % 3 = 0), "
    + _RUNS_SQL + " SELECT k AS user_id, run, first_day, last_day, state.p AS primary, state.a AS available, observations FROM spans",
    "ring_assemble": f"WITH {_POINTS_SQL} SELECT point_id AS relation_id, 0 AS n, CASE WHEN point_id % 2 = 1 THEN 2 ELSE 1 END AS n_rings, lon AS west, lat AS south FROM p",
    "extract_resolve": """WITH e AS (SELECT 'x/' || lower(n_name) AS extract, lower(n_name) AS leaf, NULL AS c, 'P' || n_nationkey AS p, 2 AS depth, n_nationkey + 10 AS ord FROM nation UNION ALL SELECT lower(r_name), lower(r_name), 'C' || r_regionkey, NULL, 1, r_regionkey FROM region),
      s AS (SELECT n_nationkey::BIGINT AS id, extract, ord, CASE WHEN n_nationkey % 5 = 0 AND p = 'P' || n_nationkey THEN 400 + depth WHEN n_nationkey % 3 = 0 AND regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') = regexp_replace(leaf, '[^a-z0-9]', '', 'g') THEN 350 + depth
       WHEN n_nationkey % 3 = 1 AND regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') = regexp_replace(leaf, '[^a-z0-9]', '', 'g') THEN 320 + depth WHEN c = 'C' || n_regionkey THEN 200 + depth END::INT AS score FROM nation, e),
      r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS rn FROM s WHERE score IS NOT NULL) SELECT id, extract, score FROM r WHERE rn = 1""",
    "previous_language": """WITH f AS (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS l FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1)
      SELECT o_orderkey AS row, coalesce(l, '') AS languages, l IS NULL AS unlabelled FROM orders LEFT JOIN f USING (o_custkey) WHERE o_orderkey % 2 = 0""",
    "nation_boxes": "WITH p AS (SELECT c_custkey * 37 % 340 - 169.75::DOUBLE AS lon, c_custkey * 53 % 140 - 69.75::DOUBLE AS lat, c_nationkey FROM customer) SELECT c_nationkey, min(lat) - 0.25 AS south, min(lon) - 0.25 AS west, max(lat) + 0.25 AS north, max(lon) + 0.25 AS east FROM p GROUP BY 1",
    "area_numbers": "SELECT c_custkey, c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 2400000000 ELSE 3600000000 END AS area FROM customer",
}
