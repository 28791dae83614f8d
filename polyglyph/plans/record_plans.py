"""Queries over records, histories, places and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import areas as A
from ..functions import names as N
from ..operators import geo as G
from ..operators import history as Hi
from ..operators import records as R
from ..operators.relations import stitch_relations

#: Squares on a grid, one with a hole; the points derived from customers fall in and between them.
AREAS = [(i + 1, f"area{i + 1}", x, y) for i, (x, y) in enumerate((x, y) for x in range(-160, 160, 40) for y in range(-60, 60, 30))]
QUERY_AREAS = ("united", "iran", "north")


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _square(x, y, n):
    return [[x, y], [x + n, y], [x + n, y + n], [x, y + n], [x, y]]


def _areas(spark):
    rows = [(i, name, [_square(float(x), float(y), 20.0), *([_square(x + 5.0, y + 5.0, 5.0)] if i % 2 else [])]) for i, name, x, y in AREAS]
    return spark.createDataFrame(rows, "area_id long, name string, rings array<array<array<double>>>")


def _points(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("point_id"), (k * 37 % 340 - 169.75).alias("lon"), (k * 53 % 140 - 69.75).alias("lat"), "c_nationkey")


def pending_urls(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left_anti")


def known_urls(spark, sf_dir):
    done = table(spark, sf_dir, "labels").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left_semi")


def label_merge(spark, sf_dir):
    known = ["en", "de", "fr", "es"]
    old = table(spark, sf_dir, "documents").select("doc_id", R.normalize_languages(F.array("lang"), known).alias("previous"))
    new = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, F.array(F.lit("xx"))).otherwise(F.array().cast("array<string>")).alias("new"))
    merged = R.merge_label(F.coalesce("new", F.array().cast("array<string>")), F.col("previous"))
    return old.join(new, "doc_id", "left").select("doc_id", F.array_join(merged, ",").alias("languages"))


def upsert_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("language"), F.col("o_orderpriority").alias("name"))
    old = o.where("k % 4 <> 0")
    new = o.where("k % 5 <> 0").select("k", F.lit("new").alias("language"), F.concat(F.lit("n"), "name").alias("name"))
    return R.upsert(old, new, ["k"], ["language"])


def _spans(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return Hi.intervals(e, ["user_id"], ["ts", "event_id"], "event_type", "day")


def event_intervals(spark, sf_dir):
    return _spans(spark, sf_dir).select("user_id", "run", F.col("from").alias("first_day"), F.col("to").alias("last_day"), "primary", "observations")


def event_transitions(spark, sf_dir):
    return Hi.transitions(_spans(spark, sf_dir), ["user_id"])


def event_annotation(spark, sf_dir):
    """Customers as records and events as an observation log of their websites: the history of each, by both tracks."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    url = F.concat(F.lit("http://u"), "user_id")
    both = F.when(k % 11 == 0, F.array().cast("array<string>")).when(k % 3 == 0, F.array(F.col("event_type"), F.lit("x"))).otherwise(F.array("event_type"))
    path = F.when(k % 4 == 0, "").when(k % 4 == 1, "/").when(k % 4 == 2, "/a?q").otherwise("/b;p")
    log = e.select(
        url.alias("url"), F.concat(F.date_format("ts", "yyyyMMddHHmmss"), F.lpad(k.cast("string"), 12, "0")).alias("snapshot"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.concat(url, path).alias("final_url"), F.col("event_type").alias("primary"), both.alias("available"),
    )
    c = F.col("c_custkey")
    records = table(spark, sf_dir, "customer").select(c, F.when(c % 3 == 0, F.concat(F.lit(" u"), c, F.lit(" "))).when(c % 3 == 1, F.concat(F.lit("http://u"), c)).otherwise(F.concat(F.lit("mailto:u"), c)).alias("website"))
    said = lambda h: F.array_join(F.transform(h, lambda i: F.concat_ws(":", i["from"], i["to"], i["primary"], i["observations"], F.array_join(i["available"], ","), i["landing_path"])), ";")
    one, two = (Hi.annotate_histories(records, log, track=t) for t in ("primary", "available"))
    two = two.select("c_custkey", said(F.col("lang_history")).alias("by_list"))
    return one.select("c_custkey", "history_state", said(F.col("lang_history")).alias("by_primary")).join(two, "c_custkey")


def event_annotation_counts(spark, sf_dir):
    """How many of those records have a history, and changed, and from what to what."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    log = e.select(
        F.concat(F.lit("http://u"), "user_id").alias("url"), F.lpad(k.cast("string"), 12, "0").alias("snapshot"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.when(k % 2 == 0, "http://x").otherwise("http://x/").alias("final_url"), F.col("event_type").alias("primary"), F.array("event_type").alias("available"),
    )
    records = table(spark, sf_dir, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("website"))
    return Hi.history_counts(Hi.annotate_histories(records, log))


def interval_modal(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return Hi.modal(e, ["user_id"], "event_type", ["ts", "event_id"])


def nearest_snapshot(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), Hi.month_index(F.date_format("o_orderdate", "yyyy-MM")).alias("month"))
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), F.explode(F.sequence(F.lit(1992 * 12), F.lit(1998 * 12), F.lit(6))).alias("month"))
    return Hi.nearest(wanted, o, "site", "month")


def month_timeline(spark, sf_dir):
    e = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM"))
    spans = Hi.intervals(e, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus", "day")
    t = Hi.timeline(spans, ["o_custkey"], 1993 * 12, 1996 * 12)
    return t.groupBy("month", "primary").agg(F.count(F.lit(1)).alias("sites"))


def month_functions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM").alias("m")).distinct()
    i = Hi.month_index(F.col("m"))
    return o.select("m", i.alias("month_index"), Hi.month_text(i).alias("back"), Hi.month_stamp(i).alias("stamp"))


_NAMES = [("Їжа", None, None), ("Рынок", None, None), ("Кафе", "Кафе", "Кафе"), ("Мій", None, None), ("Shop", "", "Shop"), ("Ґанок ы", "x", None)]


def name_pair_classify(spark, sf_dir):
    """Every part under one of six names and its number, with name tags."""
    k = F.col("p_partkey")
    pick = lambda i: F.get(F.array(*[F.lit(n[i]).cast("string") for n in _NAMES]), (k % len(_NAMES)).cast("int"))
    df = table(spark, sf_dir, "part").select(k, F.concat_ws(" ", pick(0), k).alias("name"), *[F.when(pick(i) != "", F.concat_ws(" ", pick(i), k)).otherwise(pick(i)).alias(c) for i, c in ((1, "uk"), (2, "ru"))])
    primary, available = N.by_tags(F.col("name"), F.col("uk"), F.col("ru"), "ukrainian", "russian", N.ukrainian_or_russian)
    return df.select("p_partkey", primary.alias("primary"), F.array_join(available, ",").alias("available"))


def tile_grid(spark, sf_dir):
    """The tiles of a box for every supplier."""
    k = F.col("s_suppkey")
    south, west = (k % 60).cast("double"), (k * 7 % 170).cast("double")
    boxes = table(spark, sf_dir, "supplier").select(k.alias("k"), south.alias("south"), west.alias("west"), (south + 0.5 + k % 5 * 0.75).alias("north"), (west + 1.0 + k % 3 * 0.25).alias("east"))
    return G.tile_grid(boxes.drop("k"), 1.0)


def point_in_polygon(spark, sf_dir):
    return G.locate(_points(spark, sf_dir), _areas(spark), cell=10.0)


def nearest_centroid(spark, sf_dir):
    return G.nearest_area(_points(spark, sf_dir), _areas(spark), within=12.0)


def area_share(spark, sf_dir):
    p = _points(spark, sf_dir)
    at = G.locate(p, _areas(spark), cell=10.0).join(p.select("point_id", "c_nationkey"), "point_id")
    langs = F.array_compact(F.array(F.when(F.col("c_nationkey") % 2 == 0, "english"), F.when(F.col("c_nationkey") % 3 == 0, "welsh")))
    shares = G.area_shares(at.select("area_id", langs.alias("languages")))
    return shares.select("area_id", "language", "sites", F.round("share", 6).alias("share"), F.round("multilingual_share", 6).alias("multilingual_share"))


def way_centroid(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    ways = li.groupBy(F.col("l_orderkey").alias("way_id")).agg(F.collect_list("l_suppkey").alias("node_ids"))
    k = F.col("s_suppkey")
    nodes = table(spark, sf_dir, "supplier").select(k.alias("node_id"), (k * 1.0).alias("lat"), (k * 2.0).alias("lon"))
    return G.way_centroids(ways, nodes).select("way_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def _squares(spark, sf_dir):
    k, x, y = F.col("point_id"), F.col("lon"), F.col("lat")
    square = lambda at, n: F.array(*[F.array(x + at + a * n, y + at + b * n) for a, b in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    return _points(spark, sf_dir).select(k.alias("area_id"), F.when(k % 2 == 1, F.array(square(0, 4), square(1, 1))).otherwise(F.array(square(0, 4))).alias("rings"))


def area_bbox(spark, sf_dir):
    """Boxes and means of a square at every customer's point, every other one with a hole."""
    return _squares(spark, sf_dir).select("area_id", G.bbox(F.col("rings")[0]).alias("b"), G.vertex_mean(F.col("rings")).alias("c")).select("area_id", "b.*", F.round("c.lon", 6).alias("lon"), F.round("c.lat", 6).alias("lat"))


def place_search(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("area_id"), F.col("n_name").alias("name"), F.lit("country").alias("kind"))
    r = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("area_id"), F.col("r_name").alias("name"), F.lit("subdivision_1").alias("kind"))
    areas = n.unionByName(r).withColumn("key", A.folded_key(F.col("name")))
    return G.top_areas(areas, "key", "america", A.name_rank(F.col("key"), "america")).unionByName(G.top_areas(areas, "key", "nation1", A.name_rank(F.col("key"), "nation1")))


def best_extract(spark, sf_dir):
    """For each customer's nation, the finest region that covers it: the score argmax, first of equals."""
    n = table(spark, sf_dir, "nation")
    score = F.when(F.col("r_regionkey") == F.col("n_regionkey"), 400).when(F.col("r_regionkey") < F.col("n_regionkey"), 200).otherwise(0) + F.length("r_name")
    pairs = n.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(4)))).join(F.broadcast(table(spark, sf_dir, "region")), F.col("c") == F.col("r_regionkey")).withColumn("score", score)
    return pairs.groupBy("n_nationkey").agg(F.max_by("r_name", F.struct("score", -F.col("r_regionkey"))).alias("extract"), F.max("score").alias("score"))


def area_codes(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    code = F.concat(F.lower(F.substring("p_brand", 1, 2)), F.lit("_"), F.col("p_size").cast("string"))
    return p.select("p_partkey", A.iso_code(code).alias("iso"), A.stable_id(F.col("p_name")).alias("stable_id"), A.area_kind((F.col("p_size") % 9).cast("string")).alias("kind"), F.array_join(A.child_levels(F.col("p_size") % 11).cast("array<string>"), ",").alias("levels"), A.plain_key(F.col("p_name")).alias("key"))


def common_nations(spark, sf_dir):
    """The seven nations with most customers."""
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("string").alias("nation")).agg(F.count(F.lit(1)).alias("n"))
    return R.most_common(counts, "nation", 7)


def mojibake(spark, sf_dir):
    """Part names with accents, a third of them UTF-8 read as Latin-1, a third of them damaged."""
    k = F.col("p_partkey")
    name = F.concat(F.lit("Québec "), "p_name")
    wrong = F.decode(F.encode(name, "UTF-8"), "ISO-8859-1")
    return table(spark, sf_dir, "part").select("p_partkey", A.fix_mojibake(F.when(k % 3 == 0, wrong).when(k % 3 == 1, name).when(k % 5 > 0, F.concat(F.lit("Ãx€"), "p_name"))).alias("name"))


def ring_simplify(spark, sf_dir):
    """A square at every customer's point with a corner too many, which lies off its side by less than the tolerance for even keys."""
    k = F.col("point_id")
    x, y = F.col("lon"), F.col("lat")
    corner = lambda a, b: F.array(x + a, y + b)
    ring = F.array(corner(0, 0), F.array(x + 1, y + F.when(k % 2 == 0, 0.00001).otherwise(0.5)), corner(2, 0), corner(2, 2), corner(0, 2), corner(0, 0))
    done = G.simplify(_points(spark, sf_dir).select(k.alias("area_id"), F.array(ring).alias("rings")), 0.005)
    first = F.col("rings")[0]
    return done.select("area_id", F.size("rings").alias("n_rings"), F.size(first).alias("n"), F.round(first[1][0], 2).alias("lon"), F.round(first[1][1], 2).alias("lat"))


def ring_stitch(spark, sf_dir):
    """A square around every customer's point, cut into three lines, some of them reversed, and put together again."""
    p = _points(spark, sf_dir)
    corner = lambda a, b: F.array(F.col("lon") + a, F.col("lat") + b)
    lines = (F.array(corner(0, 0), corner(1, 0)), F.array(corner(1, 1), corner(1, 0)), F.array(corner(1, 1), corner(0, 1), corner(0, 0)))
    pieces = p.select(F.col("point_id").alias("relation_id"), F.explode(F.array(*lines)).alias("line")).select("relation_id", F.when(F.col("relation_id") % 2 == 0, "outer").otherwise("inner").alias("role"), "line")
    ring = F.col("ring")
    return stitch_relations(pieces).select("relation_id", "role", "n", F.size(ring).alias("points"), _total(ring, 0).alias("lon"), _total(ring, 1).alias("lat"))


def _total(ring, i):
    """The sum of a coordinate over a closed ring's corners."""
    return F.round(F.aggregate(F.slice(ring, 1, F.size(ring) - 1), F.lit(0.0), lambda a, q: a + q[i]), 4)


QUERIES = {
    f.__name__: f
    for f in (pending_urls, known_urls, label_merge, upsert_merge, event_intervals, event_transitions, event_annotation, event_annotation_counts, interval_modal, nearest_snapshot, month_timeline, month_functions, name_pair_classify, tile_grid, point_in_polygon, nearest_centroid, area_share, way_centroid, area_bbox, place_search, best_extract, area_codes, common_nations, mojibake, ring_simplify, ring_stitch)
}

_RUNS_SQL = """
 x AS (SELECT *, CASE WHEN lag(state) OVER w IS NOT DISTINCT FROM state AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY k ORDER BY ts, id)),
 y AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY ts, id ROWS UNBOUNDED PRECEDING)::INT AS run FROM x),
 spans AS (SELECT k, run, min(day) AS first_day, max(day) AS last_day, any_value(state) AS state, count(*) AS observations FROM y GROUP BY k, run)
"""
_EVENTS_SQL = "WITH e AS (SELECT user_id AS k, ts, event_id AS id, event_type AS state, strftime(ts, '%Y-%m-%d') AS day FROM events), " + _RUNS_SQL
_MONTH = "(year({0}) * 12 + month({0}) - 1)::INT"
_AREAS_SQL = "areas(area_id, x, y) AS (VALUES " + ", ".join(f"({i}::BIGINT, {x}.0::DOUBLE, {y}.0::DOUBLE)" for i, _, x, y in AREAS) + ")"
_POINTS_SQL = "p AS (SELECT c_custkey AS point_id, c_custkey * 37 % 340 - 169.75::DOUBLE AS lon, c_custkey * 53 % 140 - 69.75::DOUBLE AS lat, c_nationkey FROM customer)"
_LOCATE_SQL = f"WITH {_AREAS_SQL}, {_POINTS_SQL}, l AS (SELECT point_id, min(area_id) AS area_id FROM p JOIN areas ON lon >= x AND lon < x + 20 AND lat >= y AND lat < y + 20 WHERE NOT (area_id % 2 = 1 AND lon >= x + 5 AND lon < x + 10 AND lat >= y + 5 AND lat < y + 10) GROUP BY point_id)"
_CENTRE = "CASE WHEN area_id % 2 = 1 THEN ({0} * 2 + ({0} + 20) * 2 + {0}) + ({0} + 5) * 3 + ({0} + 10) * 2 ELSE {0} * 3 + ({0} + 20) * 2 END / CASE WHEN area_id % 2 = 1 THEN 10.0 ELSE 5.0 END"

ORACLE_SQL = {
    "pending_urls": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "known_urls": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)",
    "label_merge": "SELECT d.doc_id, CASE WHEN l.quality = 1 THEN 'xx' ELSE coalesce(d.lang, '') END AS languages FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "upsert_merge": """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS language, o_orderpriority AS name FROM orders),
      a AS (SELECT * FROM o WHERE k % 4 <> 0), b AS (SELECT k, 'new' AS language, 'n' || name AS name FROM o WHERE k % 5 <> 0)
      SELECT coalesce(a.k, b.k) AS k, coalesce(a.language, b.language) AS language, CASE WHEN b.k IS NOT NULL THEN b.name ELSE a.name END AS name FROM a FULL JOIN b ON a.k = b.k""",
    "event_intervals": _EVENTS_SQL + "SELECT k AS user_id, run, first_day, last_day, state AS primary, observations FROM spans",
    "event_transitions": _EVENTS_SQL + ", t AS (SELECT k, arg_min(state, run) AS from_state, arg_max(state, run) AS to_state, max(run) AS runs FROM spans GROUP BY k) SELECT from_state, to_state, count(*) AS n FROM t WHERE runs > 1 AND from_state <> to_state GROUP BY ALL",
    "event_annotation": """WITH e AS (SELECT user_id AS k, strftime(ts, '%Y%m%d%H%M%S') || lpad(event_id::VARCHAR, 12, '0') AS snap, strftime(ts, '%Y-%m-%d') AS day, event_type AS p, CASE WHEN event_id % 3 = 0 THEN [event_type, 'x'] ELSE [event_type] END AS a,
        CASE event_id % 4 WHEN 2 THEN '/a' WHEN 3 THEN '/b' ELSE '/' END AS path FROM events WHERE event_id % 11 <> 0),
      t AS (SELECT *, unnest([p, array_to_string(a, ' ')]) AS state, unnest(['p', 'l']) AS track FROM e),
      x AS (SELECT *, CASE WHEN lag(state) OVER w = state THEN 0 ELSE 1 END AS new FROM t WINDOW w AS (PARTITION BY track, k ORDER BY snap)),
      y AS (SELECT *, sum(new) OVER (PARTITION BY track, k ORDER BY snap) AS run FROM x),
      paths AS (SELECT track, k, run, path, count(*) AS n, min(snap) AS f FROM y GROUP BY ALL),
      best AS (SELECT track, k, run, first(path ORDER BY n DESC, f) AS path FROM paths GROUP BY ALL),
      lists AS (SELECT track, k, run, array_to_string(list_sort(list_distinct(flatten(list(a)))), ',') AS a, min(day) AS d, max(day) AS u, any_value(p) AS p, count(*) AS n FROM y GROUP BY ALL),
      h AS (SELECT track, k, string_agg(d || ':' || u || ':' || p || ':' || n || ':' || a || ':' || path, ';' ORDER BY run) AS said FROM lists JOIN best USING (track, k, run) GROUP BY ALL)
      SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 OR c_custkey NOT IN (SELECT user_id FROM events) THEN 'no_history' WHEN a.said IS NULL THEN 'no_usable_label' ELSE 'with_history' END AS history_state,
        CASE WHEN c_custkey % 3 < 2 THEN a.said END AS by_primary, CASE WHEN c_custkey % 3 < 2 THEN b.said END AS by_list
      FROM customer LEFT JOIN h a ON a.k = c_custkey AND a.track = 'p' LEFT JOIN h b ON b.k = c_custkey AND b.track = 'l'""",
    "event_annotation_counts": """WITH x AS (SELECT user_id AS k, event_id AS snap, event_type AS p, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS new FROM events WHERE user_id IN (SELECT c_custkey FROM customer)),
      h AS (SELECT k, sum(new) AS runs, arg_min(p, snap) AS a, arg_max(p, snap) AS b FROM x GROUP BY k),
      s AS (SELECT unnest(['with_history', CASE WHEN runs > 1 THEN 'changed' END, CASE WHEN runs > 1 THEN 'changed_same_landing_path' END, CASE WHEN runs > 1 AND a <> b THEN a || ' -> ' || b END]) AS state FROM h
        UNION ALL SELECT 'no_history' FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events))
      SELECT state, count(*) AS n FROM s WHERE state IS NOT NULL GROUP BY 1""",
    "interval_modal": "WITH c AS (SELECT user_id, event_type, count(*) AS n, min((ts, event_id)) AS f FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rn FROM c) SELECT user_id, event_type FROM r WHERE rn = 1",
    "nearest_snapshot": f"""WITH s AS (SELECT DISTINCT o_custkey AS site, {_MONTH.format('o_orderdate')} AS seen FROM orders), w AS (SELECT c_custkey AS site, unnest(range(23904, 23977, 6))::INT AS month FROM customer),
      r AS (SELECT site, month, seen, row_number() OVER (PARTITION BY site, month ORDER BY abs(seen - month), seen) AS rn FROM w JOIN s USING (site) WHERE abs(seen - month) <= 9) SELECT site, month, seen FROM r WHERE rn = 1""",
    "month_timeline": f"WITH e AS (SELECT o_custkey AS k, o_orderdate AS ts, o_orderkey AS id, o_orderstatus AS state, {_MONTH.format('o_orderdate')} AS day FROM orders), {_RUNS_SQL}, t AS (SELECT state, unnest(range(greatest(first_day, 23916), least(last_day, 23952) + 1))::INT AS month FROM spans WHERE first_day <= 23952 AND last_day >= 23916) SELECT month, state AS primary, count(*) AS sites FROM t GROUP BY ALL",
    "month_functions": f"SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS m, {_MONTH.format('o_orderdate')} AS month_index, strftime(o_orderdate, '%Y-%m') AS back, strftime(o_orderdate, '%Y%m') || '15000000' AS stamp FROM orders",
    "name_pair_classify": """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ukrainian' WHEN 1 THEN 'russian' WHEN 2 THEN 'ukrainian' WHEN 3 THEN 'ukrainian' WHEN 4 THEN 'russian' END AS "primary",
      CASE p_partkey % 6 WHEN 0 THEN 'ukrainian' WHEN 1 THEN 'russian' WHEN 2 THEN 'russian,ukrainian' WHEN 3 THEN 'ukrainian' WHEN 4 THEN 'russian' ELSE 'ukrainian' END AS available FROM part""",
    "tile_grid": "WITH b AS (SELECT (s_suppkey % 60)::DOUBLE AS s, (s_suppkey * 7 % 170)::DOUBLE AS w, s + 0.5 + s_suppkey % 5 * 0.75 AS n, w + 1.0 + s_suppkey % 3 * 0.25 AS e FROM supplier), i AS (SELECT *, unnest(range(0, ceil(n - s)::INT)) AS i FROM b), j AS (SELECT *, unnest(range(0, ceil(e - w)::INT)) AS j FROM i) SELECT s + i AS tile_south, w + j AS tile_west, least(s + i + 1, n)::DOUBLE AS tile_north, least(w + j + 1, e)::DOUBLE AS tile_east FROM j",
    "point_in_polygon": _LOCATE_SQL + " SELECT point_id, area_id FROM l",
    "nearest_centroid": f"WITH {_AREAS_SQL}, {_POINTS_SQL}, c AS (SELECT area_id, {_CENTRE.format('x')} AS cx, {_CENTRE.format('y')} AS cy FROM areas), d AS (SELECT point_id, area_id, (lon - cx) * (lon - cx) + (lat - cy) * (lat - cy) AS d FROM p, c), r AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY d, area_id) AS rn FROM d WHERE d < 144) SELECT point_id, area_id FROM r WHERE rn = 1",
    "area_share": _LOCATE_SQL + """, t AS (SELECT area_id, list_filter([CASE WHEN c_nationkey % 2 = 0 THEN 'english' END, CASE WHEN c_nationkey % 3 = 0 THEN 'welsh' END], lambda z: z IS NOT NULL) AS g FROM l JOIN p USING (point_id)),
      a AS (SELECT area_id, count(*) FILTER (WHERE len(g) > 0) AS c, count(*) FILTER (WHERE len(g) > 1) AS m FROM t GROUP BY 1), u AS (SELECT area_id, unnest(g) AS language FROM t)
      SELECT area_id, language, count(*) AS sites, round(count(*) / any_value(c), 6) AS share, round(any_value(m) / any_value(c), 6) AS multilingual_share FROM u JOIN a USING (area_id) GROUP BY area_id, language""",
    "way_centroid": "SELECT l_orderkey AS way_id, round(avg(l_suppkey * 1.0::DOUBLE), 6) AS lat, round(avg(l_suppkey * 2.0::DOUBLE), 6) AS lon FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1",
    "area_bbox": f"WITH {_POINTS_SQL} SELECT point_id AS area_id, lon AS west, lat AS south, lon + 4 AS east, lat + 4 AS north, round(CASE WHEN point_id % 2 = 1 THEN (10 * lon + 15) / 10 ELSE (5 * lon + 8) / 5 END, 6)::DOUBLE AS lon, round(CASE WHEN point_id % 2 = 1 THEN (10 * lat + 15) / 10 ELSE (5 * lat + 8) / 5 END, 6)::DOUBLE AS lat FROM p",
    "place_search": """WITH a AS (SELECT (n_nationkey + 100)::BIGINT AS area_id, n_name AS name, 'country' AS kind, 0 AS kr FROM nation UNION ALL SELECT r_regionkey::BIGINT, r_name, 'subdivision_1', 1 FROM region),
      k AS (SELECT *, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS key, q FROM a, (VALUES ('america'), ('nation1')) AS v(q)),
      r AS (SELECT *, CASE WHEN key = q THEN 0 WHEN starts_with(key, q) THEN 1 WHEN ends_with(key, q) THEN 2 WHEN contains(key, q) THEN 3 END::INT AS rank FROM k),
      n AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rank, kr, length(key), name, area_id) AS rn FROM r WHERE rank IS NOT NULL)
      SELECT area_id, name, kind, rank FROM n WHERE rn <= 10""",
    "best_extract": "WITH s AS (SELECT n_nationkey, r_name, r_regionkey, (CASE WHEN r_regionkey = n_regionkey THEN 400 WHEN r_regionkey < n_regionkey THEN 200 ELSE 0 END + length(r_name))::INT AS score FROM nation, region), r AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY score DESC, r_regionkey) AS rn FROM s) SELECT n_nationkey, r_name AS extract, score FROM r WHERE rn = 1",
    "area_codes": """WITH c AS (SELECT *, upper(translate(lower(substr(p_brand, 1, 2)) || '_' || p_size, '_', '-')) AS code, (p_size % 9)::INT AS lv, p_size % 11 AS pl FROM part),
      b AS (SELECT *, CASE WHEN pl <= 3 THEN 4 WHEN pl <= 5 THEN 6 ELSE 8 END AS best FROM c)
      SELECT p_partkey, CASE WHEN regexp_full_match(code, '[A-Z]{2}-[A-Z0-9]{1,3}') THEN code ELSE '' END AS iso, ('0x' || substr(sha1(p_name), 1, 8))::BIGINT % 900000000 + 100000000 AS stable_id,
      CASE WHEN lv <= 2 THEN 'country' WHEN lv <= 4 THEN 'subdivision_1' ELSE 'subdivision_2' END AS kind, array_to_string(list_filter([best, best + 2, best - 1, best + 1], lambda v: v >= 3 AND v <= 10 AND v > pl), ',') AS levels, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS key FROM b""",
    "common_nations": "SELECT c_nationkey::VARCHAR AS nation, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey::VARCHAR)::INT AS place FROM customer GROUP BY 1 ORDER BY n DESC, nation LIMIT 7",
    "mojibake": "SELECT p_partkey, CASE WHEN p_partkey % 3 < 2 THEN 'Québec ' || p_name WHEN p_partkey % 5 > 0 THEN 'Ãx€' || p_name END AS name FROM part",
    "ring_simplify": "SELECT c_custkey AS area_id, 1 AS n_rings, CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 6 END AS n, round(c_custkey * 37 % 340 - 169.75 + CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END, 2)::DOUBLE AS lon, round(c_custkey * 53 % 140 - 69.75 + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 0.5 END, 2)::DOUBLE AS lat FROM customer",
    "ring_stitch": "SELECT c_custkey AS relation_id, CASE WHEN c_custkey % 2 = 0 THEN 'outer' ELSE 'inner' END AS role, 0 AS n, 5 AS points, round(4 * (c_custkey * 37 % 340 - 169.75) + 2, 4)::DOUBLE AS lon, round(4 * (c_custkey * 53 % 140 - 69.75) + 2, 4)::DOUBLE AS lat FROM customer",
}
