"""Administrative areas of several sources made into one tree: countries, their subdivisions and those within."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.areas import area_kind, fix_mojibake, folded_key, iso_code, plain_key, stable_id
from .places import match_parents

# Census codes of Canada's provinces and their ISO codes; a territory that counts as another country's.
CENSUS_PROVINCES = {
    "10": "CA-NL", "11": "CA-PE", "12": "CA-NS", "13": "CA-NB", "24": "CA-QC", "35": "CA-ON", "46": "CA-MB",
    "47": "CA-SK", "48": "CA-AB", "59": "CA-BC", "60": "CA-YT", "61": "CA-NT", "62": "CA-NU",
}
OVERSEAS_PARENT = {"GF": "FR"}
KIND_LABELS = {"country": "Country", "subdivision_1": "Subdivision 1", "subdivision_2": "Subdivision 2"}
#: Areas of one level from which on a level is too local to show, and the fewest that a parent shows.
MOST_AREAS, LEAST_AREAS = 8000, 2
#: Hits of a search.
MOST_HITS = 10


def _lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def feature_codes(code: Column, country: Column, overseas: dict[str, str] = OVERSEAS_PARENT) -> tuple[Column, Column]:
    """(iso, country) of a subdivision: the country in its ISO code goes before the one given; empty where there is none."""
    iso = F.coalesce(iso_code(code), F.lit(""))
    of = F.when(iso != "", F.substring(iso, 1, 2)).otherwise(F.upper(F.coalesce(country, F.lit(""))))
    of = F.coalesce(_lookup(overseas, of), of)
    return iso, F.when(F.length(of) == 2, of).otherwise("")


def with_ids(areas: DataFrame) -> DataFrame:
    """areas (osm_id, iso, name) where a missing id is a stable number made of the code, else of the name."""
    made = stable_id(F.coalesce(F.nullif("iso", F.lit("")), F.col("name"), F.lit("")))
    return areas.withColumn("osm_id", F.coalesce(F.nullif("osm_id", F.lit(0)), made))


def too_deep(areas: DataFrame, parent: str = "parent_osm_id", level: str = "admin_level") -> DataFrame:
    """(parent, too_deep): whether fewer than two areas are there or more than half lie below level 4."""
    digits = F.coalesce(F.nullif(level, F.lit("")), F.lit("4"))
    deeper = F.count_if(digits.rlike("^[0-9]+$") & (digits.try_cast("int") > 4))
    n = F.count(F.lit(1))
    return areas.groupBy(parent).agg(((n < LEAST_AREAS) | (deeper > n / 2)).alias("too_deep"))


def mostly_ready(parents: DataFrame, done: DataFrame, group: str = "parent_iso", key: str = "osm_id") -> DataFrame:
    """(group, ready): whether at least two of a group's parents, and nine tenths of them, are among `done`."""
    have = parents.join(done.select(key, F.lit(1).alias("_done")).distinct(), key, "left")
    n, there = F.count(F.lit(1)), F.count("_done")
    return have.groupBy(group).agg(((n >= 2) & (there >= F.greatest(F.lit(2), F.floor(n * 0.9)))).alias("ready"))


def assign_by_code(children: DataFrame, parents: DataFrame, codes: dict[str, str] = CENSUS_PROVINCES) -> DataFrame:
    """children (code, ...) with parent_osm_id of the parent (osm_id, iso) that their code stands for; others go."""
    of = parents.where("iso <> ''").groupBy(F.col("iso").alias("_iso")).agg(F.max("osm_id").alias("parent_osm_id"))
    return children.withColumn("_iso", _lookup(codes, F.col("code"))).join(of, "_iso").drop("_iso")


def child_areas(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of second subdivisions: children (shape_id, name, parent_osm_id, maybe polygons) below parents (osm_id, name, iso).

    Names are repaired, ids are stable numbers; a child without a name goes. Of several parents with one id the least
    name and code count.
    """
    of = parents.groupBy(F.col("osm_id").alias("parent_osm_id")).agg(F.min("name").alias("parent_name"), F.min(F.coalesce("iso", F.lit(""))).alias("parent_iso"))
    name = fix_mojibake(F.col("name"))
    named = children.withColumn("name", name).where("name <> ''").join(of, "parent_osm_id")
    number = stable_id(F.coalesce(F.nullif("shape_id", F.lit("")), F.col("name")))
    return named.select(F.lit("relation").alias("osm_type"), number.alias("osm_id"), "name", F.lit("6").alias("admin_level"), F.lit("subdivision_2").alias("kind"), "parent_osm_id", F.coalesce("parent_name", F.lit("")).alias("parent_name"), "parent_iso", *[c for c in children.columns if c == "polygons"])


def worth_showing(children: DataFrame, level: str, parent: str = "parent_osm_id", most: int | None = MOST_AREAS, least: int = LEAST_AREAS) -> DataFrame:
    """children without the levels (one value of `level` each) of more than `most` areas (None: all levels stay) and the parents with fewer than `least`."""
    kept = children
    if most is not None:
        per_level = children.groupBy(F.col(level).alias("_l")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") <= most).select("_l")
        kept = children.join(per_level, F.col(level).eqNullSafe(F.col("_l"))).drop("_l")
    per_parent = kept.groupBy(F.col(parent).alias("_p")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select("_p")
    return kept.join(per_parent, F.col(parent) == F.col("_p")).drop("_p")


def promoted(shapes: DataFrame, areas: DataFrame, country: str = "country") -> DataFrame:
    """First subdivisions of a country made of another source's shapes (id, shape_id, name, iso, country).

    A shape that match_parents finds among areas (area_id, name, iso, level, ord) takes that area's id, name, code and
    level; another has a stable number and level 4. A country that so has fewer than two keeps what it had: no rows.
    """
    s = shapes.withColumn("name", fix_mojibake(F.col("name"))).where("name <> ''")
    found = match_parents(s.select("id", "name", "iso"), areas.select("area_id", "name", "iso", "ord")).select("id", "area_id")
    of = areas.groupBy("area_id").agg(F.min_by(F.struct(F.col("name").alias("n"), F.col("iso").alias("i"), F.col("level").alias("l")), "ord").alias("_a"))
    joined = s.join(found, "id", "left").join(of, "area_id", "left")
    rows = joined.select(
        "id", F.coalesce("area_id", stable_id(F.coalesce(F.nullif("shape_id", F.lit("")), F.col("name")))).alias("osm_id"), F.coalesce(F.nullif("_a.n", F.lit("")), F.col("name")).alias("name"),
        F.coalesce("_a.l", F.lit("4")).alias("admin_level"), F.coalesce("_a.i", F.lit("")).alias("iso"), F.col(country).alias("parent_iso"),
    )
    enough = rows.groupBy(F.col("parent_iso").alias("_c")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= LEAST_AREAS).select("_c")
    return rows.join(enough, F.col("parent_iso").eqNullSafe(F.col("_c"))).drop("_c")


def with_overseas(areas: DataFrame, overseas: DataFrame) -> DataFrame:
    """areas (osm_id, name, parent_iso, ...) and the overseas ones (the same columns, and `names`: keys they go by) that are not there.

    One is there if its country has an area with its id or with one of its names.
    """
    keys = F.array_union(F.coalesce("names", F.array().cast("array<string>")), F.array(folded_key(F.col("name"))))
    by_id = overseas.join(areas.select("parent_iso", "osm_id").distinct(), ["parent_iso", "osm_id"], "left_anti")
    named = areas.select("parent_iso", folded_key(F.col("name")).alias("_key")).distinct()
    there = by_id.select("parent_iso", "osm_id", F.explode(keys).alias("_key")).join(named, ["parent_iso", "_key"]).select("parent_iso", "osm_id").distinct()
    return areas.unionByName(by_id.join(there, ["parent_iso", "osm_id"], "left_anti").select(*areas.columns))


def area_index(countries: DataFrame, admin1: DataFrame) -> DataFrame:
    """Countries (osm_id, name, iso, admin_level) and first subdivisions (also parent_iso, parent_osm_id) as rows to be searched.

    A subdivision has its country's name, by code, else by id. Areas without a name or an id are left out.
    """
    ok = "name <> '' and osm_id is not null"
    c = countries.where(ok).select("osm_id", "name", F.upper(F.coalesce("iso", F.lit(""))).alias("iso"), F.coalesce(F.nullif("admin_level", F.lit("")), F.lit("2")).alias("admin_level"), F.lit("country").alias("kind"))
    a = admin1.where(ok).select(
        "osm_id", "name", F.coalesce("iso", F.lit("")).alias("iso"), F.coalesce(F.nullif("admin_level", F.lit("")), F.lit("4")).alias("admin_level"), F.lit("subdivision_1").alias("kind"),
        F.upper(F.coalesce("parent_iso", F.lit(""))).alias("parent_iso"), F.nullif("parent_osm_id", F.lit(0)).alias("parent_osm_id"),
    )
    by_iso = c.where("iso <> ''").groupBy(F.col("iso").alias("parent_iso")).agg(F.max_by("name", "osm_id").alias("_a"))
    by_id = c.groupBy(F.col("osm_id").alias("parent_osm_id")).agg(F.max("name").alias("_b"))
    named = a.join(by_iso, "parent_iso", "left").join(by_id, "parent_osm_id", "left").withColumn("parent_name", F.coalesce("_a", "_b", F.lit(""))).drop("_a", "_b")
    rows = named.unionByName(c, allowMissingColumns=True)
    return rows.withColumn("key", folded_key(F.col("name"))).withColumn("iso_key", folded_key(F.col("iso")))


def search_rank(key: Column, iso_key: Column, query: str) -> Column:
    """0 equal, 1 prefix (of the name or the code), 2 suffix of 4 letters at least, 3 part of 5 at least, else 4."""
    out = F.when((key == query) | (iso_key == query), 0).when(F.startswith(key, F.lit(query)) | F.startswith(iso_key, F.lit(query)), 1)
    out = out.when(F.lit(len(query) >= 4) & F.endswith(key, F.lit(query)), 2).when(F.lit(len(query) >= 5) & F.contains(key, F.lit(query)), 3)
    return out.otherwise(4)


def search_areas(index: DataFrame, remote: DataFrame, query: str, most: int = MOST_HITS) -> DataFrame:
    """The best areas for a query (a folded key): the index's own if the best of them is equal or a prefix, else with the remote ones.

    remote: rows of the index's columns that another search found. An area found by both is the index's. Both sides are
    cut to the `most` best before they are compared, which is all that a search shows.
    """
    kinds = F.when(F.col("kind") == "country", 0).when(F.col("kind") == "subdivision_1", 1).when(F.col("kind") == "subdivision_2", 2).otherwise(9)
    order = [F.col("rank"), F.col("kind_rank"), F.length("key"), F.col("name"), F.col("osm_id")]
    ranked = lambda df: df.withColumn("rank", search_rank(F.col("key"), F.coalesce("iso_key", F.lit("")), query)).withColumn("kind_rank", kinds)
    own = ranked(index).where("rank < 4").orderBy(*order).limit(most).withColumn("origin", F.lit(0))
    other = ranked(remote).orderBy(*order).limit(most).withColumn("origin", F.lit(1)) if len(query) >= 3 else ranked(remote).limit(0).withColumn("origin", F.lit(1))
    both = own.unionByName(other, allowMissingColumns=True)  # 2 * most rows
    best = F.min(F.when(F.col("origin") == 0, F.col("rank"))).over(W.partitionBy())
    first = F.row_number().over(W.partitionBy("osm_id").orderBy("origin", *order))
    shown = both.withColumn("_best", best).withColumn("_first", first).where("_first = 1 and (origin = 0 or coalesce(_best > 1, true))")
    return hits(shown.orderBy(*order).limit(most))


def hits(rows: DataFrame, *more: str) -> DataFrame:
    """What a search shows of areas, after the columns `more`: empty optional values are null, a missing kind is told from the level."""
    kind = F.coalesce("kind", area_kind(F.col("admin_level")))
    optional = [F.nullif(c, F.lit("")).alias(c) for c in ("iso", "parent_name", "parent_iso")]
    return rows.select(*more, "name", "osm_id", "admin_level", kind.alias("kind"), _lookup(KIND_LABELS, kind).alias("kind_label"), *optional, "parent_osm_id")


def subdivisions(wanted: DataFrame, children: DataFrame) -> DataFrame:
    """(osm_id, kind, n, features): each wanted area's second subdivisions by id; none are an empty leaf.

    children: osm_id, name, parent_osm_id.
    """
    of = children.groupBy(F.col("parent_osm_id").alias("osm_id")).agg(F.array_sort(F.collect_list(F.struct(F.col("osm_id").alias("id"), "name"))).alias("features"))
    features = F.coalesce("features", F.array().cast("array<struct<id:bigint,name:string>>"))
    return wanted.select("osm_id").distinct().join(of, "osm_id", "left").select("osm_id", F.lit("subdivision_2").alias("kind"), F.size(features).alias("n"), features.alias("features"))
