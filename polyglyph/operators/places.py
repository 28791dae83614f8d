"""Sites from map elements, children of areas, and matching areas of two sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.areas import child_levels, folded_key, iso_candidates, plain_key
from ..functions.names import REGIONS, Region, site_languages

# Tags that name what a place is, the first that is there wins.
CATEGORY_TAGS = ("shop", "amenity", "office", "craft", "tourism", "leisure", "healthcare", "government", "religion", "historic", "natural", "man_made", "landuse", "building")
LEAST_PART = 5


def sites_of(elements: DataFrame, region: Region | None = REGIONS["ukraine"]) -> DataFrame:
    """Site records of elements (type, id, tags, lat, lon) that have a website and a place.

    language holds what the name tags say by a region's rule, wherever the place is; without a region nothing.
    """
    tags = F.col("tags")
    tag = lambda k: F.try_element_at(tags, F.lit(k))
    website = F.coalesce(F.nullif(tag("website"), F.lit("")), F.nullif(tag("contact:website"), F.lit("")))
    category = F.coalesce(*[F.when(F.map_contains_key(tags, k), F.concat(F.lit(f"{k}="), tag(k))) for k in CATEGORY_TAGS], F.lit("unclassified"))
    language = site_languages(*region.languages(tags)) if region else F.lit(None).cast("array<string>")
    out = elements.select(
        F.coalesce(tag("name"), F.lit("(unnamed)")).alias("name"), website.alias("website"), category.alias("category"), "lat", "lon",
        F.col("type").alias("osm_type"), F.col("id").alias("osm_id"), language.alias("language"),
    ).where("website is not null and lat is not null and lon is not null")
    return out.withColumn("history_source", F.when(F.col("language").isNotNull(), "osm_name"))


def select_children(records: DataFrame) -> DataFrame:
    """Of each parent's records (parent_id, parent_level, child_id, level, ord) those of one level, the best.

    The best: three or more of a level that is tried for the parent, in that order; else the largest level of 3 to 500;
    else two or more without a level; else the largest level; else what is there. Levels not below the parent go.
    Counts alone decide, so no parent's records are gathered.
    """
    level = F.when(F.col("level").rlike("^[0-9]+$"), F.col("level").cast("int"))
    r = records.withColumn("_level", level).where(F.col("_level").isNull() | (F.coalesce("parent_level", F.lit(0)) <= 0) | (F.col("_level") > F.col("parent_level")))
    n = r.groupBy("parent_id", "parent_level", "_level").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))
    tried = F.array_position(child_levels(F.coalesce("parent_level", F.lit(0))), F.col("_level"))
    big = F.col("n") >= 3
    rank = (
        F.when(F.col("_level").isNull() & (F.col("n") >= 2), F.struct(F.lit(2), F.lit(0).cast("long"), F.col("first")))
        .when(F.col("_level").isNull(), F.struct(F.lit(4), F.lit(0).cast("long"), F.col("first")))
        .when(big & (tried > 0), F.struct(F.lit(0), tried.cast("long"), F.col("first")))
        .when(big & (F.col("n") <= 500), F.struct(F.lit(1), -F.col("n"), F.col("first")))
        .otherwise(F.struct(F.lit(3), -F.col("n"), F.col("first")))
    )
    best = n.groupBy("parent_id").agg(F.min_by(F.struct("_level"), rank).alias("_b")).select(F.col("parent_id").alias("_p"), F.col("_b._level").alias("_l"))
    return r.join(best, (F.col("parent_id") == F.col("_p")) & F.col("_level").eqNullSafe(F.col("_l"))).select(*records.columns)


def choose_children(members: DataFrame, denser: DataFrame, listed: DataFrame) -> DataFrame:
    """Each parent's children from the source that serves it, with `origin`.

    The members, unless they are fewer than 20 and the denser source has more of them and over two; the listed ones
    where fewer than two were found.
    """
    some = select_children(members).withColumn("origin", F.lit("members")).unionByName(select_children(denser).withColumn("origin", F.lit("denser")))
    every = some.unionByName(listed.withColumn("origin", F.lit("listed")))
    n = every.groupBy("parent_id").agg(F.count_if(F.col("origin") == "members").alias("m"), F.count_if(F.col("origin") == "denser").alias("d"))
    dense = (F.col("m") < 20) & (F.col("d") > F.greatest("m", F.lit(2)))
    source = F.when(F.when(dense, F.col("d")).otherwise(F.col("m")) < 2, "listed").when(dense, "denser").otherwise("members")
    return every.join(n.select("parent_id", source.alias("origin")), ["parent_id", "origin"])


def children_ok(children: DataFrame) -> DataFrame:
    """(parent_id, ok): two or more children, and 20 or at least half of them (two at least) with a level."""
    n, labelled = F.count(F.lit(1)), F.count_if(F.col("level").rlike("^[0-9]+$"))
    return children.groupBy("parent_id").agg(((n >= 2) & ((n >= 20) | (labelled >= F.greatest(F.lit(2), F.floor(n / 2))))).alias("ok"))


def _pinned(key: Column, pinned: dict[str, int]) -> Column:
    if not pinned:
        return F.lit(None).cast("long")
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pinned.items() for x in kv]), key).cast("long")


def _best(found: DataFrame, order: list[str]) -> DataFrame:
    return found.groupBy("id").agg(F.min_by("area_id", F.struct(*order)).alias("area_id"))


def match_parents(shapes: DataFrame, areas: DataFrame, pinned: dict[str, int] | None = None) -> DataFrame:
    """(id, area_id, how): the area of each shape (id, name, iso) among areas (area_id, name, iso, ord); null without any.

    Tried in turn: pinned keys, ISO codes, equal names, and a name that is part of the other with five letters at least.
    Of two names one of which holds the other, the first five letters of the shorter are five successive letters of the
    longer, so this too is an equi-join. The first area by ord of several.
    """
    s = shapes.select("id", folded_key(F.col("name")).alias("key"), F.posexplode_outer(iso_candidates(F.col("iso"))).alias("pos", "code"))
    a = areas.select("area_id", folded_key(F.col("name")).alias("area_key"), F.col("iso").alias("area_iso"), "ord")
    keys = s.select("id", "key").distinct()
    by_iso = _best(s.join(a, F.col("code") == F.col("area_iso")), ["pos", "ord"])
    by_name = _best(keys.where("key <> ''").join(a, F.col("key") == F.col("area_key")), ["ord"])
    parts = lambda k: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(k) - LEAST_PART + 1), lambda i: F.substring(F.col(k), i, F.lit(LEAST_PART)))))
    long_keys = keys.where(F.length("key") >= LEAST_PART)
    long_areas = a.where(F.length("area_key") >= LEAST_PART)
    head = lambda k: F.substring(k, 1, LEAST_PART).alias("g")
    holds = long_keys.select("*", parts("key").alias("g")).join(long_areas.select("*", head("area_key")), "g").where(F.contains("key", F.col("area_key")))
    held = long_keys.select("*", head("key")).join(long_areas.select("*", parts("area_key").alias("g")), "g").where(F.contains("area_key", F.col("key")))
    by_part = _best(holds.unionByName(held), ["ord"])
    out = shapes.select("id", _pinned(folded_key(F.col("name")), pinned or {}).alias("p"))
    for name, found in (("i", by_iso), ("n", by_name), ("c", by_part)):
        out = out.join(found.withColumnRenamed("area_id", name), "id", "left")
    how = F.when(F.col("p").isNotNull(), "pinned").when(F.col("i").isNotNull(), "iso").when(F.col("n").isNotNull(), "name").when(F.col("c").isNotNull(), "part")
    return out.select("id", F.coalesce("p", "i", "n", "c").alias("area_id"), how.alias("how"))


def attach_ids(shapes: DataFrame, areas: DataFrame, pinned: dict[str, int] | None = None) -> DataFrame:
    """(id, area_id, how) of shapes (id, name, iso): pinned keys, then the ISO code, then a name only one area in the world has."""
    a = areas.select("area_id", folded_key(F.col("name")).alias("_key"), F.col("iso").alias("_iso"), "ord")
    by_iso = a.where("_iso <> ''").groupBy("_iso").agg(F.min_by("area_id", "ord").alias("i"))
    by_name = a.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("area_id").alias("n")).where("_n = 1").drop("_n")
    out = shapes.select("id", "iso", folded_key(F.col("name")).alias("key")).join(by_iso, F.col("iso") == F.col("_iso"), "left").join(by_name, F.col("key") == F.col("_key"), "left")
    p = _pinned(F.col("key"), pinned or {})
    how = F.when(p.isNotNull(), "pinned").when(F.col("i").isNotNull(), "iso").when(F.col("n").isNotNull(), "name")
    return out.select("id", F.coalesce(p, "i", "n").alias("area_id"), how.alias("how"))


def with_parent_names(areas: DataFrame) -> DataFrame:
    """areas (area_id, name, iso, parent_iso, parent_id) with parent_name: by the parent's ISO code, else by its id."""
    by_iso = areas.where("iso <> ''").groupBy(F.col("iso").alias("parent_iso")).agg(F.min_by("name", "area_id").alias("_a"))
    by_id = areas.groupBy(F.col("area_id").alias("parent_id")).agg(F.min("name").alias("_b"))
    return areas.join(by_iso, "parent_iso", "left").join(by_id, "parent_id", "left").select(*areas.columns, F.coalesce("_a", "_b").alias("parent_name"))


def best_relations(relations: DataFrame, iso: str = "iso") -> DataFrame:
    """One relation (iso, area_id, level, ended, ord) a code: the highest area that has not ended; the first of equals."""
    rank = F.coalesce(F.col("level").try_cast("int"), F.lit(99)) + F.when(F.col("ended"), 100).otherwise(0)
    ranked = relations.withColumn("_r", F.row_number().over(W.partitionBy(iso).orderBy(rank, "ord")))
    return ranked.where("_r = 1").drop("_r")


def order_extracts(extracts: DataFrame, continents: list[str], *, skip=(), without_iso=(), early=(), late=(), last=()) -> DataFrame:
    """Country extracts (id, name, parent, iso) of the continents with `position`, in the order they are worked on.

    Continents in turn, in each the early ones, the others by name and the late ones; `last` after all. The catalogue of
    extracts is a small table, so one window over it is no burden.
    """
    listed = lambda ids: F.col("id").isin(*ids) if ids else F.lit(False)
    wanted = extracts.where(~listed(skip) & ((F.size("iso") > 0) | listed(without_iso)) & F.col("parent").isin(*continents))
    place = lambda c, values: F.array_position(F.array(*[F.lit(v) for v in values]), c)
    keys = [listed(last), place(F.col("id"), last) if last else F.lit(0), place(F.col("parent"), continents), ~listed(early), place(F.col("id"), early) if early else F.lit(0), listed(late)]
    shown = F.trim(F.split("name", r"\(")[0])
    return wanted.select("id", shown.alias("name"), "parent", (F.row_number().over(W.orderBy(*keys, shown, "id")) - 1).alias("position"))


def resolve_extract(wanted: DataFrame, extracts: DataFrame) -> DataFrame:
    """(id, extract, score): the finest extract that covers a place; the first by ord of equals, no row without any.

    wanted: id, query, name, country, iso2 (codes of its parts); extracts: extract, name, iso1, iso2, depth, ord. A shared
    subdivision code counts most, then the name that was asked for, the name that was found, the country; depth adds to
    each. All are equal keys of one join.
    """
    def keys(df: DataFrame, columns: list[str], *parts: tuple[str, Column, int]) -> DataFrame:
        tell = lambda kind, n: lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"), F.lit(n).alias("n"))
        each = F.flatten(F.array(*[F.transform(v, tell(kind, n)) for kind, v, n in parts]))
        return df.select(*columns, F.inline(each)).where("key is not null and key <> ''")

    up = lambda c: F.transform(c, lambda v: F.upper(v))
    leaf = F.element_at(F.split("extract", "/"), -1)
    asked = keys(wanted, ["id"], ("part", up(F.col("iso2")), 400), ("name", F.array(plain_key(F.col("query"))), 350), ("name", F.array(plain_key(F.col("name"))), 320), ("country", F.array(F.upper("country")), 200))
    offered = keys(extracts, ["extract", "depth", "ord"], ("part", up(F.col("iso2")), 0), ("name", F.array(plain_key(leaf), plain_key(F.col("name"))), 0), ("country", up(F.col("iso1")), 0)).drop("n")
    hits = asked.join(offered, ["kind", "key"]).withColumn("score", F.col("n") + F.col("depth"))
    return hits.groupBy("id").agg(F.max_by("extract", F.struct("score", -F.col("ord"))).alias("extract"), F.max("score").alias("score"))


def area_number(kind: Column, osm_id: Column) -> Column:
    """The id of the area of a relation or a way; an error for anything else."""
    known = F.when(kind == "relation", osm_id + 3_600_000_000).when(kind == "way", osm_id + 2_400_000_000)
    return known.otherwise(F.raise_error(F.concat(F.lit("no area for "), F.coalesce(kind, F.lit("null")))).cast("long"))


def padded_boxes(sites: DataFrame, key: str, pad: float = 0.02) -> DataFrame:
    """(key, south, west, north, east) around each key's sites, with a margin."""
    return sites.groupBy(key).agg(
        (F.min("lat") - pad).alias("south"), (F.min("lon") - pad).alias("west"), (F.max("lat") + pad).alias("north"), (F.max("lon") + pad).alias("east")
    )
