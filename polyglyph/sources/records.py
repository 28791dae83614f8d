"""Readers and writers of site records, map elements, observation logs and boundaries. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INTERVAL = "struct<from: string, to: string, primary: string, observations: int, available: array<string>, landing_path: string>"
SITE = f"name string, website string, category string, lat double, lon double, osm_type string, osm_id long, language string, history_source string, lang_history array<{INTERVAL}>"
OBSERVATION = "url string, snapshot string, date string, final_url string, http_status int, primary string, available array<string>, words int, complete boolean, status string"
ELEMENT = "struct<type: string, id: long, tags: map<string, string>, lat: double, lon: double, center: struct<lat: double, lon: double>, nodes: array<long>>"
PROPERTIES = "osm_type string, osm_id long, name string, admin_level string, iso string, parent_iso string, parent_osm_id long, parent_name string, kind string"
CORRUPT = "_corrupt_record"
POLYGON, MULTI = "array<array<array<double>>>", "array<array<array<array<double>>>>"


def _json(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def read_sites(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Site records of JSON arrays, or with `lines` of what write_sites wrote. A path that is not there has none; a file that is no JSON has none and is left alone.

    language is a list or, in older files, a label: both become a list of strings, the label as its only member.
    """
    try:
        rows = _json(spark, path, SITE, lines)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SITE).withColumn("language", language_list(F.col("language")))
    return rows.where(_whole() == "").drop(CORRUPT).withColumn("language", language_list(F.col("language")))


def _whole() -> Column:
    """Empty for a row of a file that is JSON. Spark refuses to read the corrupt column alone, so a name is read with it."""
    return F.coalesce(F.col(CORRUPT), F.substring(F.coalesce("name", F.lit("")), 1, 0))


def damaged_files(spark: SparkSession, path: str) -> DataFrame:
    """(file): the files of site records that read_sites reads as empty since they are no JSON. They are left where they are."""
    rows = _json(spark, path, SITE)
    return rows.where(_whole() != "").select(F.col("_metadata.file_path").alias("file")).distinct()


def write_sites(sites: DataFrame, path: str) -> None:
    """Site records as JSON lines, a folder of files that read_sites(lines=True) reads; the old folder is replaced when all are written."""
    sites.withColumn("language", F.to_json("language")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_extracts(spark: SparkSession, path: str) -> DataFrame:
    """extract, name, parent, iso1, iso2, url and depth of a catalogue of extracts ({"features": [...]}) that have a file."""
    schema = "features array<struct<properties: struct<id: string, name: string, parent: string, `iso3166-1:alpha2`: array<string>, `iso3166-2`: array<string>, urls: map<string, string>>>>"
    p = _json(spark, path, schema).where("features is not null").select(F.inline("features")).select("properties.*")
    none = F.array().cast("array<string>")
    url = F.try_element_at("urls", F.lit("pbf"))
    depth = F.length("id") - F.length(F.translate("id", "/", "")) + F.when(F.col("parent").isNotNull(), 1).otherwise(0)
    return p.where(url.isNotNull()).select(F.col("id").alias("extract"), "name", "parent", F.coalesce("iso3166-1:alpha2", none).alias("iso1"), F.coalesce("iso3166-2", none).alias("iso2"), url.alias("url"), depth.alias("depth"))


def list_datasets(spark: SparkSession, folder: str) -> DataFrame:
    """(name, url, bytes) of the JSON files in a folder, by name. Only the listing is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    file = F.element_at(F.split("path", "/"), -1)
    return files.select(F.regexp_replace(file, r"\.json$", "").alias("name"), F.concat(F.lit("data/"), file).alias("url"), F.col("length").alias("bytes")).orderBy("name")


def language_list(value: Column) -> Column:
    listed = F.from_json(value, "array<string>")
    return F.when(value.startswith("["), listed).when(value.isNotNull(), F.array(value))


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """type, id, tags, lat, lon, nodes of map elements in answers of the form {"elements": [...]}; centres give the place."""
    answers = _json(spark, path, f"elements array<{ELEMENT}>")
    e = answers.where("elements is not null").select(F.inline("elements"))
    return e.select("type", "id", F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"), F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"), "nodes")


def split_log(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, markers) of a log, batch or stream: a marker says that a URL is complete. A row without a URL is neither."""
    named = rows.where(F.col("url").isNotNull())
    done = F.coalesce("complete", F.lit(False))
    return named.where(~done).drop("complete", "status"), named.where(done).select("url", "status")


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """An observation log in JSON lines; lines cut short are left out."""
    rows = _json(spark, path, OBSERVATION, lines=True)
    return split_log(rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT))


def append_log(observations: DataFrame, markers: DataFrame, path: str) -> None:
    """Appends observations, then the markers of the URLs they complete."""
    observations.write.mode("append").json(path)
    markers.select("url", F.lit(True).alias("complete"), "status").write.mode("append").json(path)


_FEATURE = "properties struct<" + ", ".join(c.replace(" ", ": ") for c in PROPERTIES.split(", ")) + ">, geometry struct<type: string, coordinates: string>"


def _areas(features: DataFrame) -> DataFrame:
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    polygons = F.when(kind == "Polygon", F.array(F.from_json(text, POLYGON))).when(kind == "MultiPolygon", F.from_json(text, MULTI))
    return features.select("properties.*", F.coalesce(polygons, F.array().cast(MULTI)).alias("polygons"))


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    """Areas of GeoJSON collections, one a file: their properties and `polygons`, a multipolygon in either case."""
    collections = _json(spark, path, "features array<struct<" + _FEATURE.replace("properties struct", "properties: struct").replace("geometry struct", "geometry: struct") + ">>")
    return _areas(collections.where("features is not null").select(F.inline("features")))


def read_boundary_lines(spark: SparkSession, path: str) -> DataFrame:
    """What write_boundaries wrote."""
    return _areas(_json(spark, path, _FEATURE, lines=True).where(F.col(CORRUPT).isNull()))


def write_boundaries(areas: DataFrame, path: str, by: str = "parent_osm_id") -> None:
    """A GeoJSON feature a line, in a folder for each parent, so that no parent's areas have to fit one row."""
    names = [c.split(" ")[0] for c in PROPERTIES.split(", ")]
    one = F.size("polygons") == 1
    text = F.when(one, F.to_json(F.get("polygons", F.lit(0)))).otherwise(F.to_json("polygons"))
    geometry = F.concat(F.lit('{"type":"'), F.when(one, "Polygon").otherwise("MultiPolygon"), F.lit('","coordinates":'), text, F.lit("}"))
    line = F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*[c for c in names if c in areas.columns])), F.lit(',"geometry":'), geometry, F.lit("}"))
    areas.select(line.alias("value"), F.col(by).alias("of")).repartition("of").write.mode("overwrite").partitionBy("of").text(path)


def boundary_index(areas: DataFrame, by: str = "parent_osm_id") -> DataFrame:
    """(parent, n, name): how many areas each parent has."""
    return areas.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min("parent_name").alias("name"))
