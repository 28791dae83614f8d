"""Records: labels of older formats, shards, annotation, histories, and reading and writing of sites."""

import json

import pytest
from pyspark.sql import functions as F

from polyglyph.operators import boundaries as B
from polyglyph.operators import history as Hi
from polyglyph.operators import records as R
from polyglyph.sources import records as S

KNOWN = ["english", "french", "german", "welsh"]


def test_compounds_only_of_the_older_format(spark):
    cases = {("english+welsh",): ["english", "welsh"], ("welsh+klingon",): [], ("french+german",): [], (" Welsh ", "fetch_failed", None): ["welsh"], ("unknown",): [], (): [], ("french", "english", "french"): ["english", "french"]}
    df = spark.createDataFrame([(list(k), v) for k, v in cases.items()] + [(None, [])], "x array<string>, want array<string>")
    for r in df.select("*", R.normalize_languages(F.col("x"), KNOWN).alias("got"), R.good_label(F.col("x"), KNOWN).alias("good")).collect():
        assert r.got == r.want and r.good == bool(r.want)


def test_migration_tells_what_changed(spark):
    df = spark.createDataFrame([(1, ["welsh", "english"]), (2, ["english", "welsh"]), (3, None), (4, [])], "id int, language array<string>")
    got = {r.id: (r.language, r.changed) for r in R.migrate_languages(df, KNOWN).collect()}
    assert got == {1: (["english", "welsh"], True), 2: (["english", "welsh"], False), 3: ([], True), 4: ([], False)}


@pytest.mark.parametrize("rows", [10_000_000, 700])
def test_shards_of_many_partitions(spark, rows, monkeypatch):
    monkeypatch.setattr(R, "RANGE_ROWS", rows)
    n = 20_000
    urls = spark.range(0, n, 1, 37).select(F.concat(F.lit("u"), "id").alias("url"), (F.pmod(F.col("id") * 7919, F.lit(n)) * 3 + 5).alias("first_row"))
    got = {(r.url, r.position) for k in range(3) for r in R.shard(urls, k, 3).collect()}
    order = sorted(((7919 * i) % n * 3 + 5, f"u{i}") for i in range(n))
    assert got == {(u, p) for p, (_, u) in enumerate(order)}
    assert {r.position % 3 for r in R.shard(urls, 1, 3).collect()} == {1} and R.shard(urls.limit(0), 0, 2).count() == 0


def test_annotation_doubles_no_site(spark):
    sites = spark.createDataFrame([(1, "a", ["x"]), (2, "a", []), (3, "b", ["x"]), (4, None, ["x"])], "id int, url string, languages array<string>")
    labels = spark.createDataFrame([("a", ["z"]), ("a", ["y"]), ("a", []), ("b", []), (None, ["q"])], "url string, languages array<string>")
    got = {r.id: r.languages for r in R.annotate(sites, labels, "url", "languages").collect()}
    assert got == {1: ["y"], 2: ["y"], 3: ["x"], 4: ["x"]}


def test_histories_in_records(spark):
    rows = [("a", f"2019-0{m}-01", p, [p], path) for m, p, path in [(1, "uk", "/"), (2, "uk", "/"), (3, "ru", "/ru"), (4, "uk", "/")]] + [("b", "2020-01-01", "ru", ["ru"], "/")]
    seen = spark.createDataFrame(rows, "url string, date string, primary string, available array<string>, path string")
    spans = Hi.intervals(seen, ["url"], ["date"], "primary", "date", available="available", path="path")
    records = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, None)], "id int, website string")
    done = Hi.with_histories(records, spans, "website")
    got = {r.id: r.lang_history and [(h["from"], h["to"], h["primary"], h["observations"], h["landing_path"]) for h in r.lang_history] for r in done.collect()}
    a = [("2019-01-01", "2019-02-01", "uk", 2, "/"), ("2019-03-01", "2019-03-01", "ru", 1, "/ru"), ("2019-04-01", "2019-04-01", "uk", 1, "/")]
    assert got == {1: a, 2: a, 3: [("2020-01-01", "2020-01-01", "ru", 1, "/")], 4: None, 5: None}
    assert {r.url: r.moved for r in Hi.moved(spans, ["url"]).collect()} == {"a": True}


def test_sites_written_and_read(spark, tmp_path):
    rows = [("A", "http://a", "shop=x", 1.5, 2.5, "node", 1, ["welsh", "english"], None, None), ("B", "http://b", "office=y", 0.0, 0.0, "way", 2, None, "archive", [("2019", "2020", "uk", 3, ["uk"], "/")]), ("Ñ", "", "", None, None, None, None, [], None, [])]
    sites = spark.createDataFrame(rows, S.SITE.replace("language string", "language array<string>"))
    S.write_sites(sites.repartition(2), str(tmp_path / "s"))
    S.write_sites(S.read_sites(spark, str(tmp_path / "s"), lines=True), str(tmp_path / "t"))
    got = S.read_sites(spark, str(tmp_path / "t"), lines=True)
    assert sorted(map(str, got.select(*sites.columns).collect())) == sorted(map(str, sites.collect()))


def test_extract_catalogue(spark, tmp_path):
    features = [
        {"properties": {"id": "wales", "parent": "great-britain", "name": "Wales", "iso3166-2": ["GB-WLS"], "urls": {"pbf": "http://x/w.pbf", "shp": "s"}}},
        {"properties": {"id": "us/ohio", "parent": "us", "name": "Ohio", "iso3166-1:alpha2": ["US"], "urls": {"pbf": "http://x/o.pbf"}}},
        {"properties": {"id": "none", "name": "None", "urls": {"shp": "s"}}},
        {"properties": {"id": "europe", "name": "Europe", "urls": {"pbf": "http://x/e.pbf"}}},
    ]
    (tmp_path / "index.json").write_text(json.dumps({"features": features}), encoding="utf-8")
    got = {r.extract: (r.parent, r.iso1, r.iso2, r.url, r.depth) for r in S.read_extracts(spark, str(tmp_path / "index.json")).collect()}
    assert got == {"wales": ("great-britain", [], ["GB-WLS"], "http://x/w.pbf", 1), "us/ohio": ("us", ["US"], [], "http://x/o.pbf", 2), "europe": (None, [], [], "http://x/e.pbf", 0)}
    (tmp_path / "b.geojson").write_text("{}", encoding="utf-8")
    (tmp_path / "a.json").write_text("[]", encoding="utf-8")
    assert [(r.name, r.url, r.bytes > 0) for r in S.list_datasets(spark, str(tmp_path)).collect()] == [("a", "data/a.json", True), ("index", "data/index.json", True)]


def test_searches_without_hits_ask_the_other_source(spark):
    countries = spark.createDataFrame([(1, "Wales", "GB", "2"), (2, "", "XX", "2")], "osm_id long, name string, iso string, admin_level string")
    admin1 = spark.createDataFrame([(5, "Gwent", "GB-GWT", None, "gb", 9), (6, "New Wales", None, "4", None, 1)], "osm_id long, name string, iso string, admin_level string, parent_iso string, parent_osm_id long")
    index = B.area_index(countries, admin1)
    rows = {r.osm_id: r for r in index.collect()}
    assert sorted(rows) == [1, 5, 6] and rows[5].parent_name == "Wales" and rows[6].parent_name == "Wales" and rows[5].admin_level == "4"
    remote = spark.createDataFrame([(1, "Wales again", "country", "2", "walesagain", ""), (77, "Old Wales Town", "subdivision_2", "8", "oldwalestown", "")], "osm_id long, name string, kind string, admin_level string, key string, iso_key string")
    names = lambda q: [r.name for r in B.search_areas(index, remote, q).collect()]
    assert names("wales") == ["Wales", "New Wales"]
    assert names("ewwales") == ["New Wales", "Wales again", "Old Wales Town"]
    assert names("zz") == [] and names("town") == ["Old Wales Town", "Wales again"]
    leaf = B.subdivisions(spark.createDataFrame([(1,), (1,)], "osm_id long"), admin1.select("osm_id", "name", "parent_osm_id")).collect()
    assert [(r.osm_id, r.n) for r in leaf] == [(1, 1)]


def test_levels_too_large_and_parents_too_small_go(spark):
    rows = [("ADM2", 1)] * 3 + [("ADM2", 2)] + [("ADM3", 1)] * 6
    df = spark.createDataFrame(rows, "level string, parent_osm_id long")
    assert [tuple(r) for r in B.worth_showing(df, "level", most=4).collect()] == [("ADM2", 1)] * 3


def test_runs_of_large_keys(spark):
    import random

    draw = random.Random(4)
    rows = [(draw.choice(["a", "a", "a", "b", None]), draw.randint(0, 900), i, draw.choice([None, "x", "x", "y"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t int, i int, s string")
    want = sorted(map(str, Hi.runs(df, ["k"], ["t", "i"], ["s"]).collect()))
    assert sorted(map(str, Hi.runs(df, ["k"], ["t", "i"], ["s"], hot_rows=100).collect())) == want
    assert sorted(map(str, Hi.runs(df.withColumn("t", F.timestamp_seconds("t")), ["k"], ["t", "i"], ["s"], hot_rows=100).select("k", F.unix_timestamp("t").cast("int").alias("t"), "i", "s", "run").collect())) == want


def test_levels_stay_without_a_bound(spark):
    df = spark.createDataFrame([("ADM2", 1)] * 3 + [("ADM2", 2)] + [("ADM3", 1)] * 6, "level string, parent_osm_id long")
    assert sorted(map(tuple, B.worth_showing(df, "level", most=None).collect())) == [("ADM2", 1)] * 3 + [("ADM3", 1)] * 6
