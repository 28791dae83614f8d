"""Histories, upserts and keys with values typed from the rules."""

import random

import pytest
from pyspark.sql import functions as F

from polyglyph.functions import areas as A
from polyglyph.operators import boundaries as B
from polyglyph.operators import history as Hi
from polyglyph.operators import records as R
from polyglyph.streaming import observations as O

SEEN = "url string, snapshot string, date string, final_url string, primary string, available array<string>"


def test_landing_paths(spark):
    urls = ["http://a", "http://a/", "https://a/uk/?x=1#y", None, "", "http://a/x;p?q", "http://a/x;p/y", "http://a?x", "//a/b", "a/b"]
    got = [r.p for r in spark.createDataFrame([(u,) for u in urls], "u string").select(Hi.landing_path(F.col("u")).alias("p")).collect()]
    assert got == ["/", "/", "/uk/", "/", "/", "/x", "/x;p/y", "/", "/b", "a/b"]


def observations(spark):
    rows = [
        ("http://a", "20190115000000", "2019-01-15", "http://a", "uk", ["ru", "uk"]),
        ("http://a", "20190315000000", "2019-03-15", "http://a/", "ru", ["ru", "uk"]),
        ("http://a", "20190215000000", "2019-02-15", "http://a/", "uk", ["uk"]),
        ("http://a", "20190216000000", "2019-02-16", "http://a/", None, []),
        ("http://b", "20190115000000", "2019-01-15", "http://b/en", "en", ["en"]),
        ("http://b", "20200115000000", "2020-01-15", "http://b/de", "de", ["de"]),
        ("http://c", "20200115000000", "2020-01-15", "http://c/", None, []),
    ]
    return spark.createDataFrame(rows, SEEN).repartition(3)


def test_tracks(spark):
    """With track `available` the list is part of the state, and primary stays a language."""
    spans = lambda track: sorted((r.url, r.run, r["from"], r["to"], r.primary, r.observations, r.available, r.landing_path) for r in O.histories(observations(spark), track).collect())
    b = [("http://b", 1, "2019-01-15", "2019-01-15", "en", 1, ["en"], "/en"), ("http://b", 2, "2020-01-15", "2020-01-15", "de", 1, ["de"], "/de")]
    assert spans("primary") == [("http://a", 1, "2019-01-15", "2019-02-15", "uk", 2, ["ru", "uk"], "/"), ("http://a", 2, "2019-03-15", "2019-03-15", "ru", 1, ["ru", "uk"], "/"), *b]
    assert spans("available") == [
        ("http://a", 1, "2019-01-15", "2019-01-15", "uk", 1, ["ru", "uk"], "/"), ("http://a", 2, "2019-02-15", "2019-02-15", "uk", 1, ["uk"], "/"), ("http://a", 3, "2019-03-15", "2019-03-15", "ru", 1, ["ru", "uk"], "/"), *b]
    with pytest.raises(ValueError):
        O.histories(observations(spark), "words")


def test_annotated_records(spark):
    old = [("2018", "2018", "fr", 1, ["fr"], "/")]
    rows = [(1, " a ", None), (2, "http://b", old), (3, "http://c", old), (4, "http://d", None), (5, None, None), (6, "mailto:x", None)]
    records = spark.createDataFrame(rows, "id int, website string, lang_history array<struct<from:string,to:string,primary:string,observations:bigint,available:array<string>,landing_path:string>>")
    done = Hi.annotate_histories(records, observations(spark))
    got = {r.id: (r.history_state, r.lang_history and [h.primary for h in r.lang_history]) for r in done.collect()}
    assert got == {1: ("with_history", ["uk", "ru"]), 2: ("with_history", ["en", "de"]), 3: ("no_usable_label", ["fr"]), 4: ("no_history", None), 5: ("no_history", None), 6: ("no_history", None)}
    counts = {r.state: r.n for r in Hi.history_counts(done).collect()}
    assert counts == {"with_history": 2, "no_usable_label": 1, "no_history": 3, "changed": 2, "changed_same_landing_path": 1, "changed_with_landing_path_move": 1, "uk -> ru": 1, "en -> de": 1}


@pytest.mark.parametrize("kind", ["string", "date", "timestamp_ntz", "int"])
def test_runs_of_large_keys_by_any_order(spark, kind):
    draw = random.Random(7)
    rows = [(draw.choice("aaab"), f"20{draw.randint(10, 29)}-{draw.randint(1, 12):02}-{draw.randint(1, 28):02}", i, draw.choice(["x", "x", "y"])) for i in range(2000)]
    df = spark.createDataFrame(rows + [("a", None, 9999, "y")], "k string, t string, i int, s string")
    df = df.withColumn("t", F.regexp_replace("t", "-", "").cast("int") if kind == "int" else F.col("t").cast(kind))
    want = sorted(map(str, Hi.runs(df, ["k"], ["t", "i"], ["s"]).collect()))
    assert sorted(map(str, Hi.runs(df, ["k"], ["t", "i"], ["s"], hot_rows=100).collect())) == want


def test_upsert_of_repeated_keys_and_empty_lists(spark):
    old = spark.createDataFrame([(1, ["welsh"], "old", None), (2, [], "old", "x"), (3, None, "old", ""), (4, ["kept"], "old", "y")], "k int, language array<string>, name string, history string")
    rows = [(1, ["english"], "new", "h", 1), (2, ["irish"], "new", "h", 1), (3, ["a"], "first", "", 1), (3, ["b"], "last", "z", 2), (5, [], "e1", None, 2), (5, ["q"], "e0", None, 1)]
    new = spark.createDataFrame(rows, "k int, language array<string>, name string, history string, at int")
    got = {r.k: (r.language, r.name, r.history) for r in R.upsert(old, new, ["k"], ["language", "history"], "at").collect()}
    assert got == {1: (["welsh"], "new", "h"), 2: (["irish"], "new", "x"), 3: (["a"], "last", "z"), 4: (["kept"], "old", "y"), 5: (["q"], "e1", None)}
    again = R.upsert(old, new.drop("at"), ["k"], ["language", "history"])
    assert again.count() == 5 and again.columns == ["k", "language", "name", "history"]


def test_accents_are_folded_in_searches(spark):
    countries = spark.createDataFrame([(1, "Québec", "CA", "2"), (2, "Åland", "AX", "2")], "osm_id long, name string, iso string, admin_level string")
    admin1 = spark.createDataFrame([(5, "Saint-Étienne", "FR-SE", None, "ca", 1)], "osm_id long, name string, iso string, admin_level string, parent_iso string, parent_osm_id long")
    index = B.area_index(countries, admin1)
    assert {r.osm_id: r.key for r in index.collect()} == {1: "quebec", 2: "aland", 5: "saintetienne"}
    names = lambda q: [r.name for r in B.search_areas(index, index.limit(0), q).collect()]
    assert names("quebec") == ["Québec"] and names("etienne") == ["Saint-Étienne"] and names("ala") == ["Åland"]
    assert spark.range(1).select(A.folded_key(F.lit("Ångström")).alias("k")).first().k == "angstrom"


def test_nearest_does_not_broadcast_what_explodes(spark):
    from polyglyph.plans import record_plans

    plan = record_plans.nearest_snapshot(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
