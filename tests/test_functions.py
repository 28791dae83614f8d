"""Hand-derived cases."""

from pyspark.sql import functions as F

from polyglyph.functions.urls import normalize_url
from polyglyph.operators import classify, geo, records, relations
from polyglyph.sources.languages import load_packs

PACKS = load_packs()


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_normalize_url(spark):
    cases = {"shop.example/": "http://shop.example/", "mailto:a@b": None, "https://x.example/menu.PDF?p=1": None, "": None, "HTTP://x.example": "http://HTTP://x.example"}
    for raw, want in cases.items():
        assert one(spark, normalize_url(F.lit(raw))) == want


def test_switchers(spark):
    found = lambda h: set(one(spark, classify.switch_languages(F.lit(h), PACKS)))
    assert found('<a href="/cy/">Cymraeg</a>') == {"welsh"}
    assert found('<a href="/uk/">change language</a>') == set()
    assert found('<html lang="en_GB"><link rel="alternate" hreflang="fr" href="/fr"><a href="/x">In  Deutsch</a>') == {"english", "french", "german"}


def test_merge_and_lists(spark):
    known = ["english", "welsh"]
    assert one(spark, records.normalize_languages(F.array(F.lit("Welsh"), F.lit("english+welsh"), F.lit("klingon")), known)) == ["english", "welsh"]
    assert one(spark, records.merge_label(F.array().cast("array<string>"), F.array(F.lit("welsh")))) == ["welsh"]


def test_classify_script(spark):
    df = spark.createDataFrame([(1, "<body>" + "ελληνικα κειμενα ειναι εδω και παντου " * 4), (2, None), (3, "")], "id long, html string")
    got = {r.id: r.languages for r in classify.classify(df, PACKS).collect()}
    assert got == {1: ["greek"], 2: [], 3: []}


def test_stitch_and_simplify():
    ring = relations.stitched([[[0, 0], [1, 0]], [[1, 1], [1, 0]], [[1, 1], [0, 1], [0, 0]]])[0][1]
    assert ring[0] == ring[-1] and len(ring) == 5
    assert geo.simplify_ring([[0, 0], [1, 0.00001], [2, 0], [2, 2], [0, 2], [0, 0]], 0.005) == [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]
