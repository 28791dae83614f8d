"""Outlines, second subdivisions from polygons to files, and complete parents."""

import duckdb
import pytest
from pyspark.sql import functions as F

from polyglyph.operators import subdivisions as S
from polyglyph.plans import subdivision_plans
from polyglyph.sources import records

POLYGONS = "array<array<array<array<double>>>>"


def square(x, y, n):
    return [[[[x, y], [x + n, y], [x + n, y + n], [x, y + n], [x, y]]]]


def test_codes_of_outlines(spark):
    rows = [("de", "XX", "DE"), ("-99", "fr", "FR"), ("", "no", "NO"), (None, "-99", "-99"), ("-99", None, ""), (None, None, "")]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, b string")
    assert [r.c for r in df.select(S.outline_code(F.col("a"), F.col("b")).alias("c")).collect()] == [r[2] for r in rows]


def test_outlines_change_hands_in_the_box(spark):
    shapes = spark.createDataFrame([("RU", None, square(33.0, 45.0, 1.0) + square(60.0, 60.0, 5.0)), ("UA", None, square(30.0, 50.0, 2.0)), ("ZZ", None, square(0.0, 0.0, 1.0))], f"iso_a2 string, iso_a2_eh string, polygons {POLYGONS}")
    countries = spark.createDataFrame([(1, "R", "RU"), (2, "U", "UA"), (3, "N", "NO")], "osm_id long, name string, iso string")
    assert {r.iso: len(r.polygons) for r in S.country_outlines(shapes, countries).collect()} == {"RU": 1, "UA": 2}


def test_second_subdivisions_to_files(spark, tmp_path):
    parents = [(1, "West", "A-W", "A", square(0.0, 0.0, 10.0)), (2, "East", "A-E", "A", square(10.0, 0.0, 10.0)), (3, "Over", "B-O", "B", square(0.0, 0.0, 20.0))]
    child = lambda i, name, country, x, y, level="ADM2": (f"s{i}", name, country, level, square(x, y, 1.0))
    children = [
        child(1, "a", "A", 1.0, 1.0), child(2, "QuÃ©bec", "A", 3.0, 3.0), child(3, "alone", "A", 15.0, 3.0), child(4, "b", "B", 1.0, 1.0), child(5, "c", "B", 15.0, 9.0), child(6, "", "A", 2.0, 2.0),
        child(7, "near", "A", 4.0, -1.0), child(8, "far", "A", 90.0, 80.0), *[child(100 + i, f"x{i}", "A", 2.0, 2.0, "ADM4") for i in range(9)],
    ]
    p = spark.createDataFrame(parents, f"osm_id long, name string, iso string, country string, polygons {POLYGONS}")
    c = spark.createDataFrame(children, f"shape_id string, name string, country string, level string, polygons {POLYGONS}")
    made = S.second_subdivisions(c, p, most=8)
    assert sorted((r.name, r.parent_osm_id, r.parent_name, r.parent_iso) for r in made.collect()) == [("Québec", 1, "West", "A-W"), ("a", 1, "West", "A-W"), ("b", 3, "Over", "B-O"), ("c", 3, "Over", "B-O"), ("near", 1, "West", "A-W")]
    records.write_boundaries(made, str(tmp_path / "b"))
    back = records.read_boundary_lines(spark, str(tmp_path / "b"))
    assert {(r.name, r.parent_osm_id, str(r.polygons)) for r in back.collect()} == {(r.name, r.parent_osm_id, str(r.polygons)) for r in made.collect()}
    assert {(r.parent_osm_id, r.n) for r in records.boundary_index(back).collect()} == {(1, 3), (3, 2)}


def test_complete_children(spark):
    make = lambda *counts: spark.createDataFrame([(p, i) for p, n in counts for i in range(n)], "parent_osm_id int, i int")
    got = S.complete_children(make((1, 8), (2, 7), (3, 1), (4, 2)), make((1, 10), (2, 10), (3, 1)))
    assert {(r.parent_osm_id, r.n) for r in got.groupBy("parent_osm_id").agg(F.count("*").alias("n")).collect()} == {(1, 8), (4, 2)}


@pytest.mark.parametrize("name", sorted(subdivision_plans.QUERIES))
def test_matches_sql(spark, name):
    c, sf = duckdb.connect(), "/root/testdata/sf0.01"
    for t in ("nation", "customer", "part"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = subdivision_plans.QUERIES[name](spark, sf)
    cols = ",".join(sorted(df.columns))
    got, want = sorted(map(tuple, df.select(*sorted(df.columns)).collect())), sorted(c.execute(f"select {cols} from ({subdivision_plans.ORACLE_SQL[name]})").fetchall())
    assert got == want and got
