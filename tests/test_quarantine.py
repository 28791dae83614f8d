"""Damaged files are named, and names say their language at harvest wherever a place is."""

from polyglyph.operators import places
from polyglyph.sources import records


def test_damaged_files_are_named(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"name": "N"}, {}]')
    (tmp_path / "bad.json").write_text("[{")
    (tmp_path / "worse.json").write_text("no json")
    got = sorted(r.file.rsplit("/", 1)[1] for r in records.damaged_files(spark, str(tmp_path)).collect())
    assert got == ["bad.json", "worse.json"] and records.read_sites(spark, str(tmp_path)).count() == 2
    assert (tmp_path / "bad.json").read_text() == "[{"


def test_names_say_their_language_everywhere(spark):
    rows = [("node", 1, {"website": "w", "name": "Їжа"}, 50.0, 1.0), ("node", 2, {"website": "w", "name": "Shop"}, 50.0, 1.0), ("node", 3, {"website": "w", "name": "Рынок", "name:uk": "Ринок"}, 1.0, 1.0)]
    e = spark.createDataFrame(rows, "type string, id long, tags map<string,string>, lat double, lon double")
    assert {r.osm_id: (r.language, r.history_source) for r in places.sites_of(e).collect()} == {1: (["ukrainian"], "osm_name"), 2: (None, None), 3: (["russian", "ukrainian"], "osm_name")}
