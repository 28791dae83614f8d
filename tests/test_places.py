"""Names, children, boundaries, change-point searches and the observation log, with hand-derived cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from polyglyph.functions import areas as A
from polyglyph.functions import names as N
from polyglyph.operators import classify, geo, history, places
from polyglyph.sources import records as S
from polyglyph.sources.languages import load_packs
from polyglyph.streaming import observations as O

SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0], [1.0, 1.0]]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "region,name,want",
    [
        ("wales", "Siop y Pentre", "welsh"), ("wales", "The Shop", "english"), ("wales", "123", None), ("greenland", "Qaqortoq", "greenlandic"), ("greenland", "Nuuk", "danish"),
        ("kazakhstan", "Магазин", "russian"), ("estonia", "Shop", "estonian"), ("estonia", "Кафе", "russian"), ("quebec", "Dépanneur 5", "french"), ("ukraine", None, None), ("kazakhstan", "", None),
    ],
)
def test_names(spark, region, name, want):
    assert one(spark, N.REGIONS[region].classify(F.lit(name).cast("string"))) == want


def test_keys_and_boxes(spark):
    assert one(spark, A.folded_key(F.lit("Saint-Étienne"))) == "saintetienne" and one(spark, A.plain_key(F.lit("Saint-Étienne"))) == "sainttienne"
    assert one(spark, A.iso_candidates(F.lit("ABC-12"))) == ["AB-12"] and one(spark, A.iso_candidates(F.lit("GB.SCT"))) == ["GB-SCT"] and one(spark, A.iso_candidates(F.lit(None))) == []
    inside = lambda lat: one(spark, A.in_box(F.lit(lat).cast("double"), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0)))
    assert (inside(2.0), inside(2.5), inside(None)) == (True, False, True)


def test_rings():
    line = [[x / 10, 0.0 if x % 2 else 0.05] for x in range(400)]
    short = geo.shorten_ring([*line, [40.0, 9.0], line[0]], 48)
    assert len(short) <= 49 and short[0] == short[-1]
    assert geo.thin_ring([[0, 0], [1, 0.0001], [2, 0], [2, 2], [0, 2], [0, 0]]) == [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]


def test_assemble_and_move(spark):
    rings = spark.createDataFrame([(1, "outer", 0, SQUARE), (1, "inner", 0, HOLE), (2, "inner", 0, HOLE), (3, "outer", 0, HOLE)], "relation_id long, role string, n int, ring array<array<double>>")
    assert {r.relation_id: r.rings for r in geo.assemble(rings).collect()} == {1: [SQUARE, HOLE], 3: [HOLE]}
    far = [[[x + 50, y] for x, y in SQUARE]]
    areas = spark.createDataFrame([("A", [[SQUARE], far]), ("B", [far]), ("C", [])], "iso string, polygons array<array<array<array<double>>>>")
    box = (-1.0, -1.0, 5.0, 5.0)
    moved = lambda df, a, b: {r.iso: r.polygons for r in geo.move_by_box(df, a, b, box).collect()}
    assert moved(areas, "A", "B") == {"A": [far], "B": [far, [SQUARE]], "C": []}
    assert moved(areas, "A", "Z")["A"] == [[SQUARE], far]
    both = areas.where("iso = 'A'").unionByName(spark.createDataFrame([("B", [[HOLE]])], areas.schema))
    assert moved(both, "A", "B") == {"A": [far], "B": [[HOLE]]}


def plain_search(months, first, last, coarse):
    """The search by recursion, in the order of its description."""
    seen = set()

    def at(m):
        if m in months:
            seen.add(months[m][0])
            return months[m][1]
        return None

    def halve(a, b, s, t, depth):
        if b - a <= 1 or depth > 8 or (a in months and b in months and months[a][0] == months[b][0]):
            return
        mid = (a + b) // 2
        m = at(mid)
        if m is None:
            if depth < 3:
                halve(a, mid, s, t, depth + 1)
                halve(mid, b, s, t, depth + 1)
            return
        if m != s:
            halve(a, mid, s, m, depth + 1)
        if m != t:
            halve(mid, b, m, t, depth + 1)

    grid = list(range(first, last + 1, coarse))
    grid += [] if grid[-1] == last else [last]
    states = [at(m) for m in grid]
    for a, b, s, t in zip(grid, grid[1:], states, states[1:]):
        if s and t and s != t:
            halve(a, b, s, t, 0)
    return seen if any(states) else set()


def test_search_changes(spark):
    rnd, first, last = random.Random(5), 24228, 24311
    rows = []
    for site in range(25):
        for m in range(first - 12, last + 12):
            if rnd.random() < 0.3:
                rows.append((site, f"{m // 12:04d}{m % 12 + 1:02d}{rnd.randint(1, 28):02d}000000", rnd.choice("aaab") if rnd.random() < 0.8 else None))
    got = {}
    for r in history.search_changes(spark.createDataFrame(rows, "site long, snapshot string, state string"), "site", first, last, coarse=21).collect():
        got.setdefault(r.site, set()).add(r.snapshot)
    for site in range(25):
        mine = sorted((int(s[:4]) * 12 + int(s[4:6]) - 1, s, t) for i, s, t in rows if i == site)
        months = {}
        for m in range(first, last + 1):
            near = [(abs(x - m), x, s, t) for x, s, t in mine if abs(x - m) <= 9]
            if near:
                months[m] = min(near, key=lambda v: v[:3])[2:]
        assert got.get(site, set()) == plain_search(months, first, last, 21)
    assert history.search_changes(spark.createDataFrame([], "site long, snapshot string, state string"), "site", first, last).count() == 0


def test_histories_of_names(spark):
    snaps = spark.createDataFrame([(1, "2019-01-01", "Кафе", "russian", ["russian"]), (2, "2019-01-01", "Їжа", "ukrainian", ["ukrainian"])], "id long, date string, name string, primary string, available array<string>")
    now = spark.createDataFrame([(1, "Їжа"), (2, "Їжа"), (3, "Їжа")], "id long, name string")
    all_ = history.with_current_names(snaps, now, ["id"], "2020-01-01", N.ukrainian_or_russian)
    spans = history.name_intervals(all_, ["id"], ["date"], "date")
    assert sorted((r.id, r.run, r.primary, r.observations) for r in spans.collect()) == [(1, 1, "russian", 1), (1, 2, "ukrainian", 1), (2, 1, "ukrainian", 2)]
    assert [tuple(r) for r in history.tracked(spans, ["id"], "ukrainian").collect()] == [("gained", 1)]


def test_early_languages(spark):
    packs = load_packs()
    switch = '<html lang="en"><link rel="alternate" hreflang="fr" href="/fr">'
    pages = spark.createDataFrame([(1, switch + "x" * 9000), (2, "<body>short"), (3, None), (4, "<body>" + "the and of with from " * 4000)], "id long, html string")
    got = {r.id: (r.n_chars, r.languages) for r in classify.early_languages(pages, packs, step=1000).collect()}
    assert set(got) == {1, 4} and got[1] == (1000, ["english", "french"]) and got[4][1] == ["english"] and got[4][0] < 4000


def test_order_extracts(spark):
    rows = [("fr", "France", "europe", ["FR"]), ("de", "Germany", "europe", ["DE"]), ("xk", "Kosovo (x)", "europe", []), ("us", "US", "america", ["US"]), ("alps", "Alps", "europe", []), ("ru", "Russia", "asia", ["RU"])]
    got = places.order_extracts(spark.createDataFrame(rows, "id string, name string, parent string, iso array<string>"), ["europe", "america"], without_iso=["xk"], early=["xk"], last=["fr"])
    assert [(r.id, r.name) for r in got.orderBy("position").collect()] == [("xk", "Kosovo"), ("de", "Germany"), ("us", "US"), ("fr", "France")]


def test_parent_names_and_best_relations(spark):
    a = spark.createDataFrame([(1, "Land", "LL", None, None), (2, "Part", "LL-A", "LL", None), (3, "Bit", "", None, 2), (4, "Lost", "", "ZZ", 9)], "area_id long, name string, iso string, parent_iso string, parent_id long")
    assert {r.area_id: r.parent_name for r in places.with_parent_names(a).collect()} == {1: None, 2: "Land", 3: "Part", 4: None}
    r = spark.createDataFrame([("X", 1, "4", True, 0), ("X", 2, "6", False, 1), ("X", 3, "6", False, 2), ("Y", 4, None, False, 3)], "iso string, area_id long, level string, ended boolean, ord long")
    assert {x.iso: x.area_id for x in places.best_relations(r).collect()} == {"X": 2, "Y": 4}


def test_readers(spark, tmp_path):
    assert S.read_sites(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "a.json").write_text(json.dumps([{"name": "N", "language": ["welsh"], "lat": 1.5}, {"language": "english+welsh"}, {}]))
    assert [r.language for r in S.read_sites(spark, str(tmp_path / "a.json")).collect()] == [["welsh"], ["english+welsh"], None]
    (tmp_path / "bad.json").write_text("[{")
    assert S.read_sites(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "e.json").write_text(json.dumps({"elements": [{"type": "way", "id": 7, "tags": {"website": "w", "office": "it"}, "center": {"lat": 1.0, "lon": 2.0}}, {"type": "node", "id": 8, "lat": 1.0, "lon": 2.0}]}))
    sites = places.sites_of(S.read_elements(spark, str(tmp_path / "e.json")), N.REGIONS["ukraine"]).collect()
    assert [(r.osm_id, r.category, r.name, r.lat, r.language) for r in sites] == [(7, "office=it", "(unnamed)", 1.0, None)]


def test_boundaries_round_trip(spark, tmp_path):
    feature = lambda i, kind, c: {"type": "Feature", "properties": {"osm_id": i, "name": "é", "parent_osm_id": 5, "parent_name": "P"}, "geometry": {"type": kind, "coordinates": c}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature(1, "Polygon", [SQUARE, HOLE]), feature(2, "MultiPolygon", [[SQUARE], [HOLE]])]}))
    areas = S.read_boundaries(spark, str(tmp_path / "a.geojson"))
    want = {1: [[SQUARE, HOLE]], 2: [[SQUARE], [HOLE]]}
    assert {r.osm_id: r.polygons for r in areas.collect()} == want
    S.write_boundaries(areas, str(tmp_path / "out"))
    assert {r.osm_id: r.polygons for r in S.read_boundary_lines(spark, str(tmp_path / "out")).collect()} == want
    assert [tuple(r) for r in S.boundary_index(areas).collect()] == [(5, 2, "P")]


def test_observation_log(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    row = lambda u, t, p, w=50: json.dumps({"url": u, "snapshot": t + "15000000", "date": f"{t[:4]}-{t[4:]}-15", "final_url": f"http://{u}/{p}/", "primary": p, "available": [p], "words": w})
    (log / "1.json").write_text("\n".join([row("a", "201901", "uk"), row("a", "201903", "ru"), row("a", "201901", "uk", 9), json.dumps({"url": "a", "complete": True, "status": "ok"}), '{"url": "b", "snap']))
    run = lambda: O.ingest(spark, str(log), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    run()
    (log / "2.json").write_text("\n".join([row("a", "201902", "uk"), row("a", "201903", "ru"), row("b", "201901", "en")]))
    run()
    run()
    kept = O.stored(spark, str(tmp_path / "t/observations"))
    spans = sorted((r.url, r["from"], r["to"], r.primary, r.observations, r.landing_path) for r in O.histories(kept).collect())
    assert spans == [("a", "2019-01-15", "2019-02-15", "uk", 2, "/uk/"), ("a", "2019-03-15", "2019-03-15", "ru", 1, "/ru/"), ("b", "2019-01-15", "2019-01-15", "en", 1, "/en/")]
    urls = spark.createDataFrame([("a",), ("b",)], "url string")
    assert [r.url for r in O.pending(urls, O.stored(spark, str(tmp_path / "t/markers"))).collect()] == ["b"]
    seen, done = S.read_log(spark, str(log))
    assert seen.count() == 6 and done.count() == 1


def test_record_helpers(spark):
    from polyglyph.operators import records

    assert [one(spark, records.unlabelled(F.array(*map(F.lit, v)).cast("array<string>"))) for v in ([], ["unknown"], ["", "fetch_failed"], ["welsh"])] == [True, True, True, False]
    assert one(spark, records.unlabelled(F.lit(None).cast("array<string>"))) is True
    sites = spark.createDataFrame([(3, "a", "x"), (1, "a", "x"), (2, "b", "y")], "row long, url string, name string")
    assert [(r.row, r.url) for r in records.site_sample(sites, 1, ["url"], "row").collect()] == [(1, "a")]
    labels = spark.createDataFrame([("a", ["welsh"])], "url string, languages array<string>")
    assert sorted((r.row, r.languages) for r in records.annotate(sites, labels, "url", "languages").collect()) == [(1, ["welsh"]), (2, []), (3, ["welsh"])]


def test_area_number_refuses_nodes(spark):
    with pytest.raises(Exception, match="no area for node"):
        one(spark, places.area_number(F.lit("node"), F.lit(5)))


def test_change_search_hands_no_snapshot_to_many_months(spark):
    rows = [(1, "202001", "a"), (1, "202012", "b"), (2, "202005", "a"), (None, "202005", "a")]
    df = history.search_changes(spark.createDataFrame([(s, f"{m}15000000", t) for s, m, t in rows], "site long, snapshot string, state string"), "site", 24240, 24251, coarse=6)
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == [(1, "20200115000000"), (1, "20201215000000"), (2, "20200515000000")]
