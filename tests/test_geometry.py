"""The edge index, the tree of tiles, nested relations and stitched rings against plain recomputations."""

import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyglyph.operators import edges, relations, tiles

POINT, AREA = "point_id long, lon double, lat double", "area_id long, rings array<array<array<double>>>"


def plain_inside(polygon, lon, lat):
    def ring(r):
        odd = False
        for i in range(len(r)):
            p, q = r[i], r[i - 1]
            rise = q[1] - p[1] if abs(q[1] - p[1]) >= 1e-12 else 1e-12
            if (p[1] > lat) != (q[1] > lat) and lon < (q[0] - p[0]) * (lat - p[1]) / rise + p[0]:
                odd = not odd
        return odd

    return ring(polygon[0]) and not any(ring(h) for h in polygon[1:])


def plain_locate(points, areas):
    out = {}
    for i, lon, lat in points:
        held = [a for a, polygon in areas if lon is not None and polygon and polygon[0] and plain_inside(polygon, lon, lat)]
        if held:
            out[i] = min(held)
    return out


def some_areas(rng, n=24):
    """Stars with holes, rectangles on grid lines, rings that cross themselves."""
    out = []
    for a in range(n):
        c = rng.uniform(-8, 8, 2)
        angle = np.sort(rng.random(30)) * 2 * np.pi
        star = np.c_[np.cos(angle), np.sin(angle)] * rng.uniform(1, 4, (30, 1)) + c
        if a % 3 == 0:
            rings = [star, (star - c) / 3 + c, star[:5]]
        elif a % 3 == 1:
            x, y, w, h = *np.floor(c), *rng.integers(1, 6, 2)
            rings = [np.array([[x, y], [x + w, y], [x + w, y + h], [x, y + h], [x, y]])]
        else:
            rings = [np.round(rng.normal(size=(12, 2)) * 3 + c, 1)]
        out.append((a // 2, [r.tolist() for r in rings]))
    return out


@pytest.mark.parametrize("hot_points, hot_edges, cell", [(10**9, 10**9, 1.0), (5, 4, 2.0), (10**9, 3, 5.0), (20, 10**9, 64.0)])
def test_locate_by_loops(spark, hot_points, hot_edges, cell):
    rng = np.random.default_rng(4)
    areas = some_areas(rng)
    spots = [*rng.normal(size=(300, 2)) * 6, *np.floor(rng.normal(size=(200, 2)) * 6), *[p for _, r in areas for p in r[0][:6]]]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(spots)]
    points += [(10_000, None, 1.0), (10_001, float("nan"), 0.0), (10_002, 1e300, 0.0), points[0]]
    areas += [(90, []), (91, None), (92, [[]]), areas[0]]
    got = edges.locate(spark.createDataFrame(points, POINT), spark.createDataFrame(areas, AREA), cell, hot_points=hot_points, hot_edges=hot_edges)
    rows = got.collect()
    assert {r.point_id: r.area_id for r in rows} == plain_locate([p for p in points if p[0] < 10_000], areas) and len(rows) == len({r.point_id for r in rows})


def test_locate_of_nothing(spark):
    none, some = spark.createDataFrame([], POINT), spark.createDataFrame([(1, [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]]])], AREA)
    assert edges.locate(none, some).count() == 0 and edges.locate(spark.createDataFrame([(1, 0.9, 0.5)], POINT), some.limit(0)).count() == 0


def test_an_ocean_takes_seconds_and_one_join(spark):
    a = np.linspace(0, 2 * np.pi, 100_001)[:-1]
    ring = np.c_[170 * np.cos(a) * (1 + 0.02 * np.sin(400 * a)), 80 * np.sin(a) * (1 + 0.05 * np.sin(997 * a))]
    ocean = spark.createDataFrame([(1, [ring.tolist()])], AREA)
    rng = np.random.default_rng(0)
    spots = np.c_[rng.uniform(-180, 180, 2000), rng.uniform(-90, 90, 2000)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(spots)], POINT)
    start = time.time()
    got = edges.locate(points, ocean)
    found = {r.point_id for r in got.collect()}
    assert time.time() - start < 60
    inside = np.zeros(len(spots), bool)
    for (x1, y1), (x2, y2) in zip(ring, np.roll(ring, 1, axis=0)):
        span = (y1 > spots[:, 1]) != (y2 > spots[:, 1])
        if span.any():
            inside[span] ^= spots[span, 0] < (x2 - x1) * (spots[span, 1] - y1) / (y2 - y1) + x1
    assert found == set(np.flatnonzero(inside).tolist())
    plain = edges.locate(points, spark.createDataFrame([(1, [[[0.0, 0.0], [9.0, 0.0], [9.0, 9.0]]])], AREA), 4.0)
    assert plain._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_hot_cells_are_quartered(spark):
    """A city's cell: its points meet parts that hold few of them, and its edges are dealt to the parts."""
    rng = np.random.default_rng(2)
    angle = np.linspace(0, 2 * np.pi, 4001)[:-1]
    blob = np.c_[np.cos(angle), np.sin(angle)] * 0.4 * (1 + 0.1 * np.sin(50 * angle))[:, None] + 0.5
    areas = spark.createDataFrame([(1, [blob.tolist()])], AREA)
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((4000, 2)))], POINT)
    index = edges.spread(edges.cells(areas, 1.0))
    assert index.select(F.max(F.size(F.col("rings")[0]["edges"]))).first()[0] == 4000
    hot = edges.hot_cells(points, index, 1.0, 100, 48)
    assert hot.collect()[0]["level"] == 6
    parts = edges.deepened(index.join(hot, ["x", "y"], "left"), 1.0)
    assert parts.select(F.max(F.size(F.col("rings")[0]["edges"]))).first()[0] <= 100


def plain_tree(spots, side, most, deepest):
    at = lambda x, level: int(np.floor(x / side * 2**level))
    open_, out = [(0, x, y) for x, y in {(at(a, 0), at(b, 0)) for a, b in spots}], set()
    while open_:
        level, x, y = open_.pop()
        n = sum((at(a, level), at(b, level)) == (x, y) for a, b in spots)
        if n > most and level < deepest:
            open_ += [(level + 1, 2 * x + i, 2 * y + j) for i in (0, 1) for j in (0, 1)]
        else:
            out.add((level, x, y, n))
    return out


def test_tree_of_tiles(spark):
    rng = np.random.default_rng(6)
    spots = [*(rng.normal(size=(150, 2)) * 3).tolist(), *(rng.normal(size=(150, 2)) * 0.01 + 0.3).tolist(), *[[-1.5, -1.5]] * 40]
    df = spark.createDataFrame([(float(x), float(y)) for x, y in spots] + [(None, 1.0), (float("nan"), 2.0)], "lon double, lat double")
    rows = tiles.quadtree(df, 2.0, 10, 5).collect()
    assert {(r.level, r.x, r.y, r.n) for r in rows} == plain_tree(spots, 2.0, 10, 5)
    assert sum(r.n for r in rows) == len(spots) and all(r.n <= 10 or r.level == 5 for r in rows) and any(r.n > 10 for r in rows)
    assert len({(r.level, r.key) for r in rows}) == len(rows)
    assert tiles.quadtree(df.limit(0)).count() == 0


def test_morton_keys_nest(spark):
    df = spark.range(4000).select((F.col("id") * 37 % 501 - 250).alias("x"), (F.col("id") * 91 % 777 - 400).alias("y"))
    up = lambda c: F.shiftright(F.col(c), 2)
    keys = df.select("x", "y", tiles.morton(F.col("x"), F.col("y"), 5).alias("k"), tiles.morton(up("x"), up("y"), 3).alias("up"))
    assert keys.where(F.shiftright("k", 4) != F.col("up")).count() == 0
    rows = {(r.x, r.y): r.k for r in keys.collect()}
    assert len(set(rows.values())) == len(rows)
    for (x, y), k in list(rows.items())[:50]:
        a, b = x + (1 << 23), y + (1 << 23)
        assert k == sum(((a >> i) & 1) << (2 * i) | ((b >> i) & 1) << (2 * i + 1) for i in range(31))


def plain_stitch(lines):
    """Line by line over all that are left."""
    left, rings = [[tuple(p) for p in line] for line in lines if len(line) > 1], []
    meets = lambda a, b: abs(a[0] - b[0]) <= 1e-9 and abs(a[1] - b[1]) <= 1e-9
    while left:
        ring, grown = left.pop(0), True
        while grown and not meets(ring[0], ring[-1]):
            grown = False
            for i, other in enumerate(left):
                for piece in (other, other[::-1]):
                    if meets(ring[-1], piece[0]):
                        ring, grown = ring + piece[1:], True
                    elif meets(ring[0], piece[-1]):
                        ring, grown = piece[:-1] + ring, True
                    if grown:
                        break
                if grown:
                    left.pop(i)
                    break
        if len(ring) >= 4:
            rings.append([list(p) for p in (ring if meets(ring[0], ring[-1]) else [*ring, ring[0]])])
    return rings


def turned(ring):
    """A closed ring whatever its start and direction."""
    body = [tuple(p) for p in ring[:-1]]
    return min(tuple(b[i:] + b[:i]) for b in (body, body[::-1]) for i in range(len(b)) if b[i] == min(body))


def test_stitched_equals_the_plain_form_where_many_ends_meet():
    rng = np.random.default_rng(8)
    for n in range(200):
        spots = rng.integers(0, 5 if n % 2 else 30, (40, 2)).astype(float)
        lines = [[spots[a].tolist(), *rng.random((rng.integers(0, 3), 2)).tolist(), spots[b].tolist()] for a, b in rng.integers(0, 40, (rng.integers(1, 40), 2))]
        assert [r for _, r in relations.stitched(lines)] == plain_stitch(lines)


def circles(rng, n_rings, n_lines):
    """Rings cut into lines, shuffled and partly reversed, with an open chain."""
    out = []
    for r in range(n_rings):
        spots = [[r + i / 1000, float(rng.integers(0, 9)) + i / 1e6] for i in range(n_lines)]
        out += [[spots[i], [r + i / 1000 + 0.0005, 0.5], spots[(i + 1) % n_lines]] for i in range(n_lines)]
    out += [[[90.0 + i, 1.0], [91.0 + i, 1.0 + (i == 4)]] for i in range(5) if i < 4] + [[[200.0, 0.0], [201.0, 0.0], [200.5, 1.0]], [[300.0, 0.0], [301.0, 0.0], [300.0, 0.0]], [[310.0, 0.0], [311.0, 0.0], [311.0, 1.0], [310.0, 0.0]]]
    return [line[::-1] if rng.random() < 0.5 else line for line in (out[i] for i in rng.permutation(len(out)))]


@pytest.mark.parametrize("local_lines", [0, 12, 10_000])
def test_stitching_in_many_tasks_equals_the_plain_form(spark, local_lines):
    rng = np.random.default_rng(9)
    lines = {(i, role): circles(rng, 3, 4 + 9 * i) for i in (1, 2) for role in ("outer", "inner")}
    rows = [(i, role, line) for (i, role), ls in lines.items() for line in ls]
    df = spark.createDataFrame(rows + [(7, "outer", [[0.0, 0.0]])], "relation_id long, role string, line array<array<double>>").repartition(5)
    got = relations.stitch_relations(df, local_lines=local_lines).collect()
    for key, ls in lines.items():
        mine = [r for r in got if (r.relation_id, r.role) == key]
        assert sorted(turned(r.ring) for r in mine) == sorted(turned(r) for r in plain_stitch(ls))
        assert sorted(r.n for r in mine) == list(range(len(mine)))
    assert len(got) == sum(len(plain_stitch(ls)) for ls in lines.values())
    assert relations.stitch_relations(df.limit(0)).count() == 0


def test_chains_between_branches(spark):
    """Two rings that touch, cut finely: chains are made between the touching points, then stitched to rings."""
    left = [[float(np.cos(a)) - 1, float(np.sin(a))] for a in np.linspace(0, 2 * np.pi, 41)[:-1]]
    right = [[1 - float(np.cos(a)), float(np.sin(a))] for a in np.linspace(0, 2 * np.pi, 41)[:-1]]
    left[0] = right[0] = [0.0, 0.0]
    rows = [(1, "outer", [c[i], c[(i + 1) % 40]]) for c in (left, right) for i in range(40)]
    got = relations.stitch_relations(spark.createDataFrame(rows, "relation_id long, role string, line array<array<double>>"), local_lines=0).collect()
    assert sorted(turned(r.ring) for r in got) == sorted(turned([*c, c[0]]) for c in (left, right))


def test_a_hundred_thousand_lines(spark):
    n = 100_000
    k = F.col("id")
    at = lambda c: F.array(F.cos(c * (2 * np.pi / n)), F.sin(c * (2 * np.pi / n)))
    lines = spark.range(n).select(F.lit(1).cast("long").alias("relation_id"), F.lit("outer").alias("role"), F.array(at(k), at((k + 1) % n)).alias("line")).repartition(8)
    row = relations.stitch_relations(lines).select(F.size("ring").alias("n"), F.col("ring")[0].alias("a"), F.element_at("ring", -1).alias("b"), "ring").collect()
    assert len(row) == 1 and row[0].n == n + 1 and row[0].a == row[0].b
    ring = np.array(row[0].ring)
    assert np.hypot(*(ring[1:] - ring[:-1]).T).max() < 7e-5


def test_nested_relations(spark):
    kinds = f"id long, tags map<string,string>, members {relations.MEMBERS}"
    area = {"boundary": "administrative"}
    rows = [
        (1, area, [("way", 10, "outer"), ("relation", 2, ""), ("relation", 3, None), ("relation", 4, "outer"), ("relation", 99, "outer"), ("node", 2, "")]),
        (2, {}, [("way", 11, "inner"), ("relation", 5, "inner"), ("relation", 1, "outer")]),  # back to the first
        (3, area, [("way", 12, "")]),  # an area of its own, without a role
        (4, area, [("way", 13, None), ("relation", 5, "")]),
        (5, None, [("way", 14, "outer"), ("way", 77, "outer"), ("relation", 6, "subarea"), ("relation", 5, "")]),
        (6, {}, [("way", 15, "outer")]),
        (7, {}, None),
    ]
    df = spark.createDataFrame(rows, kinds)
    links = relations.nested_links(df)
    assert sorted(map(tuple, links.collect())) == [(1, 2), (1, 4), (2, 1), (2, 5), (4, 5), (5, 5)]
    reach = {}
    for r in relations.followed(links, df.select("id")).collect():
        reach.setdefault(r.root, []).append(r.id)
    assert {k: sorted(v) for k, v in reach.items()} == {1: [1, 2, 4, 5], 2: [1, 2, 4, 5], 3: [3], 4: [4, 5], 5: [5], 6: [6], 7: [7]}
    ways = spark.createDataFrame([(w, [[float(w), 0.0], [w + 1.0, 0.0]]) for w in range(10, 16)] + [(16, [[0.0, 0.0]])], "way_id long, line array<array<double>>")
    pieces = Counter((r.role, r.line[0][0]) for r in relations.relation_pieces(df, ways, df.where("id = 1").select("id")).collect())
    assert pieces == Counter([("outer", 10.0), ("inner", 11.0), ("outer", 13.0), ("outer", 14.0)])
    assert relations.followed(links, df.select("id").limit(0)).count() == 0


def test_lines_of_ways(spark):
    ways = spark.createDataFrame([(1, [3, 1, 9, 3]), (2, [9, 1]), (3, [])], "way_id long, node_ids array<long>")
    nodes = spark.createDataFrame([(1, 1.0, 2.0), (3, 3.0, 4.0)], "node_id long, lon double, lat double")
    assert [tuple(r) for r in relations.way_lines(ways, nodes).collect()] == [(1, [[3.0, 4.0], [1.0, 2.0], [3.0, 4.0]])]


def test_tiles_of_the_last_level_have_the_keys_of_the_sql(spark, tmp_path):
    import duckdb

    from polyglyph.plans import geometry_plans

    places = [(5,), (1200,)]  # 40 customers at each of two places, east and west
    spark.range(40).crossJoin(spark.createDataFrame(places, "at long")).selectExpr("id * 2380 + at as c_custkey", "0 as c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = sorted(map(tuple, geometry_plans.customer_tiles(spark, str(tmp_path)).collect()))
    want = duckdb.sql("with customer as (from '" + f"{tmp_path}/customer.parquet/*.parquet" + "') select * from (" + geometry_plans.ORACLE_SQL["customer_tiles"] + ")").fetchall()
    assert got == sorted(want) and max(r[0] for r in got) == 6


def test_relations_are_not_broadcast(spark):
    from polyglyph.plans import geometry_plans

    plan = geometry_plans.nested_areas(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_many_small_relations_are_stitched_in_one_pass(spark):
    rows = [(i, "outer" if j % 2 else None, [[float(a), float(i)], [float(b), float(j)]]) for i in range(30) for j in range(2) for a, b in ((0, 1), (1, 2), (2, 3))]
    rows = [(i, role, [[p[0], 0.0], [q[0], 0.0]]) for i, role, (p, q) in rows]
    df = spark.createDataFrame(rows, "relation_id long, role string, line array<array<double>>")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)  # roles go on over batches
    try:
        made = relations.stitch_relations(df)
        plan = made._jdf.queryExecution().executedPlan().toString()
        got = sorted(((r.relation_id, r.role or "", r.n, len(r.ring)) for r in made.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
    assert got == sorted((i, role, 0, 5) for i in range(30) for role in ("", "outer"))


def test_nesting_is_followed_in_few_rounds(spark, monkeypatch):
    links = [(i, i + 1) for i in range(40)] + [(40, 0), (5, 5), (100, 101), (100, 102), (101, 103), (102, 103)]
    rounds = []
    add = relations.Rounds.add
    monkeypatch.setattr(relations.Rounds, "add", lambda self, df: rounds.append(1) or add(self, df))
    roots = sorted({n for link in links for n in link})
    got = sorted(map(tuple, relations.followed(spark.createDataFrame(links, "parent long, child long"), spark.createDataFrame([(n,) for n in roots], "id long")).collect()))
    circle = [(i, j) for i in range(41) for j in range(41)]
    assert got == sorted(circle + [(100, n) for n in (100, 101, 102, 103)] + [(101, 101), (101, 103), (102, 102), (102, 103), (103, 103)])
    assert len(rounds) <= 9


def test_nearest_area_deals_out_areas_and_not_points(spark):
    from polyglyph.operators import geo

    areas = spark.createDataFrame([(2, [[[0.0, 0.0], [0.0, 2.0], [2.0, 2.0], [2.0, 0.0]]]), (1, [[[4.0, 0.0], [4.0, 2.0], [6.0, 2.0], [6.0, 0.0]]])], "area_id long, rings array<array<array<double>>>")
    points = spark.createDataFrame([(1, 3.0, 1.0), (2, -2.0, 1.0), (3, 9.9, 1.0), (4, 10.0, 1.0), (5, None, 1.0), (6, -3.9, 1.0)], "point_id long, lon double, lat double")
    found = geo.nearest_area(points, areas, within=5.0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "point_id" not in plan[plan.index("Generate explode") :]
    assert sorted(map(tuple, found.collect())) == [(1, 1), (2, 2), (3, 1), (6, 2)]
