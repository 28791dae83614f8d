"""Points, rings and areas. A geometry is array<array<array<double>>>: rings of [lon, lat], the outer ring first."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .edges import locate  # noqa: F401


def in_ring(ring: Column, lon: Column, lat: Column) -> Column:
    """Even-odd rule over the ring's edges, the closing edge included."""
    turned = F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.size(ring) - 1))

    def crosses(p: Column, q: Column) -> Column:
        rise = q[1] - p[1]
        safe = F.when(F.abs(rise) < 1e-12, 1e-12).otherwise(rise)
        return F.when(((p[1] > lat) != (q[1] > lat)) & (lon < (q[0] - p[0]) * (lat - p[1]) / safe + p[0]), 1).otherwise(0)

    return F.aggregate(F.zip_with(ring, turned, crosses), F.lit(0), lambda a, x: a + x) % 2 == 1


def in_polygon(rings: Column, lon: Column, lat: Column) -> Column:
    """Inside the outer ring and in none of the holes."""
    holes = F.slice(rings, 2, F.greatest(F.size(rings) - 1, F.lit(0)))
    return in_ring(rings[0], lon, lat) & ~F.exists(holes, lambda h: in_ring(h, lon, lat))


def bbox(ring: Column) -> Column:
    x, y = F.transform(ring, lambda p: p[0]), F.transform(ring, lambda p: p[1])
    return F.struct(F.array_min(x).alias("west"), F.array_min(y).alias("south"), F.array_max(x).alias("east"), F.array_max(y).alias("north"))


def vertex_mean(rings: Column) -> Column:
    """Mean of all vertices, holes included."""
    points = F.flatten(rings)
    total = lambda i: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[i])
    return F.struct((total(0) / F.size(points)).alias("lon"), (total(1) / F.size(points)).alias("lat"))


def nearest_area(points: DataFrame, areas: DataFrame, within: float = 5.0) -> DataFrame:
    """(point_id, area_id): the area whose vertex mean is nearest in degrees, closer than `within`; the least id of equals.

    Means lie in cells as wide as the reach, and an area is offered to the nine around its own, so a point meets what may
    be near it and not all areas. Areas are dealt out and not points, of which there are many more.
    """
    c = areas.select("area_id", vertex_mean(F.col("rings")).alias("c")).select("area_id", F.col("c.lon").alias("_lon"), F.col("c.lat").alias("_lat"))
    around = F.array(*[F.struct((F.floor(F.col("_lon") / within) + dx).alias("_x"), (F.floor(F.col("_lat") / within) + dy).alias("_y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    c = c.withColumn("_c", F.explode(around)).select("area_id", "_lon", "_lat", "_c._x", "_c._y")
    p = points.select("point_id", "lon", "lat", F.floor(F.col("lon") / within).alias("_x"), F.floor(F.col("lat") / within).alias("_y"))
    d = F.pow(F.col("lon") - F.col("_lon"), 2) + F.pow(F.col("lat") - F.col("_lat"), 2)
    near = p.join(c, ["_x", "_y"]).withColumn("_d", d).where(F.col("_d") < within * within)
    return near.groupBy("point_id").agg(F.min_by("area_id", F.struct("_d", "area_id")).alias("area_id"))


def area_shares(sites: DataFrame, key: str = "area_id", languages: str = "languages") -> DataFrame:
    """(area, language, sites, share, multilingual_share): per area, over its classified sites."""
    per = sites.groupBy(key).agg(F.count_if(F.size(languages) > 0).alias("classified"), F.count_if(F.size(languages) > 1).alias("several"))
    each = sites.select(key, F.explode(languages).alias("language")).groupBy(key, "language").agg(F.count(F.lit(1)).alias("sites"))
    return each.join(per, key).select(key, "language", "sites", (F.col("sites") / F.col("classified")).alias("share"), (F.col("several") / F.col("classified")).alias("multilingual_share"))


def tile_grid(boxes: DataFrame, step: float) -> DataFrame:
    """Tiles (south, west, north, east) of each box, the last row and column clipped."""
    n = lambda a, b: F.ceil((b - a) / step).cast("int") - 1
    rows = boxes.withColumn("_i", F.explode(F.sequence(F.lit(0), n(F.col("south"), F.col("north"))))).withColumn("_j", F.explode(F.sequence(F.lit(0), n(F.col("west"), F.col("east")))))
    s, w = F.col("south") + F.col("_i") * step, F.col("west") + F.col("_j") * step
    return rows.select(s.alias("tile_south"), w.alias("tile_west"), F.least(s + step, F.col("north")).alias("tile_north"), F.least(w + step, F.col("east")).alias("tile_east"))


def way_centroids(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, lat, lon): mean of a way's found nodes, repeats counted; a way without any is dropped."""
    each = ways.select("way_id", F.explode("node_ids").alias("node_id"))
    return each.join(nodes, "node_id").groupBy("way_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))


def _keep(points: np.ndarray, tolerance: float, segment: bool = False) -> np.ndarray:
    """Which points of a line remain: a span whose farthest point is beyond the tolerance is split there.

    Distances are from the line through the span's ends, or from the segment between them.
    """
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    spans = [(0, len(points) - 1)]
    while spans:
        i, j = spans.pop()
        if j - i < 2:
            continue
        a, d, between = points[i], points[j] - points[i], points[i + 1 : j]
        long = np.hypot(*d)
        if segment and long > 0:
            along = np.clip((between - a) @ d / long**2, 0, 1)
            far = np.hypot(*(between - a - along[:, None] * d).T)
        else:
            far = np.hypot(*(between - a).T) if long == 0 else np.abs(d[0] * (between - a)[:, 1] - d[1] * (between - a)[:, 0]) / long
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            spans += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep


def simplify_ring(ring: list, tolerance: float, places: int = 4) -> list:
    """The ring simplified, rounded and closed; a smaller tolerance, then none, where fewer than three corners remain."""
    points = np.array([list(p) for p in ring], float)
    for t in (tolerance, tolerance / 4, 0.0):
        out = np.round(points[_keep(points, t)] if len(points) > 2 else points, places)
        out = out[np.concatenate([[True], np.any(out[1:] != out[:-1], axis=1)])] if len(out) else out
        corners = out[:-1] if len(out) > 1 and (out[0] == out[-1]).all() else out
        if len(corners) >= 3:
            return [*corners.tolist(), corners[0].tolist()]
    return []


def shorten_ring(ring: list, most: int, tolerance: float = 0.003, places: int = 4) -> list:
    """The ring simplified and, if it still has more than `most` points, every so-manieth of them; its first four if too few are left."""
    points = np.array([list(p) for p in ring], float)
    kept = points[_keep(points, tolerance)] if len(points) > 4 else points
    if len(kept) > most:
        kept = kept[(np.arange(most - 1) * ((len(kept) - 1) / (most - 1))).astype(int)]
        kept = np.concatenate([kept, kept[:1]])
    out = np.round(kept, places).tolist()
    out = [p for i, p in enumerate(out) if i == 0 or p != out[i - 1]]
    if len(out) < 4:
        return np.round(points[:4], places).tolist()
    return out if out[0] == out[-1] else [*out, out[0]]


def thin_ring(ring: list, tolerance: float = 0.003, near: float = 1e-9) -> list:
    """The open ring simplified by distance from segments, then closed; every n/20-th corner if fewer than three remain."""
    points = np.array([list(p) for p in ring], float)
    body = points[:-1] if len(points) > 1 and np.abs(points[0] - points[-1]).max() <= near else points
    kept = body[_keep(body, tolerance, segment=True)] if len(body) > 2 else body
    out = (kept if len(kept) >= 3 else body[:: max(1, len(body) // 20)]).tolist()
    return [*out, out[0]] if out and out[0] != out[-1] else out


def simplify(areas: DataFrame, tolerance: float, how: str = "close") -> DataFrame:
    """areas with their rings simplified; a lost hole goes, a lost outer ring empties the area.

    how: close (simplify_ring), short (shorten_ring: 180 points, a hole 48) or thin (thin_ring).
    """
    ways = {
        "close": lambda r, i: simplify_ring(r, tolerance),
        "short": lambda r, i: shorten_ring(r, 48 if i else 180, tolerance),
        "thin": lambda r, i: thin_ring(r, tolerance),
    }
    way = ways[how]

    def run(frames):
        for pdf in frames:
            def one(rings):
                done = [way(r, i) for i, r in enumerate(rings)]
                return [done[0], *[h for h in done[1:] if h]] if done and done[0] else []

            yield pdf.assign(rings=[one(r) for r in pdf["rings"]])

    return areas.mapInPandas(run, areas.schema)


def assemble(rings: DataFrame) -> DataFrame:
    """Rings of relations.stitch_relations -> (relation_id, n, rings), a polygon a row: a hole goes to the first outer ring around its first corner.

    Holes in no outer ring go, a relation without outer rings has no row.
    """
    outer = rings.where("role = 'outer'").select("relation_id", "n", F.col("ring").alias("outer"))
    inner = rings.where("role = 'inner'").select("relation_id", F.col("n").alias("hole_n"), F.col("ring").alias("hole"))
    inside = outer.join(inner.hint("merge"), "relation_id").where(in_ring(F.col("outer"), F.col("hole")[0][0], F.col("hole")[0][1]))
    homes = inside.groupBy("relation_id", "hole_n").agg(F.min("n").alias("n"), F.first("hole").alias("hole"))
    holes = homes.groupBy("relation_id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("hole_n", "hole"))), lambda h: h["hole"]).alias("holes"))
    none = F.array().cast("array<array<array<double>>>")
    return outer.join(holes.hint("merge"), ["relation_id", "n"], "left").select("relation_id", "n", F.concat(F.array("outer"), F.coalesce("holes", none)).alias("rings"))


def move_by_box(areas: DataFrame, giver: str, taker: str, box: tuple[float, float, float, float], key: str = "iso") -> DataFrame:
    """areas (key, polygons, ...) where the giver's polygons inside the box (west, south, east, north) are the taker's.

    The taker's stay as they are if it has polygons in the box already; without the taker nothing moves.
    """
    west, south, east, north = box

    def lies_in(rings: Column) -> Column:
        b = bbox(rings[0])
        return (b["west"] >= west) & (b["south"] >= south) & (b["east"] <= east) & (b["north"] <= north)

    given = areas.where(F.col(key) == giver).select(F.lit(taker).alias("_to"), F.filter("polygons", lies_in).alias("_given"))
    takes = areas.where(F.col(key) == taker).select(F.lit(giver).alias("_from"), F.lit(True).alias("_taken")).distinct()
    out = areas.join(F.broadcast(given), F.col(key) == F.col("_to"), "left").join(F.broadcast(takes), F.col(key) == F.col("_from"), "left")
    got = F.when(F.exists("polygons", lies_in), F.col("polygons")).otherwise(F.concat("polygons", F.coalesce("_given", F.array().cast("array<array<array<array<double>>>>"))))
    polygons = F.when(F.col("_taken"), F.filter("polygons", lambda p: ~lies_in(p))).when(F.col(key) == taker, got).otherwise(F.col("polygons"))
    return out.select(*[polygons.alias(c) if c == "polygons" else F.col(c) for c in areas.columns])


def assign(children: DataFrame, parents: DataFrame, *, within: float = 5.0, cell: float = 1.0) -> DataFrame:
    """(child_id, parent_id): the parent around a child's vertex mean, else the one whose own mean is nearest and closer than `within`.

    children (child_id, polygons), parents (parent_id, polygons). A child without a parent near it has no row.
    """
    mean = vertex_mean(F.flatten("polygons"))
    points = children.where(F.size(F.flatten("polygons")) > 0).select(F.col("child_id").alias("point_id"), mean.alias("c")).select("point_id", "c.lon", "c.lat")
    inside = locate(points, parents.select(F.col("parent_id").alias("area_id"), F.explode("polygons").alias("rings")), cell)
    rest = points.join(inside, "point_id", "left_anti")
    near = nearest_area(rest, parents.select(F.col("parent_id").alias("area_id"), F.flatten("polygons").alias("rings")), within)
    return inside.unionByName(near).select(F.col("point_id").alias("child_id"), F.col("area_id").alias("parent_id"))


def top_areas(areas: DataFrame, key: str, query: str, rank: Column, limit: int = 10) -> DataFrame:
    """Search hits in order: rank, kind, length of key, name, id; one row per id, the best `limit`."""
    kinds = F.when(F.col("kind") == "country", 0).when(F.col("kind") == "subdivision_1", 1).when(F.col("kind") == "subdivision_2", 2).otherwise(9)
    hits = areas.withColumn("rank", rank).where(F.col("rank").isNotNull()).withColumn("kind_rank", kinds).withColumn("key_length", F.length(key))
    order = ["rank", "kind_rank", "key_length", "name", "area_id"]
    one = hits.withColumn("_n", F.row_number().over(W.partitionBy("area_id").orderBy(*order))).where("_n = 1")
    return one.orderBy(*order).limit(limit).select("area_id", "name", "kind", "rank")
