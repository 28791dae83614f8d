"""Which areas hold which points, by an index of edges: a cell keeps the edges that touch it and a parity, never whole rings.

A ray from a point to the east crosses a ring's edges an odd number of times if the point is inside. Of the edges that
span the point's height, those left of its cell are not crossed, and those right of it are, whatever the point. Along a
chain of edges to the right, whether each spans the height comes down to the chain's ends: the ends that lie in the
cell's height are ends of edges that the cell keeps, and all others are on the same side of every point of the cell. So
a cell needs its own edges, which of their ends begin such a chain, and one parity for the rest, found at its middle.

The index is made a polygon at a time by quartering a square around it; quarters that no edge touches are inside or
outside as a whole. Cells with many points or edges are quartered on, by the tree of tiles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiles import quadtree, tile_of

#: Points and edges of a cell from which on it is quartered, and how often it may be.
HOT_POINTS, HOT_EDGES, DEEPEST = 200_000, 48, 6
#: How far beyond a cell, as a part of its side and of the coordinates' size, an edge still counts as touching it.
PAD = 1e-9
#: Hot cells up to which the table of them is broadcast.
BROADCAST_CELLS = 100_000

_EDGE = "struct<i:int,x1:double,y1:double,x2:double,y2:double,u:boolean,v:boolean>"
_RINGS = f"array<struct<odd:boolean,n:int,edges:array<{_EDGE}>>>"
#: A cell of an area: its place (of level 0), how many cells of that level it is wide, and what is left of the rings there.
CELLS = f"area_id {{0}}, x long, y long, width long, rings {_RINGS}"


class Ring:
    """The edges of a ring that touch a tile: edge i from corner i - 1 (x2, y2) to corner i (x1, y1) of n.

    u and v say that a chain of edges right of the tile begins at (x1, y1) or (x2, y2); odd is the parity of what is
    not kept.
    """

    def __init__(self, i, x1, y1, x2, y2, u, v, n: int, odd: bool):
        self.i, self.x1, self.y1, self.x2, self.y2, self.u, self.v, self.n, self.odd = i, x1, y1, x2, y2, u, v, n, odd

    @classmethod
    def whole(cls, corners) -> Ring:
        p = np.array([list(c)[:2] for c in corners], float).reshape(-1, 2)
        q, none = np.roll(p, 1, axis=0), np.zeros(len(p), bool)
        return cls(np.arange(len(p)), p[:, 0], p[:, 1], q[:, 0], q[:, 1], none, none, len(p), False)

    @classmethod
    def kept(cls, row) -> Ring:
        e = row["edges"]
        column = lambda name, kind: np.array([x[name] for x in e], kind)
        return cls(column("i", np.int64), *(column(c, float) for c in ("x1", "y1", "x2", "y2")), column("u", bool), column("v", bool), row["n"], row["odd"])

    def row(self) -> dict:
        names = ("i", "x1", "y1", "x2", "y2", "u", "v")
        columns = [getattr(self, c).tolist() for c in names]
        return {"odd": bool(self.odd), "n": self.n, "edges": [dict(zip(names, e)) for e in zip(*columns)]}

    def parity(self, lon: float, lat: float) -> bool:
        rise = self.y2 - self.y1
        rise = np.where(np.abs(rise) < 1e-12, 1e-12, rise)
        a, b = self.y1 > lat, self.y2 > lat
        crossed = (a != b) & (lon < (self.x2 - self.x1) * (lat - self.y1) / rise + self.x1)
        return bool((self.odd + crossed.sum() + (a & self.u).sum() + (b & self.v).sum()) % 2)

    def within(self, west: float, south: float, east: float, north: float) -> Ring:
        """The ring in a part of the tile."""
        size = max(abs(west), abs(east), abs(south), abs(north), east - west)
        pad = PAD * size
        w, s, e, n = west - pad, south - pad, east + pad, north + pad
        low, high = np.minimum(self.y1, self.y2), np.maximum(self.y1, self.y2)
        inside = (high >= s) & (low <= n)
        rise = self.y2 - self.y1
        flat = np.abs(rise) < 1e-12
        slope = (self.x2 - self.x1) / np.where(flat, 1.0, rise)
        at = lambda y: np.where(flat, np.nan, slope * (np.clip(y, low, high) - self.y1) + self.x1)
        a, b = np.where(flat, self.x1, at(s)), np.where(flat, self.x2, at(n))
        left, right = np.minimum(a, b), np.maximum(a, b)
        keep = inside & (right >= w) & (left <= e)
        beyond = inside & (left > e)

        def chain(step: int, before: np.ndarray) -> np.ndarray:
            """Of every edge, whether its neighbour is right of the part: by itself if it is kept here, else as before."""
            if not len(self.i):
                return before
            other = (self.i + step) % self.n
            at = np.minimum(np.searchsorted(self.i, other), len(self.i) - 1)
            return np.where(self.i[at] == other, beyond[at], before)

        u, v = chain(1, self.u), chain(-1, self.v)
        part = Ring(*(x[keep] for x in (self.i, self.x1, self.y1, self.x2, self.y2, u, v)), self.n, False)
        lon, lat = (west + east) / 2, (south + north) / 2
        part.odd = self.parity(lon, lat) != part.parity(lon, lat)
        return part


def _part(rings: list[Ring], box: tuple[float, float, float, float]) -> list[Ring] | None:
    """What is left of an outer ring and its holes in a part; None if it is outside the one or inside another as a whole."""
    outer, *holes = (r.within(*box) for r in rings)
    if not len(outer.i) and not outer.odd or any(h.odd and not len(h.i) for h in holes):
        return None
    return [outer, *[h for h in holes if len(h.i)]]


def quarter(rings: list[Ring], x: int, y: int, width: int, side: float, smallest: int):
    """(x, y, width, rings) of the parts of a square of `width` tiles: `smallest` wide, or larger where no edge touches them."""
    left = [(x, y, width, rings)]
    while left:
        x, y, width, rings = left.pop()
        if width <= smallest or not any(len(r.i) for r in rings):
            yield x, y, width, rings
            continue
        half = width // 2
        for a in (x, x + half):
            for b in (y, y + half):
                part = _part(rings, (a * side, b * side, (a + half) * side, (b + half) * side))
                if part is not None:
                    left.append((a, b, half, part))


def polygon_cells(polygon, side: float):
    """(x, y, width, rings) of a polygon's cells; nothing of one without an outer ring."""
    if polygon is None or not len(polygon) or polygon[0] is None or not len(polygon[0]):
        return
    rings = [Ring.whole(r) for r in polygon if r is not None and len(r)]
    outer = rings[0]
    x, y = (int(np.floor(c.min() / side)) for c in (outer.x1, outer.y1))
    span = max(int(np.floor(outer.x1.max() / side)) - x, int(np.floor(outer.y1.max() / side)) - y) + 1
    width = 1 << (span - 1).bit_length()
    box = (x * side, y * side, (x + width) * side, (y + width) * side)
    whole = _part(rings, box)
    if whole is not None:
        yield from quarter(whole, x, y, width, side, 1)


def cells(areas: DataFrame, side: float) -> DataFrame:
    """CELLS of areas (area_id, rings): several of an area that has several polygons."""
    kind = areas.schema["area_id"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            rows = [(i, x, y, w, [r.row() for r in rings]) for i, polygon in zip(pdf["area_id"], pdf["rings"]) for x, y, w, rings in polygon_cells(polygon, side)]
            yield pd.DataFrame(rows, columns=["area_id", "x", "y", "width", "rings"])

    return areas.where(F.col("area_id").isNotNull()).select("area_id", "rings").mapInPandas(run, CELLS.format(kind))


def spread(rows: DataFrame) -> DataFrame:
    """cells() where each is one cell of level 0: wide ones, which no edge touches, are told cell by cell."""
    many = lambda c: F.explode(F.sequence(F.col(c), F.col(c) + F.col("width") - 1))
    return rows.withColumn("_x", many("x")).withColumn("_y", many("y")).select("area_id", F.col("_x").alias("x"), F.col("_y").alias("y"), "rings")


def deepened(rows: DataFrame, side: float) -> DataFrame:
    """(area_id, level, x, y, rings): the parts of spread() cells (with `level`, null or 0 where they stay whole)."""
    names = ["area_id", "level", "x", "y", "rings"]
    whole = rows.where("coalesce(level, 0) = 0").select("area_id", F.lit(0).alias("level"), "x", "y", "rings")
    kind = rows.schema["area_id"].dataType.simpleString()

    def run(frames):
        for pdf in frames:
            out = []
            for i, level, x, y, rings in zip(*(pdf[c] for c in names)):
                n = 1 << int(level)
                for a, b, w, part in quarter([Ring.kept(r) for r in rings], x * n, y * n, n, side / n, 1):
                    kept = [r.row() for r in part]
                    out += [(i, level, a + s, b + t, kept) for s in range(w) for t in range(w)]
            yield pd.DataFrame(out, columns=names)

    split = rows.where("level > 0").select(*names).mapInPandas(run, f"area_id {kind}, level int, x long, y long, rings {_RINGS}")
    return whole.unionByName(split)


def odd(ring: Column, lon: Column, lat: Column) -> Column:
    """The parity of a cell's ring at a point of the cell, as Ring.parity()."""

    def bit(e: Column) -> Column:
        rise = e["y2"] - e["y1"]
        safe = F.when(F.abs(rise) < 1e-12, 1e-12).otherwise(rise)
        a, b = e["y1"] > lat, e["y2"] > lat
        crossed = (a != b) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / safe + e["x1"])
        return (crossed != (a & e["u"])) != (b & e["v"])

    return F.aggregate(ring["edges"], ring["odd"], lambda p, e: p != bit(e))


def hot_cells(points: DataFrame, rows: DataFrame, side: float, hot_points: int, hot_edges: int, deepest: int = DEEPEST) -> DataFrame | None:
    """(x, y, level): cells to be quartered so that parts hold few edges, and few points by the tree of tiles; None if there are none.

    There is at most one such cell for hot_points points or hot_edges edges; up to BROADCAST_CELLS are brought to the
    driver, to be broadcast, and more stay a table that is joined by shuffle.
    """
    edges = F.aggregate("rings", F.lit(0), lambda n, r: n + F.size(r["edges"]))
    halvings = F.least(F.ceil(F.log2(edges / float(hot_edges))).cast("int"), F.lit(deepest))
    by_edges = rows.where(edges > hot_edges).select("x", "y", halvings.alias("level"))
    dealt = points.select("lon", "lat", tile_of(F.col("lon"), side).alias("x"), tile_of(F.col("lat"), side).alias("y"))
    crowded = dealt.groupBy("x", "y").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_points).select("x", "y")
    # a part of a crowded cell is at least one halving deep; how deep is left to the tree
    hot = _few(by_edges.unionByName(crowded.withColumn("level", F.lit(0))).groupBy("x", "y").agg(F.max("level").alias("level"), F.min("level").alias("_least")))
    if hot is None:
        return None
    tree = quadtree(dealt.join(hot.where("_least = 0").select("x", "y"), ["x", "y"], "left_semi"), side, hot_points, deepest).where("level > 0")
    down = lambda c: F.call_function("shiftright", F.col(c), F.col("level"))
    by_points = tree.select(down("x").alias("x"), down("y").alias("y"), "level")
    return _few(hot.select("x", "y", "level").unionByName(by_points).where("level > 0").groupBy("x", "y").agg(F.max("level").alias("level")))


def _few(df: DataFrame) -> DataFrame | None:
    """df as a local table to be broadcast if it has at most BROADCAST_CELLS rows, None if it has none, else as it is."""
    rows = df.limit(BROADCAST_CELLS + 1).collect()
    if len(rows) > BROADCAST_CELLS:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if rows else None


def locate(points: DataFrame, areas: DataFrame, cell: float = 1.0, *, hot_points: int = HOT_POINTS, hot_edges: int = HOT_EDGES) -> DataFrame:
    """(point_id, area_id): of the areas that held() says hold a point the least; points in none have no row."""
    return held(points, areas, cell, hot_points=hot_points, hot_edges=hot_edges).groupBy("point_id").agg(F.min("area_id").alias("area_id"))


def held(points: DataFrame, areas: DataFrame, cell: float = 1.0, *, hot_points: int = HOT_POINTS, hot_edges: int = HOT_EDGES) -> DataFrame:
    """(point_id, area_id): points (point_id, lon, lat) with each of the areas (area_id, rings) that hold them, once a polygon.

    A point is inside a polygon if it is inside its outer ring and in none of its holes, by the even-odd rule. Points and
    cells meet in one equi-join, of a point's cell. Cells with more than hot_points points or hot_edges edges are
    quartered first; the table of those cells has at most one row for so many points or edges, and is broadcast if that
    is little. Points without coordinates and areas without rings are in nothing; areas that share an id are one.
    """
    index = spread(cells(areas, cell)).withColumn("level", F.lit(0))
    p = points.select("point_id", "lon", "lat", tile_of(F.col("lon"), cell).alias("x"), tile_of(F.col("lat"), cell).alias("y")).where("x is not null and y is not null")
    p = p.withColumn("level", F.lit(0))
    hot = hot_cells(points, index, cell, hot_points, hot_edges)
    if hot is not None:
        index = deepened(index.drop("level").join(hot, ["x", "y"], "left"), cell)
        p = p.drop("level").join(hot, ["x", "y"], "left").withColumn("level", F.coalesce("level", F.lit(0)))
        p = p.select("point_id", "lon", "lat", "level", tile_of(F.col("lon"), cell, F.col("level")).alias("x"), tile_of(F.col("lat"), cell, F.col("level")).alias("y"))
    inside = lambda r: odd(r, F.col("lon"), F.col("lat"))
    holes = F.slice("rings", 2, F.greatest(F.size("rings") - 1, F.lit(0)))
    return p.join(index, ["level", "x", "y"]).where(inside(F.col("rings")[0]) & ~F.exists(holes, inside)).select("point_id", "area_id")
