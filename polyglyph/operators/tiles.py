"""Square tiles of a plane: numbers, keys, and a tree of tiles that are split where they hold much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Points of a tile that is not split, side of the largest tiles, and how often one may be halved: down to 0.25 degrees.
MOST_POINTS, SIDE, DEEPEST = 10_000, 1.0, 2


def tile_of(at: Column, side: float, level: Column | int = 0) -> Column:
    """The number of the tile that a coordinate is in, tiles of level 0 being `side` wide and each level half of the last.

    Halving is exact, so a tile's number is half of those of its halves, rounded down. Null where there is no number.
    """
    scaled = at.cast("double") / side * F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
    return F.when(F.abs(scaled) < 2.0**52, F.floor(scaled).cast("long"))


def _spread(n: Column) -> Column:
    """The low 31 bits of n, each followed by a free one."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(F.lit(mask))
    return n


def morton(x: Column, y: Column, level: Column | int = 0) -> Column:
    """The Morton key of a tile: near tiles have near keys, and a tile's key is a quarter of those of its quarters, rounded down.

    Numbers of level 0 from -2**18 to 2**18 - 1 and levels up to 12 fit; from level 0 on, tiles are counted from -2**18.
    """
    first = F.shiftleft(F.lit(1 << 18), level) if isinstance(level, int) else F.call_function("shiftleft", F.lit(1 << 18), level)
    return _spread((x + first).cast("long")).bitwiseOR(F.shiftleft(_spread((y + first).cast("long")), 1))


def quadtree(points: DataFrame, side: float = SIDE, most: int = MOST_POINTS, deepest: int = DEEPEST) -> DataFrame:
    """(level, x, y, key, n): the tiles of points (lon, lat), split into quarters while they hold more than `most` and can be halved.

    The tiles cover all tiles of level 0 that hold a point, quarters without any included; only those of the last level
    hold more than `most`. Points are counted once, in the smallest tiles; the counts of larger ones are sums of those,
    so the work beyond that scan grows with the tiles, not with the points, and where all points lie does not matter.
    Points without a number for a coordinate are in no tile.
    """
    small = points.select(tile_of(F.col("lon"), side, deepest).alias("x"), tile_of(F.col("lat"), side, deepest).alias("y"))
    small = small.where("x is not null and y is not null").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    up = lambda c: F.call_function("shiftright", F.col(c), F.lit(deepest) - F.col("level"))
    levels = small.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(deepest))))
    nodes = levels.select("level", up("x").alias("x"), up("y").alias("y"), "n").groupBy("level", "x", "y").agg(F.sum("n").alias("n"))
    parts = nodes.where((F.col("n") > most) & (F.col("level") < deepest))
    quarters = F.explode(F.array(*[F.struct((2 * F.col("x") + i).alias("x"), (2 * F.col("y") + j).alias("y")) for j in (0, 1) for i in (0, 1)]))
    quarters = parts.select((F.col("level") + 1).alias("level"), quarters.alias("q")).select("level", "q.x", "q.y")
    inner = quarters.join(nodes, ["level", "x", "y"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tiles = nodes.where("level = 0").unionByName(inner).where((F.col("n") <= most) | (F.col("level") == deepest))
    return tiles.select("level", "x", "y", morton(F.col("x"), F.col("y"), F.col("level")).alias("key"), "n")


def tile_boxes(tiles: DataFrame, side: float = SIDE) -> DataFrame:
    """tiles (level, x, y, ...) with west, south, east and north."""
    width = F.lit(side) / F.pow(F.lit(2.0), F.col("level"))
    return tiles.select("*", (F.col("x") * width).alias("west"), (F.col("y") * width).alias("south"), ((F.col("x") + 1) * width).alias("east"), ((F.col("y") + 1) * width).alias("north"))
