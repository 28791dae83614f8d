"""Relations of map elements: nested members followed to a fixed point, lines stitched to rings, rings made polygons."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.areas import area_kind
from ..sources.scratch import Rounds, written
from .geo import assemble, simplify

MEMBERS = "array<struct<type: string, ref: long, role: string>>"
#: Lines of a relation's role up to which one task stitches them, and the part of a degree within which ends meet.
LOCAL_LINES, NEAR = 5000, 1e-9
#: How tables that grow with the map are joined. Lines, tags and rows of an explode are far more in memory than their files say, so the planner would broadcast them.
_BIG = "merge"
_RING = "relation_id long, role string, first long, n int, ring array<array<double>>"
_ARROW = pa.schema([("relation_id", pa.int64()), ("role", pa.string()), ("first", pa.int64()), ("n", pa.int32()), ("ring", pa.list_(pa.list_(pa.float64())))])


def _role(role: Column) -> Column:
    return F.coalesce(role, F.lit(""))


def nested_links(relations: DataFrame) -> DataFrame:
    """(parent, child): the members of relations (id, tags, members) that are relations and belong to their geometry.

    Those are members as `inner` or `outer`, and members without a role unless they are administrative areas themselves.
    Members that are not in the table go.
    """
    m = relations.select(F.col("id").alias("parent"), F.explode("members").alias("m")).where("m.type = 'relation'")
    m = m.select("parent", F.col("m.ref").alias("child"), _role(F.col("m.role")).alias("role")).where(F.col("role").isin("inner", "outer", ""))
    administrative = F.coalesce(F.try_element_at("tags", F.lit("boundary")) == "administrative", F.lit(False))
    known = relations.groupBy(F.col("id").alias("child")).agg(F.max(administrative).alias("area"))
    return m.join(known.hint(_BIG), "child").where("not area or role <> ''").select("parent", "child").distinct()


def followed(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, id): every root (id) with itself and all it reaches by links (parent, child), each once, cycles or not.

    What a root has already reached is found by an anti join, so cycles end and a relation reached twice counts once.
    Where all that have links are roots, a round doubles the distance that is known: what lies up to twice as far is what
    is reached from those just at it. There are as many rounds as the deepest nesting has binary digits. Where only some
    are roots, a round joins what the last one found, and there are as many as the deepest nesting. Null ids go.
    """
    links = written(links.where("parent is not null and child is not null"), "links")
    start = roots.where("id is not null").select(F.col("id").alias("root"), F.col("id").cast("long").alias("id")).distinct()
    start = written(start, "roots")
    others = links.join(start.select(F.col("id").alias("parent")).hint(_BIG), "parent", "left_anti")
    if others.limit(1).isEmpty():
        return _doubled(start, links)
    found = Rounds(start, "followed")
    while not found.last.isEmpty():
        step = found.last.join(links.hint(_BIG), F.col("id") == F.col("parent")).select("root", F.col("child").alias("id")).distinct()
        found.add(step.join(found.all().hint(_BIG), ["root", "id"], "left_anti"))
    return found.all()


def _doubled(start: DataFrame, links: DataFrame) -> DataFrame:
    """followed() where every parent is a root, with `far`, the least number of links that lead there, while it goes on."""
    far = lambda n: F.lit(n).cast("long").alias("far")
    one = start.join(links.hint(_BIG), F.col("id") == F.col("parent")).where("id <> child").select("root", F.col("child").alias("id"), far(1)).distinct()
    found = Rounds(start.select("root", "id", far(0)), "followed")
    found.add(one)
    span = 1
    while not found.last.where(F.col("far") == span).limit(1).isEmpty():
        at = found.last.where(F.col("far") == span).select("root", F.col("id").alias("_mid"))
        on = found.all().where("far > 0").select(F.col("root").cast("long").alias("_mid"), "id", (F.col("far") + span).alias("far"))
        step = at.join(on.hint(_BIG), "_mid").groupBy("root", "id").agg(F.min("far").alias("far"))
        found.add(step.join(found.all().select("root", "id").hint(_BIG), ["root", "id"], "left_anti"))
        span *= 2
    return found.all().drop("far")


def way_lines(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, line): the places of a way's nodes in order. ways: way_id, node_ids; nodes: node_id, lon, lat. Nodes that are not there are left out; fewer than two make no line."""
    each = ways.select("way_id", F.posexplode("node_ids").alias("_at", "node_id"))
    found = each.join(nodes.select("node_id", "lon", "lat").hint(_BIG), "node_id").groupBy("way_id")
    lines = found.agg(F.array_sort(F.collect_list(F.struct("_at", "lon", "lat"))).alias("_l"))
    return lines.where(F.size("_l") > 1).select("way_id", F.transform("_l", lambda p: F.array(p["lon"], p["lat"])).alias("line"))


def relation_pieces(relations: DataFrame, ways: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(relation_id, role, line): the lines of each root's own ways and of those of all relations it reaches.

    A way's role in the relation that names it counts: `inner`, else outer. ways: way_id, line. A way named twice is there
    twice. Relations are all roots unless `roots` (id) is given; ids are unique.
    """
    reached = followed(nested_links(relations), relations.select("id") if roots is None else roots)
    m = relations.select("id", F.explode("members").alias("m")).where("m.type = 'way'")
    m = m.select("id", F.col("m.ref").alias("way_id"), F.when(_role(F.col("m.role")) == "inner", "inner").otherwise("outer").alias("role"))
    lines = m.join(ways.where(F.size("line") > 1).select("way_id", "line").hint(_BIG), "way_id")
    return reached.join(lines.hint(_BIG), "id").select(F.col("root").alias("relation_id"), "role", "line")


def stitched(lines: list[list]) -> list[tuple[int, list]]:
    """(place of its first line, ring) of lines that meet at their ends, in time that grows with the lines.

    A ring begins with the first line left and takes, while it is open, the first line left that meets either of its
    ends. An open ring of four points and more is closed; shorter ones go.
    """
    key = lambda p: (round(p[0] / NEAR), round(p[1] / NEAR))
    ends = [(key(line[0]), key(line[-1])) for line in lines]
    at: dict[tuple, list[int]] = {}
    for i in reversed(range(len(lines))):
        for k in set(ends[i]):
            at.setdefault(k, []).append(i)  # the first line last
    used, out = [False] * len(lines), []

    def first(k) -> int:
        left = at[k]
        while left and used[left[-1]]:
            left.pop()
        return left[-1] if left else len(lines)

    for i, line in enumerate(lines):
        if used[i]:
            continue
        used[i] = True
        a, b = ends[i]
        tail, head = list(line), []  # the ring is head backwards, then tail
        while a != b:
            j = min(first(a), first(b))
            if j == len(lines):
                break
            used[j] = True
            c, d = ends[j]
            if c == b:
                tail, b = _longer(tail, lines[j][1:]), d
            elif d == a:
                head, a = _longer(head, lines[j][-2::-1]), c
            elif d == b:
                tail, b = _longer(tail, lines[j][-2::-1]), c
            else:
                head, a = _longer(head, lines[j][1:]), d
        ring = [list(p) for p in head[::-1] + tail]
        if len(ring) >= 4:
            out.append((i, ring if a == b else [*ring, ring[0]]))
    return out


def _longer(line: list, more) -> list:
    line.extend(more)
    return line


def _arcs(lines: DataFrame) -> DataFrame:
    """(arc, nxt): every line (line_id, line, of its relation and role) in both directions, and the arc that follows.

    An arc follows where exactly two ends meet. Arc 2 * line_id goes along the line, the next number against it.
    """
    end = lambda point, n: F.struct(F.round(point[0] / NEAR).cast("long").alias("x"), F.round(point[1] / NEAR).cast("long").alias("y"), F.lit(n).alias("end"))
    both = F.explode(F.array(end(F.col("line")[0], 0), end(F.element_at("line", -1), 1))).alias("e")
    ends = lines.select("relation_id", "role", "line_id", both)
    mine = F.struct("line_id", "e.end")
    nodes = ends.groupBy("relation_id", "role", "e.x", "e.y").agg(F.count(F.lit(1)).alias("n"), F.min(mine).alias("a"), F.max(mine).alias("b")).where("n = 2")
    pairs = nodes.select(F.explode(F.array(F.struct(F.col("a").alias("at"), F.col("b").alias("to")), F.struct(F.col("b").alias("at"), F.col("a").alias("to")))).alias("p"))
    # who arrives at end 1 of a line has gone along it; who leaves from end 1 goes against it
    turns = pairs.select((F.col("p.at.line_id") * 2 + 1 - F.col("p.at.end")).alias("arc"), (F.col("p.to.line_id") * 2 + F.col("p.to.end")).alias("nxt"))
    arcs = lines.select(F.explode(F.array(F.col("line_id") * 2, F.col("line_id") * 2 + 1)).alias("arc"))
    return arcs.join(turns.hint(_BIG), "arc", "left")


def ranked(arcs: DataFrame) -> DataFrame:
    """(arc, chain, place): the chain or circle of each arc (arc, nxt) and its place there, by pointer doubling.

    After round k an arc knows the arc 2**k ahead, or the chain's last one and how far it is, and the least arc before
    that and how far that is. The rounds end when nothing has changed: then a circle's arcs all know its least one. There
    are as many rounds as the longest chain has binary digits; a round is one join of all arcs, wherever they lie.
    """
    now = written(arcs.select("arc", "nxt", F.col("arc").alias("last"), F.lit(0).cast("long").alias("far"), F.col("arc").alias("best"), F.lit(0).cast("long").alias("at")), "arcs")
    span, changed = 1, True
    while changed:
        ahead = now.select(*[F.col(c).alias(f"_{c}") for c in now.columns])
        more = F.col("_arc").isNotNull()
        better = more & (F.col("_best") < F.col("best"))
        step = now.join(ahead.hint(_BIG), F.col("nxt") == F.col("_arc"), "left").select(
            "arc", F.when(more, F.col("_nxt")).alias("nxt"), F.coalesce("_last", "last").alias("last"), F.when(more, F.col("_far") + span).otherwise(F.col("far")).alias("far"),
            F.when(better, F.col("_best")).otherwise(F.col("best")).alias("best"), F.when(better, F.col("_at") + span).otherwise(F.col("at")).alias("at"),
            (more & (better | F.col("_nxt").isNull())).alias("changed"),
        )
        now = written(step, "ranked")
        changed = not now.where("changed").limit(1).isEmpty()
        now, span = now.drop("changed"), span * 2
    ends = F.col("nxt").isNull()
    place = F.when(ends, -F.col("far")).when(F.col("at") == 0, F.lit(-(1 << 62))).otherwise(-F.col("at"))
    return now.select("arc", F.when(ends, F.col("last")).otherwise(F.col("best")).alias("chain"), ends.alias("open"), place.alias("place"), "best")


def chains(lines: DataFrame) -> DataFrame:
    """(relation_id, role, first, open, line): lines (relation_id, role, line_id, line) joined wherever exactly two ends meet.

    first: the least line_id of a chain; it goes along that line. Of a chain's two directions the other is dropped.
    """
    order = ranked(_arcs(lines))
    least = order.groupBy("open", "chain").agg(F.min("best").alias("first")).where("first % 2 = 0")
    mine = order.join(least.hint(_BIG), ["open", "chain"]).select(F.shiftright("arc", 1).alias("line_id"), (F.col("arc") % 2 == 1).alias("back"), "open", "first", "place")
    each = F.struct("place", F.when(F.col("back"), F.reverse("line")).otherwise(F.col("line")).alias("line"))
    grouped = lines.join(mine.hint(_BIG), "line_id").groupBy("relation_id", "role", "first", "open").agg(F.array_sort(F.collect_list(each)).alias("l"))
    rest = F.flatten(F.transform("l", lambda x: F.slice(x["line"], 2, F.size(x["line"]) - 1)))
    return grouped.select("relation_id", "role", F.shiftright("first", 1).alias("first"), "open", F.concat(F.slice(F.col("l")[0]["line"], 1, 1), rest).alias("line"))


def _stitched_groups(lines: DataFrame) -> DataFrame:
    """(relation_id, role, first, n, ring) of lines (relation_id, role, line_id, line): each relation's role stitched by itself, its rings numbered from 0.

    The lines of a role lie one after the other in one partition, and a batch holds many roles.
    """

    def run(batches):
        held, ids, own, out = None, [], [], []

        def close() -> None:
            out.extend((*held, ids[i], n, ring) for n, (i, ring) in enumerate(stitched(own)))

        for batch in batches:
            for relation, role, line_id, line in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if held != (relation, role):
                    if own:
                        close()
                    held, ids, own = (relation, role), [], []
                ids.append(line_id)
                own.append(line)
            if out:
                yield _rings(out)
                out = []
        if own:
            close()
        if out:
            yield _rings(out)

    sorted_ = lines.select("relation_id", "role", "line_id", "line").repartition("relation_id", "role").sortWithinPartitions("relation_id", "role", "line_id")
    return sorted_.mapInArrow(run, _RING)


def _rings(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def stitch_relations(pieces: DataFrame, local_lines: int = LOCAL_LINES) -> DataFrame:
    """pieces (relation_id, role, line) -> (relation_id, role, n, ring): the rings of each relation's lines, numbered from 0.

    A relation's role with up to `local_lines` lines is stitched in one task, line by line. Of larger ones, the ends that
    meet in pairs are joined first, by pointer doubling over all tasks; what is still open then is stitched as before.
    Ends meet where they are equal as multiples of 1e-9. Lines of fewer than two points go, as do open rings of fewer
    than four. Where more than two ends meet, the first line is taken; of a large relation that is the first chain.
    """
    lines = written(pieces.where(F.size("line") > 1).select("relation_id", "role", "line", F.monotonically_increasing_id().alias("line_id")), "lines")
    large = lines.groupBy("relation_id", "role").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > local_lines).drop("_n")
    if large.isEmpty():
        return _stitched_groups(lines).select("relation_id", "role", "n", "ring")
    large = written(large, "large")
    joined = written(chains(lines.join(large, ["relation_id", "role"], "left_semi")), "chains")
    open_ = joined.where("open").select("relation_id", "role", "line", F.col("first").alias("line_id"))
    small = lines.join(large, ["relation_id", "role"], "left_anti")
    closed = joined.where(~F.col("open") & (F.size("line") >= 4)).select("relation_id", "role", "first", F.col("line").alias("ring"))
    rest = _stitched_groups(open_).drop("n").unionByName(closed)
    n = F.row_number().over(W.partitionBy("relation_id", "role").orderBy("first")) - 1
    return _stitched_groups(small).select("relation_id", "role", "n", "ring").unionByName(rest.select("relation_id", "role", n.alias("n"), "ring"))


def relation_features(relations: DataFrame, ways: DataFrame, roots: DataFrame | None = None, tolerance: float = 0.003) -> DataFrame:
    """(osm_type, osm_id, name, admin_level, kind, polygons) of the relations whose lines make an outer ring.

    Names are the English ones where there are some; rings are simplified. See relation_pieces(), stitch_relations() and
    geo.assemble().
    """
    made = assemble(stitch_relations(relation_pieces(relations, ways, roots)))
    simple = simplify(made.select("relation_id", "n", "rings"), tolerance, "short").where(F.size("rings") > 0)
    polygons = simple.groupBy("relation_id").agg(F.array_sort(F.collect_list(F.struct("n", "rings"))).alias("p"))
    tag = lambda k: F.nullif(F.try_element_at("tags", F.lit(k)), F.lit(""))
    named = relations.select("id", F.coalesce(tag("name:en"), tag("name"), F.concat(F.lit("relation/"), "id")).alias("name"), F.try_element_at("tags", F.lit("admin_level")).alias("admin_level"))
    rows = polygons.join(named.hint(_BIG), F.col("relation_id") == F.col("id"))
    return rows.select(F.lit("relation").alias("osm_type"), F.col("relation_id").alias("osm_id"), "name", "admin_level", area_kind(F.col("admin_level")).alias("kind"), F.transform("p", lambda x: x["rings"]).alias("polygons"))
