"""The binary extract source: numbers, blocks, ranges, what is pushed down, and a file made by hand."""

import glob
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from polyglyph.functions.names import REGIONS
from polyglyph.operators import extracts as X
from polyglyph.sources import extracts as S

MEMBER = {"type": "way", "ref": -5, "role": "outer"}
ROWS = [
    ("node", 5, {"name": "é", "empty": ""}, 1.2345678, -179.9999999, None, None), ("node", -3, {}, -90.0, 180.0, None, None), ("node", 2**40, {"website": "w"}, 0.0, 0.0000001, None, None),
    ("way", 7, {"website": "x", "name": "é"}, None, None, [5, -3, 2**40, 5], None), ("way", 8, {}, None, None, [], None),
    ("relation", 9, {"type": "multipolygon"}, None, None, None, [MEMBER, {"type": "node", "ref": 5, "role": ""}, {"type": "relation", "ref": 9, "role": "é"}]),
]


def plain(row):  # tags in order
    return (row[0], row[1], sorted((row[2] or {}).items()), row[3], row[4], row[5], None if row[6] is None else [tuple(m.values()) if isinstance(m, dict) else tuple(m) for m in row[6]])


def test_numbers():
    rng = np.random.default_rng(1)
    big = np.concatenate([[0, 1, 127, 128, 300, 2**32, 2**62], rng.integers(0, 2**50, 500)])
    assert S.varints(S.put_varints(big)).tolist() == big.tolist() and S.put_varints([300]) == b"\xac\x02"
    around = np.concatenate([[0, -1, 1, -2, 2**61, -(2**61)], rng.integers(-(2**40), 2**40, 500)])
    assert S.deltas(S.put_deltas(around)).tolist() == around.tolist() and S.zigzag([0, -1, 1, -2]).tolist() == [0, 1, 2, 3]
    assert S.varints(b"").tolist() == [] and S.put_deltas([]) == b""


@pytest.fixture(scope="module")
def many(spark):
    """Nodes, ways and relations in many blocks."""
    k = F.col("id")
    none, m = F.lit(None), F.lit(None).cast("array<struct<type:string,ref:bigint,role:string>>")
    tags = F.when(k % 10 == 0, F.create_map(F.lit("website"), F.concat(F.lit("w"), k))).otherwise(F.create_map().cast("map<string,string>"))
    base = spark.range(0, 3000, 1, 3)
    nodes = base.select(F.lit("node").alias("type"), k, tags.alias("tags"), (k % 90 + 0.5).alias("lat"), (-(k % 180)).cast("double").alias("lon"), none.cast("array<bigint>").alias("nodes"), m.alias("members"))
    ways = base.select(F.lit("way").alias("type"), k, tags.alias("tags"), none.cast("double").alias("lat"), none.cast("double").alias("lon"), F.array(k, k + 1).alias("nodes"), m.alias("members"))
    return nodes.unionByName(ways)


def test_round_trip(spark, tmp_path):
    rows = spark.createDataFrame(ROWS, S.SCHEMA)
    S.write_extract(rows.repartition(2), str(tmp_path / "x"))
    assert sorted(map(str, map(plain, S.read_extract(spark, str(tmp_path / "x")).collect()))) == sorted(map(str, map(plain, ROWS)))
    with pytest.raises(Exception, match="without a place"):
        S.write_extract(spark.createDataFrame([("node", 1, {}, None, 1.0, None, None)], S.SCHEMA), str(tmp_path / "y"))
    (tmp_path / "none").mkdir()
    assert S.read_extract(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("size", [1, 7, 333, 5000, 10**9])
def test_every_range_size_finds_every_block_once(tmp_path, size):
    rng = np.random.default_rng(size)
    blocks = [[("node", int(i), [("k", S.MARK.decode("latin-1"))], 0.0, 0.0, None, None) for i in range(b * 100, b * 100 + int(rng.integers(1, 40)))] for b in range(12)]
    noise = S.struct.pack(">I", 12) + S.MARK + b"\x18\x05"  # what looks like a header, inside a block that is not packed
    plain_block = S.put(1, S.put(1, b"") + S.put(1, noise)) + S.put(2, b"")
    blob = S.put(1, plain_block)
    head = S.put(1, b"OSMData") + S.put(3, len(blob))
    data = S.FILE_HEADER + b"".join(S.framed("OSMData", S.block_of(b)) for b in blocks[:6]) + struct.pack(">I", len(head)) + head + blob + b"".join(S.framed("OSMData", S.block_of(b)) for b in blocks[6:])
    (tmp_path / "f.pbf").write_bytes(data)
    step = max(size, 1) if size > 1 else 97
    got = []
    with pa.OSFile(str(tmp_path / "f.pbf")) as f:
        for start in range(0, len(data), step):
            for block in S.blocks(f, start, min(start + step, len(data)), len(data)):
                got += [r[1] for r in S.elements(block, S.Wanted())]
    assert got == [r[1] for b in blocks for r in b]


def test_only_what_is_asked_for_is_made(spark, tmp_path, many):
    path = str(tmp_path / "m")
    S.write_extract(many, path, elements=100)
    read = lambda **o: S.read_extract(spark, path, range_bytes=3000, **o)
    assert sorted(r.id for r in read(kinds=("way",), ids=S.pack_ids([4, 10, 70000])).collect()) == [4, 10]
    assert read(keys=("website",)).count() == 600 and read(keys=("website",), kinds=("node",)).count() == 300 and read(keys=("none",)).count() == 0
    assert read(ids=S.pack_ids([])).count() == 0 and read().where("type = 'node'").union(read().where("type = 'way'")).count() == 6000
    nodes, ways = read(kinds=("node",)).repartition(3, "id"), read(kinds=("way",)).repartition(3, "id")
    assert {(r.type, r.n) for r in nodes.unionByName(ways).groupBy("type").agg(F.count("*").alias("n")).collect()} == {("node", 3000), ("way", 3000)}
    assert nodes.join(ways.select("id", F.col("type").alias("t")), "id").where("type = 'node' and t = 'way'").count() == 3000
    block = S.block_of([("node", i, [("k", "v")], 0.0, 0.0, None, None) for i in range(9)])
    assert [r[1] for r in S.elements(block, S.Wanted(ids=np.array([3, 8, 11])))] == [3, 8] and not list(S.elements(block, S.Wanted(keys=("v2",))))


@pytest.mark.parametrize("most", [10_000, 5])
def test_wanted_ids(spark, tmp_path, many, most):
    path = str(tmp_path / f"w{most}")
    S.write_extract(many, path, elements=100)
    wanted = spark.createDataFrame([("node", 1), ("node", 2999), ("way", 17), ("way", 10**7), ("relation", 5), (None, 3), ("node", None), ("node", 1)] + [("way", i) for i in range(40, 50)], "type string, id long")
    got = sorted((r.type, r.id) for r in S.scan_wanted(spark, path, wanted, most=most).collect())
    assert got == [("node", 1), ("node", 2999), ("way", 17), *[("way", i) for i in range(40, 50)]]
    assert S.scan_wanted(spark, path, wanted.limit(0), most=most).count() == 0


def test_sites_of_an_extract(spark, tmp_path):
    S.write_extract(spark.createDataFrame(ROWS, S.SCHEMA), str(tmp_path / "s"))
    got = sorted((r.osm_type, r.osm_id, r.website, r.lat) for r in X.extract_sites(spark, str(tmp_path / "s")).collect())
    # the way's place: nodes 5, -3, 2**40 and 5 again
    assert [(t, i, w) for t, i, w, _ in got] == [("node", 2**40, "w"), ("way", 7, "x")] and got[1][3] == pytest.approx((2 * 1.2345678 - 90.0) / 4)
    assert X.extract_sites(spark, str(tmp_path / "s"), (10.0, 10.0, 20.0, 20.0)).count() == 0


def test_names_over_the_years(spark, tmp_path):
    for stamp, name in (("140101", "Siop"), ("150101", "Shop")):
        rows = [("node", 1, {"name": name, "name:cy": "Siop"}, 0.0, 0.0, None, None), ("node", 2, {"name": name}, 0.0, 0.0, None, None)]
        S.write_extract(spark.createDataFrame(rows, S.SCHEMA), str(tmp_path / stamp))
    seen = X.name_snapshots(spark, {s: str(tmp_path / s) for s in ("150101", "140101")}, spark.createDataFrame([("node", 1)], "type string, id long"), REGIONS["wales"])
    assert sorted((r.stamp, r.id, r.name, r.primary, r.available) for r in seen.collect()) == [("140101", 1, "Siop", "welsh", ["welsh"]), ("150101", 1, "Shop", "english", ["english", "welsh"])]


def test_a_file_written_by_others(spark, tmp_path):
    """Plain nodes beside dense ones, offsets and another unit, a block that is not packed, index data in the header."""
    strings = b"".join(S.put(1, s) for s in (b"", b"name", b"A"))
    node = S.put(1, 10) + S.put(2, S.put_varints([1])) + S.put(3, S.put_varints([2])) + S.put(8, 20) + S.put(9, 29)  # id 5, lat 10, lon -15 units
    dense = S.put(1, S.put_deltas([6, 8])) + S.put(5, b"") + S.put(8, S.put_deltas([1, 2])) + S.put(9, S.put_deltas([3, -4]))
    block = S.put(1, strings) + S.put(2, S.put(1, node)) + S.put(2, S.put(2, dense)) + S.put(17, 1000) + S.put(19, 5_000_000_000) + S.put_varints([20 << 3]) + S.put_varints([-5_000_000_000])
    blob = S.put(1, block)
    head = S.put(1, b"OSMData") + S.put(2, b"index") + S.put(3, len(blob))
    (tmp_path / "o.pbf").write_bytes(S.FILE_HEADER + struct.pack(">I", len(head)) + head + blob)
    got = sorted((r.id, dict(r.tags), r.lat, r.lon) for r in S.read_extract(spark, str(tmp_path / "o.pbf")).collect())
    assert got == [(5, {"name": "A"}, 5.00001, -5.000015), (6, {}, 5.000001, -4.999997), (8, {}, 5.000002, -5.000004)]
    assert zlib.decompress(zlib.compress(block)) == block and glob.glob(str(tmp_path / "*.pbf"))


def test_a_block_of_ways_is_joined_once_and_read_without_arrays(monkeypatch):
    from polyglyph.sources import extracts as S

    ways = [("way", i - 3, [("a", "b")] if i % 7 == 0 else [], None, None, [i // 10, -i, i + 1_000_000, 1 << 40], None) for i in range(500)]
    block = S.block_of(ways)
    monkeypatch.setattr(S, "varints", lambda data: 1 / 0)  # arrays are for long runs
    assert list(S.elements(block, S.Wanted())) == ways
    monkeypatch.undo()
    long = [("way", 1 << 40, [], None, None, list(range(0, 9000, 9))[::-1], None)]
    assert list(S.elements(S.block_of(long), S.Wanted())) == long
    some = S.Wanted(ids=S.np.array([-3, 4, 496]))
    assert [r[1] for r in S.elements(block, some)] == [-3, 4, 496] and not list(S.elements(block, S.Wanted(ids=S.np.array([], int))))
