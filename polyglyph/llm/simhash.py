"""SimHash near-duplicates, searched with BK-trees.

A BK-tree holds fingerprints; each child hangs on its parent by their Hamming distance, and a search within radius r
follows only the edges whose distance is within r of the query's distance to the node. One tree over all documents
would have to be broadcast, which has no size bound, so the trees are sharded, and the shuffle takes them to their
queries. A shard holds its own tree and queries and sends on only the links that join two of its subtrees, never all
pairs of a group.

Links of fingerprints (op3): the 64 bits are cut into radius + 1 blocks, of which two fingerprints within the radius
agree in one at least; the first bits of a block are its shard, as many as give about SHARD fingerprints each. A shard
that is larger than MOST is dealt again by the choices of AGREE of radius + AGREE blocks. The search is exact.

Near copies (the pipeline's stage): texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.
At that similarity fingerprints differ in 15 % of their bits on average, so no block of bits need agree; shards are
the texts with the same least shingle under one of ORDERS hash functions, which two similar texts miss in all orders
less than three times in a million. Fingerprints are 64 * LANES bits, so that their distance tells similar texts from
those that only share a passage; a shard's BK-tree is searched within COPY_RADIUS, and what it links is confirmed by
the sets themselves.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, materialize, table
from .components import components

RADIUS = 2
SHINGLE = 3
AGREE = 4
#: Fingerprints that a shard is to have, and from how many on it is dealt again.
SHARD, MOST = 512, 4096
#: Near copies: words of a shingle, least similarity as a fraction, orders of the shingles.
COPY_SHINGLE, SIMILAR, ORDERS = 5, (4, 5), 8
#: 64-bit parts of their fingerprints, and the radius of the search: at similarity 0.8 they differ in 39 bits of 256 on
#: average, with a deviation of 6; at 0.5 in 69, with 7.
LANES, COPY_RADIUS = 4, 62
#: Shingles of the sets that are compared in one task; larger groups are compared block by block.
BLOCK_SHINGLES = 2_000_000
#: Rows up to which a table of row numbers is broadcast; a larger one is joined by shuffle.
BROADCAST_NUMBERS = 2_000_000

_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, (2, ORDERS + LANES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(hashes: np.ndarray, k) -> np.ndarray:
    """The hashes under the k-th of the hash functions."""
    x = hashes * _FACTORS[0, k]
    x ^= x >> np.uint64(32)
    return x * _FACTORS[1, k]


def shingles(text: str | None, shingle: int) -> list[int]:
    """XXH64 of the text's word shingles, repeats included; a shorter text is one shingle, one without words has none."""
    words = (text or "").encode().lower().split()
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return [digest(joined, 42)]
    ends = list(accumulate(len(w) + 1 for w in words))
    return [digest(joined[s : e - 1], 42) for s, e in zip([0, *ends], ends[shingle - 1 :])]


def simhash(hashes: list[int]) -> int:
    """The fingerprint of hashed shingles as an unsigned 64-bit number; 0 without shingles."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.array(hashes[at : at + 65536], dtype=">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def wide_simhash(hashes: list[int]) -> bytes:
    """The fingerprint of hashed shingles in 64 * LANES bits, each 64 of them of the hashes mixed anew."""
    own = np.array(hashes, dtype=np.uint64)
    return b"".join(simhash(_mixed(own, ORDERS + k).tolist() if len(own) else []).to_bytes(8, "big") for k in range(LANES))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return simhash(shingles(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and its fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            out = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


class BKTree:
    def __init__(self):
        self.keys: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, key: int, radius: int) -> list[int]:
        """Places in the tree of the keys within the radius; then hangs key in the tree, as its last place."""
        keys, children, found = self.keys, self.children, []
        if keys:
            stack = [0]
            while stack:
                at = stack.pop()
                d = (keys[at] ^ key).bit_count()
                if d <= radius:
                    found.append(at)
                edges = children[at]
                if len(edges) <= 2 * radius + 1:
                    stack += [n for e, n in edges.items() if -radius <= e - d <= radius]
                else:
                    stack += [edges[e] for e in range(d - radius, d + radius + 1) if e in edges]
            at = 0
            while True:
                d = (keys[at] ^ key).bit_count()
                if d not in children[at]:
                    children[at][d] = len(keys)
                    break
                at = children[at][d]
        keys.append(key)
        children.append({})
        return found


def shard_links(keys: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (i, j) of places in keys that span the components of a shard's fingerprints."""
    tree, parent, out = BKTree(), list(range(len(keys))), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, key in enumerate(keys):
        for j in tree.add(key, radius):
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _blocks(n: int) -> list[tuple[int, int]]:
    """The first bit and the width of n blocks of the 64 bits."""
    cuts = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def block_masks(n_fingerprints: int, radius: int = RADIUS) -> list[int]:
    """A mask of bits of each of radius + 1 blocks, so many that uniform fingerprints are SHARD to a shard, or the whole block."""
    bits = max(1, math.ceil(math.log2(max(2, n_fingerprints) / SHARD)))
    return [_signed(((1 << min(bits, width)) - 1) << first) for first, width in _blocks(radius + 1)]


def agree_masks(radius: int = RADIUS, agree: int = AGREE) -> list[int]:
    """For each choice of `agree` of radius + agree blocks, the mask of their bits: two within the radius agree under one."""
    block = [((1 << width) - 1) << first for first, width in _blocks(radius + agree)]
    return [_signed(sum(chosen)) for chosen in combinations(block, agree)]


def _dealt(fps: DataFrame, masks: list[int], first: int = 0) -> DataFrame:
    shards = F.array(*[F.struct(F.lit(first + k).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)])
    return fps.select("fp", F.explode(shards).alias("s")).select("s.k", "s.bits", "fp")


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp long) -> links (a, b) with the same components as all pairs within the radius."""
    coarse = block_masks(fps.count(), radius)
    shards = _dealt(fps, coarse)
    sizes = materialize(shards.groupBy("k", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST), "large_shards")
    if not sizes.isEmpty():
        large = few(sizes.select("k", "bits"))
        again = _dealt(shards.join(large, ["k", "bits"], "left_semi").select("fp").distinct(), agree_masks(radius), len(coarse))
        shards = shards.join(large, ["k", "bits"], "left_anti").unionByName(again)
    return _tree_links(shards, ["k", "bits"], radius)


def _tree_links(shards: DataFrame, key: list[str], radius: int) -> DataFrame:
    """shards (key of two longs, fp) -> (a, b): links that span the components of each shard's fingerprints."""
    dealt = shards.select(*key, "fp").repartition(*key).sortWithinPartitions(*key, "fp")

    def run(batches):
        rest = np.zeros((0, 3), np.int64)
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1).astype(np.int64)
            rows = np.concatenate([rest, rows]) if len(rest) else rows
            new = np.flatnonzero(np.any(rows[1:, :2] != rows[:-1, :2], axis=1)) + 1
            last = int(new[-1]) if len(new) else 0
            yield from _runs(rows[:last], new[:-1] if len(new) else new, radius)
            rest = rows[last:]
        yield from _runs(rest, np.zeros(0, np.int64), radius)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _runs(rows: np.ndarray, new: np.ndarray, radius: int):
    if not len(rows):
        return
    starts = np.concatenate([[0], new]).astype(np.int64)
    ends = np.concatenate([new, [len(rows)]]).astype(np.int64)
    many, out = ends - starts > 1, []
    for s, e in zip(starts[many].tolist(), ends[many].tolist()):
        fps = rows[s:e, 2]
        out += [(fps[i], fps[j]) for i, j in shard_links(fps.view(np.uint64).tolist(), radius)]
    if out:
        pairs = np.array(out, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fingerprint and component_id of every document.

    A null or empty text has fingerprint zero and is linked like any other; rows alike share a component; null
    doc_ids are kept, and are not a component's smallest id unless there is no other. An empty table stays empty.
    """
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    reps = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(reps.select("fp"), radius))
    member = reps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    member = materialize(member, "members")
    first = member.groupBy("root").agg(F.min("least").alias("component_id"))
    member = materialize(member.join(first, "root").select("fp", "component_id"), "classes")
    return prints.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def least_shingles(hashes: np.ndarray) -> list[int]:
    """The least value of the set under each of the orders, as signed longs."""
    least = np.full(ORDERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 8192):
        np.minimum(least, _mixed(hashes[at : at + 8192, None], np.arange(ORDERS)).min(axis=0), out=least)
    return least.view(np.int64).tolist()


def _sets(text: str | None) -> np.ndarray:
    """Sorted distinct hashes; a text without words has the empty set."""
    return np.unique(np.array(shingles(text, COPY_SHINGLE), dtype=np.uint64))


def _sketches(batches):
    for batch in batches:
        out = []
        for text in batch.column(2):
            hashes = shingles(text.as_py(), COPY_SHINGLE)
            own = np.unique(np.array(hashes, dtype=np.uint64))
            out.append((xxhash.xxh3_128_digest(own.tobytes()), len(own), wide_simhash(hashes), least_shingles(own)))
        cols = list(zip(*out)) or [()] * 4
        kinds = (pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds)]], ["row", "doc_id", "digest", "n", "fp", "least"])


def _copy_shards(nodes: DataFrame) -> DataFrame:
    """nodes (node, fp, least) -> (h, g, node, fp): the shards of texts that have a least shingle in common.

    A shard with more than MOST texts, such as that of a passage which many texts share, is dealt again by the least
    shingles under each other order. One that is still larger holds texts alike, and its tree links them fast.
    """
    shards = nodes.select("node", F.posexplode("least").alias("o", "h")).select("node", F.xxhash64("o", "h").alias("h"))
    sizes = shards.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = materialize(sizes.select("h", (F.col("n") > MOST).alias("large")), "shard_sizes")
    kept = materialize(shards.join(sizes, "h"), "shards")
    again = kept.where("large").join(nodes.select("node", "least"), "node").select("h", "node", F.posexplode("least").alias("o", "other"))
    # the order that a shard was dealt by gives one more shard with all of its rows: it is left out
    again = again.select("h", F.xxhash64("o", "other").alias("g"), "node").where("h <> g")
    every = kept.where("not large").select("h", F.lit(0).cast("long").alias("g"), "node").unionByName(again)
    return every.join(nodes.select("node", "fp"), "node").select("h", "g", "node", "fp")


def _copy_links(batches):
    """Sorted shards (h, g, node, fp) -> (a, b): nodes linked by the shards' BK-trees."""
    for rows in _cells(batches, 2):
        found = shard_links([int.from_bytes(r[3], "big") for r in rows], COPY_RADIUS)
        if found:
            yield _pairs([(rows[i][2], rows[j][2]) for i, j in found], ["a", "b"])


def _pairs(found: list[tuple[int, int]], names: list[str]):
    a, b = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names)


def _cells(batches, key_columns: int):
    """The rows of sorted batches, in lists with the same first columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:key_columns] != key:
                if len(rows) > 1:
                    yield rows
                key, rows = row[:key_columns], []
            rows.append(row)
    if len(rows) > 1:
        yield rows


def _similar(a: frozenset, b: frozenset) -> bool:
    similar, of = SIMILAR
    if min(len(a), len(b)) * of < max(len(a), len(b)) * similar:
        return False
    both = len(a & b)
    return both * of >= (len(a) + len(b) - both) * similar


def _confirmed(batches):
    """Cells (root, i, j, node, fp, hashes) -> (a, b): links that span the components of the sets' similarity."""
    for rows in _cells(batches, 3):
        nodes, fps = [r[3] for r in rows], np.frombuffer(b"".join(r[4] for r in rows), np.uint64).reshape(-1, LANES)
        sets = [frozenset(np.frombuffer(r[5], np.uint64).tolist()) for r in rows]
        left, out = np.arange(len(rows)), []
        while len(left):
            reached, left = [int(left[0])], left[1:]
            while reached and len(left):
                x = reached.pop()
                near = np.bitwise_count(fps[left] ^ fps[x]).sum(axis=1) <= COPY_RADIUS
                hit = np.array([bool(n) and _similar(sets[x], sets[y]) for n, y in zip(near, left.tolist())])
                reached += left[hit].tolist()
                out += [(nodes[x], nodes[y]) for y in left[hit].tolist()]
                left = left[~hit]
        if out:
            yield _pairs(out, ["a", "b"])


def near_copies(rows: DataFrame) -> DataFrame:
    """rows (row long, doc_id, text) -> (row, doc_id, group): rows of one group are near copies, linked or by others.

    Similarity: Jaccard of the sets of five-word shingles (A-Z lower-cased), 0.8 or more, for fingerprints within
    COPY_RADIUS. Texts with equal sets are one from the start, so also all texts without words; a shorter text is one
    shingle. group is the least row of those with its set, or linked to it.
    """
    prints = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_sketches, "row long, doc_id long, digest binary, n long, fp binary, least array<long>")
    prints = materialize(prints, "sketches")
    same = prints.groupBy("digest").agg(F.min("row").alias("node"), F.min_by(F.struct("n", "fp", "least"), "row").alias("of"))
    same = materialize(same.select("digest", "node", "of.*"), "sets")
    shards = _copy_shards(same).repartition("h", "g").sortWithinPartitions("h", "g", "node")
    linked = components(materialize(shards.mapInArrow(_copy_links, "a long, b long").distinct(), "likely"))
    roots = linked.select("node", "root").union(linked.select("root", "root")).distinct()
    coarse = materialize(same.select("node", "fp", "n").join(roots, "node"), "groups")
    sizes = coarse.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("shingles")).where("members > 1")
    sizes = sizes.select("root", F.ceil(F.col("shingles") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    # a large group is cut into blocks, and each pair of blocks is compared in a cell of its own
    block = F.pmod(F.xxhash64("node"), F.greatest("blocks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1))
    cells = coarse.join(sizes, "root").withColumn("block", block).withColumn("other", other)
    cells = materialize(cells.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "fp"), "cells")

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([_sets(t.as_py()).tobytes() for t in batch.column(5)], pa.binary())], ["root", "i", "j", "node", "fp", "hashes"])

    sets = rows.select(F.col("row").alias("node"), "text").join(few(cells, BROADCAST_NUMBERS), "node").select("root", "i", "j", "node", "fp", "text")
    sets = sets.mapInArrow(hashed, "root long, i int, j int, node long, fp binary, hashes binary").repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node")
    found = components(materialize(sets.mapInArrow(_confirmed, "a long, b long"), "confirmed"))
    named = prints.select("row", "doc_id", "digest").join(same.select("digest", "node"), "digest").join(found, "node", "left")
    return materialize(named.select("row", "doc_id", F.coalesce("root", "node").alias("group")), "copies")


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs without the rows that are near copies of one that is kept.

    Of a group the row with the smallest doc_id stays, of equals one, a row without doc_id only if all are. Rows are
    told apart by themselves: different texts that share a doc_id stay. Null texts count as empty, and all texts
    without words are copies of one another; an empty table stays empty; other columns pass.
    """
    row = "__polyglyph_row"
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_copies(rows.select(F.col(row).alias("row"), "doc_id", "text"))
    kept = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("kept")).select(F.col("kept.row").alias("row"))
    dropped = materialize(groups.select(F.col("row").alias(row)).join(kept, F.col(row) == F.col("row"), "left_anti"), "dropped")
    return rows.join(few(dropped, BROADCAST_NUMBERS), row, "left_anti").select(*docs.columns)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; nulls, repeated rows and an empty table as in near_duplicates()."""
    return near_duplicates(table(spark, sf_dir, "documents"))
