"""Hard negatives by bit-sliced integer products.

A block of vectors is kept as bit-planes: each component less its least value in the block, one plane a bit. A query's
product with a block starts as the interval that the least values and the number of planes leave open, and every plane,
most significant first, halves the interval of every candidate. A candidate whose interval can no longer reach the best
so far, or any window, is dropped; the few that stay are finished one by one. Whole blocks drop before their first plane.

First each anchor's positives are found in the blocks of its own label, then negatives of every positive in the others.
Anchors lie in chunks and vectors in blocks, each of one label. Chunks and blocks meet in cells of bounded size: a stated
query set against all rows, in blocks; no cell sends on more than its best rows of each anchor or positive.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table
from .topk import SCALE

POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these hundredths of its positive's.
LOW, HIGH = 50, 95
#: Vectors of a block and of a chunk; blocks and chunks of a cell.
BLOCK_SIZE, CHUNK_SIZE, CELL_BLOCKS, CELL_CHUNKS = 512, 512, 64, 8
#: Pairs of a chunk and a block are finished one by one when so small a part of them is left.
SPARSE = 0.1
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1

PACKED = "n long, label string, dim int, rows binary, ids binary, terms binary, high binary"
POSITIVE = "anchor long, anchor_id long, row long, vec_id long, score long"
NEGATIVE = "anchor long, anchor_id long, positive long, positive_id long, positive_score long, vec_id long, score long"


def labelled(vectors: DataFrame, label=None) -> DataFrame:
    """row, vec_id, terms, label (as text) of the vectors that take part; `label` is a column in place of the label's."""
    x = F.col("embedding")
    whole = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    terms = F.transform(x, lambda v: F.floor(v.cast("double") * float(SCALE)).cast("long"))
    group = (F.col("label") if label is None else label).cast("string")
    used = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & whole)
    return used.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), terms.alias("terms"), group.alias("label"))


def pack(terms: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of `size` vectors of one label and length, with their highest allowed scores where `high` is given."""
    high = F.col("high") if "high" in terms.columns else F.array().cast("array<long>")
    ranged = terms.select("row", "vec_id", "label", "terms", high.alias("high")).repartitionByRange("label", "row").sortWithinPartitions("label", "row")
    names = [x.split()[0] for x in PACKED.split(", ")]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())

    def run(batches):
        held: list = []

        def send():
            rows, ids, labels, values, tops = zip(*held)
            least, most = min(map(min, values)), max(map(max, values))
            kind = next(k for k in ("<i2", "<i4", "<i8") if np.iinfo(k).min <= least and most <= np.iinfo(k).max)
            numbers = [np.array(x, "<i8").tobytes() for x in (rows, ids)]
            one = (0, labels[0], len(values[0]), *numbers, np.array(values, kind).tobytes(), np.array(tops, "<i8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, kinds)], names)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if held and (len(held) >= size or row[2] != held[-1][2] or len(row[3]) != len(held[-1][3])):
                    yield send()
                    held = []
                held.append(row)
        if held:
            yield send()

    return materialize(ranged.mapInArrow(run, PACKED).withColumn("n", F.monotonically_increasing_id()), name)


class Block:
    """Vectors as bit-planes over the least value of each component."""

    def __init__(self, row):
        self.rows, self.ids = (np.frombuffer(x, "<i8") for x in (row.rows, row.ids))
        n = len(self.rows)
        terms = np.frombuffer(row.terms, f"<i{len(row.terms) // (n * row.dim)}").reshape(n, row.dim).astype(np.int64)
        self.terms, self.low = terms, terms.min(axis=0)
        self.over = (terms - self.low).astype(np.uint64)  # right even where the difference is beyond a long
        self.bits = int(self.over.max()).bit_length()

    def plane(self, i: int, kind) -> np.ndarray:
        return ((self.over >> np.uint64(i)) & np.uint64(1)).astype(kind)


def number_kind(q: np.ndarray, block: Block):
    """The numbers that hold all sums exactly: floats, which multiply fastest, or Python's integers."""
    reach = float(np.abs(q.astype(float)).sum(axis=1).max(initial=0)) * max(2.0**block.bits, float(np.abs(block.low.astype(float)).max(initial=0)))
    return np.float64 if reach < 2**52 else object


def scan(q: np.ndarray, block: Block, wanted):
    """(query places, block places, scores) of the pairs that wanted(query places, low, high) keeps to the last plane.

    low and high are the scores' bounds: matrices of the queries by the block's rows, or, when few pairs are left,
    vectors beside the pairs' query places.
    """
    kind = number_kind(q, block)
    q = q.astype(kind)
    long = (lambda x: np.clip(x, _LEAST, _MOST)) if kind is object else lambda x: x
    less, more = np.minimum(q, 0).sum(axis=1), np.maximum(q, 0).sum(axis=1)
    base, rest = q @ block.low.astype(kind), 2**block.bits - 1
    who = np.flatnonzero(wanted(np.arange(len(q)), long(base + rest * less)[:, None], long(base + rest * more)[:, None]).any(axis=1))
    cols = np.arange(len(block.rows))
    total = np.repeat(base[who][:, None], len(cols), axis=1)
    live = np.ones(total.shape, bool)
    i = block.bits
    while i > 0 and live.any() and live.mean() >= SPARSE:
        i -= 1
        total = total + (q[who] @ block.plane(i, kind)[cols].T) * 2**i
        rest = 2**i - 1
        live &= wanted(who, long(total + rest * less[who][:, None]), long(total + rest * more[who][:, None]))
        some, there = live.any(axis=1), live.any(axis=0)
        if some.sum() * there.sum() < 0.7 * live.size:
            who, cols, total, live = who[some], cols[there], total[some][:, there], live[some][:, there]
    a, b = np.nonzero(live)
    score, a, b = total[a, b], who[a], cols[b]
    while i > 0 and len(a):
        i -= 1
        score = score + (q[a] * block.plane(i, kind)[b]).sum(axis=1) * 2**i
        rest = 2**i - 1
        keep = wanted(a, long(score + rest * less[a]), long(score + rest * more[a]))
        a, b, score = a[keep], b[keep], score[keep]
    return a, b, long(score).astype(np.int64)


class Best:
    """The k best (score, then smaller id) of each place, fed in parts."""

    def __init__(self, places: int, k: int):
        self.k, self.kth = k, np.full(places, _LEAST)
        self.place, self.score, self.ids, self.rows = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, place, score, ids, rows) -> None:
        place, score, ids, rows = (np.concatenate(x) for x in zip((self.place, self.score, self.ids, self.rows), (place, score, ids, rows)))
        order = np.lexsort((rows, ids, ~score, place))
        place = place[order]
        rank = np.arange(len(place)) - np.searchsorted(place, place)
        order, rank, place = order[rank < self.k], rank[rank < self.k], place[rank < self.k]
        self.place, self.score, self.ids, self.rows = place, score[order], ids[order], rows[order]
        full = rank == self.k - 1
        self.kth[place[full]] = self.score[full]


def _queries(chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, ids = (np.frombuffer(x, "<i8") for x in (chunk.rows, chunk.ids))
    terms = np.frombuffer(chunk.terms, f"<i{len(chunk.terms) // (len(rows) * chunk.dim)}")
    return rows, ids, terms.reshape(len(rows), chunk.dim).astype(np.int64)


def positives_cell(chunks: list, blocks: list, k: int) -> list[tuple]:
    """POSITIVE rows: for each anchor the k best other rows of its label in the cell."""
    out = []
    made = [(b, Block(b)) for b in blocks]
    for chunk in chunks:
        rows, ids, q = _queries(chunk)
        best = Best(len(rows), k)
        for b, block in made:
            if (b.label, b.dim) != (chunk.label, chunk.dim):
                continue
            a, c, score = scan(q, block, lambda who, low, high: high >= (best.kth[who][:, None] if high.ndim == 2 else best.kth[who]))
            other = block.rows[c] != rows[a]
            a, c, score = a[other], c[other], score[other]
            best.add(a, score, block.ids[c], block.rows[c])
        out += zip(rows[best.place].tolist(), ids[best.place].tolist(), best.rows.tolist(), best.ids.tolist(), best.score.tolist())
    return out


def windows(scores: np.ndarray, low: int = LOW, high: int = HIGH) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest score of a negative of a positive of each score."""
    given = scores.tolist()
    return np.array([-((-low * s) // 100) for s in given], np.int64), np.array([(high * s) // 100 for s in given], np.int64)


def negatives_cell(chunks: list, blocks: list, k: int, low: int = LOW, high: int = HIGH) -> list[tuple]:
    """NEGATIVE rows: for each positive of each anchor the k best rows of other labels in its window.

    A chunk's `high` holds, for each of its rows, (positive row, positive id, score) of up to POSITIVES positives.
    """
    out = []
    made = [(b, Block(b)) for b in blocks]
    for chunk in chunks:
        rows, ids, q = _queries(chunk)
        given = np.frombuffer(chunk.high, "<i8").reshape(len(rows), -1, 4)
        there = given[:, :, 0] == 1
        least, most = (np.full(there.shape, x) for x in (_MOST, _LEAST))
        for x, to in zip(windows(given[:, :, 3][there], low, high), (least, most)):
            to[there] = x
        width = there.shape[1]
        best = Best(len(rows) * width, k)
        for b, block in made:
            if b.dim != chunk.dim or b.label == chunk.label:
                continue
            floor = np.maximum(least, best.kth.reshape(-1, width))

            def wanted(who, lo, hi):
                ok = np.zeros(np.broadcast_shapes(lo.shape, hi.shape), bool)
                for p in range(width):
                    f, m = floor[who, p], most[who, p]
                    ok |= (hi >= (f[:, None] if hi.ndim == 2 else f)) & (lo <= (m[:, None] if hi.ndim == 2 else m))
                return ok

            a, c, score = scan(q, block, wanted)
            at, p = np.nonzero((score[:, None] >= floor[a]) & (score[:, None] <= most[a]))
            best.add(a[at] * width + p, score[at], block.ids[c[at]], block.rows[c[at]])
        at, p = np.divmod(best.place, width) if width else (best.place, best.place)
        pos = given[at, p] if width else np.zeros((0, 4), np.int64)
        out += zip(rows[at].tolist(), ids[at].tolist(), pos[:, 1].tolist(), pos[:, 2].tolist(), pos[:, 3].tolist(), best.ids.tolist(), best.score.tolist())
    return out


def _cells(chunks: DataFrame, blocks: DataFrame, run, schema: str) -> DataFrame:
    """Chunks and blocks meet in their cells (r, c)."""
    both = chunks.withColumn("q", F.lit(True)).unionByName(blocks.withColumn("q", F.lit(False)))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.itertuples())
        found = run([x for x in rows if x.q], [x for x in rows if not x.q])
        return pd.DataFrame(found, columns=[x.split()[0] for x in schema.split(", ")])

    return both.groupBy("r", "c").applyInPandas(cell, schema)


def _all_cells(chunks: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every chunk and every block in the cells where they meet."""
    n_r, n_c = (max(1, math.ceil(df.count() / most)) for df, most in ((chunks, CELL_CHUNKS), (blocks, CELL_BLOCKS)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = lambda n: F.pmod(F.xxhash64("n"), F.lit(n)).cast("int")
    return chunks.withColumn("r", spread(n_r)).withColumn("c", every(n_c)), blocks.withColumn("c", spread(n_c)).withColumn("r", every(n_r))


def _label_cells(chunks: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every chunk and every block in the cells of their label. r and c number a label's groups of chunks and of blocks."""
    counted = lambda df, most, to: df.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias(to))
    groups = counted(chunks, CELL_CHUNKS, "_r").join(counted(blocks, CELL_BLOCKS, "_c"), "label")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    spread = lambda n: F.pmod(F.xxhash64("n"), n)
    name = lambda n: F.concat_ws(" ", n, "label")
    left = chunks.join(groups, "label").withColumn("r", name(spread(F.col("_r")))).withColumn("c", every(F.col("_c")))
    right = blocks.join(groups, "label").withColumn("c", spread(F.col("_c")).cast("int")).withColumn("_n", every(F.col("_r"))).withColumn("r", name(F.col("_n")))
    return left.select(*chunks.columns, "r", "c"), right.select(*blocks.columns, "r", "c")


def positives(terms: DataFrame, is_anchor, k: int = POSITIVES, blocks: DataFrame | None = None) -> DataFrame:
    """POSITIVE: for each anchor its k best other rows of the same label; a written table."""
    blocks = pack(terms, BLOCK_SIZE, "blocks") if blocks is None else blocks
    chunks = pack(terms.where(is_anchor), CHUNK_SIZE, "anchors")
    found = _cells(*_label_cells(chunks, blocks), lambda q, b: positives_cell(q, b, k), POSITIVE)
    rank = F.row_number().over(W.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "row"))
    return materialize(found.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank"), "positives")


def hard_negatives(vectors: DataFrame, is_anchor, label=None, n_positives: int = POSITIVES, n_negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Vectors (vec_id, embedding, label) with a null vec_id or label, or whose vector is null, empty or holds null or
    non-finite components, take no part. Rows that share a vec_id are rows of their own, told apart by a row number.
    Only vectors of equal length are compared; components and scores beyond a long are the nearest long. An anchor
    without other rows of its label has no rows, nor has a positive of a negative score, whose window is empty. An empty
    table gives none. Other columns do not matter.
    """
    terms = materialize(labelled(vectors, label), "terms")
    blocks = pack(terms, BLOCK_SIZE, "blocks")
    found = positives(terms, is_anchor, n_positives, blocks)
    given = F.struct("score", "vec_id", "row")
    lists = found.groupBy("anchor").agg(F.sort_array(F.collect_list(given), asc=False).alias("_p"))  # n_positives at most
    slot = lambda i: F.get("_p", F.lit(i))
    flat = [x for i in range(n_positives) for x in (slot(i).isNotNull().cast("long"), *[F.coalesce(slot(i)[c], F.lit(0)) for c in ("row", "vec_id", "score")])]
    anchors = terms.where(is_anchor).join(lists, F.col("row") == F.col("anchor")).select("row", "vec_id", "label", "terms", F.array(*flat).alias("high"))
    chunks = pack(anchors, CHUNK_SIZE, "anchors_with_positives")
    best = _cells(*_all_cells(chunks, blocks), lambda q, b: negatives_cell(q, b, n_negatives, low, high), NEGATIVE)
    rank = F.row_number().over(W.partitionBy("anchor", "positive").orderBy(F.desc("score"), "vec_id"))
    ranked = best.withColumn("rank", rank).where(F.col("rank") <= n_negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives of every row whose vec_id is divisible by 50; labels of rows divisible by 7 move on by one; edge cases as in hard_negatives()."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


ORACLE_OP11 = """
WITH t AS (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n AS anchor, q.vec_id AS anchor_id, c.n, c.vec_id, q.label = c.label AS same, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM t q JOIN t c ON q.vec_id % 50 = 0 AND q.n <> c.n AND len(q.e) = len(c.e)),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, n) AS r FROM s WHERE same),
m AS (
  SELECT p.anchor, p.anchor_id, p.n AS positive, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.n ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON p.r <= 5 AND p.anchor = s.anchor AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM m WHERE rank <= 3
"""
