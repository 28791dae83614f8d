"""Exact top-k inner product with block-at-a-time pruning.

Vectors are documents and components are terms. Document ranges of `block_size` vectors are blocks; a block keeps the
greatest and least value of each term and its vectors as a forward index. A query orders the blocks by their summed
bounds, sum_t max(q_t max_t, q_t min_t), and scores them until the bound falls below its k-th score so far.

A chunk of queries is first scored against a few blocks, which gives each query a threshold. Then the blocks'
bounds alone, a small part of the blocks, meet the chunks, and only the blocks whose bound reaches the threshold of some
query of a cell's chunks are sent there. Where vectors point everywhere alike (as those of the tables here do) no bound
is below any threshold, and every block meets every chunk: a stated query set against all rows, in blocks.
Queries and blocks meet in cells of a grid, of bounded size, which send on k rows per query at most.
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

K = 5
SCALE = 256
BLOCK_SIZE = 256
CHUNK_QUERIES = 512
#: Blocks of a cell, chunks of a cell, blocks that give a chunk's thresholds, blocks' bounds that meet at a time.
GROUP_BLOCKS, CELL_CHUNKS, SEED_BLOCKS, GROUP_BOUNDS = 64, 4, 4, 4096
_LONG = (-(1 << 63), (1 << 63) - 1)


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """row, vec_id, terms array<long> = floor(scale * x) with x as double; without unusable vectors.

    Rows that share a vec_id stay apart, told by `row`. A component beyond a long is the nearest long.
    """
    x = F.col("embedding")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    terms = F.transform(x, lambda v: F.floor(v.cast("double") * float(scale)).cast("long"))
    return vectors.where(usable).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), terms.alias("terms"))


BLOCK = "rows binary, ids binary, terms binary, dim int, top binary, low binary"


def _pack_blocks(batches, size: int):
    """(row, vec_id, terms) in range order -> one row per block: rows, ids, terms and bounds as bytes."""

    def send(rows, ids, terms):
        a = np.array(terms, dtype="<i8")
        one = (np.array(rows, "<i8").tobytes(), np.array(ids, "<i8").tobytes(), a.tobytes(), a.shape[1], a.max(axis=0).tobytes(), a.min(axis=0).tobytes())
        kinds = (pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(one, kinds)], [x.split()[0] for x in BLOCK.split(", ")])

    held: tuple[list, list, list] = ([], [], [])
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if len(held[0]) >= size or (held[2] and len(row[2]) != len(held[2][-1])):
                yield send(*held)
                held = ([], [], [])
            for column, value in zip(held, row):
                column.append(value)
    if held[0]:
        yield send(*held)


def _matrix(row, column: str = "terms") -> np.ndarray:
    return np.frombuffer(getattr(row, column), "<i8").reshape(-1, row.dim)


def _kind(q: np.ndarray, top: np.ndarray, low: np.ndarray):
    """The numbers that hold all sums exactly: doubles, which multiply fastest, longs, or Python's integers."""
    reach = float(np.abs(q.astype(float)).max(initial=0)) * float(max(np.abs(top.astype(float)).max(), np.abs(low.astype(float)).max())) * q.shape[1]
    return np.float64 if reach < 2**52 else np.int64 if reach < 2**62 else object


def _bounds(q: np.ndarray, top: np.ndarray, low: np.ndarray) -> np.ndarray:
    return np.maximum(q, 0) @ top.T + np.minimum(q, 0) @ low.T


def _long(x: np.ndarray) -> np.ndarray:
    """As longs; a score beyond a long is the nearest long."""
    return (np.clip(x, *_LONG) if x.dtype == object else x).astype(np.int64)


def _least(chunk) -> np.ndarray:
    """The thresholds of a chunk's queries."""
    least = getattr(chunk, "least", None)
    return np.frombuffer(least, "<i8") if isinstance(least, bytes) else np.full(len(chunk.rows) // 8, _LONG[0])


def search_cell(queries: list, blocks: list, k: int) -> list[tuple[int, int, int, int]]:
    """(query row, query id, vec_id, score) of the k best of the blocks for each query; ties to the smaller vec_id.

    A query may bring a threshold, `least`: blocks below it are not scored.
    """
    out = []
    for dim in sorted({q.dim for q in queries} & {b.dim for b in blocks}):
        mine = [q for q in queries if q.dim == dim]
        q_rows, q_ids = (np.concatenate([np.frombuffer(getattr(x, c), "<i8") for x in mine]) for c in ("rows", "ids"))
        q = np.concatenate([_matrix(x) for x in mine])
        own = [b for b in blocks if b.dim == dim]
        top, low = (np.concatenate([_matrix(b, c) for b in own]) for c in ("top", "low"))
        kind = _kind(q, top, low)
        q = q.astype(kind)
        bounds = _long(_bounds(q, top.astype(kind), low.astype(kind)))
        order = np.argsort(~bounds, axis=1, kind="stable")  # ~x is -x - 1, which no long overflows
        rows, ids = ([np.frombuffer(getattr(b, c), "<i8") for b in own] for c in ("rows", "ids"))
        terms = [_matrix(b).astype(kind) for b in own]
        best = np.full((len(q), k), _LONG[0], np.int64)
        best_id, found = np.full((len(q), k), _LONG[1], np.int64), np.zeros((len(q), k), bool)
        least = np.concatenate([_least(x) for x in mine])
        live = np.ones(len(q), bool)
        for step in range(len(own)):
            at = order[:, step]
            # bounds fall from step to step: once below, done
            live &= bounds[np.arange(len(q)), at] >= np.maximum(least, np.where(found[:, -1], best[:, -1], _LONG[0]))
            if not live.any():
                break
            for b in np.unique(at[live]).tolist():
                on = np.flatnonzero(live & (at == b))
                got = _long(q[on] @ terms[b].T)
                there = rows[b][None, :] != q_rows[on, None]  # every row but the query's own
                score = np.concatenate([best[on], got], axis=1)
                who = np.concatenate([best_id[on], np.broadcast_to(ids[b], got.shape)], axis=1)
                some = np.concatenate([found[on], there], axis=1)
                pick = np.lexsort((who, ~score, ~some), axis=1)[:, :k]
                best[on], best_id[on], found[on] = (np.take_along_axis(x, pick, 1) for x in (score, who, some))
        hit = found.ravel()
        out += zip(np.repeat(q_rows, k)[hit].tolist(), np.repeat(q_ids, k)[hit].tolist(), best_id.ravel()[hit].tolist(), best.ravel()[hit].tolist())
    return out


def blocks_of(terms: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of `size` vectors of a document range, numbered by n."""
    ranged = terms.repartitionByRange("vec_id", "row").sortWithinPartitions("vec_id", "row")
    return materialize(ranged.mapInArrow(lambda b: _pack_blocks(b, size), BLOCK).withColumn("n", F.monotonically_increasing_id()), name)


def _cells(chunks: DataFrame, blocks: DataFrame, run, schema: str) -> DataFrame:
    """chunks and blocks meet in their cells (r, c)."""
    both = chunks.withColumn("q", F.lit(True)).unionByName(blocks.withColumn("q", F.lit(False)), allowMissingColumns=True)

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.itertuples())
        found = run([x for x in rows if x.q], [x for x in rows if not x.q])
        return pd.DataFrame(found, columns=[x.split()[0] for x in schema.split(", ")])

    return both.groupBy("r", "c").applyInPandas(cell, schema)


def _thresholds(chunks: list, blocks: list, k: int) -> list[tuple[int, bytes]]:
    """(chunk n, for each of its queries the k-th score among the blocks, the least long where they are fewer)."""
    out = []
    for chunk in chunks:
        scores: dict[int, list[int]] = {}
        for row, _, _, score in search_cell([chunk], blocks, k):
            scores.setdefault(row, []).append(score)
        rows = np.frombuffer(chunk.rows, "<i8").tolist()
        kth = [min(scores[r]) if len(scores.get(r, ())) == k else _LONG[0] for r in rows]
        out.append((int(chunk.n), np.array(kth, "<i8").tobytes()))
    return out


def _wanted(chunks: list, blocks: list) -> list[tuple[int, int]]:
    """(cell row r, block n): the blocks whose bound reaches the threshold of some query of the cell's chunks."""
    out = set()
    for dim in {q.dim for q in chunks} & {b.dim for b in blocks}:
        mine, own = [q for q in chunks if q.dim == dim], [b for b in blocks if b.dim == dim]
        q, least = np.concatenate([_matrix(x) for x in mine]), np.concatenate([_least(x) for x in mine])
        top, low = (np.concatenate([_matrix(b, c) for b in own]) for c in ("top", "low"))
        kind = _kind(q, top, low)
        reach = (_long(_bounds(q.astype(kind), top.astype(kind), low.astype(kind))) >= least[:, None]).any(axis=0)
        out |= {(int(mine[0].r), int(own[i].n)) for i in np.flatnonzero(reach)}
    return sorted(out)


def prune(terms: DataFrame, is_query, k: int = K, block_size: int = BLOCK_SIZE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks of the queries (with cell row r), blocks, and (r, n): which block is to be sent to which cell row."""
    blocks = blocks_of(terms, block_size, "blocks")
    chunks = blocks_of(terms.where(is_query), CHUNK_QUERIES, "chunks")
    n_blocks, n_rows = blocks.count(), max(1, math.ceil(chunks.count() / CELL_CHUNKS))
    seeds = max(1, n_blocks // SEED_BLOCKS)
    group = F.pmod(F.xxhash64("n"), F.lit(seeds))
    home = chunks.withColumn("c", group).withColumn("r", F.col("n"))
    near = home.select("r", "c").join(blocks.withColumn("c", group), "c")  # about SEED_BLOCKS blocks to a chunk
    least = _cells(home, near.select("r", "c", *blocks.columns), lambda q, b: _thresholds(q, b, k), "n long, least binary")
    chunks = chunks.join(least, "n").withColumn("r", F.pmod(F.xxhash64("n"), F.lit(n_rows)))
    chunks = materialize(chunks, "chunks_with_thresholds")
    groups = max(1, math.ceil(n_blocks / GROUP_BOUNDS))
    every_group = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    every_row = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_rows - 1).cast("long")))
    bounds = blocks.select("n", "dim", "top", "low").withColumn("c", F.pmod(F.xxhash64("n"), F.lit(groups)).cast("int")).withColumn("r", every_row)
    wanted = _cells(chunks.select("r", "n", "rows", "terms", "dim", "least").withColumn("c", every_group), bounds, _wanted, "r long, n long")
    return chunks, blocks, materialize(wanted, "wanted")


def top_k(vectors: DataFrame, is_query, k: int = K, block_size: int = BLOCK_SIZE) -> DataFrame:
    """query_id, rank, vec_id, score: for each query row (is_query: a condition on vec_id) its k best other rows.

    A null vec_id or a vector that is null, empty or holds null or non-finite components takes no part. Rows that
    share a vec_id are rows of their own: each is a candidate of the others, and each query among them has its ranks.
    Only vectors of equal length are compared. Components and scores beyond a long are the nearest long. Fewer
    candidates than k give fewer rows, an empty table none. Other columns do not matter.
    """
    terms = materialize(quantized(vectors), "terms")
    chunks, blocks, wanted = prune(terms, is_query, k, block_size)
    groups = max(1, math.ceil(blocks.count() / GROUP_BLOCKS))
    group = F.pmod(F.xxhash64("n"), F.lit(groups)).cast("int")
    wanted = wanted.withColumn("c", group)
    left = chunks.join(wanted.select("r", "c").distinct(), "r")
    right = blocks.join(wanted, "n").select("r", "c", *blocks.columns)
    found = _cells(left, right, lambda q, b: search_cell(q, b, k), "query_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all other rows for each row whose vec_id is divisible by 50; edge cases as in top_k()."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLE_OP5 = """
WITH t AS (
  SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM t q JOIN t c ON q.vec_id % 50 = 0 AND q.n <> c.n AND len(q.e) = len(c.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
