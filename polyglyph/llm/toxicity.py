"""Toxicity by a factorization machine over hashed terms.

A document's terms are its words and its words' first letters, hashed to buckets; each term present has weight 1. The
machine adds a weight for each term and, for each pair, the product of the terms' factors, so that two words can mean
what neither means alone. A first machine is trained on the buckets that tell the classes apart alone, by chi-squared. A bucket
joins them if it explains, beside an anchor, what that machine leaves unexplained; anchors are the buckets kept so far
and the most frequent ones. So a group mention that is neutral alone is kept if it tells something beside an insult,
and so are two terms that are neutral alone and tell something only together.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, materialize, table
from .labelled import FOLDS, HELD_OUT, training_rows

BUCKETS = 1 << 20
#: Lengths of the stems that are terms beside the word itself.
STEMS = (3, 4, 5)
#: Bound of the fit: labelled documents of each class.
PER_CLASS = 5000
#: Least chi-squared of a bucket alone, and of a pair by what the first machine leaves, of which many more are tried.
CHI2, PAIR_CHI2 = 25.0, 45.0
#: Rows' worth of residual that a pair is to explain, so that a few odd rows make no pair.
PAIR_ROWS = 5.0
#: A row that the first machine misses by less is explained.
MISFIT = 0.1
#: The most frequent buckets that are anchors beside the kept ones.
ANCHORS = 128
FACTORS, EPOCHS, RATE, RIDGE = 6, 25, 0.3, 1e-5
TOXIC = 0.5
_WORDS = re.compile(r"\w+")
#: Entries of a worker's cache from words to buckets; it is emptied when full.
CACHE_WORDS = 200_000


class Terms:
    """Buckets of a text's terms."""

    def __init__(self, only: dict[int, int] | None = None):
        self.only, self.known = only, {}

    def _of(self, word: str) -> tuple[int, ...]:
        ids = {zlib.crc32(word.encode()) % BUCKETS}
        ids |= {zlib.crc32((word[:n] + "*").encode()) % BUCKETS for n in STEMS if len(word) >= n}
        return tuple(ids) if self.only is None else tuple(self.only[i] for i in ids if i in self.only)

    def __call__(self, text: str | None) -> list[int]:
        known, out = self.known, set()
        for word in set(_WORDS.findall((text or "").lower())):
            ids = known.get(word)
            if ids is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                ids = known[word] = self._of(word)
            if ids:
                out.update(ids)
        return sorted(out)


@dataclass(frozen=True)
class ToxicityModel:
    place: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scorer(self):
        terms = Terms(self.place)
        return lambda texts: predict([terms(t) for t in texts], self.bias, self.weights, self.factors)


def predict(rows: list[list[int]], bias: float, weights: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The machine's probability of class 1 for rows of its terms."""

    def one(x):
        v = factors[x]
        return bias + weights[x].sum() + 0.5 * ((v.sum(axis=0) ** 2).sum() - (v**2).sum())

    return 1 / (1 + np.exp(-np.clip([one(np.array(x, dtype=np.int64)) for x in rows] or np.zeros(0), -30, 30)))


def train_machine(rows: list[list[int]], y: np.ndarray, weight: np.ndarray, n: int, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = RATE, ridge: float = RIDGE, seed: int = 7):
    """Adagrad on the weighted logistic loss of a factorization machine, in small batches."""
    rng = np.random.default_rng(seed)
    bias, w, v = 0.0, np.zeros(n), rng.normal(0, 0.05, (n, factors))
    gb, gw, gv = 1e-8, np.full(n, 1e-8), np.full((n, factors), 1e-8)
    sizes = np.array([len(r) for r in rows])
    flat, first = np.array([t for r in rows for t in r], dtype=np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    summed = lambda at, x, m: np.stack([np.bincount(at, x[:, f], m) for f in range(factors)], axis=1)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 256)):
            n_terms, m = sizes[batch], len(batch)
            doc = np.repeat(np.arange(m), n_terms)
            term = flat[np.repeat(first[batch] - np.cumsum(n_terms) + n_terms, n_terms) + np.arange(n_terms.sum())]
            vt = v[term]
            s = summed(doc, vt, m)
            z = bias + np.bincount(doc, w[term], m) + 0.5 * ((s**2).sum(axis=1) - np.bincount(doc, (vt**2).sum(axis=1), m))
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[batch]) * weight[batch] / weight[batch].sum()
            db = g.sum()
            gb += db * db
            bias -= rate * db / np.sqrt(gb)
            used, at = np.unique(term, return_inverse=True)
            dw = np.bincount(at, g[doc], len(used)) + ridge * w[used]
            dv = summed(at, g[doc, None] * (s[doc] - vt), len(used)) + ridge * v[used]
            gw[used] += dw**2
            gv[used] += dv**2
            w[used] -= rate * dw / np.sqrt(gw[used])
            v[used] -= rate * dv / np.sqrt(gv[used])
    return bias, w, v


class Rows:
    """Rows of buckets: `flat` holds them one row after the other, `sizes` their numbers; `terms` are the distinct ones."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.sizes, self.first = sizes, np.concatenate([[0], np.cumsum(sizes)])
        self.terms, at = np.unique(flat, return_inverse=True)
        self.at = at.astype(np.int32)
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.n = np.bincount(self.at, minlength=len(self.terms))

    def sums(self, value: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
        """For each term the sum of `value` over the rows (all, or those given) that hold it."""
        if rows is None:
            return np.bincount(self.at, value[self.row], len(self.terms))
        n = self.sizes[rows]
        places = np.arange(n.sum()) + np.repeat(self.first[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return np.bincount(self.at[places], np.repeat(value[rows], n), len(self.terms))

    def only(self, kept: np.ndarray) -> list[list[int]]:
        """Each row's kept terms, as numbers among the kept ones."""
        number = np.where(kept, np.cumsum(kept) - 1, -1)[self.at]
        hit = number >= 0
        ends = np.cumsum(np.bincount(self.row[hit], minlength=len(self.sizes)))[:-1]
        return [x.tolist() for x in np.split(number[hit], ends)]


def alone(rows: Rows, y: np.ndarray, chi2: float = CHI2) -> np.ndarray:
    """Which terms tell the classes apart by themselves."""
    n, ones, m, a = len(y), y.sum(), rows.n.astype(float), rows.sums(y)
    bottom = ones * (n - ones) * m * (n - m)
    return (bottom > 0) & (n * (a * (n - ones) - (m - a) * ones) ** 2 >= chi2 * np.maximum(bottom, 1.0))


def in_pairs(rows: Rows, y: np.ndarray, p: np.ndarray, kept: np.ndarray, pair_chi2: float = PAIR_CHI2, anchors: int = ANCHORS) -> np.ndarray:
    """kept and the terms of pairs that explain y - p: by the score test of the pair, (sum of y - p)^2 / sum of p (1 - p)."""
    out, left, spread = kept.copy(), np.where(np.abs(y - p) >= MISFIT, y - p, 0.0), p * (1 - p)
    frequent = np.argsort(-rows.n, kind="stable")[:anchors]
    tried = np.unique(np.concatenate([np.flatnonzero(kept), frequent]))
    tried = tried[rows.sums(np.abs(left))[tried] >= PAIR_ROWS]
    by_term, begins = np.argsort(rows.at, kind="stable").astype(np.int32), np.concatenate([[0], np.cumsum(rows.n)])
    for t in tried.tolist():
        own = rows.row[by_term[begins[t] : begins[t + 1]]]
        u, v = rows.sums(left, own), rows.sums(spread, own)
        found = (np.abs(u) >= PAIR_ROWS) & (u * u >= pair_chi2 * np.maximum(v, 1e-9)) & ~out
        if found.any():
            out |= found
            out[t] = True
    return out


def learn(rows: Rows, y: np.ndarray, pairs: bool = True) -> ToxicityModel:
    """The machine of the rows; without `pairs`, of the terms that tell something alone."""

    def machine(kept):
        # many documents hold the same kept terms: those alike are one row with a weight, in an order of their own
        alike = sorted(Counter((tuple(x), k) for x, k in zip(rows.only(kept), y.tolist())).items())
        weight = np.array([float(n) for _, n in alike])
        return train_machine([list(x) for (x, _), _ in alike], np.array([k for (_, k), _ in alike]), weight, int(kept.sum()))

    kept = alone(rows, y)
    found = machine(kept)
    if pairs:
        more = in_pairs(rows, y, predict(rows.only(kept), *found), kept)
        if (more & ~kept).any():
            kept = more
            found = machine(kept)
    return ToxicityModel({int(t): i for i, t in enumerate(rows.terms[kept])}, *found)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> ToxicityModel:
    """Learns from about per_class labelled documents of each class at most; the driver gets their buckets only.

    Without labels of both classes the scores are all 0.
    """

    def buckets(batches):
        terms = Terms()
        for batch in batches:
            xs = [terms(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(xs, pa.list_(pa.int32()))], ["y", "x"])

    rows = materialize(training_rows(docs, labels, "toxic", per_class).select("text", "y").mapInArrow(buckets, "y int, x array<int>"), "toxic_terms")
    got = rows.toArrow().combine_chunks()
    y = got.column("y").to_numpy().astype(float)
    if len(set(y)) < 2:
        return ToxicityModel({}, -30.0, np.zeros(0), np.zeros((0, FACTORS)))
    lists = pa.concat_arrays(got.column("x").chunks)
    return learn(Rows(lists.flatten().to_numpy(), lists.value_lengths().to_numpy()), y)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", to: str = "score") -> DataFrame:
    """docs with a score `to` from 0 to 1 of each whole text; a column of that name is replaced, others pass.

    A null text is scored as the empty one, which the bias alone decides; repeated rows are scored each for itself; an
    empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.drop(to).schema.add(to, "double")

    def run(batches):
        score = held.value.scorer()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            yield from table.append_column(to, pa.array(score(table.column(text).to_pylist()), pa.float64())).to_batches()

    return docs.drop(to).mapInArrow(run, schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; nulls, repeated rows and an empty table as in score_toxicity()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs, model).drop("text")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= TOXIC, 1).otherwise(0).alias("predicted"))
