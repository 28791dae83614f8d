"""Quality by compression: text that is well compressed with a dictionary of good text is like good text.

Two zstandard dictionaries are built from the segments of good and of bad labelled documents, whole texts and not their
starts. A document is compressed with both, segment by segment so that a long one does not become its own dictionary,
and the difference of the compressed sizes, divided by its length, is calibrated by logistic regression. Every term of
the calibration holds that difference: a text's length alone says nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold, materialize, table
from .labelled import FOLDS, HELD_OUT, training_rows

#: Bounds of the fit: labelled documents of each class, segments of each class that its dictionary is built from, bytes
#: of a dictionary.
PER_CLASS, PER_CLASS_SEGMENTS, DICTIONARY = 4000, 8000, 1_000_000
#: Characters of a segment of the dictionaries, bytes of one that is compressed.
SEGMENT, LEVEL = 2048, 3
#: zstandard's cover: bytes of a dictionary's passages and of the strings that are counted.
COVER = {"k": 200, "d": 8}
#: Bytes added to the length that the difference is divided by, so that a few words say little.
SMOOTHING = 64
ACCEPT = 0.3


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]

    def scorer(self):
        sizes = [_compressor(x) for x in (self.good, self.bad)]
        w = np.array(self.weights)
        return lambda texts: 1 / (1 + np.exp(-np.clip(_features(*_differences(sizes, texts)) @ w, -30, 30)))


def _dictionary(segments: list[bytes], size: int) -> bytes:
    """A dictionary of the segments; where they are too few to choose from, the segments themselves."""
    try:
        return zstandard.train_dictionary(size, segments, level=LEVEL, **COVER).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(segments)[-size:]


def _compressor(dictionary: bytes):
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=held, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def _differences(sizes, texts):
    d, n = np.zeros(len(texts)), np.zeros(len(texts))
    good, bad = (x.compress for x in sizes)
    for i, t in enumerate(texts):
        b = (t or "").encode()
        n[i] = len(b)
        d[i] = sum(len(bad(p)) - len(good(p)) for p in (b[s : s + SEGMENT] for s in range(0, len(b), SEGMENT)))
    return d, n


def _features(d: np.ndarray, n: np.ndarray) -> np.ndarray:
    """1, the normalised difference, and the difference again, weighed by how much text it was found in."""
    x = 20 * d / (n + SMOOTHING)
    return np.stack([np.ones_like(x), x, x * np.log2(1 + n) / 4], axis=1)


def _logistic(a: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, segments: int = PER_CLASS_SEGMENTS, dictionary: int = DICTIONARY) -> QualityModel:
    """Learns from at most about per_class labelled documents of each class.

    Three quarters of them make the dictionaries, from at most about `segments` of their segments of each class, drawn
    by hash from all; one quarter calibrates. The driver gets those segments and the calibrating documents' differences.
    Without labels of both classes the model scores 0.5 throughout.
    """
    use = F.pmod(F.xxhash64("doc_id", F.lit("use")), F.lit(4)) > 0
    rows = materialize(training_rows(docs, labels, "quality", per_class).withColumn("use", use), "quality_rows")
    begins = F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(SEGMENT))
    cut = rows.where("use").select("doc_id", "y", "text", F.explode(begins).alias("at")).select("y", F.substring("text", F.col("at"), F.lit(SEGMENT)).alias("part"), F.xxhash64("doc_id", "at").alias("segment"))
    got = sorted(bounded_sample(cut, ["y"], segments).collect(), key=lambda r: (r.segment, r.part))
    parts = [_dictionary([r.part.encode() for r in got if r.y == y], dictionary) if any(r.y == y for r in got) else b"" for y in (1, 0)]
    if not all(parts):
        return QualityModel(*parts, (0.0,) * 3)
    held = rows.sparkSession.sparkContext.broadcast(parts)

    def compare(batches):
        sizes = [_compressor(p) for p in held.value]
        for batch in batches:
            d, n = _differences(sizes, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d), pa.array(n)], ["y", "d", "n"])

    told = sorted(rows.where(~F.col("use")).select("y", "text").mapInArrow(compare, "y int, d double, n double").collect())
    y, d, n = (np.array([float(r[k]) for r in told]) for k in range(3))
    if len(set(y)) < 2:
        return QualityModel(*parts, (0.0,) * 3)
    w = _logistic(_features(d, n), y)
    # the sample holds the classes in other shares than the labels do: the intercept makes up for it
    learned = labels.where(F.col("quality").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    of_good, of_bad = learned.agg(F.count_if(F.col("quality") == 1), F.count_if(F.col("quality") == 0)).first()
    w[0] += np.log(max(of_good, 1) / y.sum()) - np.log(max(of_bad, 1) / (len(y) - y.sum()))
    return QualityModel(*parts, tuple(w))


def score_quality(docs: DataFrame, model: QualityModel, text: str = "text", to: str = "score") -> DataFrame:
    """docs with a score `to` from 0 to 1 of each whole text; a column of that name is replaced, others pass.

    A null text is scored as the empty one, which the intercept alone decides; repeated rows are scored each for
    itself; an empty table stays empty.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.drop(to).schema.add(to, "double")

    def run(batches):
        score = held.value.scorer()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            values = score(table.column(text).to_pylist())
            yield from table.append_column(to, pa.array(values, pa.float64())).to_batches()

    return docs.drop(to).mapInArrow(run, schema)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document; nulls, repeated rows and an empty table as in score_quality()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_quality(docs, model).drop("text")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= ACCEPT, 1).otherwise(0).alias("predicted"))
