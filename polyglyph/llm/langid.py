"""Language by rank-order profiles: a document's most frequent n-grams against each language's, by out-of-place distance."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import bounded_sample, fold, table

#: n-grams of 1 to 3 letters, word ends included; ranks kept of a language and of a document.
PROFILE, DOCUMENT_PROFILE = 400, 300
#: Bound of the fit: documents of each language.
PER_LANGUAGE = 2000
FOLDS, HELD_OUT = 3, 1
#: Most languages that are learned: their profiles are on the driver and in every task.
MOST_LANGUAGES = 5000
UNDETERMINED = "und"
#: Stands for a word's end in an n-gram; no letter's code, and not 0, which would make `a` of `(end, a)`.
WORD_END = 1

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """n-grams (21 bits a character) of the lower-cased text and how often each occurs; words are set off by a 0."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = np.where(_is_letter()[codes], codes, 0)
    codes = np.concatenate([[0], codes, [0]])
    codes = codes[(codes != 0) | (np.roll(codes, 1) != 0) | (np.arange(len(codes)) == 0)]
    if not codes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edged = np.where(codes == 0, WORD_END, codes)
    two = (edged[:-1] << 21) | edged[1:]
    three = (two[:-1] << 21) | edged[2:]
    three = three[codes[1:-1] != 0]  # a word end in the middle joins two words
    return np.unique(np.concatenate([codes[codes != 0], two, three]), return_counts=True)


def ranked(keys: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first; ties by n-gram."""
    return keys[np.lexsort((keys, -counts))[:most]]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, profile: int = PROFILE) -> dict[str, np.ndarray]:
    """Language -> its n-grams in order of rank, from the training fold's rows with a language.

    More than MOST_LANGUAGES of them raise: such a column holds no languages.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).where(fold("doc_id", FOLDS) != HELD_OUT)
    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    rows = bounded_sample(rows.select("doc_id", "lang", "text"), ["lang"], per_language)

    def count(batches):
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                k, n = grams(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n)], ["lang", "gram", "n"])

    counts = rows.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    got = counts.withColumn("rank", rank).where(F.col("rank") <= profile).collect()
    out: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.rank)):
        out.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(g, np.int64) for lang, g in out.items()}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred, score of every whole text.

    The language with the least mean out-of-place distance wins, ties by name; an n-gram that a profile lacks is as
    far out of place as the profile is long. score: 1 - that distance / the greatest possible, 0 for `und`. `und`
    where the text is null or has no letter, or no language was learned. Repeated rows are judged each for itself, an
    empty table has no rows, a null doc_id stays null; other columns do not matter.
    """
    held = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches):
        langs = sorted(held.value)
        places = []
        for lang in langs:
            g = held.value[lang]
            order = np.argsort(g)
            places.append((g[order], order.astype(np.int64), len(g)))
        for batch in batches:
            pred, score = [], []
            for text in batch.column(1):
                k, n = grams(text.as_py())
                if not len(k) or not langs:
                    pred.append(UNDETERMINED)
                    score.append(0.0)
                    continue
                own = ranked(k, n, DOCUMENT_PROFILE)
                at = np.arange(len(own))
                far = []
                for g, place, most in places:
                    i = np.minimum(np.searchsorted(g, own), most - 1)
                    far.append(np.where(g[i] == own, np.minimum(np.abs(place[i] - at), most), most).mean() / most)
                best = int(np.argmin(far))
                pred.append(langs[best])
                score.append(float(1 - far[best]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; nulls, repeated rows and an empty table as in identify()."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs))
    return found.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
