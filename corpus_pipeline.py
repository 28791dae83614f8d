"""The corpus pipeline: quality, toxicity, near-duplicates, mixing, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyglyph.llm import mixing, packing, quality, simhash, toxicity
from polyglyph.llm.common import materialize, table

SCORE = "__polyglyph_score"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts. The model is fitted on the labelled documents of the input."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, to=SCORE).where(F.col(SCORE) >= quality.ACCEPT).drop(SCORE)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine does not call toxic, fitted on the labelled ones still there."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, to=SCORE).where(F.col(SCORE) < toxicity.TOXIC).drop(SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id: op3's BK-trees at five words and similarity 0.8.

    Nulls, empty texts, repeated rows, an empty table and other columns as in simhash.drop_copies().
    """
    return simhash.drop_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the one at a source's cut up to the last word taken.

    Null sources are one source; a null text has no words, and a document without words is not in the mix; rows alike
    share evenly what is taken of them; an empty table stays empty; other columns pass.
    """
    return mixing.mixed_texts(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document: where it lies in which sequence."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages score with trained models, hash shingles and tokenize: SQL cannot express them; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
