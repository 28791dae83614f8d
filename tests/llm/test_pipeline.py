"""Every stage of the pipeline on its own input: edge cases and brute force."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from polyglyph.llm import mixing, packing, quality, toxicity
from polyglyph.llm.common import word_count

SF = "/root/testdata/sf0.001"
STAGES = dict(P.STAGES)
#: nulls in every column, empty and long texts, repeated rows, and columns named like those the operators make
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, component_id long, taken long, y int"
ROWS = [
    (1, None, None, None, 9, 0.5, 1, 1, 1, 1), (2, "", "en", "a", 9, 0.5, 1, 1, 1, 0), (3, "same words here", "en", "a", 9, None, 1, 1, 1, 1), (3, "same words here", "en", "a", 9, None, 1, 1, 1, 1),
    (None, "x " * 30000, "de", "b", None, None, None, None, None, None), (4, "one", None, None, 1, 1.0, 2, 2, 2, 2), (5, "SAME words here", "en", "b", 9, 0.0, 1, 1, 1, 1),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_order():
    assert [n for n, _ in P.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_edges(spark, edge, name):
    out = STAGES[name](spark, edge, SF)
    assert out.columns == edge.columns and [t for _, t in out.dtypes] == [t for _, t in edge.dtypes]
    known = Counter(map(str, ROWS))
    if name == "mixing":
        assert {r.doc_id for r in out.collect()} <= {r[0] for r in ROWS}
    else:
        assert not Counter(str(tuple(r)) for r in out.collect()) - known
    assert STAGES[name](spark, edge.limit(0), SF).count() == 0


def test_packing_edges(spark, edge):
    rows = P.pack_sequences(spark, edge, SF).collect()
    texts = Counter((r[0], r[1] or "") for r in ROWS)
    first = Counter(r.doc_id for r in rows if r.piece == 0)
    assert first == Counter(i for (i, _), n in texts.items() for _ in range(n))
    assert P.pack_sequences(spark, edge.limit(0), SF).count() == 0


def test_classifier_stages_keep_what_the_model_accepts(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    q, t = quality.fit(documents, labels).scorer(), toxicity.fit(documents, labels)
    texts = {r.doc_id: r.text for r in documents.collect()}
    good = {r.doc_id for r in P.keep_quality(spark, documents, SF).collect()}
    assert good == {i for i, x in texts.items() if q([x])[0] >= quality.ACCEPT}
    scored = {r.doc_id: r.s for r in toxicity.score_toxicity(documents, t, to="s").collect()}
    assert {r.doc_id for r in P.drop_toxic(spark, documents, SF).collect()} == {i for i, s in scored.items() if s < toxicity.TOXIC}


def test_mixing_takes_what_the_mix_says(spark, documents):
    sized = documents.select("doc_id", "source", word_count("text").alias("size"))
    want = {r.doc_id: r.taken for r in mixing.mix(sized).collect() if r.taken}
    got = P.mix_sources(spark, documents, SF).groupBy("doc_id").agg(F.sum(word_count("text")).alias("n")).collect()
    assert {r.doc_id: r.n for r in got if r.n} == want


def test_last_stage_holds_every_token(spark, documents):
    docs = documents.where("doc_id % 4 = 0")
    encode = packing.encoder().encode
    tokens = {r.doc_id: len(encode(r.text or "")) // 4 + 1 for r in docs.collect()}
    got = Counter()
    for r in P.pack_sequences(spark, docs, SF).collect():
        got[r.doc_id] += r.length
    assert got == tokens


def test_run(spark):
    rows = P.run(spark, SF).collect()
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert rows and all(sum(n for _, n in spans) <= packing.MAX_TOKENS for spans in at.values())
