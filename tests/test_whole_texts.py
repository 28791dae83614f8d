"""Words after the two-hundredth count where whole texts are read."""

from pyspark.sql import functions as F

from polyglyph.functions import html as H
from polyglyph.plans import page_plans as P

SF = "/root/testdata/sf0.001"


def test_words_of_reads_whole_texts(spark):
    df = spark.createDataFrame([("word " * 500 + "last",)], "text string")
    words = df.select(H.words_of(F.col("text")).alias("w"), F.size(H.visible_words(F.col("text"))).alias("page")).first()
    assert len(words.w) == 501 and words.w[-1] == "last" and words.page == 200


def test_whole_documents_score_more_than_their_start(spark):
    start = {(r.doc_id, r.language): r.n for r in P.doc_word_scores(spark, SF).collect()}
    whole = {(r.doc_id, r.language): r.n for r in P.doc_whole_word_scores(spark, SF).collect()}
    assert sum(whole.values()) > sum(start.values())
