"""Bounded samples where ids repeat or are missing."""

from pyspark.sql import functions as F

from polyglyph.llm import langid
from polyglyph.llm.common import bounded_sample
from polyglyph.llm.labelled import training_rows


def test_rows_without_ids_are_drawn_each_for_itself(spark):
    k = F.col("id")
    rows = spark.range(30_000).select(F.when(k % 3 == 0, None).when(k % 3 == 1, 7).otherwise(k).alias("doc_id"), F.when(k % 2 == 0, "a").otherwise("b").alias("lang"), F.concat(F.lit("text "), k).alias("text"))
    rows = rows.union(rows.limit(4000))  # repeats are one row
    got = bounded_sample(rows, ["lang"], 3000)
    for r in got.groupBy("lang").agg(F.count("*").alias("n"), F.count_distinct("text").alias("d"), F.avg(F.isnull("doc_id").cast("int")).alias("none")).collect():
        assert 2700 < r.n < 3300 and r.n == r.d and 0.28 < r.none < 0.39
    again = bounded_sample(rows.repartition(7), ["lang"], 3000)
    assert again.exceptAll(got).count() == 0 and bounded_sample(rows.limit(0), ["lang"], 5).count() == 0
    assert bounded_sample(rows, ["lang"], 10**6).count() == 30_000


def test_a_language_of_rows_without_ids_is_learned(spark):
    k = F.col("id")
    docs = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.when(k % 2 == 0, "xx").otherwise("yy").alias("lang"), F.concat(F.when(k % 2 == 0, "abab baba ").otherwise("wxyz zyxw "), k).alias("text"))
    assert set(langid.fit(docs, per_language=50)) == {"xx", "yy"}


def test_a_labelled_id_on_many_documents_counts_once(spark):
    docs = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = docs.select("doc_id").distinct().select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    rows = training_rows(docs, labels, "toxic", 100)
    assert rows.count() == rows.select("doc_id").distinct().count() <= 280
    everything = training_rows(docs, labels, "toxic", 10**6)
    assert everything.where("doc_id = 1").count() == 1
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, training_rows(docs.repartition(9), labels, "toxic", 10**6).collect()))
