"""Searches of many queries by postings, against the search of one and plain recomputations."""

import random

from pyspark.sql import functions as F

from polyglyph.operators import boundaries as B
from polyglyph.operators import search as S


def test_many_queries_equal_one_by_one(spark):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abc") for _ in range(draw.randint(1, 9)))
    rows = [(i % 55, word(), draw.choice(["", word()[:4]]), draw.choice(["country", "subdivision_1", "subdivision_2", None]), "6") for i in range(60)]
    index = spark.createDataFrame([(i, k.title(), k, c, kind, level) for i, k, c, kind, level in rows], "osm_id long, name string, key string, iso_key string, kind string, admin_level string")
    for c in ("iso", "parent_name", "parent_iso"):
        index = index.withColumn(c, F.lit(""))
    index = index.withColumn("parent_osm_id", F.lit(None).cast("long"))
    remote = index.withColumn("osm_id", F.col("osm_id") + F.when(F.col("osm_id") % 2 == 0, 0).otherwise(1000)).limit(12)
    queries = sorted({word() for _ in range(40)} | {"a", "ab", "zz", "abcabcabc"})
    asked = spark.createDataFrame([(q,) for q in queries + queries[:3] + ["", None]], "query string")
    every = remote.withColumn("query", F.explode(F.array(*map(F.lit, queries))))
    got = {}
    for r in S.search_all(index, asked, every, most=6).orderBy("query", "place").collect():
        got.setdefault(r.query, []).append((r.osm_id, r.name, r.kind))
    for q in queries:
        one = [(r.osm_id, r.name, r.kind) for r in B.search_areas(index, remote, q, most=6).collect()]
        assert got.get(q, []) == one, q
    assert set(got) <= set(queries) and S.search_all(index, asked.limit(0)).count() == 0


def test_the_rarest_gram_is_joined(spark):
    index = spark.createDataFrame([(i, "common" + ("rare" if i == 7 else "xyz"), "") for i in range(50)], "osm_id long, key string, iso_key string")
    queries = spark.createDataFrame([("commonrare",), ("nowhere",), ("co",)], "query string")
    found = {}
    for r in S.candidates(queries, S.postings(index)).collect():
        found.setdefault(r.query, []).append(r.osm_id)
    assert found["commonrare"] == [7] and "nowhere" not in found and len(found["co"]) == 50


def test_parts_are_all_that_queries_find(spark):
    draw = random.Random(3)
    keys = ["".join(draw.choice("ab") for _ in range(draw.randint(0, 12))) for _ in range(60)]
    df = spark.createDataFrame([(k, k[:4]) for k in keys], "key string, iso_key string")
    sizes = [1, 3, 4, 5, 7]
    said = {(r.key, r.query): r.rank for r in df.select("key", F.inline(S.parts(F.col("key"), sizes, True))).collect()}
    queries = {k[i : i + n] for k in keys for n in sizes for i in range(len(k) - n + 1)}
    pairs = spark.createDataFrame([(k, q) for k in set(keys) for q in queries], "key string, query string")
    ranks = {(r.key, r.query): r.rank for r in pairs.withColumn("rank", S.query_rank(F.col("key"), F.lit(""), F.col("query"))).where("rank < 4").collect()}
    assert said == ranks
    codes = [r.query for r in df.limit(1).select(F.inline(S.parts(F.lit("p12345"), sizes, False))).collect()]
    assert codes == ["p", "p12", "p123", "p1234"] and df.select(F.inline(S.parts(F.col("key"), [], True))).count() == 0


def test_searches_do_not_broadcast(spark):
    from polyglyph.plans import boundary_plans

    plan = boundary_plans.part_search(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
