"""Searches for areas by name, a whole table of queries at once: the parts of keys that a query may equal, joined by the query itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .boundaries import MOST_HITS, hits

#: Letters of a gram; shorter queries find beginnings only.
GRAM = 3


def grams(key: Column) -> Column:
    """All triples of letters of a key, each once."""
    n = F.length(key) - (GRAM - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(key, i, F.lit(GRAM))))).otherwise(F.array().cast("array<string>"))


def beginnings(key: Column) -> Column:
    """The first letter and the first two of a key, marked."""
    return F.transform(F.sequence(F.lit(1), F.lit(GRAM - 1)), lambda n: F.concat(F.lit("^"), F.substring(key, F.lit(1), n)))


def postings(index: DataFrame, of: str = "osm_id") -> DataFrame:
    """(gram, of): what a query may ask for of the rows of an index (of, key, iso_key): triples and beginnings of both keys."""
    keys = F.array_compact(F.array("key", "iso_key"))
    every = F.flatten(F.transform(F.filter(keys, lambda k: k != ""), lambda k: F.array_union(grams(k), beginnings(k))))
    return index.select(of, F.explode(F.array_distinct(every)).alias("gram"))


def asked(queries: DataFrame) -> DataFrame:
    """(query, gram): the grams of which every hit of a query (a folded key) has all. Null and empty queries have none."""
    q = F.col("query")
    every = F.when(F.length(q) < GRAM, F.array(F.concat(F.lit("^"), q))).otherwise(grams(q))
    return queries.where("query <> ''").select("query").distinct().select("query", F.explode(every).alias("gram"))


def candidates(queries: DataFrame, posted: DataFrame, of: str = "osm_id") -> DataFrame:
    """(query, of): the rows with the rarest gram of each query, and so all its hits. A query with a gram that is nowhere has none."""
    often = posted.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked(queries).join(often, "gram", "left").groupBy("query").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    return rarest.join(posted, "gram").select("query", of)


def query_rank(key: Column, iso_key: Column, query: Column) -> Column:
    """boundaries.search_rank() for a column of queries: 0 equal, 1 prefix, 2 suffix of 4 letters at least, 3 part of 5 at least, else 4."""
    long = F.length(query)
    return (
        F.when((key == query) | (iso_key == query), 0).when(F.startswith(key, query) | F.startswith(iso_key, query), 1)
        .when((long >= 4) & F.endswith(key, query), 2).when((long >= 5) & F.contains(key, query), 3).otherwise(4)
    )


def parts(key: Column, lengths: list[int], inside: bool) -> Column:
    """[(query, rank)]: all that a query of one of the lengths may be of a key, each once with its best rank (see query_rank()).

    inside: ends of four letters and parts of five count too, as in `key`; in a code only its beginning does.
    """
    n = F.length(key)
    one = lambda q, rank: F.struct(q.alias("query"), F.lit(rank).cast("int").alias("rank"))
    none = F.array().cast("array<struct<query: string, rank: int>>")

    def of(size: Column) -> Column:
        start, end = F.substring(key, F.lit(1), size), F.substring(key, n - size + 1, size)
        found = F.array(F.struct(start.alias("query"), F.when(n == size, 0).otherwise(1).alias("rank")))
        if inside:
            within = F.array_except(F.transform(F.sequence(F.lit(2), F.greatest(n - size, F.lit(2))), lambda i: F.substring(key, i, size)), F.array(start, end))
            ends = F.when((size >= 4) & (n > size) & (end != start), F.array(one(end, 2))).otherwise(none)
            found = F.concat(found, ends, F.when((size >= 5) & (n > size + 1), F.transform(within, lambda q: one(q, 3))).otherwise(none))
        return F.when(n >= size, found).otherwise(none)

    return F.flatten(F.transform(F.array(*map(F.lit, lengths)).cast("array<int>"), of))


def search_all(index: DataFrame, queries: DataFrame, remote: DataFrame | None = None, most: int = MOST_HITS) -> DataFrame:
    """The best areas for each query (a folded key), with `query` and `place` from 1: as boundaries.search_areas() for one.

    remote: what another search answered, rows of the index's columns with `query`; they count where the index's best hit
    is neither equal nor a prefix, for queries of three letters and more. Rows of the index that share an id are rows of
    their own until the best of an id is shown.
    """
    numbered = index.withColumn("_row", F.monotonically_increasing_id())
    iso = F.coalesce("iso_key", F.lit(""))
    kinds = F.when(F.col("kind") == "country", 0).when(F.col("kind") == "subdivision_1", 1).when(F.col("kind") == "subdivision_2", 2).otherwise(9)
    ranked = lambda df: df.withColumn("rank", query_rank(F.col("key"), iso, F.col("query"))).withColumn("kind_rank", kinds)
    order = [F.col("rank"), F.col("kind_rank"), F.length("key"), F.col("name"), F.col("osm_id")]
    first = lambda df, n, by=("query",), order=order: df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    asked_ = queries.where("query <> ''").select("query").distinct()
    lengths = sorted(r[0] for r in asked_.select(F.length("query")).distinct().collect())  # as many numbers as lengths
    keyed = numbered.select("_row", "osm_id", "key", "iso_key", "name", "kind")
    # of rows with one key a query finds the same first ones, so no more than `most` of them say what is in the key
    alike = first(keyed.where("key <> ''").withColumn("kind_rank", kinds), most, ("key",), ["kind_rank", "name", "osm_id"])
    said = alike.select("*", F.inline(parts(F.col("key"), lengths, True))).drop("iso_key")
    coded = keyed.where("iso_key <> ''").withColumn("kind_rank", kinds).select("*", F.inline(parts(F.col("iso_key"), lengths, False))).drop("iso_key")
    found = said.unionByName(coded).join(asked_.hint("merge"), "query")
    # a row that both its key and its code offer counts once, by the better; of twice `most` offers as many rows are left at least
    once = first(first(found, 2 * most), 1, ("query", "_row"), [F.col("rank")])
    own = first(once, most).select("query", "_row", "rank", "kind_rank")
    own = own.join(numbered.hint("merge"), "_row").drop("_row").withColumn("origin", F.lit(0))
    if remote is not None:
        other = first(ranked(remote.where(F.length("query") >= 3).join(asked_.hint("merge"), "query", "left_semi")), most).withColumn("origin", F.lit(1))
        own = own.unionByName(other, allowMissingColumns=True)  # twice `most` rows of a query at most
    best = F.min(F.when(F.col("origin") == 0, F.col("rank"))).over(W.partitionBy("query"))
    one = F.row_number().over(W.partitionBy("query", "osm_id").orderBy("origin", *order))
    shown = own.withColumn("_best", best).withColumn("_one", one).where("_one = 1 and (origin = 0 or coalesce(_best > 1, true))")
    placed = shown.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(*order))).where(F.col("place") <= most)
    return hits(placed, "query", "place")
