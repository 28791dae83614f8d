"""Mixing sources to target weights by weighted fair queueing. DataFrame operations only.

Each source is a queue of its documents in a shuffled order, and starts over when it has been served, `max_repeat`
times at most. Every copy of a document is queued with its virtual finish time: its source's words up to its end,
divided by the source's target; a long document is queued in segments of SEGMENT words, so that none holds its queue
up. All queues are merged by virtual finish time and cut where the running total reaches the budget.

Nothing gathers a source or the merged queue in one task. Running sums within a source: its shuffled documents are
dealt to about sqrt(n) ranges of the shuffle key, the ranges' sums are accumulated, then the documents within each.
The merged order: the queue is dealt to ranges of virtual finish time, the ranges' sums are accumulated, and the range
that the budget falls into is dealt again until it is small enough to be sorted. Texts are never shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, few, materialize, table, word_count

#: Words of a segment, the unit of the queues.
SEGMENT = 256
#: Ranges that the merged queue is dealt to at a time, and the rows from which on a range is sorted.
RANGES, SORTED_ROWS = 1024, 20_000


def source_targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """One row per source: source, rank, n_docs, source_size, weight, target.

    Sources by code point, null last, take the weights in turn. Targets share `share` of all words by weight; none
    exceeds max_repeat times its source's size, and what exceeds it is shared again by weight (water-filling: the
    sources that fill up are a prefix of the order by size / weight). A source without words gets 0.
    """
    per = sized.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", F.get(turn, (F.col("rank") - 1) % len(weights)).cast("double"))
    per = per.withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    fill, whole = W.orderBy(F.col("cap") / F.col("weight"), "rank"), W.partitionBy()
    per = (
        per.withColumn("budget", F.sum("source_size").over(whole).cast("double") * share)
        .withColumn("place", F.row_number().over(fill))
        .withColumn("full", F.coalesce(F.sum("cap").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("open", F.col("cap") * F.col("rest") >= (F.col("budget") - F.col("full")) * F.col("weight"))
        .withColumn("first_open", F.min(F.when(F.col("open"), F.col("place"))).over(whole))
    )
    at = F.col("place") == F.col("first_open")
    per = per.withColumn("to_share", F.max(F.when(at, F.col("budget") - F.col("full"))).over(whole)).withColumn("weights_left", F.max(F.when(at, F.col("rest"))).over(whole))
    target = F.when(F.col("first_open").isNull() | (F.col("place") < F.col("first_open")), F.col("cap")).otherwise(F.col("to_share") * F.col("weight") / F.col("weights_left"))
    return per.select("source", "rank", "n_docs", "source_size", "weight", target.alias("target"))


def _key(doc_id: Column) -> Column:
    """The shuffle order: that of md5(doc_id), a null id as the empty text."""
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def queues(sized: DataFrame, weights=(5, 2, 1), share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """sized (doc_id, source, size, tie) -> one row per group of rows alike: the queues, in order of `start`.

    Columns: doc_id, source, tie, size, alike (rows in the group), start (words of its source before it), source_size,
    target, rank (of the source), served (words that the mix takes from its source, repeats counted). Rows alike are
    served as one, evenly; a document without words is in its queue and gets nothing.
    """
    targets = materialize(source_targets(sized, weights, share, max_repeat), "targets")
    t = targets.select(F.col("source").alias("_source"), F.col("n_docs").alias("_n"), "source_size", "target", "rank")
    rows = sized.groupBy("source", "doc_id", "tie").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("alike")).withColumn("key", _key(F.col("doc_id")))
    spot = F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 4294967296.0
    dealt = rows.join(few(t), F.col("source").eqNullSafe(F.col("_source"))).withColumn("range", F.floor(spot * F.ceil(F.sqrt("_n"))).cast("long"))
    words = F.col("size") * F.col("alike")
    sums = dealt.groupBy("rank", "range").agg(F.sum(words).alias("words"))
    before = W.partitionBy("rank").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = materialize(sums.select("rank", "range", F.coalesce(F.sum("words").over(before), F.lit(0)).cast("long").alias("_before")), "range_starts")
    within = W.partitionBy("rank", "range").orderBy("key", "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    own = F.coalesce(F.sum(words).over(within), F.lit(0)).cast("long")
    queue = dealt.withColumn("own", own).join(starts, ["rank", "range"]).withColumn("start", F.col("_before") + F.col("own"))
    queue = materialize(queue.select("doc_id", "source", "tie", "key", "size", "alike", "start", "source_size", "target", "rank"), "queues")
    budget = int((targets.agg(F.sum("source_size")).first()[0] or 0) * share)
    served = _serve(_segments(queue, max_repeat), budget)
    return queue.join(few(materialize(served, "served")), "rank")


def _segments(queue: DataFrame, max_repeat: int) -> DataFrame:
    """(rank, finish, words): every segment of every copy; finish is its virtual finish time."""
    words = F.col("size") * F.col("alike")
    copies = queue.where("size > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeat - 1))))
    cut = copies.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), words - 1, F.lit(SEGMENT).cast("long"))))
    end = F.least(F.col("at") + SEGMENT, words)
    finish = (F.col("copy") * F.col("source_size") + F.col("start") + end) / F.col("target")
    return cut.select("rank", finish.alias("finish"), (end - F.col("at")).alias("words"))


def _serve(segments: DataFrame, budget: int) -> DataFrame:
    """(rank, served): the words taken from each source when the merged queue is cut at the budget.

    The merged order is that of (finish, rank), in which no two segments are equal.
    """
    left, before = segments, 0
    while True:
        low, high, n, total = left.agg(F.min("finish"), F.max("finish"), F.count(F.lit(1)), F.sum("words")).first()
        if not n or before + total <= budget:  # all is taken
            return segments.groupBy("rank").agg(F.sum("words").cast("long").alias("served"))
        if n <= SORTED_ROWS or low == high:
            break
        place = F.floor((F.col("finish") - low) / (high - low) * RANGES).cast("long")
        ranges = sorted(left.groupBy(place.alias("place")).agg(F.sum("words").alias("words")).collect())  # RANGES + 1 rows at most
        sums = list(accumulate(r.words for r in ranges))
        at = bisect_left(sums, budget - before)
        before += sums[at] - ranges[at].words
        left = left.where(place == ranges[at].place)
    # few rows are left: one range of the merged queue
    order = W.orderBy("finish", "rank")
    sums = left.withColumn("sum", before + F.sum("words").over(order.rowsBetween(W.unboundedPreceding, 0)))
    finish, rank, excess = sums.where(F.col("sum") >= budget).orderBy("finish", "rank").select("finish", "rank", F.col("sum") - budget).first()
    taken = segments.where((F.col("finish") < finish) | ((F.col("finish") == finish) & (F.col("rank") <= rank)))
    return taken.groupBy("rank").agg(F.sum("words").cast("long").alias("all")).select("rank", (F.col("all") - F.when(F.col("rank") == rank, excess).otherwise(0)).cast("long").alias("served"))


def mix(sized: DataFrame, weights=(5, 2, 1), share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """sized (doc_id, source, size) -> one row for each of its rows: these columns, source_size, target, taken, virtual_finish.

    taken: the words of the document that the mix takes, repeats counted. virtual_finish: of its first copy, null in a
    source without words. Reruns agree. Null sources are one source, null doc_ids sort as the empty text; rows alike
    share evenly what is taken of them; a document without words gets 0; an empty table gives an empty mix. Other
    columns of sized do not matter.
    """
    rows = queues(sized.select("doc_id", "source", "size", F.col("size").alias("tie")), weights, share, max_repeat)
    words = F.col("size") * F.col("alike")
    of_copy = lambda e: F.greatest(F.lit(0), F.least(words, F.col("served") - F.col("source_size") * e - F.col("start")))
    taken = sum([F.floor(of_copy(e) / F.col("alike")).cast("long") for e in range(1, max_repeat)], F.floor(of_copy(0) / F.col("alike")).cast("long"))
    finish = F.when(F.col("target") > 0, (F.col("start") + words) / F.col("target"))
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike")))
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), finish.alias("virtual_finish"), each.alias("_each")).drop("_each")


def mixed_texts(docs: DataFrame, weights=(5, 2, 1), share: float = 1.0, max_repeat: int = 3) -> DataFrame:
    """docs (doc_id, source, text and any other columns) as often as the mix takes them.

    Whole copies, and of a document at its source's cut the text up to its last word taken. The cut of each source is
    the place in its queue that the mix has come to, so that every row tells from its own place what it gives: the
    texts stay where they are. A document without words, or of which nothing is taken, is not in the mix.
    """
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    narrow = materialize(docs.select("doc_id", "source", word_count("text").alias("size"), tie.alias("tie")), "sized")
    rows = queues(narrow, weights, share, max_repeat)
    into = F.col("served") % F.col("source_size")
    words = F.col("size") * F.col("alike")
    cuts = rows.where((F.col("start") <= into) & (into < F.col("start") + words)).select(
        F.col("source").alias("_mix_source"), F.floor(F.col("served") / F.col("source_size")).cast("int").alias("_mix_whole"),
        F.struct("key", "doc_id", "tie").alias("_mix_cut"), F.floor((into - F.col("start")) / F.col("alike")).cast("int").alias("_mix_left"),
    )
    place = F.struct(_key(F.col("doc_id")).alias("key"), F.col("doc_id"), tie.alias("tie"))
    at = docs.join(few(materialize(cuts, "cuts")), F.col("source").eqNullSafe(F.col("_mix_source"))).withColumn("_mix_place", place)
    whole = F.col("_mix_whole") + F.when(F.col("_mix_place") < F.col("_mix_cut"), 1).otherwise(0)
    part = F.when(F.col("_mix_place") == F.col("_mix_cut"), F.col("_mix_left")).otherwise(0)
    has_words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    copies = F.when(has_words, F.concat(F.array_repeat(F.lit(0), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))).otherwise(F.array().cast("array<int>"))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0)), F.lit(1), F.greatest(F.col("_mix_take"), F.lit(1))), "")
    out = at.withColumn("_mix_take", F.explode(copies)).withColumn("text", F.when(F.col("_mix_take") == 0, F.col("text")).otherwise(head))
    return out.select(*docs.columns)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, in the order of the merged queue; nulls, repeated rows and an empty table as in mix()."""
    docs = table(spark, sf_dir, "documents")
    sized = materialize(docs.select("doc_id", "source", word_count("text").alias("size")), "sized")
    return mix(sized).orderBy("virtual_finish", "source", "doc_id").select("doc_id", "size", "source_size", "target", "taken", "virtual_finish")


ORACLE_OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '')) AS k
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM per),
weighed AS (SELECT *, [5.0, 2.0, 1.0][((rnk - 1) % 3 + 1)::INT]::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM ranked),
filled AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS budget,
         row_number() OVER (ORDER BY cap / weight, rnk) AS place,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fulls,
         sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM weighed),
opened AS (SELECT *, min(CASE WHEN cap * rest >= (budget - fulls) * weight THEN place END) OVER () AS first_open FROM filled),
level AS (
  SELECT *, max(CASE WHEN place = first_open THEN budget - fulls END) OVER () AS to_share,
         max(CASE WHEN place = first_open THEN rest END) OVER () AS weights_left
  FROM opened),
targets AS (
  SELECT source, rnk, source_size,
         CASE WHEN first_open IS NULL OR place < first_open THEN cap ELSE to_share * weight / weights_left END AS target
  FROM level),
grouped AS (SELECT source, doc_id, k, size, count(*) AS alike FROM sized GROUP BY ALL),
queued AS (
  SELECT s.doc_id, s.size, s.alike, t.rnk, t.source_size, t.target,
         (sum(s.size * s.alike) OVER (PARTITION BY s.source ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING))::BIGINT AS ended
  FROM grouped s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT *, ended - size * alike AS begun, unnest([0, 1, 2]) AS copy FROM queued WHERE size > 0),
parts AS (SELECT *, unnest(range(0, size * alike, SEGMENT_WORDS)) AS pos FROM copies),
segments AS (
  SELECT rnk, (copy * source_size + begun + least(pos + SEGMENT_WORDS, size * alike)) / target AS finish,
         least(SEGMENT_WORDS, size * alike - pos) AS words
  FROM parts),
merged AS (SELECT rnk, words, sum(words) OVER (ORDER BY finish, rnk ROWS UNBOUNDED PRECEDING) AS total FROM segments),
served AS (
  SELECT rnk, sum(greatest(0, words - greatest(0, total - (SELECT sum(size) FROM sized))))::BIGINT AS served
  FROM merged GROUP BY rnk),
taken AS (
  SELECT q.*, size * alike AS w, coalesce(served, 0) - (ended - size * alike) AS room FROM queued q LEFT JOIN served USING (rnk)),
rows_ AS (SELECT *, unnest(range(alike)) AS nth FROM taken)
SELECT doc_id, size, source_size, target,
       (greatest(0, least(w, room)) // alike + greatest(0, least(w, room - source_size)) // alike
        + greatest(0, least(w, room - 2 * source_size)) // alike)::BIGINT AS taken,
       CASE WHEN target > 0 THEN ended / target END AS virtual_finish
FROM rows_
""".replace("SEGMENT_WORDS", str(SEGMENT))
