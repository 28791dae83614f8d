"""Queries that stream whole tables, and that merge them into a stored table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from ..sources.scratch import scratch
from ..sources.store import Store
from ..streaming import intervals as I
from .record_plans import _RUNS_SQL, table


def streamed_histories(spark, sf_dir):
    """Events as a log of their users' pages that comes in two parts, every second event first: histories by months."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    url = F.concat(F.lit("http://u"), "user_id")
    log = e.select(
        url.alias("url"), F.concat(F.date_format("ts", "yyyyMMddHHmmss"), F.lpad(k.cast("string"), 12, "0")).alias("snapshot"), F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.concat(url, F.when(k % 3 == 0, "/b").otherwise("")).alias("final_url"), F.col("event_type").alias("primary"), F.array("event_type").alias("available"), (k % 2 == 0).alias("_even"),
    )
    at = scratch(spark, "log")
    for even in (True, False):
        log.where(F.col("_even") == even).drop("_even").write.mode("append").json(f"{at}/in")
        I.keep_histories(spark, f"{at}/in", f"{at}/store", f"{at}/checkpoint").awaitTermination()
    spans = I.histories_of_months(I.months_store(spark, f"{at}/store").read())
    return spans.select("url", "run", F.col("from").alias("first_day"), F.col("to").alias("last_day"), "primary", "observations", "landing_path")


def stored_upserts(spark, sf_dir):
    """Orders merged into a stored table in three parts; a status that is there stays."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    store = Store(spark, scratch(spark, "orders"), ["k"], 8)
    for part in range(3):
        rows = o.where(k % 5 != part).select(k.alias("k"), F.when((k + part) % 3 == 0, F.concat("o_orderstatus", F.lit(str(part)))).otherwise("").alias("language"), F.concat("o_orderpriority", F.lit(str(part))).alias("name"))
        store.merge(rows, lambda old, new: R.upsert(old, new, ["k"], ["language"]))
    return store.read()


QUERIES = {f.__name__: f for f in (streamed_histories, stored_upserts)}

ORACLE_SQL = {
    "streamed_histories": f"""WITH e AS (SELECT 'http://u' || user_id AS k, ts, event_id AS id, event_type AS state, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN event_id % 3 = 0 THEN '/b' ELSE '/' END AS path FROM events), {_RUNS_SQL},
      p AS (SELECT k, run, path, count(*) AS n, min((ts, id)) AS f FROM y GROUP BY ALL), b AS (SELECT k, run, first(path ORDER BY n DESC, f) AS landing_path FROM p GROUP BY ALL)
      SELECT k AS url, run, first_day, last_day, state AS "primary", observations, landing_path FROM spans JOIN b USING (k, run)""",
    "stored_upserts": """WITH s AS (SELECT o_orderkey AS k, part, CASE WHEN (o_orderkey + part) % 3 = 0 THEN o_orderstatus || part ELSE '' END AS language, o_orderpriority || part AS name FROM orders, range(3) t(part) WHERE o_orderkey % 5 <> part)
      SELECT k, coalesce(arg_min(language, part) FILTER (WHERE language <> ''), '') AS language, arg_max(name, part) AS name FROM s GROUP BY k""",
}
