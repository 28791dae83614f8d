"""Histories that are kept while observations stream in, late and repeated ones too.

The state of a URL's month holds that month's different observations, and what is stored is the month's runs: a row that
comes late extends, splits or joins runs of its own month only. A URL's history is made of its months' runs, of which there
are few, by the same rule as of observations. So a busy URL is dealt to its months, and no state grows beyond one.

The state is that of a streaming aggregation. A processor of Python's own asks for its state over a socket, some calls for
each observation, which took longer than all else.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.history import HOT_ROWS, landing_path
from ..sources.records import split_log
from ..sources.store import Store
from .observations import log_stream

#: Characters of a snapshot's stamp that name its month.
MONTH = 6
_PATHS = "array<struct<path: string, n: bigint>>"
_RUN = f"struct<first: string, from: string, to: string, primary: string, state: array<string>, observations: bigint, available: array<string>, paths: {_PATHS}>"
#: seen counts the different observations that the runs are made of.
MONTHS = f"url string, month string, seen int, runs array<{_RUN}>"
#: A state store that does not hold the state on the heap.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Months read and handed to Python at once, and runs from which on they are handed back.
MONTHS_AT_ONCE, RUNS_AT_ONCE = 200, 20_000
AT_ONCE = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")


def better(new: list, old: list | None) -> bool:
    """Of two observations of one snapshot the one with more words counts, then the greater landing URL, then language, then date."""
    rank = lambda o: (-1 if o[4] is None else o[4], o[3] or "", o[1] or "", o[2], o[0])
    return old is None or rank(new) > rank(old)


def month_runs(seen: dict[str, list], track: str) -> list[dict]:
    """The runs of equal states of observations (snapshot -> date, primary, available, final_url, words, path)."""
    out: list[dict] = []
    for snapshot in sorted(seen):
        date, primary, available, _, _, path = seen[snapshot]
        if not available:
            continue
        state = [primary] if track == "primary" else [primary, *available]
        if not out or out[-1]["state"] != state:
            out.append({"first": snapshot, "from": date, "to": date, "primary": primary, "state": state, "observations": 0, "available": set(), "paths": {}})
        run = out[-1]
        run["from"], run["to"] = min(run["from"], date), max(run["to"], date)
        run["observations"] += 1
        run["available"] |= set(available)
        run["paths"][path] = run["paths"].get(path, 0) + 1
    return [r | {"available": sorted(r["available"]), "paths": list(r["paths"].items())} for r in out]


def best_said(said: Iterable[str]) -> dict[str, list]:
    """Of the observations of a month (JSON) the one of each snapshot that counts, as month_runs takes them."""
    out: dict[str, list] = {}
    for text in said:
        o = json.loads(text)
        one = [o["date"], o.get("primary"), o.get("available") or [], o.get("final_url"), o.get("words"), o["path"]]
        if better(one, out.get(o["snapshot"])):
            out[o["snapshot"]] = one
    return out


def _runs_of(track: str, schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, start, n = [], 0, 0
            for i, said in enumerate(b.column("observations")):
                made.append([r | {"paths": [{"path": p, "n": k} for p, k in r["paths"]]} for r in month_runs(best_said(said.as_py()), track)])
                n += len(made[-1])
                if n >= RUNS_AT_ONCE or i + 1 == b.num_rows:
                    keys = [b.column(c).slice(start, i + 1 - start) for c in ("url", "month", "seen")]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(made, schema.field("runs").type)], schema=schema)
                    made, start, n = [], i + 1, 0

    return rows


def months_of(kept: DataFrame, track: str = "primary") -> DataFrame:
    """MONTHS of months with their observations (url, month, seen, observations as of month_stream)."""
    return kept.select("url", "month", "seen", "observations").mapInArrow(_runs_of(track, to_arrow_schema(StructType.fromDDL(MONTHS))), MONTHS)


def month_stream(observations: DataFrame) -> DataFrame:
    """(url, month, observations) of a stream (url, snapshot, date, final_url, primary, available, words): the months that rows come for.

    A month's observations are all different ones so far, as JSON. To be written in update mode. Rows without a snapshot go.
    """
    said = F.to_json(F.struct("snapshot", F.coalesce("date", F.lit("")).alias("date"), "primary", "available", "final_url", "words", landing_path(F.col("final_url")).alias("path")))
    rows = observations.where("url is not null and snapshot is not null").select("url", F.substring("snapshot", 1, MONTH).alias("month"), said.alias("said"))
    return rows.groupBy("url", "month").agg(F.collect_set("said").alias("observations"))


def _joined(paths: Column) -> Column:
    """Lists of (path, n) of a run's months in order as one, each path at its first place."""
    flat = F.flatten(paths)
    names = F.array_distinct(F.transform(flat, lambda p: p["path"]))
    return F.transform(names, lambda name: F.struct(name.alias("path"), F.aggregate(flat, F.lit(0).cast("long"), lambda n, p: n + F.when(p["path"].eqNullSafe(name), p["n"]).otherwise(0)).alias("n")))


def _landing(paths: Column) -> Column:
    """The most frequent of (path, n), the first of equals."""
    most = F.array_max(F.transform(paths, lambda p: p["n"]))
    return F.filter(paths, lambda p: p["n"] == most)[0]["path"]


def histories_of_months(months: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The intervals of each URL (url, run, from, to, primary, observations, available, landing_path) from MONTHS: runs that go on over months are one.

    Only a month's first and last run can go on in another month, so a URL's months are ordered by those, a short row
    each, and no task orders all runs of a URL, whatever hot_rows says. All runs but those that go on are given as they are.
    """
    states = months.select("url", "month", F.col("runs.state").alias("_s")).where(F.size("_s") > 0)
    ends = states.select("url", "month", F.size("_s").alias("_n"), F.col("_s")[0].alias("_first"), F.element_at("_s", -1).alias("_last"))
    by = W.partitionBy("url").orderBy("month")
    back = F.coalesce(F.lag("_last").over(by).eqNullSafe(F.col("_first")) & (F.row_number().over(by) > 1), F.lit(False))
    ends = ends.withColumn("_back", back)
    ahead = F.coalesce(F.lead("_back").over(by), F.lit(False))
    before = F.sum(F.col("_n") - F.col("_back").cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    ends = ends.select("url", "month", "_n", "_back", ahead.alias("_ahead"), before.alias("_before"))
    each = months.select("url", "month", "runs").join(ends.hint("shuffle_hash"), ["url", "month"]).select("url", "_n", "_back", "_ahead", "_before", F.posexplode("runs").alias("_i", "r"))
    goes_on = (F.col("_back") & (F.col("_i") == 0)) | (F.col("_ahead") & (F.col("_i") == F.col("_n") - 1))
    each = each.select("url", (F.col("_before") + F.col("_i") + 1).cast("int").alias("run"), goes_on.alias("_goes_on"), "r.*")
    whole = each.where(~F.col("_goes_on")).select("url", "run", "from", "to", "primary", "observations", "available", _landing(F.col("paths")).alias("landing_path"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("first", "paths"))), lambda x: x["paths"])
    spans = each.where("_goes_on").groupBy("url", "run").agg(
        F.min("from").alias("from"), F.max("to").alias("to"), F.first("primary").alias("primary"), F.sum("observations").alias("observations"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("available")))).alias("available"), _joined(parts).alias("_paths"),
    )
    return whole.unionByName(spans.select("url", "run", "from", "to", "primary", "observations", "available", _landing(F.col("_paths")).alias("landing_path")))


def months_store(spark: SparkSession, path: str, buckets: int = 64) -> Store:
    return Store(spark, path, ["url", "month"], buckets)


def keep_histories(spark: SparkSession, source: str, target: str, checkpoint: str, track: str = "primary", files_a_batch: int = 1000) -> StreamingQuery:
    """Follows a folder of log files: merges the months that change into the store in `target`, then ends; run it again for more.

    Sets the session's state store to STATE_STORE. A month is made anew where its observations have become more; those of a
    batch lie in `checkpoint` while they are merged. A batch that is run again merges the same months again, which changes
    nothing, so nothing counts twice. A store and its checkpoint belong together.
    """
    if track not in ("primary", "available"):
        raise ValueError(f"track {track}")
    spark.conf.set(*STATE_STORE)

    def keep(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession  # the stream's own, a copy
        for name in AT_ONCE:
            session.conf.set(name, MONTHS_AT_ONCE)
        store = months_store(session, target)
        new = batch.withColumn("seen", F.size("observations"))
        before = store.read()
        if before is not None:  # a month for which nothing new has come is as large as it was
            was = before.select("url", "month", F.col("seen").alias("_was")).hint("shuffle_hash")
            new = new.join(was, ["url", "month"], "left").where(F.col("_was").isNull() | (F.col("_was") != F.col("seen"))).drop("_was")
        new.write.mode("overwrite").parquet(f"{checkpoint}/batch")  # what reads the batch itself twice asks the state twice
        new = session.read.schema(new.schema).parquet(f"{checkpoint}/batch")
        keys = new.select("url", "month")
        store.merge(months_of(new, track), lambda old, made: old.join(keys.hint("shuffle_hash"), ["url", "month"], "left_anti").unionByName(made), keys)

    seen, _ = split_log(log_stream(spark, source, files_a_batch))
    return month_stream(seen).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
