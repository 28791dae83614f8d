"""The observation log as a stream: new files are read once, repeated observations are kept once, histories stay exact."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import label_histories
from ..sources.records import OBSERVATION, split_log

KEY = ["url", "snapshot"]
#: Months of a batch up to which only those months' observations are looked through for repeats.
MOST_MONTHS = 1000


def month(snapshot: Column) -> Column:
    """The folder of a snapshot's month; a row without one is in a folder of its own."""
    return F.concat(F.lit("m"), F.coalesce(F.substring(snapshot, 1, 6), F.lit("")))


def log_stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    """Lines of a log folder as they arrive; a line cut short has no URL and goes with split_log."""
    return spark.readStream.schema(OBSERVATION).option("mode", "PERMISSIVE").option("maxFilesPerTrigger", files_a_batch).json(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The observations stored so far; None before the first."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def best_of_repeats(seen: DataFrame) -> DataFrame:
    """Of the rows of a (url, snapshot) the one with most words, ties by landing URL and language."""
    rest = [c for c in seen.columns if c not in KEY]
    order = F.struct(F.coalesce("words", F.lit(-1)), F.coalesce("final_url", F.lit("")), F.coalesce("primary", F.lit("")))
    return seen.groupBy(*KEY).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*KEY, "_r.*")


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, *, distinct: bool = True, files_a_batch: int = 1000) -> StreamingQuery:
    """Stores what is new in `source` under target/observations and target/markers, then ends; run it again for more.

    A batch overwrites its own folder, so a batch that is run again after a failure stores nothing twice. Repeats of
    (url, snapshot) are found against what is stored of the batch's months rather than in state, which would grow without
    bound: a month that is new costs no look, however much is stored. Of repeats within a batch the one with most words
    stays. Files are ranges of month and URL, so a month that is large is in several and small ones share one task.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            seen, done = split_log(batch)
            seen = (best_of_repeats(seen) if distinct else seen).withColumn("month", month(F.col("snapshot")))
            before = stored(batch.sparkSession, f"{target}/observations") if distinct else None
            if before is not None:
                there = before.where(F.col("batch") != number)
                own = [r[0] for r in seen.select("month").distinct().limit(MOST_MONTHS + 1).collect()]
                if len(own) <= MOST_MONTHS:
                    there = there.where(F.col("month").isin(*own))
                seen = seen.join(there.select("month", *KEY), ["month", *KEY], "left_anti")
            seen.repartitionByRange("month", "url").write.mode("overwrite").partitionBy("month").parquet(f"{target}/observations/batch={number}")
            done.write.mode("overwrite").parquet(f"{target}/markers/batch={number}")
        finally:
            batch.unpersist()

    stream = log_stream(spark, source, files_a_batch)
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def histories(observations: DataFrame, track: str = "primary") -> DataFrame:
    """The intervals of each URL over all that is stored, in whatever order it arrived."""
    return label_histories(observations, track)


def pending(urls: DataFrame, markers: DataFrame) -> DataFrame:
    """URLs (url) that no marker says are complete."""
    return urls.join(markers.select("url"), "url", "left_anti")
