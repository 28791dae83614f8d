"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, as the contracts of the operators define it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local master gets a temporary folder; a cluster raises, since its executors could not see one.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="polyglyph-")
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def scratch_root(spark: SparkSession) -> str:
    """The folder of all tables that this application's operators have written."""
    return f"{shared_dir(spark)}/polyglyph-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}/{name}"


def clean(spark: SparkSession) -> None:
    """Deletes scratch_root(). To be called when no result of an operator is read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once as a table in the shared folder and reads it back: lineage is cut, lost executors cost nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column | str) -> Column:
    """Number of words; null: 0."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: Rows up to which a table is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 10_000


def few(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df (a written table), to be broadcast if it has at most `most` rows."""
    return F.broadcast(df) if df.count() <= most else df


def bounded_sample(df: DataFrame, by: list[str], most: int) -> DataFrame:
    """About `most` different rows of each group at most, the same ones at every run: those whose hash lies below most / number.

    All columns are hashed, so rows that share an id, or have none, are drawn each for itself; rows that are alike in
    all columns are one. Different rows are counted over the whole table, by their hashes, and the numbers are broadcast
    if they are few, so that df stays where it is; what is drawn is shuffled once.
    """
    marked = df.withColumn("_h", F.xxhash64(*df.columns, F.lit("sample")))
    sizes = marked.select(*by, "_h").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*[F.col(c).alias(f"_{c}") for c in by], "_n")
    sizes = few(materialize(sizes, "group_sizes"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    share = F.pmod(F.col("_h"), F.lit(1 << 30)) / float(1 << 30)
    drawn = marked.join(sizes, on).where(share * F.col("_n") < most).select("_h", F.struct(*[F.col(c) for c in df.columns]).alias("_r"))
    return drawn.groupBy("_h").agg(F.first("_r").alias("_r")).select("_r.*")
