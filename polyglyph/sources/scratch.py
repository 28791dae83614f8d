"""Tables that are written between the rounds of an operator, so that lineage does not grow and lost executors cost nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a local master without it uses a temporary one."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="polyglyph-")
        sc.setCheckpointDir(at)
    return f"{at.rstrip('/')}/polyglyph-{sc.applicationId}/{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Tables of one schema that rounds add, read as one."""

    def __init__(self, first: DataFrame, name: str):
        self.spark, self.schema, self.name, self.paths = first.sparkSession, first.schema, name, []
        self.last = self.add(first)

    def add(self, df: DataFrame) -> DataFrame:
        path = scratch(self.spark, self.name)
        df.write.parquet(path)
        self.paths.append(path)
        self.last = self.spark.read.schema(self.schema).parquet(path)
        return self.last

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths)
