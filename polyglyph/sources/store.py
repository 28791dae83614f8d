"""A table that is merged into: rows in buckets by key, new files for the buckets that change, a manifest that is switched last.

A version is a manifest, a small JSON file with a number: which folder holds which bucket. A merge writes the buckets it
touches into a folder of its own and then puts the next manifest in place under a name that must not be there yet. A run
that ends before that leaves the old version, one that ends after it the new one, and of two runs at once one fails. A
reader takes the greatest manifest, and folders of older ones stay until vacuum().
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
_DIGITS = 12


class Conflict(RuntimeError):
    """Another run has put the next version in place."""


class Store:
    """The table in `path`, by `key`; `buckets` counts when it is made. Rows of one bucket are rewritten together."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self._buckets = spark, path.rstrip("/"), key, buckets
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(f.getPath().getName() for f in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def manifest(self) -> dict | None:
        """The greatest version's; None where there is none yet."""
        names = [n for n in self._names("manifests") if n.endswith(".json") and n[:_DIGITS].isdigit()]
        if not names:
            return None
        stream = self._fs.open(self._at(f"manifests/{names[-1]}"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        made = self._at(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        name = self._at(f"manifests/{manifest['version']:0{_DIGITS}}.json")
        if self._fs.exists(name) or not self._fs.rename(made, name):
            self._fs.delete(made, False)
            raise Conflict(f"version {manifest['version']} of {self.path} is there already")

    def bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(buckets)).cast("int")

    def _read(self, manifest: dict, only: set[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        wanted = {int(b): f for b, f in manifest["folders"].items() if only is None or int(b) in only}
        paths = [f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(wanted.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame | None:
        """The rows of the greatest version; None before the first."""
        now = self.manifest()
        return None if now is None else self._read(now)

    def merge(self, new: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], keys: DataFrame | None = None) -> int:
        """The version that how(old rows, new rows) makes of the buckets that `new` touches; of all others nothing is read.

        how() sees the old rows of those buckets only and gives rows of the same columns and keys. `new` is read twice,
        or once where `keys` gives its keys for less; no rows make no new version. Raises Conflict where another run was
        faster: nothing has changed then.
        """
        now = self.manifest()
        buckets = now["buckets"] if now else self._buckets
        touched = {r[0] for r in (new if keys is None else keys).select(self.bucket(buckets)).distinct().collect()}  # as many numbers as buckets at most
        if not touched:
            return now["version"] if now else 0
        old = self._read(now, touched) if now else self.spark.createDataFrame([], new.schema)
        done = how(old, new)
        version, folder = (now["version"] if now else 0) + 1, uuid.uuid4().hex
        done.withColumn("bucket", self.bucket(buckets)).repartition(len(touched), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        written = {int(n.removeprefix("bucket=")) for n in self._names(f"data/{folder}") if n.startswith("bucket=")}
        folders = {b: f for b, f in (now["folders"] if now else {}).items() if int(b) not in touched}
        self._commit({"version": version, "buckets": buckets, "schema": json.loads(done.schema.json()), "folders": folders | {str(b): folder for b in sorted(written)}})
        return version

    def rebucket(self, buckets: int) -> int:
        """A version of the same rows in another number of buckets, for a table that has grown."""
        now = self.manifest()
        if now is None:
            self._buckets = buckets
            return 0
        folder = uuid.uuid4().hex
        self._read(now).withColumn("bucket", self.bucket(buckets)).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
        written = [n.removeprefix("bucket=") for n in self._names(f"data/{folder}") if n.startswith("bucket=")]
        self._commit(now | {"version": now["version"] + 1, "buckets": buckets, "folders": dict.fromkeys(written, folder)})
        return now["version"] + 1

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all but the greatest `keep` versions and the folders that none of them names. Not while a run merges or reads an older one."""
        names = [n for n in self._names("manifests") if n.endswith(".json") and n[:_DIGITS].isdigit()]
        used: set[str] = set()
        for n in names[-keep:]:
            stream = self._fs.open(self._at(f"manifests/{n}"))
            used |= set(json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))["folders"].values())
            stream.close()
        for n in names[:-keep]:
            self._fs.delete(self._at(f"manifests/{n}"), False)
        for folder in set(self._names("data")) - used:
            self._fs.delete(self._at(f"data/{folder}"), True)
