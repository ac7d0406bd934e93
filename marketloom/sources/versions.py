"""A table in versions, kept as Parquet by bucket of its key, and a sink of changes that may be repeated.

A version is written beside the others and holds the buckets that changed; a commit, one small file that appears at once,
says for each bucket which version has it, and up to which batch each source of changes has been taken in. Readers see the
newest commit whole; what was written without a commit is overwritten by the next attempt. So a batch that comes again,
after a failure or a restart of its stream, changes nothing. There is one writer at a time.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COMMIT = "version long, parts map<int, long>, taken map<string, long>"


def work_folder(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir, which only a local session may lack);
    it is deleted when the driver ends."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="marketloom-")
    path = f"{at.rstrip('/')}/marketloom-{label}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def _where(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def delete(spark: SparkSession, path: str) -> None:
    try:
        store, at = _where(spark, path)
        store.delete(at, True)
    except Exception:  # the session may be gone; the folder is the cluster's scratch space
        pass


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it is not there."""
    store, at = _where(spark, path)
    return [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []


class Versions:
    def __init__(self, spark: SparkSession, path: str, key: list[str], schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def last(self) -> tuple[int, dict[int, int], dict[str, int]]:
        """Version, where each bucket is, and up to which batch each source was taken in."""
        done = [n for n in names(self.spark, f"{self.path}/commits") if any(x.endswith(".parquet") for x in names(self.spark, f"{self.path}/commits/{n}"))]
        if not done:
            return 0, {}, {}
        row = self.spark.read.schema(COMMIT).parquet(f"{self.path}/commits/{max(done)}").first()
        return row["version"], row["parts"], row["taken"]

    def buckets_of(self, rows: DataFrame) -> set[int]:
        return {r[0] for r in rows.select(self.bucket()).distinct().collect()}  # at most as many as there are buckets

    def read(self, only: set[int] | None = None) -> DataFrame:
        """The newest version, or some buckets of it: no other files are read."""
        _, parts, _ = self.last()
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(parts.items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def has_taken(self, source: str, batch: int) -> bool:
        return batch <= self.last()[2].get(source, -1)

    def write(self, rows: DataFrame, touched: set[int], source: str, batch: int) -> bool:
        """The next version: rows are all there is of the touched buckets. False if the batch was taken in before."""
        version, parts, taken = self.last()
        if batch <= taken.get(source, -1):
            return False
        at = f"{self.path}/data/version={version + 1}"
        own = rows.select(*self.spark.createDataFrame([], self.schema).columns).withColumn("bucket", self.bucket())
        own.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(at)
        there = {int(n.removeprefix("bucket=")) for n in names(self.spark, at) if n.startswith("bucket=")}
        parts = {b: v for b, v in parts.items() if b not in touched} | {b: version + 1 for b in there}
        commit = self.spark.createDataFrame([(version + 1, parts, taken | {source: batch})], COMMIT)
        commit.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/{version + 1:012d}")
        return True


def taking(table: Versions, source: str, change: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch. change gives, from rows of the table and a batch, the rows after it; it sees the
    buckets that the batch touches, whose keys no others have."""

    def take(batch: DataFrame, number: int) -> None:
        if table.has_taken(source, number):
            return
        touched = table.buckets_of(batch)
        table.write(change(table.read(touched), batch), touched, source, number)

    return take
