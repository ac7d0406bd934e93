"""What the operators of this subpackage share: word rules, the shared folder, size checks."""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of all word rules: space and U+0009 to U+000D, nothing else.
SPACE = r"\x20\x09-\x0D"
#: Texts go to Python tasks in batches of this size, a few of which are in memory in several forms at a time.
BATCH_BYTES = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of runs of non-space characters, in one linear pass and without building an array of words.

    Each word, with the space after it, becomes one "x"; a text without words keeps its spaces only.
    """
    marks = F.regexp_replace(text, rf"(?:^[{SPACE}]*+)?[^{SPACE}]++[{SPACE}]*+", "x")
    return F.when(F.startswith(marks, F.lit("x")), F.length(marks)).otherwise(0).cast("long")


#: Folders made for local sessions that name none, by application.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, which only a local session may lack."""
    context = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not at:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if context.applicationId not in _own_dirs:
            _own_dirs[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="marketloom-")
        at = _own_dirs[context.applicationId]
    return at.rstrip("/")


@contextmanager
def session_conf(spark: SparkSession, **values: str):
    """Settings (dots written as two underscores) that hold within the block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Paths written so far.
_written: set[str] = set()
#: Per thread: for each open scratch block, the paths that end with it.
_blocks = threading.local()


def shared_path(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A new path in the shared folder; it is deleted with its scratch block, or when the driver ends."""
    path = f"{shared_dir(spark)}/marketloom-{label}-{uuid.uuid4().hex}"
    _written.add(path)
    if not keep and getattr(_blocks, "open", None):
        _blocks.open[-1].append(path)
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    if path not in _written:
        return
    _written.discard(path)
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone; the folder is the cluster's scratch space
        pass


@contextmanager
def scratch(spark: SparkSession):
    """What this thread materializes inside, and does not keep, is deleted at the end of the block."""
    _blocks.open = [*getattr(_blocks, "open", ()), own := []]
    try:
        yield
    finally:
        _blocks.open = _blocks.open[:-1]
        for path in own:
            _forget(spark, path)


def is_finished(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(mark)


def written(df: DataFrame | Callable[[], DataFrame], path: str) -> DataFrame:
    """df, or what a function gives that is asked only if need be, as a table at path; one that is finished there is
    taken as it is, what a lost driver left is replaced."""
    spark = SparkSession.active() if callable(df) else df.sparkSession
    if callable(df) and is_finished(spark, path):
        return spark.read.parquet(path)
    df = df() if callable(df) else df
    if not is_finished(spark, path):
        with session_conf(spark, spark__sql__execution__arrow__maxBytesPerBatch=BATCH_BYTES):
            df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """df as a table in the shared folder: computed once, lineage cut, whole after the loss of executors."""
    return written(df, shared_path(df.sparkSession, label, keep))


def fits(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows, counted no further than needed."""
    return df.limit(rows + 1).count() <= rows


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcast only if it is counted to have at most so many rows; otherwise Spark shuffles it."""
    return F.broadcast(df) if fits(df, rows) else df


def salted_join(rows: DataFrame, other: DataFrame, keys: list[str], how: str, salt: Column, broadcast_rows: int, salts: int = 16) -> DataFrame:
    """rows joined (inner or left) with a table of one row per key. Beyond the broadcast bound, rows of one key are dealt
    by salt over so many parts, each with its copy of the other row, so that a hot key is not one task's."""
    if fits(other, broadcast_rows):
        return rows.join(F.broadcast(other), keys, how)
    rows = rows.withColumn("_salt", F.pmod(salt, F.lit(salts)).cast("int"))
    other = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.join(other, [*keys, "_salt"], how).drop("_salt")


def has_file_metadata(df: DataFrame) -> bool:
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
        return True
    except Exception:  # the analyser has several classes for a column that does not exist
        return False
