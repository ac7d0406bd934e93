"""Exact deduplication as a stateful stream (operator 5), with DataFrame operations only.

A first pass notes each row's digest, size, identifier and content locator (file and row). That table is the stream:
a keyed aggregation without watermark, so that its state, held on disk by RocksDB and saved to the shared folder, keeps
for each digest the row that stays, its identifier, its locator and the number of rows, and never expires. The state is
then read as a table.

With a state folder, later runs go on from there: each run adds its arrivals to the folder as a named batch (a batch
that is there already is not added again), the stream reads what is new, and the answers are about the rows of this
batch among all that ever came. Files that locators of earlier batches point at must be kept; rows that have none are
written into the state folder.

A hit on a digest counts only after the whole normalised bytes have been compared: rows of hit digests, of earlier
batches too, are fetched by locator and grouped by digest and full text. Copies collapse on the map side, so a group of
copies that holds a third of all rows sends a few rows per task. Digests under which texts differ are settled by their
full text.

Defined cases: a null text counts as empty; null doc_id loses ties and may be kept; repeated rows are copies of each
other, one of which stays; an empty table gives an empty result. Other columns are carried or ignored.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, has_file_metadata, materialize, scratch, session_conf, shared_path, table, text_or_empty, written

#: Locators of up to this many rows (some 200 bytes each) are broadcast; beyond it the texts are joined by shuffle.
BROADCAST_ROWS = 100_000


def normalised() -> Column:
    return F.regexp_replace(text_or_empty(), f"[{SPACE}]+", "")


def arrivals(docs: DataFrame, digest_bytes: int = 32, state: str | None = None, batch: str | None = None) -> tuple[DataFrame, DataFrame, str]:
    """docs with files behind it, the table of its digests, and the folders whose tables are the stream."""
    spark = docs.sparkSession
    batch = batch or uuid.uuid4().hex
    if not has_file_metadata(docs):
        docs = written(docs, f"{state}/contents/{batch}") if state else materialize(docs, "contents")
    sha = F.unhex(F.sha2(normalised(), 256))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.length(text_or_empty()).cast("long").alias("n"), sha.alias("sha"),
        F.substring(sha, 1, digest_bytes).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    at = f"{state}/arrivals/{batch}" if state else shared_path(spark, "arrivals")
    return docs, written(rows, at), f"{state}/arrivals/*" if state else at


def best() -> Column:
    """The row that stays is the greatest: most code points, then smallest doc_id (its bits flipped), then place."""
    return F.max(F.struct("n", F.bitwise_not("doc_id").alias("flipped"), "file", "row"))


def stream_state(spark: SparkSession, schema: T.StructType, folders: str, checkpoint: str) -> DataFrame:
    """Runs what is new in the folders through the keyed state and returns the state: digest, members, stays."""
    provider = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    # A store is closed as soon as its task has committed: after the run nothing of the state stays on executors.
    with session_conf(spark, spark__sql__streaming__stateStore__providerClass=provider, spark__sql__streaming__stateStore__unloadOnCommit="true"):
        stream = spark.readStream.schema(schema).parquet(folders)
        seen = stream.groupBy("digest").agg(best().alias("stays"), F.count(F.lit(1)).alias("members"))
        query = seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        kept = spark.read.format("statestore").option("path", checkpoint).load()
        stays, members = (f.name for f in kept.schema["value"].dataType.fields)
        kept = kept.select(F.col("key.digest").alias("digest"), F.col(f"value.{members}").alias("members"), F.col(f"value.{stays}").alias("stays"))
        return materialize(kept, "groups")


def compared(contents: DataFrame, where: DataFrame, small: bool) -> DataFrame:
    """doc_id, n, file, row, digest and the whole normalised text of each row of where (locators)."""
    texts = contents.select(normalised().alias("norm"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return texts.join(F.broadcast(where) if small else where, ["file", "row"])


def older_contents(spark: SparkSession, where: DataFrame) -> DataFrame:
    """The files that locators point at, by their text column. A scan's driver lists its files in any case."""
    files = [unquote(r.file) for r in where.select("file").distinct().collect()]
    return spark.read.schema("text string").parquet(*files)


def classes(docs: DataFrame, digest_bytes: int = 32, state: str | None = None, batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """docs with files behind it, and one row per document of it: doc_id, file, row, sha, keep_id, group_size, kept.

    Groups are those of all batches of the state, so that keep_id may be of an earlier batch.
    """
    spark = docs.sparkSession
    docs, rows, folders = arrivals(docs, digest_bytes, state, batch)
    if state is None and not rows.inputFiles():  # no file, no stream
        groups = spark.createDataFrame([], "digest binary, members long, stays struct<n:long,flipped:long,file:string,row:long>")
    else:
        groups = stream_state(spark, rows.schema, folders, f"{state}/checkpoint" if state else shared_path(spark, "state"))
    answer = lambda stays, size: (
        "doc_id", "file", "row", "sha", F.bitwise_not(F.col(f"{stays}.flipped")).alias("keep_id"), F.col(size).alias("group_size"),
        ((F.col("file") == F.col(f"{stays}.file")) & (F.col("row") == F.col(f"{stays}.row"))).alias("kept"),
    )
    hits = groups.where("members > 1")
    joined = rows.join(groups, "digest")
    came = rows
    if state:
        hits = materialize(hits.join(rows.select("digest"), "digest", "left_semi"), "hits")
        came = spark.read.schema(rows.schema).parquet(folders)
    total = hits.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    if total == 0:
        return docs, joined.select(*answer("stays", "members"))
    found = lambda some: came.join(some.select("digest"), "digest", "left_semi").select("file", "row", "digest", "n", "doc_id")
    where = found(hits)
    contents = older_contents(spark, where) if state else docs
    texts = compared(contents, where, total <= BROADCAST_ROWS).groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("same"))
    clash = materialize(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "clashes")
    if clash.limit(1).count() == 0:
        return docs, joined.select(*answer("stays", "members"))
    whole = compared(contents, found(clash), False)
    exact = whole.groupBy("digest", "norm").agg(best().alias("stays_"), F.count(F.lit(1)).alias("size_"))
    exact = whole.select("digest", "norm", "file", "row").join(exact, ["digest", "norm"]).select("file", "row", "stays_", "size_")
    settled = joined.join(clash, "digest", "left_semi").join(exact, ["file", "row"]).select(*answer("stays_", "size_"))
    return docs, joined.join(clash, "digest", "left_anti").select(*answer("stays", "members")).unionByName(settled)


def dedup_documents(docs: DataFrame, state: str | None = None, batch: str | None = None) -> DataFrame:
    """The rows of docs that stay, with all columns of docs."""
    if not has_file_metadata(docs):
        docs = materialize(docs, "contents", keep=True)
    with scratch(docs.sparkSession):
        _, rows = classes(docs, state=state, batch=batch)
        gone = rows.where(~F.col("kept")).select(F.col("file").alias("_ml_file"), F.col("row").alias("_ml_row"))
        gone = materialize(gone, "dropped", keep=True)
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    at = docs.select("*", F.col("_metadata.file_path").alias("_ml_at"), F.col("_metadata.row_index").alias("_ml_index"))
    stay = at.join(gone, (F.col("_ml_at") == F.col("_ml_file")) & (F.col("_ml_index") == F.col("_ml_row")), "left_anti")
    return stay.drop("_ml_at", "_ml_index")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rows = classes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP5_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
         row_number() OVER w AS rn
  FROM n WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id ASC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
