"""Token counts of documents in flat, unindexed token files by a separator scan (operator 4).

A token file is identifiers of a fixed width one after another, with an end identifier after each document and nothing
that says where documents are. Files are cut into blocks of BLOCK_BYTES; each block is read on its own and searched for
end identifiers with one vector comparison. A block reports how many tokens it has, where its ends are, and so the
lengths of documents that begin and end in it. A prefix scan over the blocks of a file then gives each block the place
of its first token, the number of documents ended before, and the last end before it, which stitches the documents that
run over block boundaries, over any number of blocks.

The query first writes documents to such files in the shared folder (a task writes under a name of its own and renames
at the end, so a task that runs again leaves the same file), and keeps beside them which document is the k-th of which
file, to give counts back by doc_id. The end identifier here is the vocabulary's one special token, so its name in a
text is ordinary text: read as the token it would end the document.

Defined cases: null or empty text has 0 tokens; texts of any length, and runs of space in them, are encoded whole; tokens after a file's last end are one unfinished document (ended is
false); an empty file or folder has no documents; a file whose length is no whole number of tokens is an error;
repeated rows are documents each; null doc_id is carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, shared_path, table, text_or_empty
from .packing import encoder

BLOCK_BYTES = 4 << 20
END_ID = 50256
DTYPE = "<u2"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str = "byte_bpe_50k.tiktoken", tokenizer: str = "byte_bpe_50k.json", end_id: int = END_ID, dtype: str = DTYPE) -> DataFrame:
    """Writes one token file per partition; returns file, ordinal, doc_id of each document, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = encoder(public_tokenizers.path(vocabulary), public_tokenizers.PATTERN, public_tokenizers.path(tokenizer), special=False)
        context = TaskContext.get()
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"tokens-{context.partitionId():06d}.bin"
        # Names that start with a dot are not read as files of the folder.
        part, ordinal = f"{path}/.{name}-{context.taskAttemptId()}", 0
        with store.open_output_stream(part) as out:
            for batch in batches:
                for text in batch.column(1):
                    out.write(np.array([*encode(text.as_py()), end_id], dtype).tobytes())
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(ordinal, ordinal + n), pa.int64()), batch.column(0)], names=["file", "ordinal", "doc_id"])
                ordinal += n
        store.move(part, f"{path}/{name}") if ordinal else store.delete_file(part)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return materialize(picked.mapInArrow(run, "file string, ordinal long, doc_id long"), "order")


def block_ends(ids: np.ndarray, end_id: int) -> np.ndarray:
    return np.flatnonzero(ids == end_id)


def scan_blocks(spark: SparkSession, folder: str, end_id: int = END_ID, dtype: str = DTYPE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, block, tokens, ends (places within the block): one row per block of each file."""
    width = np.dtype(dtype).itemsize
    step = max(1, block_bytes // width) * width
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder).select("path", "length").where("length > 0")
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(step).cast("long"))).alias("at"))
    blocks = blocks.repartition("path", "at")  # listed files are few partitions; reading is spread by block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if length % width:
                    raise ValueError(f"{path} has {length} bytes, no whole number of {width}-byte tokens")
                store, where = fs.FileSystem.from_uri(path if "://" in path else path.replace(":", "://", 1))
                with store.open_input_file(where) as source:
                    ids = np.frombuffer(source.read_at(min(step, length - at), at), dtype)
                ends = pa.array([block_ends(ids, end_id)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at // step]), pa.array([len(ids)]), ends], names=["file", "block", "tokens", "ends"])

    return blocks.mapInArrow(run, "file string, block long, tokens long, ends array<long>")


def count_tokens(blocks: DataFrame) -> DataFrame:
    """file, ordinal, start (place of the first token in the file), n_tokens (without the end), ended."""
    # The windows see four numbers a block; the ends join afterwards, by block.
    blocks = materialize(blocks, "ends")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    sums = blocks.select("file", "block", "tokens", F.size("ends").alias("n_ends"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    sums = sums.withColumn("first", F.coalesce(F.sum("tokens").over(before), F.lit(0))).withColumn("last_end", F.col("first") + F.col("last"))
    sums = sums.withColumns({"ended": F.coalesce(F.sum("n_ends").over(before), F.lit(0)), "previous": F.coalesce(F.max("last_end").over(before), F.lit(-1))})
    placed = blocks.select("file", "block", "ends").join(sums.select("file", "block", "first", "ended", "previous"), ["file", "block"])
    # The end before each end: for the first of a block it may be blocks away.
    places = F.transform("ends", lambda e: F.col("first") + e)
    prior = F.concat(F.array("previous"), F.slice(places, 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    pairs = placed.where(F.size("ends") > 0).select("file", "ended", F.posexplode(F.arrays_zip(prior.alias("prior"), places.alias("end"))).alias("k", "x"))
    start = F.col("x.prior") + 1
    whole = pairs.select("file", (F.col("ended") + F.col("k")).alias("ordinal"), start.alias("start"), (F.col("x.end") - start).alias("n_tokens"), F.lit(True).alias("ended"))
    rest = sums.groupBy("file").agg(F.sum("tokens").alias("tokens"), F.coalesce(F.max("last_end"), F.lit(-1)).alias("last"), F.sum("n_ends").alias("ordinal"))
    rest = rest.where(F.col("tokens") - F.col("last") > 1)
    rest = rest.select("file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("tokens") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, file, ordinal, start of every document."""
    folder = shared_path(spark, "tokens")
    order = write_token_files(table(spark, sf_dir, "documents"), folder)
    if order.limit(1).count() == 0:
        return order.select("doc_id", F.lit(0).cast("long").alias("n_tokens"), "file", "ordinal", F.lit(0).cast("long").alias("start"))
    counts = count_tokens(scan_blocks(spark, folder)).withColumn("file", F.regexp_extract("file", "[^/]+$", 0))
    # Both sides have a row per document: a broadcast, which the small blocks before the explosion invite, would not do.
    return order.join(counts.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens", "file", "ordinal", "start")
