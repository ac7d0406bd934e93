"""titles that contain a text, found through a table of which rows have which three characters in a row.

The table of postings is written by bucket of the trigram, with how often each occurs. A search takes the rarest trigrams
of its text, reads their buckets only, and tests the rows that have all of them. In the text, % stands for anything and _
for any one character, as in ILIKE; a text that has no three plain characters in a row reads all titles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 256
#: Trigrams of a search that are looked up.
RAREST = 3
#: Parts over which the rows of a common trigram are dealt when they are written.
SALTS = 8


def trigrams(text: Column) -> Column:
    text = F.lower(text)
    n = F.char_length(text)
    return F.when(n >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def bucket(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BUCKETS)).cast("int")


def write_index(rows: DataFrame, key: str, text: str, path: str) -> None:
    each = rows.select(F.col(key).alias("key"), F.explode(trigrams(F.col(text))).alias("trigram")).withColumn("bucket", bucket(F.col("trigram")))
    each = each.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(SALTS))).sortWithinPartitions("bucket", "trigram")
    each.write.partitionBy("bucket").parquet(f"{path}/postings")
    rows.select(F.col(key).alias("key")).limit(0).coalesce(1).write.parquet(f"{path}/columns")
    counts = table(rows.sparkSession, path, "postings").groupBy("bucket", "trigram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/counts")


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    more = spark.read.parquet(f"{path}/columns").schema if name == "postings" else StructType().add("n", "long")
    return spark.read.schema(more.add("trigram", "string").add("bucket", "integer")).parquet(f"{path}/{name}")


def plain_runs(text: str) -> list[str]:
    """The parts of a text between its wildcards; a backslash makes the next character a plain one."""
    runs = [""]
    for escaped, wild, plain in re.findall(r"\\(.)|([%_])|(.)", text, re.S):
        if wild:
            runs.append("")
        else:
            runs[-1] += escaped or plain
    return runs


def candidates(spark: SparkSession, path: str, text: str) -> DataFrame | None:
    """Keys of the rows that have the rarest trigrams of the text; None if it has none."""
    wanted = spark.createDataFrame([(r,) for r in plain_runs(text) if r], "run string").select(F.explode(trigrams(F.col("run"))).alias("trigram")).distinct()
    wanted = {r["trigram"]: r["bucket"] for r in wanted.withColumn("bucket", bucket(F.col("trigram"))).collect()}  # of one text
    if not wanted:
        return None
    of = lambda name, some: table(spark, path, name).where(F.col("bucket").isin(sorted(set(some.values()))) & F.col("trigram").isin(sorted(some)))
    counts = {r["trigram"]: r["n"] for r in of("counts", wanted).collect()}
    rarest = sorted(wanted, key=lambda g: counts.get(g, 0))[:RAREST]
    found = of("postings", {g: wanted[g] for g in rarest}).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") == len(rarest)).select("key")


def search_titles(rows: DataFrame, key: str, column: str, text: str, path: str) -> DataFrame:
    """The rows whose column contains the text, the same as ILIKE between two %."""
    keys = candidates(rows.sparkSession, path, text)
    if keys is not None:
        rows = rows.join(keys.withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left_semi")
    return rows.where(F.col(column).ilike(f"%{text}%"))
