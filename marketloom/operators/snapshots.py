"""Pages of sorted rows without sorting them again: parts in order, and a directory of how many rows each has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PART_ROWS = 100_000


def write_sorted(rows: DataFrame, order: list[Column], path: str, part_rows: int = PART_ROWS) -> None:
    """Rows sorted into parts of about so many rows. The order must tell all rows apart, else equal ones may swap."""
    parts = max(1, -(-rows.count() // part_rows))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed.withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(f"{path}/rows")
    rows.limit(0).coalesce(1).write.parquet(f"{path}/columns")
    sizes = whole(rows.sparkSession, path).groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    sizes.coalesce(1).write.parquet(f"{path}/sizes")  # written last: without it there is no snapshot


def whole(spark: SparkSession, path: str) -> DataFrame:
    """All rows with their part, in no order; a snapshot of no rows has columns only."""
    columns = spark.read.parquet(f"{path}/columns").schema
    return spark.read.schema(columns.add("_part", "integer")).parquet(f"{path}/rows")


def rows_between(spark: SparkSession, path: str, order: list[Column], first: int, n: int) -> DataFrame:
    """Rows first to first + n of the order: of the parts that hold them, and no other files."""
    before, held, offset = 0, [], 0
    for part, size in sorted(map(tuple, spark.read.parquet(f"{path}/sizes").select("_part", "n").collect())):  # a row a part
        if before < first + n and before + size > first:
            offset = offset if held else first - before
            held.append(part)
        before += size
    columns = spark.read.parquet(f"{path}/columns")
    if not held:
        return columns
    own = spark.read.schema(columns.schema).parquet(*[f"{path}/rows/_part={k}" for k in held])
    return own.orderBy(*order).offset(offset).limit(n)


def page_of(spark: SparkSession, path: str, order: list[Column], number: int = 1, per_page: int = 25) -> tuple[DataFrame, int]:
    """A page, from 1, and the number of all rows."""
    total = spark.read.parquet(f"{path}/sizes").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return rows_between(spark, path, order, (max(number, 1) - 1) * per_page, per_page), total
