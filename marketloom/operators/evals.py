"""Accuracy per class, nearest-rank percentiles and stratified samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .ranks import at_rank, cumulated


def accuracy(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """A15."""
    right = F.count_if(F.col(expected) == F.col(actual))
    return rows.groupBy(expected).agg(F.count(F.lit(1)).alias("n"), right.alias("n_right"), (right * 100.0 / F.count(F.lit(1))).alias("accuracy"))


def accuracy_with_overall(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """Accuracy per class and, under "overall", of all rows."""
    each = accuracy(rows, expected, actual)
    right, n = F.sum("n_right"), F.sum("n")
    return each.unionByName(each.agg(n.alias("n"), right.alias("n_right"), (right * 100.0 / n).alias("accuracy")).withColumn(expected, F.lit("overall")).where("n IS NOT NULL"))


def mismatches(rows: DataFrame, expected: str, actual: str) -> DataFrame:
    """The rows whose class was missed."""
    return rows.where(~F.col(expected).eqNullSafe(F.col(actual)))


def nearest_rank(rows: DataFrame, by: str, value: str, percents: tuple[int, ...]) -> DataFrame:
    """The value at the lower nearest rank, (n - 1) * p / 100 in whole numbers; an element, not an interpolation."""
    picks = [at_rank(F.floor((F.col("total") - 1) * p / 100), value).alias(f"p{p}") for p in percents]
    return cumulated(rows, by, value).groupBy(by).agg(*picks)


def stratified(rows: DataFrame, by: str, n: int, *order) -> DataFrame:
    """The first n rows of each class; the limit per class holds before rows meet."""
    return rows.withColumn("rn", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("rn") <= n)


def dataset(rows: DataFrame, by: str, n: int, classes: list[str], *order) -> DataFrame:
    """The first n rows of each of the given classes, in order of class."""
    return stratified(rows.where(F.col(by).isin(*classes)), by, n, *order).orderBy(by, "rn")


def interleaved(rows: DataFrame, by: str, limit: int, *order) -> DataFrame:
    """The first of each class, then the second of each, until the limit."""
    return stratified(rows, by, limit, *order).orderBy("rn", by).limit(limit)
