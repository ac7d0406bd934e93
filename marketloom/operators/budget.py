"""Where a running total over any number of rows reaches a cap, without putting all rows in order in one task.

Keys are whole numbers. The range of keys is cut into SHARES parts, amounts are summed by part, and the part in which the
total reaches the cap is cut again, until it is one key: a few aggregations, of which at most SHARES rows each come to the
driver. Amounts are not negative and are added up as decimals, so that the cut does not depend on the order of sums.
"""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SHARES = 1024
AMOUNT = "decimal(20,9)"


class Cut(NamedTuple):
    """The first key with which the total reaches the cap, and the total of the keys before it."""

    key: int
    before: Decimal


def cut(rows: DataFrame, key: Column, amount: Column, cap: float | Decimal) -> Cut | None:
    """None if the total stays below the cap. Null keys and amounts count as 0 and nothing."""
    rows = rows.select(F.coalesce(key.cast("long"), F.lit(0)).alias("key"), F.coalesce(amount.cast(AMOUNT), F.lit(0).cast(AMOUNT)).alias("amount"))
    ends = rows.agg(F.min("key").alias("low"), F.max("key").alias("high")).first()
    cap, before = Decimal(str(cap)), Decimal(0)
    if ends["low"] is None:
        return None
    low, high = ends["low"], ends["high"]
    while True:
        width = -(-(high - low + 1) // SHARES)
        within = rows.where(F.col("key").between(low, high)).groupBy(F.floor((F.col("key") - low) / width).alias("part"))
        for part, total in sorted(map(tuple, within.agg(F.sum("amount").alias("total")).collect())):  # at most SHARES rows
            if before + total >= cap:
                low, high = low + part * width, min(high, low + (part + 1) * width - 1)
                break
            before += total
        else:
            return None
        if low == high:
            return Cut(low, before)


def until_spent(rows: DataFrame, key: Column, ties: list[str], amount: Column, cap: float, spent: float = 0.0) -> DataFrame:
    """Rows in order of key and ties, until what is spent before one reaches the cap."""
    left = Decimal(str(cap)) - Decimal(str(spent))
    if left <= 0:
        return rows.limit(0)
    found = cut(rows, key, amount, left)
    if found is None:
        return rows
    at = F.coalesce(key.cast("long"), F.lit(0))
    ordered = W.partitionBy(at).orderBy(*ties).rowsBetween(W.unboundedPreceding, -1)  # rows of one key only
    here = rows.where(at == found.key)
    so_far = F.coalesce(F.sum(F.coalesce(amount.cast(AMOUNT), F.lit(0).cast(AMOUNT))).over(ordered), F.lit(0).cast(AMOUNT)) + F.lit(found.before)
    here = here.withColumn("_so_far", so_far).where(F.col("_so_far") < F.lit(left)).drop("_so_far")
    return rows.where(at < found.key).unionByName(here)


def granted(rows: DataFrame, key: str, amount: str, budget: int, daily_left: int | None = None) -> DataFrame:
    """What each row (one a key) gets of the amount it asks for. A row is begun while the budget is not used up, and
    then has all of it; the day's limit stops within a row, and after it none is begun."""
    begun, last = cut(rows, F.col(key), F.col(amount), budget) if budget > 0 else Cut(-(1 << 62), Decimal(0)), None
    gets = F.col(amount) if begun is None else F.when(F.col(key) <= begun.key, F.col(amount)).otherwise(0)
    if daily_left is not None:
        last = cut(rows, F.col(key), F.col(amount), daily_left) if daily_left > 0 else Cut(-(1 << 62), Decimal(0))
    if last is not None:
        most = F.when(F.col(key) < last.key, F.col(amount)).when(F.col(key) == last.key, F.lit(daily_left - int(last.before))).otherwise(0)
        gets = F.least(gets, most)
    return rows.withColumn("granted", gets.cast("long"))
