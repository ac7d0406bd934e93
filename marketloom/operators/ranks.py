"""Ranks within groups of any size: values are counted, ranges of values summed up, and only then looked at in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Ranges of values of a group; a window sees the ranges of a group or the distinct values of a range, never a whole group.
RANGES = 256
#: Cuts are looked up in two steps of so many.
STEP = 16
#: Values of a group, at most, that its cuts are taken from.
SAMPLES = 16 * RANGES


def range_of(value: Column, cuts: Column) -> Column:
    """How many of the sorted cuts are not above the value: among every STEP-th first, then among those up to the next."""
    above = F.size(F.filter(F.transform(F.sequence(F.lit(STEP), F.lit(RANGES), F.lit(STEP)), lambda k: F.get(cuts, k - 1)), lambda c: c <= value))
    return above * STEP + F.size(F.filter(F.slice(cuts, above * STEP + 1, STEP - 1), lambda c: c <= value))


def even_cuts(values: DataFrame, by: str, value: str, ranges: int = RANGES) -> DataFrame:
    """_by, _cuts: the ends of ranges of a group's distinct values with about equal shares of them.

    A plan may read its input twice, so cuts must not depend on the order in which rows come, as approximate percentiles
    do: values are dealt by their hash into SAMPLES slots, the one of the least hash stands for each.
    """
    mark = F.xxhash64(value)
    slots = values.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.pmod(mark, F.lit(SAMPLES)).alias("_slot")).agg(F.min_by(value, mark).alias("_value"))
    found = slots.groupBy("_by").agg(F.array_sort(F.collect_list("_value")).alias("_values"))
    ends = F.transform(F.sequence(F.lit(1), F.lit(ranges - 1)), lambda k: F.get("_values", F.floor(k * F.size("_values") / ranges).cast("int")))
    return found.select("_by", ends.alias("_cuts"))


def cumulated(rows: DataFrame, by: str, value: str) -> DataFrame:
    """by, value, n, before (rows of the group with a smaller value), total: one row per distinct value; nulls are left out."""
    return placed(rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("n")), by, value)


def placed(counts: DataFrame, by: str, value: str) -> DataFrame:
    """The same from counts (by, value, n) of distinct values. Ranges are cut at even shares of a group's distinct values,
    so a few outliers do not put all others in one range."""
    counts = counts.where(F.col(value).isNotNull()).select(by, value, "n")
    counts = counts.join(even_cuts(counts, by, value), F.col(by).eqNullSafe(F.col("_by"))).drop("_by")
    counts = counts.withColumn("_range", range_of(F.col(value), F.col("_cuts"))).drop("_cuts")
    sums = counts.groupBy(F.col(by).alias("_by"), F.col("_range").alias("_at")).agg(F.sum("n").alias("_n"))
    of = W.partitionBy("_by").orderBy("_at")
    sums = sums.withColumn("_offset", F.coalesce(F.sum("_n").over(of.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("total", F.sum("_n").over(of.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    inside = F.coalesce(F.sum("n").over(W.partitionBy(by, "_range").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = counts.withColumn("_inside", inside).join(sums.drop("_n"), F.col(by).eqNullSafe(F.col("_by")) & (F.col("_range") == F.col("_at")))
    return found.select(by, value, "n", (F.col("_offset") + F.col("_inside")).alias("before"), "total")


def at_rank(rank: Column, value: str) -> Column:
    """The value at a rank from 0, over the rows of cumulated of one group."""
    return F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("n")), F.col(value)))


def percentiles(rows: DataFrame, by: str, value: str, levels: tuple[float, ...], names: list[str]) -> DataFrame:
    """by, sample_count and the exact percentile of each level, linear between neighbours."""
    return percentiles_of(cumulated(rows, by, value), by, value, levels, names)


def percentiles_of(placed: DataFrame, by: str, value: str, levels: tuple[float, ...], names: list[str]) -> DataFrame:
    """The same over the rows of cumulated or placed."""
    picks = []
    for level, name in zip(levels, names, strict=True):
        at = (F.col("total") - 1) * F.lit(level)
        picks += [at_rank(F.floor(at), value).alias(f"{name}_low"), at_rank(F.ceil(at), value).alias(f"{name}_high")]
    found = placed.groupBy(by).agg(F.first("total").alias("sample_count"), *picks)

    def between(level: float, name: str) -> Column:
        at, low, high = (F.col("sample_count") - 1) * F.lit(level), F.col(f"{name}_low"), F.col(f"{name}_high")
        return F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias(name)

    return found.select(by, "sample_count", *[between(q, n) for q, n in zip(levels, names, strict=True)])


def numbered(rows: DataFrame, by: str, leading: str, descending: bool, *ties: str, width: float = 1) -> DataFrame:
    """rows with _at, from 0 in order of leading and ties within each group: ranges of leading that are so wide are
    counted first, so a window sees the ranges of a group or the rows of a range."""
    part = F.floor(F.col(leading) / F.lit(width))
    way = (lambda c: F.col(c).desc()) if descending else (lambda c: F.col(c).asc())
    rows = rows.withColumn("_part", part)
    sums = rows.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_of")).agg(F.count(F.lit(1)).alias("_n"))
    sums = sums.withColumn("_offset", F.coalesce(F.sum("_n").over(W.partitionBy("_by").orderBy(way("_of")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(W.partitionBy(by, "_part").orderBy(way(leading), *ties)) - 1
    rows = rows.withColumn("_inside", inside).join(sums, F.col(by).eqNullSafe(F.col("_by")) & F.col("_part").eqNullSafe(F.col("_of")))
    return rows.withColumn("_at", F.col("_offset") + F.col("_inside")).drop("_part", "_by", "_of", "_offset", "_inside")
