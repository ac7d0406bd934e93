"""Price baselines kept up to date by changes: exact counts that can be added and taken away, and only touched keys anew.

The state is a table of (product_key, day, unit_price, n): how many listings that count for a baseline have that price on
that day. It is the sum of what was added and what was taken away, so days, partitions and workers may be merged in any
order. A change of a listing takes its old row away and adds the new one. A run moves the window on: days that fall out of
it are dropped, and the keys that lost days or got changes, and no others, are ranked again. Windows are whole days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from .market import LEVELS, NAMES, small
from .ranks import percentiles_of, placed

STATE = ["product_key", "day", "unit_price"]


def counts_for_baseline() -> Column:
    """Whether a listing counts, whatever its day."""
    return F.col("active") & (F.col("condition_norm") != "for_parts") & (F.col("product_key") != "")


def price_counts(listings: DataFrame, sign: int = 1) -> DataFrame:
    """product_key, day, unit_price, n of listings, or of listings to be taken away (sign -1)."""
    paid = F.coalesce("sold_price", "price") if "sold_price" in listings.columns else F.col("price")
    rows = listings.where(counts_for_baseline()).select("product_key", F.to_date("updated_at").alias("day"), S.unit_price(paid, F.col("shipping_cost"), F.col("quantity")).alias("unit_price"))
    return rows.where(F.col("day").isNotNull()).groupBy(*STATE).agg((F.count(F.lit(1)) * sign).cast("long").alias("n"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """What the state changes by, from listings as they were and as they are; listings that are new are in after only."""
    return merged(price_counts(before, -1), price_counts(after))


def merged(*counts: DataFrame) -> DataFrame:
    """The sum of states and changes."""
    rows = counts[0]
    for more in counts[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(*STATE).agg(F.sum("n").alias("n")).where("n <> 0")


def since(as_of: str, window_days: int = 90) -> Column:
    return F.date_sub(F.lit(as_of).cast("date"), window_days)


def touched_keys(state: DataFrame, delta: DataFrame, as_of: str, window_days: int = 90) -> DataFrame:
    """Keys with changes, or with days that the window no longer holds."""
    old = state.where(F.col("day") < since(as_of, window_days)).select("product_key")
    return old.unionByName(delta.select("product_key")).distinct()


def baselines_of(state: DataFrame, min_samples: int = 5) -> DataFrame:
    """Baselines of the keys of a state. Prices of several days are one value; null prices have counts and no rank."""
    prices = state.groupBy("product_key", "unit_price").agg(F.sum("n").alias("n"))
    means = prices.groupBy(F.col("product_key").alias("_key")).agg(F.sum("n").alias("_n"), (F.sum(F.col("unit_price") * F.col("n")) / F.sum(F.when(F.col("unit_price").isNotNull(), F.col("n")))).alias("mean"))
    by = percentiles_of(placed(prices, "product_key", "unit_price"), "product_key", "unit_price", LEVELS, NAMES)
    by = by.join(means.where(F.col("_n") >= min_samples), F.col("product_key") == F.col("_key"))
    return by.select("product_key", F.col("_n").alias("sample_count"), *[S.money(F.col(n)).alias(n) for n in NAMES], S.money(F.col("mean")).alias("mean"))


def advanced(state: DataFrame, base: DataFrame, delta: DataFrame, as_of: str, window_days: int = 90, min_samples: int = 5) -> tuple[DataFrame, DataFrame]:
    """State and baselines after a run. Like the full computation, a run leaves out keys with too few samples; baselines of
    such keys go."""
    keys = touched_keys(state, delta, as_of, window_days)
    new_state = merged(state.where(F.col("day") >= since(as_of, window_days)), delta.where(F.col("day") >= since(as_of, window_days)))
    own = new_state.join(small(keys), "product_key", "left_semi")
    kept = base.join(small(keys), "product_key", "left_anti")
    return new_state, kept.unionByName(baselines_of(own, min_samples))
