"""Price baselines, scored listings, filtered pages and system counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from .ranks import percentiles

#: Baseline and watch tables are small beside listings; they are broadcast up to this many rows.
BROADCAST_ROWS = 200_000
#: Percentiles of a baseline.
LEVELS, NAMES = (0.10, 0.25, 0.50, 0.75, 0.90), ["p10", "p25", "p50", "p75", "p90"]


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it is counted to have few rows; otherwise Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def priced(listings: DataFrame) -> DataFrame:
    return listings.withColumn("unit_price", S.unit_price(F.col("price"), F.col("shipping_cost"), F.col("quantity")))


def baselines(listings: DataFrame, as_of: str, window_days: int = 90, min_samples: int = 5) -> DataFrame:
    """Exact percentiles of unit prices per product key, of active rows of the window that are not for parts.

    What a listing was sold for goes before its price. Prices are counted before they are ranked, and ranked by ranges,
    so a key of any size is spread. A null condition, and a null or empty key, is left out.
    """
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(window_days)} DAYS")
    rows = listings.where(F.col("active") & (F.col("condition_norm") != "for_parts") & (F.col("updated_at") >= since) & (F.col("product_key") != ""))
    paid = F.coalesce("sold_price", "price") if "sold_price" in listings.columns else F.col("price")
    rows = rows.select("product_key", S.unit_price(paid, F.col("shipping_cost"), F.col("quantity")).alias("unit_price"))
    means = rows.groupBy(F.col("product_key").alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.avg("unit_price").alias("mean")).where(F.col("_n") >= min_samples)
    by = percentiles(rows, "product_key", "unit_price", LEVELS, NAMES).join(means, F.col("product_key") == F.col("_key"))
    return by.select("product_key", F.col("_n").alias("sample_count"), *[S.money(F.col(n)).alias(n) for n in NAMES], S.money(F.col("mean")).alias("mean"))


def with_baseline(listings: DataFrame, base: DataFrame) -> DataFrame:
    """J1."""
    return priced(listings.where("active")).join(base, "product_key", "left")


def scored(listings: DataFrame, base: DataFrame, as_of: str) -> DataFrame:
    """Every active listing that has a product key, with its six factors and score, in one pass."""
    rows = with_baseline(listings.where(F.coalesce("product_key", F.lit("")) != ""), base)
    x = S.inputs(as_of)
    f = {
        "price_score": S.price_score(F.col("unit_price"), *[F.col(c) for c in ("sample_count", "p10", "p25", "p50", "p75", "p90")]),
        "seller_score": S.seller_score(F.col("seller_feedback_score"), F.col("seller_feedback_pct"), F.col("seller_top_rated")),
        "condition_score": S.condition_score(F.col("condition_norm")), "quantity_score": S.quantity_score(F.col("quantity")),
        "quality_score": S.quality_score(x["has_images"], x["has_specifics"], F.lit(0)),  # listings carry no description
        "time_score": S.time_score(x["is_auction"], x["ending_soon"], x["is_new"]),
    }
    return rows.withColumns(f).withColumn("score", S.total({k: F.col(k) for k in f}))


def any_of(options: dict[str, object]) -> Column:
    """the conjunction of the options that are set."""
    rules = {
        "component_type": lambda v: F.col("component_type") == v, "min_price": lambda v: F.col("price") >= v, "max_price": lambda v: F.col("price") <= v,
        "product_key": lambda v: F.col("product_key") == v, "min_feedback": lambda v: F.col("seller_feedback_score") >= v,
        "conditions": lambda v: F.col("condition_norm").isin(*v), "min_score": lambda v: F.col("score") >= v, "max_score": lambda v: F.col("score") <= v,
    }
    out = F.lit(True)
    for name, value in options.items():
        if value is not None and value != []:
            out = out & rules[name](value)
    return out


def with_defaults(listings: DataFrame) -> DataFrame:
    """What a listing shows where nothing is known."""
    known = {"condition_norm": "unknown", "component_type": "", "attributes": "{}", "product_key": "", "extraction_confidence": 0.0}
    return listings.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in known.items() if c in listings.columns})


def clamped(text: str | None, default: int, low: int, high: int) -> int:
    """a parameter as a whole number within bounds; what is no number, or below them, is the default."""
    try:
        value = int(text or "")
    except ValueError:
        return default
    return default if value < low else min(value, high)


ORDERS = {"price": ["price", True], "score": ["score", False], "first_seen_at": ["first_seen_at", False]}


def page(rows: DataFrame, order: str = "first_seen_at", limit: int = 50, offset: int = 0, tie: str = "listing_id") -> DataFrame:
    """O1, O2: a sorted page; unknown orders fall back, limits are held to 1..500."""
    column, rising = ORDERS.get(order, ORDERS["first_seen_at"])
    limit = 50 if limit <= 0 else min(limit, 500)
    first = F.col(column).asc_nulls_last() if rising else F.col(column).desc_nulls_last()
    return rows.orderBy(first, F.col(tie)).offset(max(offset, 0)).limit(limit)


def incomplete(listings: DataFrame, component: str | None = None) -> DataFrame:
    """memory without a speed, in its key or its attributes, and drives with something unknown in their key; all or of a type."""
    speed = F.try_variant_get(F.try_parse_json("attributes"), "$.speed_mhz", "string")
    ram = (F.col("component_type") == "ram") & (F.endswith("product_key", F.lit(":0")) | speed.isNull())
    drive = (F.col("component_type") == "drive") & F.contains("product_key", F.lit(":unknown"))
    rows = listings.where("active AND component_type IS NOT NULL")
    return (rows if component is None else rows.where(F.col("component_type") == component)).where(ram | drive)


def extraction_stats(listings: DataFrame) -> DataFrame:
    """How many listings are incomplete, and by type nothing yet."""
    return incomplete(listings).agg(F.count(F.lit(1)).alias("total_incomplete"), F.create_map().cast("map<string, bigint>").alias("by_type"))


def system_state(listings: DataFrame, watches: DataFrame, alerts: DataFrame, base: DataFrame, queue: DataFrame) -> DataFrame:
    """One pass over each table, then one row."""
    count = lambda df, **columns: df.agg(*[F.count_if(c).alias(k) for k, c in columns.items()])
    keys, kind = F.col("product_key"), F.col("component_type")
    # One pass over the base for its counts and for keys without one.
    mine = listings.where("active AND product_key IS NOT NULL").select("product_key").distinct().withColumn("listed", F.lit(True))
    both = mine.join(base.select("product_key", "sample_count"), "product_key", "full")
    lacking = (kind == "ram") & (keys.isNull() | F.endswith(keys, F.lit(":0"))) | (kind == "drive") & F.contains(keys, F.lit(":unknown"))
    parts = [
        count(watches, watches_total=F.lit(True), watches_enabled=F.col("enabled")),
        count(
            listings.where("active"), listings_total=F.lit(True), listings_unextracted=F.coalesce(kind, F.lit("")) == "",
            listings_unscored=F.col("score").isNull(), listings_incomplete=lacking,
        ),
        count(alerts, alerts_pending=~F.col("notified")),
        count(
            both, baselines_total=F.col("sample_count").isNotNull(), baselines_warm=F.col("sample_count") >= 10, baselines_cold=F.col("sample_count") < 10,
            keys_without_baseline=F.col("listed") & F.col("sample_count").isNull(),
        ),
        count(queue, queue_depth=~F.col("completed")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out
