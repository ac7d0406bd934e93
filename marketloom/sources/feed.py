"""The listing feed: nested JSON items to flat listings, and a search over titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import titles as T

ITEM = """itemId STRING, title STRING, price STRUCT<value: STRING, currency: STRING>, itemWebUrl STRING, image STRUCT<imageUrl: STRING>,
seller STRUCT<username: STRING, feedbackScore: INT, feedbackPercentage: STRING>, condition STRING, buyingOptions ARRAY<STRING>,
shippingOptions ARRAY<STRUCT<shippingCost: STRUCT<value: STRING, currency: STRING>>>, itemEndDate STRING, topRatedBuyingExperience BOOLEAN"""


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """S1 from files: one row per item of all pages."""
    pages = spark.read.schema(f"itemSummaries ARRAY<STRUCT<{ITEM}>>, total INT").json(path, multiLine=True)
    return pages.select(F.inline("itemSummaries"))


def to_listings(items: DataFrame) -> DataFrame:
    """A price, feedback or percentage that is missing or does not parse is 0, a shipping cost null; AUCTION goes
    before BEST_OFFER before the rest; the condition is given as it came and normalised."""
    kind = F.when(F.array_contains("buyingOptions", "AUCTION"), "auction").when(F.array_contains("buyingOptions", "BEST_OFFER"), "best_offer").otherwise("buy_it_now")
    first = F.try_element_at("shippingOptions", F.lit(1))
    return items.select(
        F.col("itemId").alias("item_id"), "title", F.col("itemWebUrl").alias("item_url"), F.col("image.imageUrl").alias("image_url"),
        F.coalesce(F.col("price.value").try_cast("double"), F.lit(0.0)).alias("price"), F.coalesce("price.currency", F.lit("USD")).alias("currency"),
        first["shippingCost"]["value"].try_cast("double").alias("shipping_cost"), kind.alias("listing_type"), F.col("seller.username").alias("seller_name"),
        F.coalesce("seller.feedbackScore", F.lit(0)).alias("seller_feedback_score"), F.coalesce(F.col("seller.feedbackPercentage").try_cast("double"), F.lit(0.0)).alias("seller_feedback_pct"),
        F.coalesce("topRatedBuyingExperience", F.lit(False)).alias("seller_top_rated"), F.col("condition").alias("condition_raw"), T.condition(F.col("condition")).alias("condition_norm"), F.lit(1).alias("quantity"),
        F.try_to_timestamp("itemEndDate").alias("auction_end_at"),
    )


QUOTA = """rateLimits ARRAY<STRUCT<apiName: STRING, resources: ARRAY<STRUCT<name: STRING,
rates: ARRAY<STRUCT<count: BIGINT, `limit`: BIGINT, remaining: BIGINT, reset: STRING, timeWindow: BIGINT>>>>>>"""


def quota(spark: SparkSession, path: str, resource: str) -> DataFrame:
    """The first rate of the named resource of each reply; a reply without one has no row."""
    named = F.filter(F.flatten(F.transform("rateLimits", lambda r: F.coalesce(r["resources"], F.array()))), lambda r: r["name"] == resource)
    rate = F.get(F.get(named, F.lit(0))["rates"], F.lit(0))
    rows = spark.read.schema(QUOTA).json(path, multiLine=True).select(rate.alias("r")).where("r IS NOT NULL")
    left = F.greatest(F.col("r.limit") - F.col("r.count"), F.lit(0)).alias("left")
    return rows.select("r.count", "r.limit", "r.remaining", left, F.try_to_timestamp("r.reset").alias("reset_at"), F.col("r.timeWindow").alias("window_seconds"))


def search(rows: DataFrame, query: str) -> DataFrame:
    """Titles that contain every word of the query."""
    for word in query.lower().split():
        rows = rows.where(F.contains(F.lower("title"), F.lit(word)))
    return rows


#: Orders of a search, with their columns and whether they rise.
SORTS = {"": ("listing_id", True), "price": ("price", True), "-price": ("price", False), "newlyListed": ("first_seen_at", False)}


def search_page(rows: DataFrame, query: str, categories: list[str] | None = None, sort: str = "", limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of a search, and one row with the total before paging and the next offset (null on the last page)."""
    found = search(rows, query)
    if categories:
        found = found.where(F.col("category_id").isin(*categories))
    column, rising = SORTS.get(sort, SORTS[""])
    limit, offset = limit if limit > 0 else 50, max(offset, 0)
    page = found.orderBy(F.col(column).asc_nulls_last() if rising else F.col(column).desc_nulls_last(), "listing_id").offset(offset).limit(limit)
    after = F.lit(offset + limit)
    return page, found.agg(F.count(F.lit(1)).alias("total")).withColumn("next_offset", F.when(after < F.col("total"), after))


def lookup(rows: DataFrame, **keys: object) -> DataFrame:
    """The rows of a key; none is an empty result."""
    for name, value in keys.items():
        rows = rows.where(F.col(name) == F.lit(value))
    return rows
