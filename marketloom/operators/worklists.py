"""What operators look at and workers take up next: open work, coverage of baselines, recent alerts, shares by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .alerts import verdict
from .market import small


def unextracted(listings: DataFrame) -> DataFrame:
    """active listings whose type is not known yet."""
    return listings.where(F.col("active") & F.col("component_type").isNull())


def unscored(listings: DataFrame) -> DataFrame:
    """active listings of a known type that have no score."""
    return listings.where(F.col("active") & F.col("component_type").isNotNull() & F.col("score").isNull())


def newest(rows: DataFrame, at: str, key: str, n: int) -> DataFrame:
    """The n newest rows; equal times in order of key."""
    return rows.orderBy(F.col(at).desc_nulls_last(), F.col(key)).limit(n)


def deactivated(listings: DataFrame) -> DataFrame:
    """Listings without a type are no longer active."""
    return listings.withColumn("active", F.col("active") & F.col("component_type").isNotNull())


def failed_jobs(queue: DataFrame, listings: DataFrame, job_key: str, listing_key: str) -> DataFrame:
    """Jobs that left an error, with their listings."""
    return queue.where(F.col("error_text").isNotNull()).join(listings, F.col(job_key) == F.col(listing_key))


def best_covered(base: DataFrame, n: int = 20) -> DataFrame:
    """The baselines of most samples."""
    return base.orderBy(F.col("sample_count").desc(), "product_key").limit(n)


def cold(base: DataFrame, least: int = 10) -> DataFrame:
    """Baselines of few samples, those nearest to enough first."""
    return base.where(F.col("sample_count") < least).orderBy(F.col("sample_count").desc(), "product_key")


def of_prefix(base: DataFrame, prefix: str) -> DataFrame:
    """Baselines whose key starts so, in order of key."""
    return base.where(F.startswith("product_key", F.lit(prefix))).orderBy("product_key")


def matching_keys(listings: DataFrame, key_pattern: str, title_pattern: str | None = None) -> DataFrame:
    """listings whose key matches a pattern or, without regard to case, whose title does."""
    wanted = F.rlike("product_key", F.lit(key_pattern))
    return listings.where(wanted | F.rlike("title", F.lit(f"(?i){title_pattern}")) if title_pattern else wanted)


def uncovered(listings: DataFrame, base: DataFrame) -> DataFrame:
    """Keys of active listings that have no baseline, with their number of listings."""
    keys = listings.where(F.col("active") & (F.col("product_key") != "")).groupBy("product_key").agg(F.count(F.lit(1)).alias("n_listings"))
    return keys.join(base.select("product_key"), "product_key", "left_anti")


def since(at: Column, as_of: str, days: int) -> Column:
    """At lies within so many days before as_of."""
    now = F.lit(as_of).cast("timestamp_ntz")
    return (at >= now - F.expr(f"INTERVAL {int(days)} DAYS")) & (at <= now)


def recent_alerts(alerts: DataFrame, listings: DataFrame, watches: DataFrame, as_of: str, days: int = 1) -> DataFrame:
    """Alerts of the last days with what they are about."""
    rows = alerts.where(since(F.col("created_at"), as_of, days))
    return rows.join(listings.select("listing_id", "title", "price"), "listing_id").join(small(watches.select("watch_id", "watch_name")), "watch_id")


def pending_by_watch(alerts: DataFrame, listings: DataFrame, watches: DataFrame) -> DataFrame:
    """Pending alerts of each watch. A lost listing or watch drops the alert.

    A watch may have any number of alerts, so groups are summed up; in_chunks deals them out for delivery.
    """
    rows = alerts.where(~F.col("notified")).join(listings.select("listing_id"), "listing_id", "left_semi")
    sums = rows.groupBy("watch_id").agg(F.count(F.lit(1)).alias("n_alerts"), F.max("score").alias("best_score"), F.max("created_at").alias("newest"))
    return sums.join(small(watches.select("watch_id", "watch_name")), "watch_id")


def warm_and_cold(scored: DataFrame, by: str = "component_type", least: int = 10) -> DataFrame:
    """How many listings were scored against a baseline of enough samples, and how many were not."""
    warm = F.coalesce(F.col("sample_count") >= least, F.lit(False))
    return scored.groupBy(by).agg(F.count_if(warm).alias("warm"), F.count_if(~warm).alias("cold"))


def spent_today(costed: DataFrame, as_of: str) -> DataFrame:
    """What has been spent since the midnight before as_of, 0 if nothing."""
    midnight = F.date_trunc("day", F.lit(as_of).cast("timestamp")).cast("timestamp_ntz")
    return costed.where(F.col("judged_at") >= midnight).agg(F.coalesce(F.sum(F.col("cost").cast("decimal(20,9)")), F.lit(0)).cast("decimal(20,6)").alias("spend"))


def noise_and_dismissals(alerts: DataFrame, judged: DataFrame) -> DataFrame:
    """By day of the alert, the share of judged alerts that are noise beside the share of alerts dismissed."""
    rows = alerts.join(judged.select("alert_id", "judge_score"), "alert_id", "left")
    day = F.date_trunc("day", F.col("created_at").cast("timestamp")).cast("timestamp_ntz").alias("day")
    judged_n, noise = F.count("judge_score"), F.count_if(verdict(F.col("judge_score")).eqNullSafe("noise") & F.col("judge_score").isNotNull())
    return rows.groupBy(day).agg(
        F.when(judged_n > 0, noise / judged_n).alias("noise_share"), (F.count("dismissed_at") / F.count(F.lit(1))).alias("dismissed_share"),
    )
