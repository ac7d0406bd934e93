"""Matching listings with watches, alert candidates, review pages, judging and payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import variants as V
from .budget import until_spent
from .market import small
from .ranks import numbered
from .state import one_per
from .watch_index import candidates


def on_or_off(bound: Column, holds: Column) -> Column:
    """A bound that is null is off."""
    return bound.isNull() | F.coalesce(holds, F.lit(False))


def watch_filter(conditions: Column | None = None) -> Column:
    """F8 to F11, over a listing joined with a watch; conditions: those of the watch as an array, where it is there."""
    price = on_or_off(F.col("price_max"), F.col("unit_price") <= F.col("price_max")) & on_or_off(F.col("price_min"), F.col("unit_price") >= F.col("price_min"))
    seller = on_or_off(F.nullif(F.col("min_feedback"), F.lit(0)), F.col("seller_feedback_score") >= F.col("min_feedback"))
    seller = seller & on_or_off(F.col("min_feedback_pct"), F.col("seller_feedback_pct") >= F.col("min_feedback_pct"))
    seller = seller & (~F.col("top_rated_only") | F.coalesce("seller_top_rated", F.lit(False)))
    listed = (F.col("conditions") == "") | F.coalesce(F.array_contains(F.split("conditions", ",") if conditions is None else conditions, F.col("condition_norm")), F.lit(False))
    return price & seller & listed


FILTERS = "map<string, struct<eq: variant, `in`: array<variant>, min: double, max: double>>"


def attribute_match(attrs: Column, filters: Column) -> Column:
    """every filtered attribute is there and fits. attrs is MAP<STRING, VARIANT>, filters JSON text or a map.

    An exact value goes before a list, a list before bounds. Values are compared by JSON type. Bounds hold for numbers
    only: any other value, null too, passes. No filters, and a null, match all; null attributes match no filter.
    Both sides are named by a one-element array, so that JSON is read once a row.
    """
    return F.get(F.transform(F.array(F.struct(attrs.alias("attrs"), filters.alias("filters"))), lambda x: matched(x["attrs"], x["filters"])), F.lit(0))


def matched(attrs: Column, filters: Column) -> Column:
    def fits(e: Column) -> Column:
        value, rule = F.try_element_at(attrs, e["key"]), e["value"]
        x = V.as_number(value)
        within = on_or_off(rule["min"], x >= rule["min"]) & on_or_off(rule["max"], x <= rule["max"])
        listed = F.exists(rule["in"], lambda v: V.same(value, v))
        inside = F.when(rule["in"].isNotNull(), listed).otherwise(x.isNull() | within)
        exact = rule["eq"].isNotNull() & (F.schema_of_variant(rule["eq"]) != "VOID")
        return F.coalesce(F.map_contains_key(attrs, e["key"]), F.lit(False)) & F.when(F.coalesce(exact, F.lit(False)), V.same(value, rule["eq"])).otherwise(inside)

    return F.coalesce(F.forall(F.map_entries(filters), fits), F.lit(True))


def read_filters(json: Column) -> Column:
    return F.from_json(json, FILTERS)


def watch_matches(scored: DataFrame, watches: DataFrame) -> DataFrame:
    """Listings with the enabled watches of their type that they fit. The index of watches names candidates of
    its score, the whole predicate decides; open attributes (JSON text in both tables) are read last, and only for watches that filter
    them. What a watch asks of them, and its list of conditions, is read once a watch. The columns of watches are copied with
    the index, so a caller leaves out those that it does not need."""
    read = {"_all": S.no_attributes(F.col("attribute_filters")), "_filters": read_filters(F.col("attribute_filters")), "_conditions": F.when(F.col("conditions") != "", F.split("conditions", ","))}
    enabled = watches.where("enabled").withColumns(read)
    rows = candidates(scored, enabled).where(watch_filter(F.col("_conditions")))
    if not enabled.where(~F.col("_all")).isEmpty():  # else attributes of listings need not be dealt
        fits = attribute_match(V.attributes(F.coalesce("attributes", F.lit("{}"))), F.col("_filters"))
        rows = rows.where(F.when(F.col("_all"), True).otherwise(fits))
    return rows.drop(*read)


def outside_cooldown(matches: DataFrame, alerts: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """No alert of the pair that was sent after the cut-off; 0 hours turn it off."""
    if hours <= 0:
        return matches
    since = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(hours)} HOURS")
    recent = alerts.where(F.col("notified") & (F.col("notified_at") > since)).select("watch_id", "listing_id").distinct()
    return matches.join(recent, ["watch_id", "listing_id"], "left_anti")


def create_alerts(candidates: DataFrame, alerts: DataFrame) -> DataFrame:
    """Pairs without a pending alert, once each; of a repeated pair the greatest score stays."""
    pending = alerts.where(~F.col("notified")).select("watch_id", "listing_id")
    return one_per(candidates, ["watch_id", "listing_id"], F.col("score")).join(pending, ["watch_id", "listing_id"], "left_anti")


def undelivered(alerts: DataFrame, attempts: DataFrame) -> DataFrame:
    """alerts of which no attempt succeeded."""
    return alerts.join(attempts.where("succeeded").select("alert_id"), "alert_id", "left_anti")


STATUS = {
    "active": "NOT notified", "dismissed": "dismissed_at IS NOT NULL", "notified": "notified", "undismissed": "dismissed_at IS NULL", "all": "true",
}


def review(alerts: DataFrame, listings: DataFrame, watches: DataFrame, status: str = "active", min_score: int = 0, search: str = "", component: str = "", watch_id: int | None = None) -> DataFrame:
    """Alerts with their listings and watches."""
    rows = alerts.where(STATUS.get(status, STATUS["active"]))
    if min_score > 0:
        rows = rows.where(F.col("score") >= min_score)
    if watch_id is not None:
        rows = rows.where(F.col("watch_id") == watch_id)
    rows = rows.join(listings.select("listing_id", "title", "component_type", "price"), "listing_id").join(small(watches.select("watch_id", "watch_name")), "watch_id")
    if component:
        rows = rows.where(F.col("component_type") == component)
    return rows.where(F.col("title").ilike(f"%{search}%")) if search else rows


def wide(alerts: DataFrame, listings: DataFrame, watches: DataFrame) -> DataFrame:
    """P5: alerts with all columns of their listing and watch, as structs."""
    rows = alerts.join(listings.select("listing_id", F.struct(*listings.columns).alias("listing")), "listing_id")
    return rows.join(small(watches.select("watch_id", F.struct(*watches.columns).alias("watch"))), "watch_id")


REVIEW_ORDERS = {
    "score": [("score", False), ("created_at", False)], "created": [("created_at", False)], "watch": [("watch_name", True), ("score", False)],
}


def review_page(rows: DataFrame, sort: str = "", number: int = 1, per_page: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of review rows, and the count over all of them. Unknown orders go by score; pages start at 1
    and have 25 rows unless said otherwise, 100 at most. Equal rows come by falling alert_id."""
    keys = [F.col(c).asc() if rising else F.col(c).desc() for c, rising in [*REVIEW_ORDERS.get(sort, REVIEW_ORDERS["score"]), ("alert_id", False)]]
    size = 25 if per_page < 1 else min(per_page, 100)
    return rows.orderBy(*keys).offset((max(number, 1) - 1) * size).limit(size), rows.agg(F.count(F.lit(1)).alias("total"))


def judge_candidates(alerts: DataFrame, listings: DataFrame, watches: DataFrame, base: DataFrame, judged: DataFrame, since: str, limit: int = 50) -> DataFrame:
    """Alerts since a moment that are not yet judged, newest first, with what their baselines say; 0 where there is none."""
    rows = alerts.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz")).join(judged.select("alert_id"), "alert_id", "left_anti")
    rows = rows.join(listings.select("listing_id", "product_key", "title", F.col("component_type"), "condition_norm", "price"), "listing_id")
    rows = rows.join(small(watches.select("watch_id", "watch_name", "score_threshold")), "watch_id")
    rows = rows.join(base.select("product_key", "sample_count", "p25", "p50", "p75"), "product_key", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("sample_count", "p25", "p50", "p75")})
    return rows.orderBy(F.col("created_at").desc_nulls_last(), F.col("alert_id")).limit(limit)


def judge_context(candidates: DataFrame) -> DataFrame:
    """What a judge is told about a candidate; a null trace is empty."""
    names = "alert_id watch_name component_type title condition_norm price p25 p50 p75 sample_count score score_threshold".split()
    return candidates.select(*names, F.coalesce("trace_id", F.lit("")).alias("trace_id"))


def cost(rates: DataFrame, judged: DataFrame) -> DataFrame:
    """P10: dollars per row; a model without a rate costs nothing."""
    rows = judged.join(small(rates), "model", "left")
    return rows.withColumn("cost", F.coalesce(F.col("input_tokens") / 1e6 * F.col("input_rate") + F.col("output_tokens") / 1e6 * F.col("output_rate"), F.lit(0.0)))


def verdict(score: Column) -> Column:
    """P11."""
    return F.when(score >= 0.7, "deal").when(score >= 0.3, "edge").otherwise("noise")


def within_budget(rows: DataFrame, cap: float, spent: float = 0.0) -> DataFrame:
    """Rows of any number in order, until what is spent before one reaches the cap."""
    return until_spent(rows, F.unix_micros(F.col("judged_at").cast("timestamp")), ["alert_id"], F.col("cost"), cap, spent)


def in_chunks(alerts: DataFrame, size: int = 10) -> DataFrame:
    """Per watch, in order of score, chunks of at most size."""
    return numbered(alerts, "watch_id", "score", True, "alert_id").withColumn("chunk", F.floor(F.col("_at") / size).cast("int")).drop("_at")


def summary(alerts: DataFrame, listings: DataFrame) -> DataFrame:
    """Alerts per type of listing, and the greatest score."""
    rows = alerts.join(listings.select("listing_id", "component_type"), "listing_id")
    return rows.groupBy("component_type").agg(F.count(F.lit(1)).alias("n_alerts"), F.greatest(F.max("score"), F.lit(0)).alias("max_score"))
