"""The six factors of a deal score and their sum, in double arithmetic in one fixed order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights in the order price, seller, condition, quantity, quality, time.
WEIGHTS = {"price_score": 0.40, "seller_score": 0.20, "condition_score": 0.15, "quantity_score": 0.10, "quality_score": 0.10, "time_score": 0.05}
MIN_SAMPLES = 10


def money(x: Column) -> Column:
    """Rounded as a NUMERIC(10,2) column rounds."""
    return x.cast("decimal(20,6)").cast("decimal(10,2)").cast("double")


def unit_price(price: Column, shipping: Column, quantity: Column) -> Column:
    """P1."""
    total = price + F.coalesce(shipping, F.lit(0.0))
    return F.when(quantity > 1, total / quantity).otherwise(total)


def between(x: Column, low: Column, high: Column, at_low: float, at_high: float) -> Column:
    """M8: linear; a span of no width scores at_low."""
    return F.when(high == low, F.lit(float(at_low))).otherwise(at_low + (x - low) / (high - low) * (at_high - at_low))


def price_score(x: Column, samples: Column, p10: Column, p25: Column, p50: Column, p75: Column, p90: Column) -> Column:
    """M2."""
    cold = samples.isNull() | (samples < MIN_SAMPLES)
    return (
        F.when(cold, 50.0).when(x <= p10, 100.0).when(x <= p25, between(x, p10, p25, 100, 70)).when(x <= p50, between(x, p25, p50, 70, 30))
        .when(x <= p75, between(x, p50, p75, 30, 10)).when(x <= p90, between(x, p75, p90, 10, 0)).otherwise(0.0)
    )


def seller_score(feedback: Column, percent: Column, top_rated: Column) -> Column:
    """M3."""
    count = F.when(feedback >= 5000, 100.0).when(feedback >= 500, 70.0).when(feedback >= 100, 40.0).otherwise(10.0)
    share = F.when(percent >= 99.5, 100.0).when(percent >= 98.0, 80.0).when(percent >= 95.0, 50.0).otherwise(0.0)
    both = (count + share) / 2
    return F.when(top_rated, F.least(both + 20, F.lit(100.0))).otherwise(both)


def condition_score(condition: Column) -> Column:
    """M4."""
    return F.when(condition == "new", 100.0).when(condition == "like_new", 90.0).when(condition == "used_working", 70.0).when(condition == "for_parts", 10.0).otherwise(40.0)


def quantity_score(quantity: Column) -> Column:
    """M5."""
    return F.when(quantity >= 16, 90.0).when(quantity >= 8, 80.0).when(quantity >= 4, 70.0).when(quantity > 1, 60.0).otherwise(50.0)


def quality_score(images: Column, specifics: Column, description: Column) -> Column:
    """M6."""
    length = F.when(description > 500, 30.0).when(description > 200, 20.0).when(description > 50, 10.0).otherwise(0.0)
    return F.least(F.when(images, 40.0).otherwise(0.0) + F.when(specifics, 30.0).otherwise(0.0) + length, F.lit(100.0))


def no_attributes(json: Column) -> Column:
    """attributes that are null or an object without members."""
    return json.isNull() | F.rlike(json, F.lit(r"^\s*\{\s*\}\s*$"))


def inputs(as_of: str) -> dict[str, Column]:
    """What the last two factors look at, from the columns of a listing. An auction whose end has passed ends soon."""
    now, auction = F.lit(as_of).cast("timestamp_ntz"), F.col("listing_type") == "auction"
    return {
        "has_images": F.coalesce("image_url", F.lit("")) != "", "has_specifics": ~no_attributes(F.col("attributes")), "is_auction": auction,
        "ending_soon": auction & F.coalesce(F.col("auction_end_at") < now + F.expr("INTERVAL 4 HOURS"), F.lit(False)),
        "is_new": F.col("first_seen_at") > now - F.expr("INTERVAL 24 HOURS"),
    }


def time_score(auction: Column, ending_soon: Column, new: Column) -> Column:
    """M7."""
    return F.when(auction & ending_soon, 100.0).when(new, 80.0).otherwise(30.0)


def total(factors: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """M1: half rounds away from zero, within 0 to 100."""
    weights = weights or WEIGHTS
    terms = [factors[k] * F.lit(w) for k, w in weights.items()]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return F.least(F.greatest(F.round(out), F.lit(0.0)), F.lit(100.0)).cast("int")
