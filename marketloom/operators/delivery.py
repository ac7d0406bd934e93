"""Alerts on their way out: payloads, embeds, batches of which a part was sent, and details with their history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts as X
from .alerts import wide
from .market import small
from .ranks import numbered

# Colours from scores of 90, from 80, and below.
GREEN, YELLOW, ORANGE = 0x2ECC71, 0xF1C40F, 0xE67E22
CUTS = {"worker": (0.3, 0.7), "report": (0.33, 0.66)}


def colour(score: Column) -> Column:
    """P9."""
    return F.when(score >= 90, GREEN).when(score >= 80, YELLOW).otherwise(ORANGE)


def report_verdict(score: Column) -> Column:
    """The report cuts at other scores than the worker."""
    low, high = CUTS["report"]
    return F.when(score < low, "noise").when(score < high, "edge").otherwise("deal")


def payloads(rows: DataFrame) -> DataFrame:
    """Rows of alerts with listing and watch, with texts as they go out."""
    texts = {"price_text": X.dollars(F.col("price")), "unit_price_text": X.dollars(F.col("unit_price"))}
    return rows.withColumns(texts | {"seller_text": F.format_string("%s (%d)", F.coalesce("seller_name", F.lit("")), F.coalesce("seller_feedback_score", F.lit(0)))})


def retry_payloads(rows: DataFrame) -> DataFrame:
    """Without a sign and without shipping in the unit price."""
    unit = F.when(F.col("quantity") > 1, F.col("price") / F.col("quantity")).otherwise(F.col("price"))
    return rows.withColumns({"price_text": X.plain_money(F.col("price")), "unit_price_text": X.plain_money(unit), "seller_text": F.col("seller_name")})


def embeds(rows: DataFrame) -> DataFrame:
    """One embed a payload, with six inline fields in fixed order."""
    pairs = [("Score", F.concat(F.col("score").cast("string"), F.lit("/100"))), ("Price", F.col("price_text")), ("Unit Price", F.col("unit_price_text")), ("Seller", F.col("seller_text")), ("Condition", F.col("condition_norm")), ("Type", F.col("component_type"))]
    fields = F.array(*[F.struct(F.lit(n).alias("name"), F.coalesce(v, F.lit("")).alias("value"), F.lit(True).alias("inline")) for n, v in pairs])
    embed = F.struct(F.concat(F.lit("Deal Alert: "), F.col("title")).alias("title"), F.col("item_url").alias("url"), colour(F.col("score")).alias("color"), fields.alias("fields"), F.nullif("image_url", F.lit("")).alias("thumbnail"))
    return rows.withColumn("embed", embed)


def messages(rows: DataFrame, by: str = "watch_id", size: int = 10) -> DataFrame:
    """One row a message: the embeds of up to size alerts of a watch, in order of chunk (as in_chunks deals them)."""
    return rows.groupBy(by, "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("score"), "alert_id", "embed"))), lambda x: x["embed"]).alias("embeds"))


def summary_embed(by_type: DataFrame) -> DataFrame:
    """One message for all types (component_type, n_alerts, max_score): a row a type comes in, one goes out."""
    total, top = F.coalesce(F.sum("n_alerts"), F.lit(0)), F.greatest(F.max("max_score"), F.lit(0))
    fields = F.array_sort(F.collect_list(F.struct(F.col("component_type").alias("name"), F.col("n_alerts").cast("string").alias("value"))))
    return by_type.agg(F.concat(total.cast("string"), F.lit(" new alerts (top score "), top.cast("string"), F.lit(")")).alias("title"), top.alias("score"), fields.alias("fields"))


def attempts(batch: DataFrame, outcomes: DataFrame, as_of: str, by: str = "watch_id", order: str = "alert_id", width: int = 65536) -> DataFrame:
    """One attempt per alert of each ordered batch; the first sent of it succeeded, the rest has the error.

    outcomes: one row a batch (by, sent, error). A count outside the batch is as good as its nearest end. order is a
    number, of which ranges of width are counted before rows are.
    """
    placed = numbered(batch.select(by, order), by, order, False, width=width).join(small(outcomes), by)
    done = F.col("_at") < F.coalesce("sent", F.lit(0))
    return placed.select(order, by, done.alias("succeeded"), F.when(~done, F.coalesce("error", F.lit(""))).otherwise("").alias("error_text"), F.lit(as_of).cast("timestamp_ntz").alias("attempted_at"))


def details(alerts: DataFrame, listings: DataFrame, watches: DataFrame, tried: DataFrame) -> DataFrame:
    """Alerts with listing and watch nested and their attempts, newest first; alerts without attempts have an empty list."""
    entry = F.struct("attempted_at", "succeeded", "error_text")
    history = tried.groupBy("alert_id").agg(F.sort_array(F.collect_list(entry), asc=False).alias("history"))
    return wide(alerts, listings, watches).join(history, "alert_id", "left").withColumn("history", F.coalesce("history", F.array().cast("array<struct<attempted_at: timestamp_ntz, succeeded: boolean, error_text: string>>")))
