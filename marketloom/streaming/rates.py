"""Streaming forms: windowed event rates with a watermark, and alerts deduplicated while their key is remembered."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streaming_rates(events: DataFrame, window: str = "5 minutes", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts per window and label; state of windows past the watermark is dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.window("ts", window), by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), by, "n")


def deduplicated_alerts(alerts: DataFrame, cooldown: str = "24 hours") -> DataFrame:
    """One alert per watch and listing within the cooldown."""
    return alerts.withWatermark("created_at", cooldown).dropDuplicatesWithinWatermark(["watch_id", "listing_id"])


def outside_cooldown(alerts: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """Alerts (watch_id, listing_id, created_at, score) of a pair that come hours or more after the last one that
    went out. A pair's state is the time of that alert, and goes when the watermark has passed its cooldown."""
    cooldown = pd.Timedelta(hours=hours)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values(["created_at", "score"], ascending=[True, False]).itertuples(index=False):
            at = pd.Timestamp(row.created_at).tz_localize(None)
            if last is None or at - last >= cooldown:
                last = at
                out.append((*key, row.created_at, row.score))
        state.update((last.value // 1000,))
        state.setTimeoutTimestamp(max((last + cooldown).value // 1_000_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["watch_id", "listing_id", "created_at", "score"])

    timed = alerts.select("watch_id", "listing_id", F.col("created_at").cast("timestamp").alias("created_at"), "score").withWatermark("created_at", late)
    kinds = dict(timed.dtypes)
    schema = f"watch_id {kinds['watch_id']}, listing_id {kinds['listing_id']}, created_at timestamp, score {kinds['score']}"
    return timed.groupBy("watch_id", "listing_id").applyInPandasWithState(run, schema, "sent_at long", "append", GroupStateTimeout.EventTimeTimeout)
