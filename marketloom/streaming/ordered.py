"""Streams whose rows are looked at in order of time, whatever order they come in: typed state and timers.

Rows of a key wait in state until the watermark has passed their time; then they are taken in order, with what was kept of
the row before. Results are those of the batch forms, over any order of arrival within the watermark's delay; rows later
than that are dropped by it. The query needs the RocksDB state store (ROCKSDB), which keeps waiting rows off the heap.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The setting that these streams need, and its value.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Rows are (key, at in microseconds, id, value); step gives what is kept next and the row that goes out, if any."""

    KEPT = "at long, value double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", self.KEPT)
        self.waiting = handle.getListState("waiting", "at long, id long, value double")

    def step(self, kept: tuple | None, at: int, value: float) -> tuple[tuple, float | None]:
        raise NotImplementedError

    def forget_after(self) -> int | None:
        """Microseconds after the last row from which nothing needs to be kept; None keeps it for good."""
        return None

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.waiting.appendList([(int(a), int(i), float(v)) for a, i, v in zip(frame["at"], frame["id"], frame["value"], strict=True)])
            for at in {int(a) for a in frame["at"]}:
                self.handle.registerTimer(-(-at // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(map(tuple, self.waiting.get()))
        due = [r for r in rows if r[0] <= now]
        kept = tuple(self.kept.get()) if self.kept.exists() else None
        if due:
            self.waiting.put([r for r in rows if r[0] > now]) if len(due) < len(rows) else self.waiting.clear()
        out = []
        for at, number, value in due:
            kept, said = self.step(kept, at, value)
            if said is not None:
                out.append((*key, at, number, said))
        if due:
            self.kept.update(kept)
            if self.forget_after() is not None:
                self.handle.registerTimer((kept[0] + self.forget_after()) // 1000 + 1)
        elif kept and self.forget_after() is not None and kept[0] + self.forget_after() < now:
            self.kept.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "at", "id", "said"])

    def close(self) -> None:
        pass


class Deltas(InOrder):
    """What a counter grew by since its sample before; a fall is a reset."""

    def step(self, kept, at, value):
        grown = 0.0 if kept is None else value if value < kept[1] else value - kept[1]
        return (at, value), grown


class Cooldown(InOrder):
    """Alerts that come a cooldown or more after the last that went out; nothing older is kept."""

    def __init__(self, microseconds: int):
        self.cooldown = microseconds

    def step(self, kept, at, value):
        if kept is not None and at - kept[0] < self.cooldown:
            return kept, None
        return (at, value), value

    def forget_after(self):
        return self.cooldown


def _ordered(rows: DataFrame, keys: list[str], time: str, number: str, value: str, late: str, processor: InOrder) -> DataFrame:
    key = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    timed = rows.select(key.alias("key"), F.col(time).cast("timestamp").alias("ts"), F.col(number).cast("long").alias("id"), F.col(value).cast("double").alias("value")).withWatermark("ts", late)
    timed = timed.withColumn("at", F.unix_micros("ts"))
    return timed.groupBy("key").transformWithStateInPandas(processor, "key string, at long, id long, said double", "Append", "EventTime")


def streamed_deltas(samples: DataFrame, series: str = "name", late: str = "10 minutes") -> DataFrame:
    """Series, ts, id and delta of every sample of counters (ts, id, value), as series.deltas gives them."""
    kind = dict(samples.dtypes)[series]
    out = _ordered(samples, [series], "ts", "id", "value", late, Deltas())
    return out.select(F.from_json("key", f"`{series}` {kind}")[series].alias(series), F.timestamp_micros("at").alias("ts"), "id", F.col("said").alias("delta"))


def streamed_cooldown(alerts: DataFrame, hours: int = 24, late: str = "1 hour") -> DataFrame:
    """Alerts (watch_id, listing_id, created_at, alert_id, score) of a pair that come hours or more after the last
    one that went out."""
    kinds = dict(alerts.dtypes)
    out = _ordered(alerts, ["watch_id", "listing_id"], "created_at", "alert_id", "score", late, Cooldown(hours * 3_600_000_000))
    pair = F.from_json("key", f"watch_id {kinds['watch_id']}, listing_id {kinds['listing_id']}")
    return out.select(pair["watch_id"].alias("watch_id"), pair["listing_id"].alias("listing_id"), F.timestamp_micros("at").alias("created_at"), F.col("id").alias("alert_id"), F.col("said").cast(kinds["score"]).alias("score"))
