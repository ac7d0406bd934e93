"""Rates, increases, histogram quantiles and alert rules over samples, per series."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def second(c: str) -> Column:
    return F.unix_timestamp(F.col(c).cast("timestamp"))


def deltas(samples: DataFrame, series: str, seconds: int) -> DataFrame:
    """samples with delta: what a counter grew by since its sample before; a fall is a reset, after which it counts from
    zero. Series are cut into ranges of time, and the last sample of a range is carried to the next that has one."""
    rows = samples.withColumn("_range", F.floor(second("ts") / seconds))
    ends = rows.groupBy(F.col(series).alias("_of"), F.col("_range").alias("_at")).agg(F.max_by("value", F.struct("ts", "id")).alias("_last"))
    ends = ends.withColumn("_carried", F.lag("_last").over(W.partitionBy("_of").orderBy("_at"))).drop("_last")
    rows = rows.join(ends, F.col(series).eqNullSafe(F.col("_of")) & (F.col("_range") == F.col("_at"))).drop("_of", "_at")
    before = F.coalesce(F.lag("value").over(W.partitionBy(series, "_range").orderBy("ts", "id")), "_carried")
    delta = F.col("value") - before
    return rows.withColumn("delta", F.when(delta < 0, F.col("value")).otherwise(F.coalesce(delta, F.lit(0.0)))).drop("_carried")


def increase(samples: DataFrame, series: str = "name", seconds: int = 300) -> DataFrame:
    """Growth of a counter over the trailing range, between samples in it and the one before; nothing is added
    for the ends of the range that no sample covers. Ranges of time are as long as the trailing one, which so is the end
    of one of them and the start of the next: two running sums, whose cost does not grow with the samples of a range.
    """
    rows = deltas(samples, series, seconds).withColumn("_into", F.pmod(second("ts"), F.lit(seconds)))
    both = rows.withColumn("_seen", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_part", F.col("_range") + F.col("_seen"))
    part = W.partitionBy(series, "_part")
    running = lambda seen, order: F.sum(F.when(F.col("_seen") == seen, F.col("delta"))).over(part.orderBy(order).rangeBetween(W.unboundedPreceding, W.currentRow))
    up, down = running(0, F.col("_into")), F.coalesce(running(1, F.col("_into").desc()), F.lit(0.0))
    return both.withColumn("increase", up + down).where("_seen = 0").drop("_seen", "_part", "_range", "_into")


def rate_at(samples: DataFrame, series: str, labels: list[str], step: int = 60, seconds: int = 300) -> DataFrame:
    """Sum by labels of the growth a second of counters, at ticks of the clock, over the seconds up to each.

    Deltas are summed by tick first; a tick's sum counts for all ticks whose range it lies in.
    """
    grown = deltas(samples, series, 3600).groupBy((F.ceil(second("ts") / step) * step).alias("tick"), *labels).agg(F.sum("delta").alias("delta"))
    seen = grown.withColumn("later", F.explode(F.sequence(F.lit(0), F.lit(seconds - step), F.lit(step)))).withColumn("tick", F.col("tick") + F.col("later"))
    return seen.groupBy(F.timestamp_seconds("tick").cast("timestamp_ntz").alias("tick"), *labels).agg((F.sum("delta") / seconds).alias("rate"))


def range_ends(samples: DataFrame, series: list[str], step: int, seconds: int) -> DataFrame:
    """tick, series, n, first_ts, first_value, last_ts, grown: of the samples in (tick - seconds, tick], at ticks of the clock.

    Samples are summed up by step first, with what the first of each step grew by kept apart; a step counts for the ticks
    whose range it lies in, so a sample is not copied, only its step's row.
    """
    of = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0002")) for c in series])
    rows = deltas(samples.withColumn("_series", of), "_series", 3600).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    order = F.struct("at", "id")
    steps = rows.groupBy(*series, (F.ceil(F.col("at") / step) * step).alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.struct("at", "value", "delta"), order).alias("first"), F.max("at").alias("last"), F.sum("delta").alias("grown")
    )
    seen = steps.withColumn("later", F.explode(F.sequence(F.lit(0), F.lit(seconds - step), F.lit(step)))).withColumn("tick", F.col("step") + F.col("later"))
    ends = seen.groupBy("tick", *series).agg(F.sum("n").alias("n"), F.min_by("first", "step").alias("first"), F.max("last").alias("last_ts"), F.sum("grown").alias("grown"))
    return ends.select("tick", *series, "n", F.col("first.at").alias("first_ts"), F.col("first.value").alias("first_value"), "last_ts", (F.col("grown") - F.col("first.delta")).alias("grown"))


def extrapolated(samples: DataFrame, series: list[str], step: int = 60, seconds: int = 300) -> DataFrame:
    """Increase and rate of counters with the ends of the range filled in: tick, series, increase, rate.

    What samples grew by is stretched to the range's ends where the nearest sample is within 1.1 of the average gap, by
    half a gap where it is not, and at the start no further than to where the counter would be zero. A range with fewer
    than two samples has no row.
    """
    rows = range_ends(samples, series, step, seconds).where((F.col("n") > 1) & (F.col("last_ts") > F.col("first_ts")))
    between = F.col("last_ts") - F.col("first_ts")
    gap = between / (F.col("n") - 1)
    near = gap * 1.1
    start, end = F.col("first_ts") - (F.col("tick") - seconds), F.col("tick") - F.col("last_ts")
    start = F.when(start < near, start).otherwise(gap / 2)
    to_zero = F.when((F.col("grown") > 0) & (F.col("first_value") >= 0), between * (F.col("first_value") / F.col("grown")))
    start = F.least(start, F.coalesce(to_zero, start))
    end = F.when(end < near, end).otherwise(gap / 2)
    increase = F.col("grown") * ((between + start + end) / between)
    tick = F.timestamp_seconds("tick").cast("timestamp_ntz").alias("tick")
    return rows.select(tick, *series, increase.alias("increase"), (increase / seconds).alias("rate"))


def instant(samples: DataFrame, series: list[str], step: int = 60, lookback: int = 300) -> DataFrame:
    """What a gauge shows at ticks of the clock: its newest sample, unless that is older than the lookback."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    newest = samples.groupBy(*series, (F.ceil(at / step) * step).alias("step")).agg(F.max_by("value", F.struct("ts", "id")).alias("value"))
    seen = newest.withColumn("later", F.explode(F.sequence(F.lit(0), F.lit(lookback - step), F.lit(step)))).withColumn("tick", F.col("step") + F.col("later"))
    return seen.groupBy(F.timestamp_seconds("tick").cast("timestamp_ntz").alias("tick"), *series).agg(F.max_by("value", "step").alias("value"))


def rate_quantile(rates: DataFrame, q: float, by: list[str], value: str = "rate") -> DataFrame:
    """By and the quantile of histograms given as rates of their buckets (by, le, rate); le of the last is infinite.

    Rates of one le are added up. A bucket that lacks, or has less than one below it, counts as much as that one. The rank
    is looked for among the finite bounds; beyond them the greatest bound is given. Without an infinite bucket, or where
    nothing was counted, there is no quantile: null.
    """
    sums = rates.groupBy(*by, "le").agg(F.sum(value).alias("_rate"))
    hist = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("le", F.col("_rate").alias("cum")))).alias("b"))  # one entry a bound
    repaired = F.transform("b", lambda x, i: F.struct(x["le"].alias("le"), F.array_max(F.transform(F.slice("b", 1, i + 1), lambda y: y["cum"])).alias("cum")))
    hist = hist.withColumn("b", repaired).withColumn("last", F.element_at("b", -1))
    rank = F.col("last.cum") * F.lit(q)
    k = F.size(F.filter("b", lambda x: x["cum"] < rank))
    hit, prior = F.get("b", k), F.get("b", k - 1)
    low = F.when(k == 0, F.least(F.lit(0.0), hit["le"])).otherwise(prior["le"])
    below = F.when(k == 0, 0.0).otherwise(prior["cum"])
    inside = F.when((k == 0) & (hit["le"] <= 0), hit["le"]).otherwise(low + (hit["le"] - low) * (rank - below) / (hit["cum"] - below))
    highest = F.get("b", F.size("b") - 2)["le"]
    known = (F.col("last.le") == float("inf")) & (F.col("last.cum") > 0) & (F.size("b") > 1)
    return hist.select(*by, F.when(known, F.when(hit["le"] == float("inf"), highest).otherwise(inside)).alias("quantile"))


def per_minute(rate: Column) -> Column:
    """R10."""
    return rate * 60


def rates(events: DataFrame, minutes: int = 5, by: list[str] | None = None) -> DataFrame:
    """Events in each window of the clock; rate_at has rates of counters."""
    start = F.timestamp_seconds(F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / (60 * minutes)) * (60 * minutes)).cast("timestamp_ntz")
    return events.groupBy(start.alias("window_start"), *(by or [])).agg(F.count(F.lit(1)).alias("n"))


def buckets(values: DataFrame, bounds: list[float], by: str) -> DataFrame:
    """Cumulative counts of values up to each bound, without a row per value and bound."""
    counts = values.groupBy(by).agg(*[F.count_if(F.col("value") <= b).alias(f"b{k}") for k, b in enumerate(bounds)], F.count(F.lit(1)).alias("total"))
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{k}").alias("cum")) for k, b in enumerate(bounds)])
    return counts.select(by, "total", pairs.alias("buckets"))


def quantile(hist: DataFrame, q: float) -> DataFrame:
    """The first bucket that reaches the rank, linear within it; beyond the last bound, that bound."""
    rank = F.col("total") * F.lit(q)
    upto = F.filter("buckets", lambda b: b["cum"] < rank)
    k = F.size(upto)
    low, below = F.when(k == 0, 0.0).otherwise(F.get(upto, k - 1)["le"]), F.when(k == 0, 0).otherwise(F.get(upto, k - 1)["cum"])
    hit = F.get("buckets", k)
    inside = low + (hit["le"] - low) * (rank - below) / (hit["cum"] - below)
    return hist.withColumn("quantile", F.when(hit.isNull(), F.element_at("buckets", -1)["le"]).otherwise(inside))


def held(ticks: DataFrame, series: str, minutes: int | Column, step: int = 60) -> DataFrame:
    """Whether a condition is true at a tick and has been for so many minutes since its first true tick. A tick that
    is missing (more than step minutes between two) ends what was true."""
    order = W.partitionBy(series).orderBy("ts")
    at, on = second("ts"), F.coalesce("condition", F.lit(False))
    fresh = on & ~(F.lag(on, 1, False).over(order) & (at - F.lag(at).over(order) <= 60 * step))
    rows = ticks.withColumn("_since", F.when(fresh, at)).withColumn("_since", F.last("_since", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    return rows.withColumn("firing", on & (at - F.col("_since") >= minutes * 60)).drop("_since")


#: Alert rules over a row of metrics a tick: what must hold, and for how many minutes.
ALERT_RULES = {
    "down": ("up IS NULL", 2), "readiness_down": ("readyz_up = 0", 2), "high_error_rate": ("http_errors / http_requests > 0.05", 5),
    "ingestion_errors": ("ingestion_errors > 0", 5), "extraction_failures": ("extraction_failures > 0.1", 5), "quota_high": ("quota_remaining < 1000", 5),
    "limit_reached": ("limit_hits > 0", 0), "notification_failures": ("notification_failures > 0", 1), "no_ingestion": ("ingestion_age > 1800", 5),
    "pending_backlog": ("alerts_pending > 50", 10), "notification_silence": ("notification_age > 86400", 5),
    "low_coverage": ("baselines_warm / (baselines_warm + baselines_cold + keys_without_baseline) < 0.5", 30),
}


def rule_states(ticks: DataFrame, step: int = 1, rules: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Ts, rule, firing, from rows of metrics a tick; a metric that the rows lack is null. What is unknown is not true."""
    rules = rules or ALERT_RULES
    known = set(ticks.columns)
    names = {w for text, _ in rules.values() for w in re.findall(r"[a-z_]+", text)}
    rows = ticks.withColumns({n: F.lit(None).cast("double") for n in sorted(names - known)})
    # One pass: all conditions of a tick in one array, a row a rule, and one window by rule.
    each = [F.struct(F.lit(name).alias("rule"), F.expr(text).alias("condition"), F.lit(minutes).alias("minutes")) for name, (text, minutes) in rules.items()]
    stacked = rows.select("ts", F.explode(F.array(*each)).alias("x")).select("ts", "x.*")
    return held(stacked, "rule", F.col("minutes"), step).select("ts", "rule", "firing")


def absent(samples: DataFrame, start: str, end: str, minutes: int) -> DataFrame:
    """Ticks of the range in which no sample was seen; the spine has one row a tick."""
    at = lambda c: F.timestamp_seconds(F.floor(F.unix_timestamp(F.col(c).cast("timestamp")) / (60 * minutes)) * (60 * minutes)).cast("timestamp_ntz")
    spine = samples.sparkSession.sql(f"SELECT explode(sequence(timestamp_ntz'{start}', timestamp_ntz'{end}', INTERVAL {int(minutes)} MINUTES)) AS ts")
    return spine.join(samples.select(at("ts").alias("ts")).distinct(), "ts", "left_anti")


def latest(samples: DataFrame, series: str = "name") -> DataFrame:
    """The newest sample of each series; of equal times, the greatest value."""
    return samples.groupBy(series).agg(F.max_by("value", F.struct("ts", "value")).alias("value"), F.max("ts").alias("ts"))


def gauges(samples: DataFrame, series: str = "name", by: list[str] | None = None) -> DataFrame:
    """The greatest and the sum of the newest samples of all series, by labels."""
    newest = samples.groupBy(*dict.fromkeys([series, *(by or [])])).agg(F.max_by("value", F.struct("ts", "value")).alias("value"))
    return newest.groupBy(*(by or [])).agg(F.max("value").alias("max"), F.sum("value").alias("sum"))


def percent(part, whole):
    """Null where there is nothing to divide by."""
    return F.when(whole != 0, part * 100.0 / whole)


def freshness(samples: DataFrame, as_of: str, series: str = "name") -> DataFrame:
    """Seconds since the newest positive gauge of each series."""
    newest = samples.where(F.col("value") > 0).groupBy(series).agg(F.max("value").alias("newest"))
    return newest.select(series, (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.col("newest")).alias("age_seconds"))
