"""State transitions as functions of a table and its input; each returns the new rows or the changed ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def one_per(rows: DataFrame, keys: list[str], *best: Column) -> DataFrame:
    """One row per key: the greatest by best, and of equal ones that of the greatest JSON, so that reruns agree."""
    names = [c for c in rows.columns if c not in keys]
    if not names:
        return rows.distinct()
    others = F.struct(*names)
    picked = rows.groupBy(*keys).agg(F.max_by(others, F.struct(*best, F.to_json(others))).alias("_row"))
    return picked.select(*[c if c in keys else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def upsert(old: DataFrame, new: DataFrame, key: str, overwritten: list[str], as_of: str) -> DataFrame:
    """Known keys keep all columns but the overwritten ones, unknown keys are added, both become active. Of new rows
    that repeat a key, one_per says which counts."""
    fresh = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in new.columns if c != key])
    fresh = one_per(fresh, ["_key"])
    both = old.join(fresh, F.col(key) == F.col("_key"), "full")
    came = F.col("_key").isNotNull()

    def pick(c: str):
        if c == key:
            return F.coalesce(key, "_key").alias(c)
        if c == "active":
            return (came | F.col("active")).alias(c)
        if c == "updated_at":
            return F.when(came, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col(c)).alias(c)
        if f"_{c}" not in fresh.columns:
            return F.col(c)
        return (F.when(came, F.col(f"_{c}")).otherwise(F.col(c)) if c in overwritten else F.coalesce(c, f"_{c}")).alias(c)

    return both.select(*[pick(c) for c in old.columns])


def claim(queue: DataFrame, n: int) -> DataFrame:
    """The n jobs that a worker gets, with one more attempt."""
    free = queue.where(~F.col("completed") & ~F.col("claimed"))
    return free.orderBy(F.col("priority").desc(), "enqueued_at", "job_id").limit(n).withColumns({"claimed": F.lit(True), "attempts": F.col("attempts") + 1})


def claimed(queue: DataFrame, n: int) -> DataFrame:
    """The whole queue after n jobs were claimed."""
    return apply_updates(queue, claim(queue, n).select("job_id", "claimed", "attempts"), "job_id")


def dismiss(alerts: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """The rows that change, dismissed now."""
    return alerts.where(F.col("dismissed_at").isNull()).join(ids, "alert_id", "left_semi").withColumn("dismissed_at", F.lit(as_of).cast("timestamp_ntz"))


def restore(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    return alerts.where(F.col("dismissed_at").isNotNull()).join(ids, "alert_id", "left_semi").withColumn("dismissed_at", F.lit(None).cast("timestamp_ntz"))


def latest(rows: DataFrame, key: str, *order) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def orphans(base: DataFrame, listings: DataFrame) -> DataFrame:
    """Baselines of keys that no listing has."""
    return base.join(listings.select("product_key").distinct(), "product_key", "left_anti")


#: Pages that a feed's first poll may take.
FIRST_RUN_PAGES = 5


def known_prefix(feed: DataFrame, known: DataFrame, page_size: int, max_pages: int) -> DataFrame:
    """Of an ordered feed (pos, key), what comes before the first known row and within max_pages."""
    feed = feed.where(F.col("pos") < page_size * max_pages)
    first = feed.join(known, "key", "left_semi").agg(F.min("pos").alias("first"))
    return feed.join(F.broadcast(first)).where(F.col("first").isNull() | (F.col("pos") < F.col("first"))).drop("first")


def paging(feed: DataFrame, known: DataFrame, by: str, page_size: int, max_pages: int, first_run: str | None = None) -> DataFrame:
    """For each of many ordered feeds (by, pos, key): new_listings, total_seen, pages_used and stopped_at.

    A feed is read page by page until it comes to a known row, ends or has used its pages: max_pages, and on a first run
    (a boolean column of feed) FIRST_RUN_PAGES at most. All feeds are told at once, from where their first known row is
    and how long they are; a feed without rows is not in feed and so has no row here.
    """
    first = F.bool_or(first_run) if first_run else F.lit(False)
    seen = feed.join(known.select("key", F.lit(True).alias("_known")).distinct(), "key", "left")
    by_feed = seen.groupBy(by).agg(F.min(F.when(F.col("_known"), F.col("pos"))).alias("hit"), F.count(F.lit(1)).alias("n"), first.alias("first"))
    pages = F.when(F.col("first"), F.lit(min(max_pages, FIRST_RUN_PAGES))).otherwise(F.lit(max_pages))
    by_feed = by_feed.withColumn("most", pages * page_size).withColumn("hit", F.when(F.col("hit") < F.col("most"), F.col("hit")))
    ended = F.col("hit").isNull() & (F.col("n") <= F.col("most"))
    used = F.when(F.col("hit").isNotNull(), F.floor(F.col("hit") / page_size) + 1).when(ended, F.ceil(F.col("n") / page_size)).otherwise(pages)
    total = F.when(F.col("hit").isNotNull(), F.col("hit") + 1).otherwise(F.least("n", "most"))
    return by_feed.select(
        by, F.coalesce("hit", F.least("n", "most")).cast("long").alias("new_listings"), total.cast("long").alias("total_seen"), used.cast("long").alias("pages_used"),
        F.when(F.col("hit").isNotNull(), "known_listing").when(ended, "no_more_results").otherwise("max_pages").alias("stopped_at"),
    )


def insert_unless(new: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """The rows to add: once per key (one_per says which), and none of a key that is taken."""
    return one_per(new, keys).join(taken.select(*keys), keys, "left_anti")


def apply_updates(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Columns of the updates replace those of rows with their key; nulls replace too.

    Of updates that repeat a key, one_per says which counts; other rows and columns stay as they are, unknown keys add
    nothing (upserted adds them).
    """
    updates = one_per(updates, [key])
    names = [c for c in updates.columns if c != key]
    new = updates.select(F.col(key), F.struct(*names).alias("_new"))
    rows = table.join(new, key, "left")
    return rows.select(*[F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in table.columns])


def upserted(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Like apply_updates, and rows of unknown keys are added, null where the updates say nothing."""
    new = one_per(updates, [key]).join(table.select(key), key, "left_anti")
    return apply_updates(table, updates, key).unionByName(new, allowMissingColumns=True)


def set_enabled(watches: DataFrame, watch_id: int, enabled: bool) -> DataFrame:
    """One watch turned on or off."""
    return watches.withColumn("enabled", F.when(F.col("watch_id") == watch_id, F.lit(enabled)).otherwise(F.col("enabled")))


def scored_back(listings: DataFrame, scored: DataFrame, factors: list[str]) -> DataFrame:
    """Listings with their score and, as a struct, the factors it was made of."""
    new = scored.select("listing_id", "score", F.struct(*factors).alias("score_breakdown"))
    return listings.drop("score", "score_breakdown").join(new, "listing_id", "left")


def partial_update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Like apply_updates, but a null leaves the old value."""
    names = [c for c in changes.columns if c != key]
    rows = table.join(changes.select(key, *[F.col(c).alias(f"_{c}") for c in names]), key, "left")
    return rows.select(*[F.coalesce(f"_{c}", c).alias(c) if c in names else F.col(c) for c in table.columns])


def merged_filters(old, new):
    """Maps merged, with the new value where both have a key; nulls count as empty."""
    return F.when(new.isNull(), old).when(old.isNull(), new).otherwise(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new))


def refreshed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new lacks."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"))


def completed(queue: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Outcomes (job_id, error); an empty error is none."""
    return apply_updates(queue, outcomes.select("job_id", F.lit(True).alias("completed"), F.nullif("error", F.lit("")).alias("error_text")), "job_id")


def swept_runs(runs: DataFrame, as_of: str, stale_hours: int = 2, keep_days: int = 30) -> DataFrame:
    """Runs that still run after stale_hours have crashed; those older than keep_days are gone."""
    now = F.lit(as_of).cast("timestamp_ntz")
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"INTERVAL {int(stale_hours)} HOURS"))
    rows = runs.where(F.col("started_at") >= now - F.expr(f"INTERVAL {int(keep_days)} DAYS"))
    return rows.withColumns({"status": F.when(stale, "crashed").otherwise(F.col("status")), "completed_at": F.when(stale, now).otherwise(F.col("completed_at"))})


def without_watches(alerts: DataFrame, gone: DataFrame) -> DataFrame:
    """Alerts after their watches were deleted."""
    return alerts.join(gone.select("watch_id"), "watch_id", "left_anti")


def after(rows: DataFrame, cursor, n: int = 200, key: str = "listing_id") -> DataFrame:
    """The next n rows behind a cursor; None starts."""
    return (rows if cursor is None else rows.where(F.col(key) > cursor)).orderBy(key).limit(n)


def drain(queue: DataFrame, listings: DataFrame) -> DataFrame:
    """How far the jobs of the given listings are."""
    failed = F.col("error_text").isNotNull()
    done = F.col("completed")
    return queue.join(listings.select("listing_key").distinct(), "listing_key", "left_semi").agg(
        F.count_if(~done).alias("pending"), F.count_if(done & ~failed).alias("done_ok"), F.count_if(done & failed).alias("done_err")
    )
