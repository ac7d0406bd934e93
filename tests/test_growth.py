"""Forms that do their work by parts: watch index, paged feeds, rolling baselines, budget cuts, ranges of counters."""

import json
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketloom.operators import alerts, budget, market, ranks, rolling, series, state, watch_index
from marketloom.sources import feed, paged

LISTING = "listing_id long, component_type string, score int, unit_price double, seller_feedback_score int, seller_feedback_pct double, seller_top_rated boolean, condition_norm string, attributes string"
WATCH = "watch_id long, component_type string, score_threshold int, price_max double, price_min double, min_feedback int, min_feedback_pct double, top_rated_only boolean, conditions string, enabled boolean, attribute_filters string"


def market_rows(seed, n_listings, n_watches):
    r = random.Random(seed)
    prices = [None, 0.0, -3.0, 0.001, 50.0, 99.99, 100.0, 100.01, 2.0**24, 1e12, float("nan"), float("inf")]
    price = lambda: r.choice(prices) if r.random() < 0.3 else r.lognormvariate(5, 2)
    kinds = ["ram", "drive", None]
    listings = [
        (k, r.choice(kinds), r.choice([None, *range(0, 101, 5)]), price(), r.choice([None, 0, 5, 499, 500, 10_000]), r.choice([None, 95.0, 99.5]), r.choice([None, True, False]), r.choice([None, "new", "used"]), "{}")
        for k in range(n_listings)
    ]
    watches = []
    for k in range(n_watches):
        low, high = r.choice([None, price()]), r.choice([None, price()])
        watches.append((k, r.choice(kinds), r.choice(range(0, 101, 10)), high, low, r.choice([None, 0, 500, 501, 7]), r.choice([None, 99.0]), r.random() < 0.2, r.choice(["", "new", "used,new"]), r.random() < 0.9, None))
    return listings, watches


@pytest.mark.parametrize("bound", [0, None])
def test_index_gives_what_the_whole_join_gives(spark, monkeypatch, bound):
    if bound is not None:
        monkeypatch.setattr(watch_index, "BROADCAST_CHUNKS", bound)
        monkeypatch.setattr(watch_index, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(watch_index, "CHUNK", 3)
    listings, watches = market_rows(5, 300, 120)
    left, right = spark.createDataFrame(listings, LISTING), spark.createDataFrame(watches, WATCH)
    found = sorted(map(tuple, alerts.watch_matches(left, right).select("listing_id", "watch_id").collect()))
    whole = left.join(right.where("enabled"), "component_type").where((F.col("score") >= F.col("score_threshold")) & alerts.watch_filter())
    assert found == sorted(map(tuple, whole.select("listing_id", "watch_id").collect()))
    assert len(found) > 500


def test_candidates_are_few_among_many_watches(spark):
    r = F.rand
    watches = spark.range(100_000).select(
        F.col("id").alias("watch_id"), F.lit("ram").alias("component_type"), (50 + F.col("id") % 50).cast("int").alias("score_threshold"), F.pow(F.lit(10.0), 1 + 3 * r(1)).alias("price_min"),
        (F.col("id") % 10 * 500).cast("int").alias("min_feedback"), F.lit(None).cast("double").alias("min_feedback_pct"), F.lit(False).alias("top_rated_only"), F.lit("").alias("conditions"), F.lit(True).alias("enabled"), F.lit(None).cast("string").alias("attribute_filters"),
    ).withColumn("price_max", F.col("price_min") * 1.03)
    listings = spark.range(500).select(
        F.col("id").alias("listing_id"), F.lit("ram").alias("component_type"), (F.col("id") % 101).cast("int").alias("score"), F.pow(F.lit(10.0), 1 + 3 * r(2)).alias("unit_price"), (r(3) * 6000).cast("int").alias("seller_feedback_score"),
        F.lit(99.0).alias("seller_feedback_pct"), F.lit(True).alias("seller_top_rated"), F.lit("new").alias("condition_norm"), F.lit("{}").alias("attributes"),
    )
    n, hits = watch_index.candidates(listings, watches).count(), alerts.watch_matches(listings, watches).count()
    assert hits > 10_000 and n <= 3 * hits and n < 500 * 100_000 / 50


@pytest.mark.parametrize("bound", [0, 4096])
def test_pairs_are_not_dealt_anew(spark, monkeypatch, bound):
    """each pair that the index gave was shuffled with its listing to find its watch, and a listing was copied for
    each level of the index and feedback, so what was written grew with pairs."""
    monkeypatch.setattr(watch_index, "BROADCAST_CHUNKS", bound)
    monkeypatch.setattr(watch_index, "STRETCH", 20, raising=False)
    listings, watches = market_rows(7, 100, 400)
    left, right = spark.createDataFrame(listings, LISTING), spark.createDataFrame(watches, WATCH).where("component_type IS NOT NULL")
    found = alerts.watch_matches(left, right)
    plan = found._jdf.queryExecution().executedPlan().toString().split("\n")
    above = plan[: next(k for k, x in enumerate(plan) if "Generate explode(" in x and "watches#" in x)]
    assert not any("Join" in x or "Exchange" in x or "Aggregate" in x for x in above)
    looked = watch_index.stretches(watch_index.ranged(right))
    assert sum(r.salts for r in looked.collect()) >= watch_index.SALTS and looked.count() > 5
    wide = looked.withColumn("_look", F.explode(F.sequence(F.floor(F.col("start") / watch_index.LOOK), F.floor(F.col("upto") / watch_index.LOOK))))
    rows = left.where("component_type IS NOT NULL").withColumn("_cell", F.coalesce(watch_index.price_cell(F.col("unit_price")), F.lit(0)))
    assert watch_index.placed(rows, "_cell", wide, "stretch").count() == rows.count()  # each in one stretch


@pytest.mark.parametrize("bound", [0, 4096])
@pytest.mark.parametrize("stretch", [1, 7, 4096])
def test_stretches_lose_no_match(spark, monkeypatch, bound, stretch):
    """bounds that are open, crossed, equal, no number, or not known, by few and by many stretches."""
    monkeypatch.setattr(watch_index, "BROADCAST_CHUNKS", bound)
    monkeypatch.setattr(watch_index, "STRETCH", stretch)
    monkeypatch.setattr(watch_index, "CHUNK", 2)
    listings, watches = market_rows(8, 150, 90)
    watches += [(1000, "ram", 0, 5.0, 50.0, 0, None, False, "", True, None), (1001, "ram", 0, None, None, None, None, False, None, True, None), (1002, "drive", None, None, None, 0, None, False, "", True, None)]
    watches += [(1003, "drive", 0, 100.0, 100.0, 0, None, False, "", True, '{"a": {"eq": 1}}'), (1004, "drive", 0, None, float("nan"), -5, None, False, "new,new", True, "{}")]
    left, right = spark.createDataFrame(listings, LISTING), spark.createDataFrame(watches, WATCH)
    found = sorted(map(tuple, alerts.watch_matches(left, right).select("listing_id", "watch_id").collect()))
    whole = left.join(right.where("enabled AND watch_id <> 1003"), "component_type").where((F.col("score") >= F.col("score_threshold")) & alerts.watch_filter())
    assert found == sorted(map(tuple, whole.select("listing_id", "watch_id").collect()))
    assert len(found) > 100


def some_feed(n):
    items = [{"itemId": str(k), "title": f"kit {k}", "price": {"value": str(k)}} for k in range(n)]
    return lambda offset, limit: {"total": n, "itemSummaries": items[offset : offset + limit]}


def test_pages_of_a_feed(spark):
    rows = paged.read_pages(spark, some_feed(23), page_size=5)
    assert rows.rdd.getNumPartitions() == 5
    assert sorted((r.page, r.pos, r.total, r.item.itemId) for r in rows.collect()) == [(k // 5, k, 23, str(k)) for k in range(23)]
    assert paged.read_pages(spark, some_feed(23), 5, max_pages=2).count() == 10
    assert paged.read_pages(spark, some_feed(0), 5).count() == 0
    assert feed.to_listings(rows.select("item.*")).agg(F.sum("price")).first()[0] == sum(range(23))


def test_feed_as_a_stream_goes_on_where_it_ended(spark, tmp_path):
    lines = tmp_path / "feed"
    lines.mkdir()

    def add(name, start, end):
        (lines / name).write_text("\n".join(json.dumps({"itemId": str(k)}) for k in range(start, end)))

    def run():
        rows = paged.read_pages(spark, paged.folder_feed(f"file://{lines}"), 4, stream=True).select("pos", "item.itemId")
        rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
        return sorted(int(r.itemId) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    add("a.json", 0, 10)
    assert run() == list(range(8))  # whole pages
    assert run() == list(range(8))
    add("b.json", 10, 17)
    assert run() == list(range(16))


def plain_paging(rows, known, size, most):
    seen = new = used = 0
    for page in range(most):
        items = rows[page * size : (page + 1) * size]
        used += 1
        for key in items:
            seen += 1
            if key in known:
                return new, seen, used, "known_listing"
            new += 1
        if (page + 1) * size >= len(rows):
            return new, seen, used, "no_more_results"
    return new, seen, used, "max_pages"


def test_paging_as_page_by_page(spark):
    r = random.Random(8)
    feeds, known = {}, {k for k in range(3000) if r.random() < 0.03}
    for f in range(60):
        feeds[f] = [r.randrange(3000) for _ in range(r.choice([1, 5, 19, 20, 21, 60, 90]))]
    rows = spark.createDataFrame([(f, p, k, f % 3 == 0) for f, keys in feeds.items() for p, k in enumerate(keys)], "feed int, pos long, key int, fresh boolean")
    found = state.paging(rows, spark.createDataFrame([(k,) for k in known] + [(7,)], "key int"), "feed", 10, 6, "fresh")
    expected = {f: plain_paging(keys, known | {7}, 10, 5 if f % 3 == 0 else 6) for f, keys in feeds.items()}
    assert {r.feed: tuple(r)[1:] for r in found.collect()} == expected
    assert len({x[3] for x in expected.values()}) == 3


def test_rolling_baselines_over_a_month(spark, tmp_path):
    r = random.Random(4)
    kinds = ["new", "used", "for_parts", None]
    row = lambda k, day: (k, r.choice(["a", "b", "c", "rare", "", None]), r.choice(kinds), r.random() < 0.9, r.choice([1.0, 2.5, 9.99, r.random() * 100]), None, r.choice([1, 2]), day)
    schema = "listing_id int, product_key string, condition_norm string, active boolean, price double, shipping_cost double, quantity int, day int"
    now = {k: row(k, r.randrange(0, 100)) for k in range(400)}

    def frame(rows):
        at = F.expr("timestamp_ntz'2001-01-01 00:00:00' + make_dt_interval(day, listing_id % 24)")
        return spark.createDataFrame(list(rows), schema).withColumn("updated_at", at)

    def save(df, name):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    date = lambda day: str((__import__("datetime").date(2001, 1, 1) + __import__("datetime").timedelta(days=day)))
    as_of = date(100) + " 00:00:00"
    counts = save(rolling.price_counts(frame(now.values())).where(F.col("day") >= rolling.since(as_of, 30)), "s0")
    base = save(rolling.baselines_of(counts), "b0")
    for step in range(1, 31):
        day = 100 + step
        changed = {k: row(k, day - 1) for k in [*r.sample(sorted(now), 6), 1000 + step]}
        delta = rolling.changes(frame([now[k] for k in changed if k in now] or []), frame(changed.values()))
        now |= changed
        as_of = date(day) + " 00:00:00"
        delta = save(delta.where(F.col("day") >= rolling.since(as_of, 31)), f"d{step}")
        new_counts, new_base = rolling.advanced(counts, base, delta, as_of, 30)
        counts, base = save(new_counts, f"s{step}"), save(new_base, f"b{step}")
        if step % 10 == 0:
            whole = market.baselines(frame(now.values()), as_of, 30)
            assert sorted(map(tuple, base.collect())) == sorted(map(tuple, whole.collect()))
    assert counts.where("n < 0").isEmpty()


def test_only_touched_keys_are_ranked_again(spark):
    counts = spark.createDataFrame([("a", "2001-01-01", 1.0, 9), ("b", "2001-01-20", 2.0, 9)], "product_key string, day string, unit_price double, n long").withColumn("day", F.to_date("day"))
    base = spark.createDataFrame([("a", 9, *[1.0] * 6), ("b", 9, *[77.0] * 6)], "product_key string, sample_count long, p10 double, p25 double, p50 double, p75 double, p90 double, mean double")
    after, rows = rolling.advanced(counts, base, counts.limit(0), "2001-02-05 00:00:00", 30)
    assert [tuple(r)[:2] for r in after.collect()] == [("b", F.to_date and after.first().day)]
    assert [(r.product_key, r.p50) for r in rows.collect()] == [("b", 77.0)]  # not touched, so as it was


def test_cut_of_a_running_total(spark):
    r = random.Random(1)
    rows = [(r.choice([None, r.randrange(-(10**15), 10**15), r.randrange(50)]), k, r.choice([None, 0.0, r.random()])) for k in range(400)]
    df = spark.createDataFrame(rows, "key long, tie int, cost double")
    ordered = sorted(rows, key=lambda x: (x[0] or 0, x[1]))
    for cap, spent in ((0.0, 0.0), (0.5, 0.0), (30.0, 1.25), (80.0, 80.0), (1e6, 0.0)):
        kept, total = [], Decimal(str(spent))
        for row in ordered:
            if total < Decimal(str(cap)):
                kept.append(row[1])
            total += Decimal(f"{row[2] or 0:.9f}")
        found = budget.until_spent(df, F.col("key"), ["tie"], F.col("cost"), cap, spent)
        assert sorted(x.tie for x in found.collect()) == sorted(kept)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in plan
    assert budget.until_spent(df.limit(0), F.col("key"), ["tie"], F.col("cost"), 1.0).collect() == []


def test_pages_granted(spark):
    pages = spark.createDataFrame([(1, 4), (2, 3), (3, 5), (4, 1)], "watch_id long, n_pages long")
    got = lambda *a, **b: [r.granted for r in budget.granted(pages, "watch_id", "n_pages", *a, **b).orderBy("watch_id").collect()]
    assert got(50) == [4, 3, 5, 1]
    assert got(5) == [4, 3, 0, 0]  # the second watch is begun, and has all its pages
    assert got(7) == [4, 3, 0, 0]
    assert got(0) == [0, 0, 0, 0]
    assert got(50, daily_left=9) == [4, 3, 2, 0]
    assert got(5, daily_left=100) == [4, 3, 0, 0]


def counter(spark, *samples):
    rows = [("c", k, s, v) for k, (s, v) in enumerate(samples)]
    return spark.createDataFrame(rows, "name string, id int, s double, value double").withColumn("ts", F.timestamp_micros((F.col("s") * 1_000_000).cast("long")))


def increase_at(df, tick):
    rows = series.extrapolated(df, ["name"]).withColumn("s", F.unix_timestamp(F.col("tick").cast("timestamp"))).where(F.col("s") == tick).collect()
    return rows[0]["increase"] if rows else None


def test_increase_with_ends_filled_in(spark):
    even = counter(spark, *[(3030.0 + 60 * k, 100.0 + 6 * k) for k in range(5)])
    assert increase_at(even, 3300) == pytest.approx(24 * 300 / 240)  # samples at 30 to 270 of 300 s: both ends are within a gap
    late = counter(spark, (3200.0, 100.0), (3210.0, 110.0))
    assert increase_at(late, 3300) == pytest.approx(10 * (10 + 5 + 5) / 10)  # half a gap at either end
    young = counter(spark, (3004.0, 2.0), (3010.0, 14.0), (3298.0, 14.0))
    gap = 147.0
    assert increase_at(young, 3300) == pytest.approx(12 * (294 + min(4.0, 294 * 2 / 12) + 2) / 294) and gap > 4
    reset = counter(spark, (3060.0, 50.0), (3120.0, 10.0), (3180.0, 16.0))
    assert increase_at(reset, 3300) == pytest.approx(16 * (120 + 60 + 30) / 120)
    assert increase_at(counter(spark, (3200.0, 5.0)), 3300) is None
    assert increase_at(counter(spark, (3000.0, 5.0), (3100.0, 6.0)), 3300) is None  # the first sample is not in the range


def test_quantile_of_bucket_rates(spark):
    inf = float("inf")
    rows = lambda *b: spark.createDataFrame([(1, le, rate) for le, rate in b], "tick int, le double, rate double")
    at = lambda q, *b: series.rate_quantile(rows(*b), q, ["tick"]).first()["quantile"]
    assert at(0.5, (1.0, 2.0), (2.0, 6.0), (inf, 8.0)) == pytest.approx(1.5)
    assert at(0.1, (1.0, 2.0), (2.0, 6.0), (inf, 8.0)) == pytest.approx(0.4)
    assert at(0.9, (1.0, 2.0), (2.0, 6.0), (inf, 8.0)) == 2.0
    assert at(0.5, (1.0, 2.0), (2.0, 1.0), (4.0, 6.0), (inf, 8.0)) == pytest.approx(3.0)  # a fall counts as no rise
    assert at(0.5, (1.0, 2.0), (2.0, 6.0)) is None
    assert at(0.5, (inf, 6.0)) is None
    assert at(0.5, (1.0, 0.0), (inf, 0.0)) is None
    assert at(0.5, (1.0, 1.0), (1.0, 1.0), (inf, 2.0), (inf, 2.0)) == 1.0


def test_ranges_stay_even_with_outliers(spark):
    rows = spark.range(20_000).select(F.lit("k").alias("k"), F.when(F.col("id") == 0, 1e12).otherwise(F.col("id").cast("double")).alias("v"), F.lit(1).alias("n"))
    shares = F.array(*[F.lit(k / ranks.RANGES) for k in range(1, ranks.RANGES)])
    cuts = rows.agg(F.percentile_approx("v", shares, F.lit(10 * ranks.RANGES)).alias("cuts"))
    sizes = [r["count"] for r in rows.crossJoin(cuts).groupBy(ranks.range_of(F.col("v"), F.col("cuts")).alias("r")).count().collect()]
    assert len(sizes) >= 250 and max(sizes) < 200
    got = ranks.percentiles(rows, "k", "v", (0.5,), ["p50"]).first()
    assert (got.sample_count, got.p50) == (20_000, 10_000.5)


def test_of_rows_to_add_the_same_one_counts(spark):
    new = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, "d")], "k int, v string")
    taken = spark.createDataFrame([(3,)], "k int")
    assert sorted(map(tuple, state.insert_unless(new, taken, ["k"]).collect())) == [(1, "b"), (2, "c")]
    assert sorted(map(tuple, state.insert_unless(new.select("k"), taken, ["k"]).collect())) == [(1,), (2,)]


def test_cuts_do_not_depend_on_the_order_of_rows(spark):
    """A plan reads its counts twice; ranges cut differently the second time gave wrong ranks."""
    rows = spark.range(200_000).select((F.col("id") % 3).cast("string").alias("k"), (F.xxhash64("id") / 1e12).alias("v"), F.lit(1).alias("n"))
    orders = [rows.repartition(7, "v"), rows.repartition(3, "k").sortWithinPartitions(F.desc("v")), rows.coalesce(1)]
    cuts = [{r["_by"]: r["_cuts"] for r in ranks.even_cuts(one, "k", "v").collect()} for one in orders]
    assert cuts[0] == cuts[1] == cuts[2] and set(cuts[0]) == {"0", "1", "2"}
    sizes = [r["count"] for r in rows.join(spark.createDataFrame(list(cuts[0].items()), "k string, cuts array<double>"), "k").groupBy("k", ranks.range_of(F.col("v"), F.col("cuts")).alias("r")).count().collect()]
    assert len(sizes) == 3 * ranks.RANGES and max(sizes) < 3 * 200_000 / 3 / ranks.RANGES
    plan = ranks.percentiles(rows, "k", "v", (0.5,), ["p50"])._jdf.queryExecution().toString()
    assert "percentile_approx" not in plan


def test_increase_looks_at_each_sample_a_fixed_number_of_times(spark):
    """a sliding frame adds up all samples of the range anew for each second."""
    r = random.Random(3)
    samples = [(k, r.choice("ab"), r.randrange(0, 2000), float(r.randrange(50))) for k in range(600)]
    rows = spark.createDataFrame(samples, "id long, name string, s long, value double").withColumn("ts", F.timestamp_seconds("s").cast("timestamp_ntz")).drop("s")
    out = series.increase(rows, seconds=300)
    deltas, last = [], {}
    for k, name, s, v in sorted(samples, key=lambda x: (x[2], x[0])):
        deltas.append((k, name, s, 0.0 if name not in last else v if v < last[name] else v - last[name]))
        last[name] = v
    want = {k: sum(d for _, n, at, d in deltas if n == name and s - 300 <= at <= s) for k, name, s, _ in deltas}
    assert {x["id"]: x["increase"] for x in out.collect()} == want
    assert "RangeFrame, -" not in out._jdf.queryExecution().toString()


def test_feedback_cuts_do_not_depend_on_the_order_of_rows(spark):
    """listings and watches are put into cells by cuts that are worked out on both sides."""
    rows = spark.range(60_000).select(F.concat(F.lit("t"), F.col("id") % 2).alias("component_type"), (F.col("id") % 30_000).cast("int").alias("min_feedback")).unionByName(spark.sql("SELECT 'none' AS component_type, 0 AS min_feedback"))
    found = [sorted((r[0], tuple(r[1])) for r in watch_index.feedback_cuts(one).collect()) for one in (rows.repartition(5, "min_feedback"), rows.coalesce(1).sortWithinPartitions(F.desc("min_feedback")))]
    assert found[0] == found[1] and [len(c) for _, c in found[0]] == [0, 7, 7]
    assert "percentile_approx" not in watch_index.feedback_cuts(rows)._jdf.queryExecution().toString()


def test_listings_are_looked_up_by_compiled_code(spark):
    """Spark does not compile a node with a function over an array; each of a listing's twelve looks copied its row, and
    what a watch asks of attributes was read again for each candidate."""
    listings, watches = market_rows(6, 20, 20)
    found = alerts.watch_matches(spark.createDataFrame(listings, LISTING), spark.createDataFrame(watches, WATCH))
    plan = found._jdf.queryExecution().optimizedPlan().toString().split("\n")
    slow = [x for x in plan if "lambdafunction" in x and ("Generate" in x or "Project" in x) and ("unit_price" in x or "seller_feedback_score" in x or "watches#" in x)]
    assert slow == []
    assert any("from_json" in x for x in plan) and not any("from_json" in x for x in plan if "Join" in x)


@pytest.mark.parametrize("cuts", [[], [5.0], [0.0, 5.0, 7.5, 499.0, 500.0, 501.0, 10_000.0]])
def test_feedback_cells_count_the_cuts(spark, cuts):
    values = [None, -1, 0, 4, 5, 6, 500, 20_000]
    rows = spark.createDataFrame([(v, cuts) for v in values], "v int, cuts array<double>").select(watch_index.feedback_cell(F.col("v"), F.col("cuts")).alias("c"))
    assert [r.c for r in rows.collect()] == [0 if v is None else sum(c <= v for c in cuts) for v in values]
