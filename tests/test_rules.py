"""Golden cases of scalar rules, state transitions, sources and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marketloom.functions import attributes as A
from marketloom.functions import scoring as S
from marketloom.functions import titles as T
from marketloom.operators import alerts, delivery, evals, market, ranks, series, state, worklists
from marketloom.sources import feed
from marketloom.streaming import rates


def values(spark, rows, make):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x string")
    return [r.y for r in df.select("k", make(F.col("x")).alias("y")).orderBy("k").collect()]


def test_titles(spark):
    tiers = ["PowerEdge R740 CTO", "Xeon Gold 6130 64GB DDR4", "1TB SSD Silver 4110", "no cpu, no ram"]
    assert values(spark, tiers, T.server_tier) == ["barebone", "configured", "partial", "barebone"]
    parts = ["R740xd 24 bay backplane", "NVMe SSD tray with 1TB", "GPU riser cable", "4U server with rails", "écable tray", None]
    assert values(spark, parts, T.accessory_only) == [True, True, True, False, True, None]
    systems = ["ThinkStation P920 motherboard", "ThinkStation P920 Gold 6148", "OptiPlex 7060 i5-8500"]
    assert values(spark, systems, T.system_type) == ["", "workstation", "desktop"]
    assert values(spark, ["PC4-21300V", "DDR4-2933 PC4-23466", "DDR9-1", None], T.title_speed) == [2666, 2933, None, None]
    assert values(spark, ["pc4-19200T", "25600", "PC5-1"], T.module_speed) == [2400, 3200, None]
    assert values(spark, [" Brand New ", "AS-IS", "Refurbished", None], T.condition) == ["new", "for_parts", "unknown", "unknown"]


def test_attributes(spark):
    assert values(spark, ["RTX 3090_Ti", "rtx_a2000", "4070-super", "P40"], A.gpu_model) == ["3090ti", "a2000", "4070super", "p40"]
    assert values(spark, ["Dell Inc.", "HPE", "Some Maker"], A.system_vendor) == ["dell", "hp", "some-maker"]
    assert values(spark, ["32768", "32000", "512", "5000"], lambda x: A.fewer_units(x.cast("long"), 1024).cast("int")) == [32, 32, 512, 5]
    assert values(spark, ["N/A", " none ", "SAS"], A.without_placeholder) == [None, None, "SAS"]


@pytest.mark.parametrize(
    ("kind", "attributes", "expected"),
    [
        ("ram", {"generation": "DDR4", "ecc": True, "registered": True, "capacity_gb": 32, "speed_mhz": 2666}, "ram:ddr4:ecc_reg:32gb:2666"),
        ("ram", {}, "ram:unknown:unknown:0gb:0"),
        ("drive", {"interface": "SAS", "form_factor": "2.5", "capacity": "1.2TB", "type": "HDD", "rpm": 10000}, "drive:sas:2.5:1.2tb:10k"),
        ("psu", {}, "other:psu"),
        ("gpu", {"manufacturer": "NVIDIA", "model": "A100", "vram_gb": 80}, "gpu:nvidia:unknown:a100:80gb"),
    ],
)
def test_product_keys(spark, kind, attributes, expected):
    key = A.product_key(F.lit(kind), {k: F.lit(v) for k, v in attributes.items()})
    assert spark.range(1).select(key).first()[0] == expected


def test_scores(spark):
    bounds = [F.lit(float(v)) for v in (20, 30, 50, 70, 100)]
    price = lambda x, n=50: spark.range(1).select(S.price_score(F.lit(float(x)), F.lit(n).cast("int"), *bounds)).first()[0]
    assert [price(x) for x in (15, 20, 25, 30, 50, 70, 100, 150)] == [100, 100, 85, 70, 30, 10, 0, 0]
    assert price(20, 5) == 50 and price(20, None) == 50
    unit = spark.range(1).select(S.unit_price(F.lit(45.99), F.lit(5.99), F.lit(2))).first()[0]
    assert unit == pytest.approx(25.99)


def test_pages_are_clamped(spark):
    rows = spark.range(600).select(F.col("id").cast("string").alias("listing_id"), F.col("id").cast("double").alias("price"), F.lit(None).cast("timestamp_ntz").alias("first_seen_at"))
    assert [market.page(rows, "price", n, -5).count() for n in (0, -10, 1000)] == [50, 50, 500]


    assert [market.clamped(x, 75, 0, 100) for x in ("", None, "x", "-1", "5", "500")] == [75, 75, 75, 75, 5, 100]


def test_scores_of_whole_listings(spark):
    base = spark.sql("SELECT 'k' AS product_key, 50L AS sample_count, 20D AS p10, 30D AS p25, 50D AS p50, 70D AS p75, 100D AS p90")
    rows = spark.sql("""SELECT *, true AS active, NULL AS shipping_cost, 1 AS quantity, 'buy_it_now' AS listing_type, cast(NULL AS timestamp_ntz) AS auction_end_at FROM VALUES
      ('typical', 'k', 50D, 5000, 99.5D, true, 'used_working', 'x', '{"a": 1}', timestamp_ntz'2000-01-01'), ('good', 'k', 15D, 5000, 99.5D, true, 'used_working', 'x', '{"a": 1}', timestamp_ntz'2001-01-01'),
      ('bad', 'k', 70D, 100, 95D, false, 'for_parts', '', ' { } ', timestamp_ntz'2000-01-01'), ('keyless', '', 1D, 1, 1D, false, 'new', '', NULL, timestamp_ntz'2000-01-01')
      AS v(listing_id, product_key, price, seller_feedback_score, seller_feedback_pct, seller_top_rated, condition_norm, image_url, attributes, first_seen_at)""")
    found = {r.listing_id: r for r in market.scored(rows, base, "2001-01-01 10:00:00").collect()}
    assert 55 <= found["typical"].score <= 65 and found["good"].score >= 85 and found["bad"].score <= 30 and "keyless" not in found
    assert [found[k].quality_score for k in ("typical", "bad")] == [70, 0] and [found[k].time_score for k in ("typical", "good")] == [30, 80]


@pytest.mark.parametrize("spread", [1.0, 1e6])
def test_ranks_are_those_of_sorted_groups(spark, spread):
    r = random.Random(3)
    rows = [(k, x, k) for k in ("a", "b", None) for x in [round(r.random() ** 9 * spread, 2) for _ in range(400)] + [7.0] * 50] + [("c", 1.0, "c"), ("a", None, "a")]
    df = spark.createDataFrame([(k, x) for k, x, _ in rows], "k string, x double")
    groups = {k: sorted(x for g, x, _ in rows if g == k and x is not None) for k in ("a", "b", "c", None)}
    for row in ranks.cumulated(df, "k", "x").collect():
        g = groups[row.k]
        assert (row.before, row.n, row.total) == (sum(x < row.x for x in g), g.count(row.x), len(g))
    for row in ranks.percentiles(df, "k", "x", (0.1, 0.5), ["p10", "p50"]).collect():
        at = 0.1 * (len(groups[row.k]) - 1)
        low = groups[row.k][int(at)]
        assert row.p10 == pytest.approx(low + (groups[row.k][min(int(at) + 1, len(groups[row.k]) - 1)] - low) * (at - int(at)))
    placed = ranks.numbered(df.withColumn("id", F.monotonically_increasing_id()), "k", "x", True, "id", width=0.5).where("x IS NOT NULL").collect()
    for k, g in groups.items():
        own = sorted((x._at, x.x) for x in placed if x.k == k)
        assert [x for _, x in own] == g[::-1] and [a for a, _ in own] == list(range(len(g)))


def test_counters_over_ranges_of_time(spark):
    r = random.Random(5)
    rows, at, value = [], 0, 0.0
    for k in range(300):
        at += r.choice([1, 5, 40, 700])
        value = 0.0 if r.random() < 0.1 else value + r.randint(0, 9)
        rows.append((k, "s", at, value))
    samples = spark.createDataFrame(rows, "id long, name string, t long, value double").withColumn("ts", F.timestamp_seconds("t"))
    grown = [0.0] + [b[3] if b[3] < a[3] else b[3] - a[3] for a, b in zip(rows, rows[1:], strict=False)]
    found = {x.id: x.increase for x in series.increase(samples, seconds=300).collect()}
    assert found == pytest.approx({k: sum(g for g, y in zip(grown, rows, strict=True) if t - 300 <= y[2] <= t and y[0] <= k) for k, _, t, _ in rows})
    for x in series.rate_at(samples, "name", ["name"]).select(F.unix_timestamp(F.col("tick").cast("timestamp")).alias("t"), "rate").collect():
        assert x.rate == pytest.approx(sum(g for g, y in zip(grown, rows, strict=True) if x.t - 300 < y[2] <= x.t) / 300)


def test_rules_hold_from_their_first_true_tick(spark):
    ticks = [(0, 1.0), (1, 1.0), (2, 1.0), (3, 0.0), (4, 1.0), (5, 1.0), (6, 1.0), (9, 1.0), (10, None), (11, 1.0), (12, 1.0), (13, 1.0)]
    rows = spark.createDataFrame(ticks, "m long, x double").select(F.timestamp_seconds(F.col("m") * 60).alias("ts"), F.col("x").alias("readyz_up"), F.lit(1.0).alias("up"))
    out = series.rule_states(rows, 1, {"ready": ("readyz_up = 1", 2), "now": ("readyz_up = 1", 0), "unknown": ("missing_metric > 0", 0)})
    found = {}
    for x in out.orderBy("ts").collect():
        found.setdefault(x.rule, []).append(x.firing)
    assert found["ready"] == [False, False, True, False, False, False, True, False, False, False, False, True]
    assert found["now"] == [x == 1.0 for _, x in ticks] and not any(found["unknown"])


def test_repeated_keys_have_a_winner(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 'a', 5, 'x'), (1, 'a', 7, 'y'), (1, 'a', 7, 'z'), (2, 'b', 1, 'w') AS v(watch_id, listing_id, score, note)")
    none = spark.sql("SELECT 0 AS watch_id, '' AS listing_id, false AS notified").where("false")
    assert sorted(map(tuple, alerts.create_alerts(rows, none).collect())) == [(1, "a", 7, "z"), (2, "b", 1, "w")]
    table = spark.sql("SELECT * FROM VALUES (1, 'old', 3) AS v(id, name, n)")
    new = spark.sql("SELECT * FROM VALUES (1, 'p'), (1, 'q'), (4, 'r') AS v(id, name)")
    assert sorted(map(tuple, state.upserted(table, new, "id").collect()), key=str) == [(1, "q", 3), (4, "r", None)]
    assert evals.mismatches(rows, "note", "listing_id").count() == 4 and worklists.cold(spark.sql("SELECT 'k' AS product_key, 3 AS sample_count")).count() == 1


def test_messages_have_ten_embeds_at_most(spark):
    rows = spark.range(23).select(F.lit(1).alias("watch_id"), F.col("id").alias("alert_id"), (F.col("id") % 7).cast("int").alias("score"), F.struct(F.col("id").alias("title")).alias("embed"))
    found = {x.chunk: [e.title for e in x.embeds] for x in delivery.messages(alerts.in_chunks(rows)).collect()}
    assert [len(found[k]) for k in range(3)] == [10, 10, 3]
    assert sum((found[k] for k in range(3)), []) == sorted(range(23), key=lambda k: (-(k % 7), k))


def test_cooldown_of_a_stream(spark, tmp_path):
    schema = "watch_id int, listing_id string, created_at timestamp, score int"
    hours = [[(1, "a", 0, 5), (1, "a", 3, 9), (2, "a", 3, 1)], [(1, "a", 23, 5), (1, "a", 24, 6), (1, "a", 25, 7)], [(1, "a", 50, 8), (2, "a", 26, 2)]]
    for k, batch in enumerate(hours):
        rows = spark.createDataFrame([(w, x, s, (1000 + h) * 3600) for w, x, h, s in batch], "w int, x string, s int, t long")
        rows.select(F.col("w").alias("watch_id"), F.col("x").alias("listing_id"), F.timestamp_seconds("t").alias("created_at"), F.col("s").alias("score")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = rates.outside_cooldown(spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*"))
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
    sent = sorted((r.watch_id, r.score) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert sent == [(1, 5), (1, 6), (1, 8), (2, 1)]


def test_dismiss_and_restore(spark):
    alerts = spark.createDataFrame([(1, None), (2, None)], "alert_id long, dismissed_at string").withColumn("dismissed_at", F.col("dismissed_at").cast("timestamp_ntz"))
    ids = spark.createDataFrame([(1,), (2,), (3,)], "alert_id long")
    gone = state.dismiss(alerts, ids, "2001-01-01")
    assert gone.count() == 2 and state.dismiss(gone, ids, "2001-01-02").count() == 0
    assert state.restore(gone, ids.where("alert_id = 1")).count() == 1 and state.restore(alerts, ids).count() == 0


def test_upsert_is_idempotent(spark):
    old = spark.sql("SELECT 'a' AS id, 1.0 AS price, 't' AS title, true AS active, timestamp_ntz'2001-01-01' AS updated_at")
    new = spark.sql("SELECT 'a' AS id, 2.0 AS price, 'x' AS title UNION ALL SELECT 'b', 3.0, 'y'")
    once = state.upsert(old, new, "id", ["price"], "2001-02-01")
    twice = state.upsert(once, new, "id", ["price"], "2001-02-01")
    rows = sorted((r.id, float(r.price), r.title, r.active) for r in once.collect())
    assert rows == [("a", 2.0, "t", True), ("b", 3.0, "y", True)]
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_feed(spark, tmp_path):
    item = {"itemId": "1", "title": "DDR4 kit", "price": {"value": "4x"}, "condition": " Used\t", "buyingOptions": ["BEST_OFFER", "AUCTION"], "seller": {"username": "s", "feedbackScore": 7, "feedbackPercentage": "99.5"}}
    (tmp_path / "page.json").write_text(json.dumps({"itemSummaries": [item], "total": 1}, indent=1))
    row = feed.to_listings(feed.read_feed(spark, str(tmp_path))).first()
    assert (row.item_id, row.price, row.currency, row.shipping_cost, row.listing_type, row.seller_feedback_pct) == ("1", 0.0, "USD", None, "auction", 99.5)
    assert (row.condition_raw, row.condition_norm) == (" Used\t", "used_working")


def test_streaming_rates_equal_batch(spark, tmp_path):
    events = spark.range(100).select((F.timestamp_seconds(F.col("id") * 61)).alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("event_type"))
    events.write.parquet(f"{tmp_path}/events")
    stream = rates.streaming_rates(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events"))
    query = stream.writeStream.format("memory").queryName("rates_out").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    batch = rates.streaming_rates(events)
    assert sorted(map(tuple, spark.table("rates_out").collect())) == sorted(map(tuple, batch.collect()))


def test_entry_works_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "marketloom", tmp_path / "marketloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True)
