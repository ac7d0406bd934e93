"""Versions and their sink, sorted snapshots, the search index, and streams in order of time."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marketloom.operators import search_index, series, snapshots, state
from marketloom.sources import versions
from marketloom.streaming import ordered

LISTING = "listing_id long, title string, price double, active boolean, updated_at timestamp_ntz"
AS_OF = "2001-01-01 00:00:00"


def upserts(old, new):
    return state.upsert(old, new, "listing_id", ["title", "price"], AS_OF)


def content(df):
    return sorted((r.listing_id, r.title, r.price) for r in df.collect())


def batch(spark, *rows):
    return spark.createDataFrame([(*r, True, None) for r in rows], LISTING)


def test_batches_taken_twice_change_nothing(spark, tmp_path):
    table = versions.Versions(spark, f"file://{tmp_path}/t", ["listing_id"], LISTING, buckets=8)
    assert content(table.read()) == []
    take = versions.taking(table, "feed", upserts)
    take(batch(spark, (1, "a", 1.0), (2, "b", 2.0)), 0)
    take(batch(spark, (2, "c", 3.0), (3, "d", 4.0)), 1)
    after = content(table.read())
    assert after == [(1, "a", 1.0), (2, "c", 3.0), (3, "d", 4.0)]
    take(batch(spark, (1, "again", 9.0)), 1)
    assert content(table.read()) == after and table.last()[0] == 2
    versions.taking(table, "other", lambda old, new: old.where("false"))(batch(spark, (1, "x", 0.0)), 0)
    assert 1 not in [r[0] for r in content(table.read())]


def test_what_was_written_without_a_commit_is_not_seen(spark, tmp_path):
    table = versions.Versions(spark, f"file://{tmp_path}/t", ["listing_id"], LISTING, buckets=4)
    take = versions.taking(table, "feed", upserts)
    take(batch(spark, (1, "a", 1.0)), 0)
    before = content(table.read())

    class Lost(Exception):
        pass

    class Dies(versions.Versions):
        def last(self):
            found = super().last()
            if self.spark is not None and (tmp_path / "t/data/version=2").exists():
                raise Lost
            return found

    dying = Dies(spark, table.path, table.key, LISTING, 4)
    versions.delete(spark, f"file://{tmp_path}/t/none")
    rows = batch(spark, (1, "half", 5.0), (2, "new", 6.0))
    # The data of the next version are there, its commit is not.
    rows.withColumn("bucket", table.bucket()).write.partitionBy("bucket").parquet(f"file://{tmp_path}/t/data/version=2")
    with pytest.raises(Lost):
        versions.taking(dying, "feed", upserts)(rows, 1)
    assert content(table.read()) == before
    take(rows, 1)
    assert content(table.read()) == [(1, "half", 5.0), (2, "new", 6.0)]


def test_reading_some_buckets_reads_their_files_only(spark, tmp_path):
    table = versions.Versions(spark, f"file://{tmp_path}/t", ["listing_id"], LISTING, buckets=16)
    versions.taking(table, "feed", upserts)(batch(spark, *[(k, "t", 1.0) for k in range(200)]), 0)
    change = batch(spark, (5, "changed", 2.0))
    touched = table.buckets_of(change)
    assert len(table.read(touched).inputFiles()) == 1 < len(table.read().inputFiles()) == 16
    versions.taking(table, "feed", upserts)(change, 1)
    assert len([1 for f in table.read().inputFiles() if "version=2" in f]) == 1
    assert (5, "changed", 2.0) in content(table.read()) and table.read().count() == 200


def test_stream_into_versions_goes_on_after_a_stop(spark, tmp_path):
    table = versions.Versions(spark, f"file://{tmp_path}/t", ["listing_id"], LISTING, buckets=4)
    take = versions.taking(table, "feed", upserts)

    def run(sink):
        stream = spark.readStream.schema(LISTING).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()

    batch(spark, (1, "a", 1.0)).coalesce(1).write.parquet(f"{tmp_path}/in")

    def dies_after_the_write(rows, number):
        take(rows, number)
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(dies_after_the_write)
    run(take)  # the batch comes again
    assert content(table.read()) == [(1, "a", 1.0)] and table.last()[0] == 1
    batch(spark, (2, "b", 1.0)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(take)
    assert content(table.read()) == [(1, "a", 1.0), (2, "b", 1.0)] and table.last()[0] == 2


def test_pages_of_a_snapshot(spark, tmp_path):
    rows = spark.range(1000).select("id", (F.col("id") * 7919 % 50).alias("score"), F.lit("x").alias("title"))
    order = [F.col("score").desc(), F.col("id").desc()]
    snapshots.write_sorted(rows, order, f"file://{tmp_path}/s", part_rows=90)
    whole = [r.id for r in rows.orderBy(*order).collect()]
    for number, size in ((1, 25), (4, 25), (5, 70), (40, 25), (41, 25), (3, 400), (0, 10)):
        page, total = snapshots.page_of(spark, f"file://{tmp_path}/s", order, number, size)
        first = (max(number, 1) - 1) * size
        assert total == 1000 and [r.id for r in page.collect()] == whole[first : first + size]
    page, _ = snapshots.page_of(spark, f"file://{tmp_path}/s", order, 4, 25)
    assert len(page.inputFiles()) <= 2
    snapshots.write_sorted(rows.limit(0), order, f"file://{tmp_path}/none")
    page, total = snapshots.page_of(spark, f"file://{tmp_path}/none", order)
    assert (page.count(), total) == (0, 0)


def test_search_finds_what_ilike_finds(spark, tmp_path):
    r = random.Random(3)
    words = ["R730", "r730xd", "DDR4", "ecc", "100%", "a_b", "ÄPFEL", "xeon", "SAS", "\\", "ab", "\U0001f600\U0001f600\U0001f600"]
    rows = [(k, r.choice([None, "", "ab", " ".join(r.choices(words, k=r.randint(1, 5)))])) for k in range(600)]
    df = spark.createDataFrame(rows, "k long, title string")
    at = f"file://{tmp_path}/index"
    search_index.write_index(df, "k", "title", at)
    for text in ("r730", "XEON", "äpfel", "ddr4 ecc", "r7%xd", "d_r4", "100\\%", "a\\_b", "ab", "", "%", "zzzz", "eon s", "\U0001f600\U0001f600\U0001f600"):
        found = search_index.search_titles(df, "k", "title", text, at)
        assert sorted(x.k for x in found.collect()) == sorted(x.k for x in df.where(F.col("title").ilike(f"%{text}%")).collect()), text
    search_index.write_index(df.limit(0), "k", "title", f"{at}-none")
    assert search_index.search_titles(df.limit(0), "k", "title", "r730", f"{at}-none").count() == 0
    plan = search_index.candidates(spark, at, "r730")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and re.search(r"PushedFilters: \[[^]]*trigram", plan)


@pytest.fixture
def rocksdb(spark):
    name, value = ordered.ROCKSDB
    old = spark.conf.get(name)
    spark.conf.set(name, value)
    yield
    spark.conf.set(name, old)


def in_batches(spark, tmp_path, rows, make, mixed, stops=1):
    """The stream's rows, from files in an order that is mixed within the watermark's delay, with a restart in between."""
    files = [rows[i : i + 12] for i in range(0, len(rows), 12)]
    if mixed:
        for i in range(0, len(files) - 1, 2):
            files[i], files[i + 1] = files[i + 1], files[i]
    half = len(files) // 2
    for part in (files[:half], files[half:]):
        for own in part:
            spark.createDataFrame(own, mixed_schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = make(spark.readStream.schema(mixed_schema).parquet(f"{tmp_path}/in"))
            stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/at").trigger(availableNow=True).start().awaitTermination()
    return [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()]


mixed_schema = "name string, id long, ts timestamp, value double"


@pytest.mark.skipif(not hasattr(__import__("pyspark.sql.streaming", fromlist=["x"]), "StatefulProcessor"), reason="no typed state")
def test_streamed_deltas_are_those_of_the_batch(spark, tmp_path, rocksdb):
    pytest.importorskip("google.protobuf")
    r = random.Random(2)
    start = datetime(2024, 1, 1)
    rows = [(r.choice("ab"), k, start + timedelta(seconds=20 * k), float(r.choice([k, k % 7]))) for k in range(48)]
    last = [(c, 1000 + i, start + timedelta(days=1, seconds=i), 0.0) for i, c in enumerate("ab")] + [("z", 2000, start + timedelta(days=3), 0.0)]
    got = in_batches(spark, tmp_path, [*rows, *last], lambda s: ordered.streamed_deltas(s, late="10 minutes"), mixed=True)
    whole = series.deltas(spark.createDataFrame([*rows, *last], mixed_schema), "name", 3600).select("name", "ts", "id", "delta")
    wanted = sorted(tuple(x) for x in whole.collect() if x.id < 1000)
    assert sorted(x for x in got if x[2] < 1000) == wanted


def test_streamed_cooldown_is_that_of_plain_steps(spark, tmp_path, rocksdb):
    pytest.importorskip("google.protobuf")
    global mixed_schema
    r = random.Random(7)
    start = datetime(2024, 1, 1)
    rows = [(r.randrange(2), r.randrange(3), k, start + timedelta(minutes=17 * k), k % 90) for k in range(48)]
    end = [(9, 9, 999, start + timedelta(days=30), 1), (9, 9, 1000, start + timedelta(days=60), 1)]
    old, mixed_schema = mixed_schema, "watch_id int, listing_id int, alert_id long, created_at timestamp, score int"
    try:
        got = in_batches(spark, tmp_path, [*rows, *end], lambda s: ordered.streamed_cooldown(s, 3, "8 hours"), mixed=True)
    finally:
        mixed_schema = old
    last, wanted = {}, []
    for w, k, a, at, score in rows:
        if (w, k) not in last or at - last[w, k] >= timedelta(hours=3):
            last[w, k] = at
            wanted.append((w, k, at, a, score))
    assert sorted(x for x in got if x[3] < 999) == sorted(wanted)
