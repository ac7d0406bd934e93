"""Queries of single rules, updates and sources over columns of the plain tables, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions import scoring as S
from ..functions import texts as X
from ..functions import titles as T
from ..operators import alerts as al
from ..operators import delivery, extraction, search_index, series, snapshots, state
from ..sources import feed
from ..sources.versions import Versions, taking, work_folder
from .registry import query


@query("""SELECT p_partkey, least(CASE WHEN p_size % 3 > 0 THEN 40.0e0 ELSE 0.0e0 END + CASE WHEN p_type <> 'ECONOMY' THEN 30.0e0 ELSE 0.0e0 END
  + CASE WHEN said > 500 THEN 30.0e0 WHEN said > 200 THEN 20.0e0 WHEN said > 50 THEN 10.0e0 ELSE 0.0e0 END, 100.0e0) AS score FROM (SELECT *, length(p_name) * p_size AS said FROM part)""")
def quality_of_parts(t):
    score = S.quality_score(F.col("p_size") % 3 > 0, F.col("p_type") != "ECONOMY", F.char_length("p_name") * F.col("p_size"))
    return t("part").select("p_partkey", score.alias("score"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN 100.0e0 WHEN o_orderstatus = 'O' THEN 80.0e0 ELSE 30.0e0 END AS score FROM orders")
def time_of_orders(t):
    return t("orders").select("o_orderkey", S.time_score(F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 2 == 0, F.col("o_orderstatus") == "O").alias("score"))


@query("""SELECT alert_id, CASE WHEN judge_score < 0.33 THEN 'noise' WHEN judge_score < 0.66 THEN 'edge' ELSE 'deal' END AS report,
  CASE WHEN judge_score >= 0.7 THEN 'deal' WHEN judge_score >= 0.3 THEN 'edge' ELSE 'noise' END AS worker FROM judged""", "judged")
def verdicts_of_both(t):
    return t("judged").select("alert_id", delivery.report_verdict(F.col("judge_score")).alias("report"), al.verdict(F.col("judge_score")).alias("worker"))


@query("""SELECT p_partkey, CASE WHEN length(p_name) > 9 THEN concat(left(p_name, 9), '…') ELSE p_name END AS short, CASE WHEN length(p_name) > 9 THEN concat(left(p_name, 9), '...') ELSE p_name END AS bytes,
  CASE WHEN p_partkey % 5 = 0 OR p_size % 7 = 0 THEN '' ELSE concat('http://', lower(p_type), '/trace/t', cast(p_partkey AS varchar)) END AS link FROM part""")
def texts_of_parts(t):
    base = F.when(F.col("p_size") % 7 != 0, F.concat(F.lit("http://"), F.lower("p_type"), F.when(F.col("p_size") % 2 == 0, "/").otherwise("")))
    trace = F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("t"), "p_partkey"))
    return t("part").select("p_partkey", X.shortened(F.col("p_name"), 9).alias("short"), X.shortened_bytes(F.col("p_name"), 9).alias("bytes"), X.trace_url(base, trace).alias("link"))


@query("""SELECT alert_id, CASE WHEN alert_id % 7 = 0 THEN NULL ELSE judge_score * CASE WHEN alert_id % 9 = 0 THEN 2 ELSE 1 END END AS score, CASE WHEN alert_id % 2 = 0 THEN model ELSE '' END AS reason
  FROM judged WHERE NOT (alert_id % 9 = 0 AND judge_score * 2 > 1) AND alert_id % 7 <> 0""", "judged")
def replies_of_judges(t):
    """Replies as models write them, with fences or without; those that are no verdict have no row."""
    score = F.when(F.col("alert_id") % 9 == 0, F.col("judge_score") * 2).otherwise(F.col("judge_score"))
    said = F.concat(F.lit('{"score": '), F.when(F.col("alert_id") % 7 == 0, F.lit('"high"')).otherwise(score.cast("string")), F.when(F.col("alert_id") % 2 == 0, F.concat(F.lit(', "reason": "'), "model", F.lit('"'))).otherwise(""), F.lit("}"))
    reply = F.when(F.col("alert_id") % 4 < 2, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).otherwise(F.concat(F.lit(" "), said, F.lit("\n")))
    return t("judged").withColumn("read", X.parsed_verdict(reply)).where("read IS NOT NULL").select("alert_id", "read.score", "read.reason")


SERIES = "CASE p_size % 6 WHEN 0 THEN 'Precision' WHEN 1 THEN 'OptiPlex' WHEN 2 THEN 'Pro' WHEN 3 THEN 'ProLiant' WHEN 4 THEN 'ThinkStation P' ELSE '' END"
SHAPE = "CASE p_partkey % 3 WHEN 0 THEN 'Tower' WHEN 1 THEN 'Rack' ELSE 'SFF' END"


@query(f"""SELECT p_partkey, CASE WHEN p_size % 6 IN (0, 4) THEN 'workstation' WHEN p_size % 6 = 1 OR p_size % 6 = 2 AND p_partkey % 3 <> 1 THEN 'desktop' ELSE '' END AS system,
  concat('Brand: ', p_brand, ', Form Factor: ', {SHAPE}, ', Series: ', {SERIES}) AS said FROM part""")
def specifics_of_parts(t):
    specifics = F.create_map(F.lit("Series"), F.expr(SERIES), F.lit("Form Factor"), F.expr(SHAPE), F.lit("Brand"), "p_brand")
    return t("part").select("p_partkey", X.system_of(specifics).alias("system"), X.specifics_text(specifics).alias("said"))


PART = "lower(replace({}, ' ', '_'))".format
BY_TYPE = f"""CASE p_type WHEN 'MEDIUM' THEN concat('server:', {PART('p_brand')}, ':', {PART('p_name')}, ':sff:partial') WHEN 'PROMO' THEN concat('cpu:', {PART('p_brand')}, ':unknown:', {PART('p_name')})
  WHEN 'STANDARD' THEN concat('nic:', cast(p_size AS varchar), 'gbe:', cast(p_partkey % 5 AS varchar), 'p:sfp+') WHEN 'SMALL' THEN concat('drive:sas:2.5:', cast(p_size AS varchar), 'tb:', CASE WHEN p_partkey % 4 = 0 THEN 'ssd'
    WHEN p_partkey % 4 = 1 THEN '10k' WHEN p_partkey % 4 = 2 THEN '7k2' ELSE 'hdd' END)
  WHEN 'ECONOMY' THEN concat('ram:ddr4:', CASE WHEN p_partkey % 3 = 0 THEN 'unknown' WHEN p_partkey % 3 = 1 THEN 'non_ecc' WHEN p_size % 2 = 0 THEN 'ecc_reg' ELSE 'ecc_unbuf' END, ':', cast(p_size AS varchar), 'gb:0')
  ELSE concat('gpu:', {PART('p_brand')}, ':', {PART('p_name')}, ':unknown:', cast(p_size AS varchar), 'gb') END"""


@query(f"SELECT p_partkey, {BY_TYPE} AS key, concat('workstation:', {PART('p_brand')}, ':', {PART('p_name')}, ':', CASE WHEN p_type IN ('PROMO', 'MEDIUM') THEN {PART('p_name')} ELSE 'unknown' END) AS system_key, 'other:tape' AS other_key FROM part")
def keys_of_parts(t):
    """Product keys of all types from the names, brands and sizes of parts."""
    size, key = F.col("p_size"), F.col("p_partkey")
    a = {
        "manufacturer": F.col("p_brand"), "vendor": F.col("p_brand"), "line": F.col("p_name"), "tier": F.lit("partial"), "drive_form_factor": F.lit("SFF"), "speed": F.concat(size, F.lit("GbE")), "port_count": key % 5, "port_type": F.lit("SFP+"),
        "interface": F.lit("SAS"), "form_factor": F.lit("2.5"), "capacity": F.concat(size, F.lit("TB")), "type": F.when(key % 4 == 0, "SSD").otherwise("HDD"), "rpm": F.when(key % 4 == 1, 10000).when(key % 4 == 2, 7200),
        "generation": F.lit("DDR4"), "ecc": F.when(key % 3 != 0, key % 3 == 2), "registered": size % 2 == 0, "capacity_gb": size, "vram_gb": size,
        "family": F.when(F.col("p_type") == "PROMO", F.lit(None)).otherwise(F.col("p_name")), "model": F.when(F.col("p_type").isin("PROMO", "MEDIUM"), F.col("p_name")),
    }
    kind = F.expr("CASE p_type WHEN 'ECONOMY' THEN 'ram' WHEN 'SMALL' THEN 'drive' WHEN 'MEDIUM' THEN 'server' WHEN 'PROMO' THEN 'cpu' WHEN 'STANDARD' THEN 'nic' ELSE 'gpu' END")
    return t("part").select("p_partkey", A.product_key(kind, a).alias("key"), A.product_key(F.lit("workstation"), a).alias("system_key"), A.product_key(F.lit("tape"), a).alias("other_key"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_quantity % 6 WHEN 0 THEN 1600 WHEN 1 THEN 2400 WHEN 2 THEN 3200 WHEN 3 THEN 6400 ELSE NULL END AS mhz,
  CASE l_linenumber WHEN 1 THEN 'new' WHEN 2 THEN 'used_working' WHEN 3 THEN 'for_parts' WHEN 4 THEN 'like_new' ELSE 'unknown' END AS condition FROM lineitem""")
def modules_and_conditions(t):
    number = F.expr("CASE cast(l_quantity % 6 AS int) WHEN 0 THEN ' pc3-12800R' WHEN 1 THEN 'PC4-19200T\t' WHEN 2 THEN '25600' WHEN 3 THEN 'pc551200' WHEN 4 THEN 'PC4-1' END")
    raw = F.expr("CASE l_linenumber WHEN 1 THEN '\tBrand New' WHEN 2 THEN 'Pre-Owned\n' WHEN 3 THEN 'AS-IS' WHEN 4 THEN ' open BOX ' ELSE concat('lot ', l_linestatus) END")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", T.module_speed(number).alias("mhz"), T.condition(raw).alias("condition"))


@query("""SELECT event_id, concat(event_type, chr(9), ' ', event_type) AS clean FROM events WHERE length(event_type) < 90""")
def harmless_texts(t):
    return t("events").select("event_id", X.harmless(F.concat("event_type", F.lit("\t\u0007"), F.lit(" \n\u0085"), "event_type")).alias("clean"))


MONEY2 = "printf('%d.%02d', cast(floor(c / 100) AS bigint), cast(c % 100 AS bigint))"


@query(f"""SELECT o_orderkey, concat('$', {MONEY2}) AS dollars, {MONEY2} AS bare, concat(CASE WHEN o_orderkey % 3 = 0 THEN 'USD' ELSE 'EUR' END, ' ', {MONEY2}) AS with_currency,
  TIMESTAMP '2001-09-09 01:46:40' + to_milliseconds(o_orderkey) AS moment FROM (SELECT o_orderkey, cast(o_totalprice * 100 AS bigint) AS c FROM orders)""")
def money_and_moments(t):
    price = F.col("o_totalprice")
    currency = F.when(F.col("o_orderkey") % 6 == 0, "").when(F.col("o_orderkey") % 3 != 0, "EUR")
    moment = X.whole_seconds(F.lit(1_000_000_000) + F.col("o_orderkey") / 1000)
    return t("orders").select("o_orderkey", X.dollars(price).alias("dollars"), X.plain_money(price).alias("bare"), X.money(price, currency).alias("with_currency"), moment.alias("moment"))


@query("""SELECT concat(cast(l_orderkey AS varchar), '-', cast(l_linenumber AS varchar)) AS item_id, coalesce(try_cast(CASE WHEN l_partkey % 10 = 0 THEN 'on request' ELSE cast(l_extendedprice AS varchar) END AS double), 0) AS price,
  CASE WHEN l_suppkey % 2 = 0 THEN 'EUR' ELSE 'USD' END AS currency, CASE WHEN l_partkey % 4 = 0 THEN l_discount END AS shipping_cost,
  CASE WHEN l_linenumber % 3 = 0 THEN 'auction' WHEN l_linenumber % 3 = 1 THEN 'best_offer' ELSE 'buy_it_now' END AS listing_type, CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE cast(l_quantity AS int) END AS seller_feedback_score,
  CASE WHEN l_suppkey % 5 = 0 THEN 0 ELSE 98.5e0 END AS seller_feedback_pct, l_returnflag = 'R' AS seller_top_rated, CASE WHEN l_returnflag = 'N' THEN 'new' ELSE 'used_working' END AS condition_norm FROM lineitem""")
def listings_of_items(t):
    """Nested items of a feed, as JSON text and back, to listings."""
    both = F.array(F.lit("FIXED_PRICE"), F.when(F.col("l_linenumber") % 3 == 0, "AUCTION").when(F.col("l_linenumber") % 3 == 1, "BEST_OFFER").otherwise("CLASSIFIED"), F.when(F.col("l_linenumber") % 3 == 0, "BEST_OFFER"))
    price = F.struct(F.when(F.col("l_partkey") % 10 == 0, "on request").otherwise(F.col("l_extendedprice").cast("decimal(12,2)").cast("string")).alias("value"), F.when(F.col("l_suppkey") % 2 == 0, "EUR").alias("currency"))
    seller = F.when(F.col("l_suppkey") % 5 != 0, F.struct(F.lit("s").alias("username"), F.col("l_quantity").cast("int").alias("feedbackScore"), F.lit("98.5").alias("feedbackPercentage")))
    shipping = F.when(F.col("l_partkey") % 4 == 0, F.array(F.struct(F.struct(F.col("l_discount").cast("string").alias("value")).alias("shippingCost"))))
    item = F.struct(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("itemId"), price.alias("price"), seller.alias("seller"), F.when(F.col("l_returnflag") == "N", " New").otherwise("Used\t").alias("condition"),
        F.array_compact(both).alias("buyingOptions"), shipping.alias("shippingOptions"), (F.col("l_returnflag") == "R").alias("topRatedBuyingExperience"),
    )
    items = t("lineitem").select(F.from_json(F.to_json(item), f"STRUCT<{feed.ITEM}>").alias("item")).select("item.*")
    return feed.to_listings(items).select("item_id", "price", "currency", "shipping_cost", "listing_type", "seller_feedback_score", "seller_feedback_pct", "seller_top_rated", "condition_norm")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
def lookup_by_key(t):
    return feed.lookup(t("orders"), o_custkey=7).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderkey > 1234 ORDER BY o_orderkey LIMIT 300")
def page_after_cursor(t):
    return state.after(t("orders"), 1234, 300, "o_orderkey").select("o_orderkey", "o_orderdate")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN concat(p_name, ' new') ELSE p_name END AS p_name, CASE WHEN p_partkey % 8 = 0 THEN 0 ELSE p_size END AS p_size FROM part""")
def partial_updates(t):
    new = t("part").where(F.col("p_partkey") % 4 == 0).select("p_partkey", F.concat("p_name", F.lit(" new")).alias("p_name"), F.when(F.col("p_partkey") % 8 == 0, 0).alias("p_size"))
    return state.partial_update(t("part"), new, "p_partkey").select("p_partkey", "p_name", "p_size")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN CASE WHEN p_partkey % 12 = 0 THEN NULL ELSE 'gpu' END ELSE p_type END AS component_type, CASE WHEN p_partkey % 6 = 0 THEN 0.9e0 ELSE 0.5e0 END AS confidence FROM part""")
def extraction_updates(t):
    """What an extraction found replaces what was known; nulls replace too."""
    rows = t("part").select("p_partkey", F.col("p_type").alias("component_type"), F.lit(0.5).alias("confidence"))
    found = rows.where(F.col("p_partkey") % 6 == 0).select("p_partkey", F.when(F.col("p_partkey") % 12 != 0, "gpu").alias("component_type"), F.lit(0.9).alias("confidence"))
    return state.apply_updates(rows, found.unionByName(found), "p_partkey")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) GROUP BY o_custkey")
def inserts_once(t):
    new = t("orders").select("o_custkey", "o_orderkey").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return state.insert_unless(new.unionByName(new), t("customer").where("c_nationkey < 12").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


@query("SELECT s_nationkey, max(value) AS max, sum(value) AS sum FROM (SELECT s_nationkey, s_suppkey % 10 AS name, arg_max(cast(round(s_acctbal) AS bigint), (s_suppkey, cast(round(s_acctbal) AS bigint))) AS value FROM supplier GROUP BY ALL) GROUP BY s_nationkey")
def newest_gauges(t):
    samples = t("supplier").select("s_nationkey", (F.col("s_suppkey") % 10).alias("name"), F.col("s_suppkey").alias("ts"), F.round("s_acctbal").cast("long").alias("value"))
    return series.gauges(samples, "name", ["s_nationkey"])


@query("SELECT event_type AS name, epoch(TIMESTAMP '2024-03-01') - max(cast(floor(epoch(ts)) AS bigint)) AS age_seconds FROM events WHERE value > 0 GROUP BY event_type")
def gauge_freshness(t):
    samples = t("events").where("value > 0").select(F.col("event_type").alias("name"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("value"))
    return series.freshness(samples, "2024-03-01 00:00:00")


@query("SELECT event_type, cast(count(*) FILTER (WHERE value > 50) * 100.0e0 / count(*) AS decimal(20,6)) AS share, cast(count(*) * 60 / 300.0e0 AS decimal(20,6)) AS a_minute FROM events GROUP BY event_type")
def shares_and_rates(t):
    n = F.count(F.lit(1))
    return t("events").groupBy("event_type").agg(series.percent(F.count_if(F.col("value") > 50), n).cast("decimal(20,6)").alias("share"), series.per_minute(n / 300.0).cast("decimal(20,6)").alias("a_minute"))


@query("SELECT p_partkey, concat('Name the type of \"', p_name, '\" by ', p_brand, '. {p_type}') AS prompt FROM part")
def filled_prompts(t):
    return t("part").select("p_partkey", X.filled('Name the type of "{name}" by {brand}. {last}', {"name": F.col("p_name"), "brand": F.col("p_brand"), "last": F.lit("{p_type}")}).alias("prompt"))


class Echo:
    """Stands for a model: says what a prompt's last word says."""

    def generate(self, prompts):
        return [(f"```json\n{{\"score\": 0.{p.split()[-1]}, \"reason\": \"as said\"}}\n```", 10, 2) for p in prompts]


@query("SELECT alert_id, cast(concat('0.', cast(score AS varchar)) AS double) AS judge_score, 'as said' AS judge_reason FROM alerts", "listings", "alerts")
def judged_by_model(t):
    """U4 with a stand-in model: prompts are filled, sent in batches, replies read."""
    rows = extraction.judged(t("alerts").select("alert_id", "score"), "Judge {id}: {score}", {"id": F.col("alert_id"), "score": F.col("score")}, Echo)
    return rows.select("alert_id", "judge_score", "judge_reason")


@query("SELECT alert_id, score, created_at FROM alerts ORDER BY score DESC, created_at DESC, alert_id DESC LIMIT 40 OFFSET 80", "listings", "alerts")
def snapshot_page(t):
    """A page of alerts from a sorted snapshot, of which only the parts that hold the page are read."""
    rows = t("alerts").select("alert_id", "score", "created_at")
    order = [F.col("score").desc(), F.col("created_at").desc(), F.col("alert_id").desc()]
    path = work_folder(rows.sparkSession, "alerts")
    snapshots.write_sorted(rows, order, path, part_rows=2000)
    return snapshots.page_of(rows.sparkSession, path, order, 3, 40)[0]


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%ED%dg%' OR p_name ILIKE '%small r%'")
def titles_by_index(t):
    """Names that contain a text, with a wildcard in one of them, through an index of trigrams."""
    rows = t("part").select("p_partkey", "p_name")
    path = work_folder(rows.sparkSession, "titles")
    search_index.write_index(rows, "p_partkey", "p_name", path)
    found = [search_index.search_titles(rows, "p_partkey", "p_name", text, path) for text in ("ED%dg", "small r")]
    return found[0].unionByName(found[1]).distinct()


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 2 = 0 THEN 0 ELSE 1 END AS batch FROM orders""")
def versions_of_orders(t):
    """Orders taken into a table of versions in three batches, each of them twice; the last one changes a third of the rows."""
    rows = t("orders").select("o_orderkey", "o_totalprice")
    table = Versions(rows.sparkSession, work_folder(rows.sparkSession, "orders"), ["o_orderkey"], "o_orderkey long, o_totalprice double, batch int", buckets=8)
    take = taking(table, "orders", lambda old, new: state.upserted(old, new, "o_orderkey"))
    first, second = rows.where(F.col("o_orderkey") % 2 == 0), rows.where(F.col("o_orderkey") % 2 == 1)
    third = rows.where(F.col("o_orderkey") % 3 == 0).withColumn("o_totalprice", F.col("o_totalprice") * 2)
    for number, batch in enumerate((first, second, third)):
        for _ in range(2):
            take(batch.withColumn("batch", F.lit(number)), number)
    return table.read()
