"""The library's queries over the plain tables, each with the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import attributes as A
from ..functions import scoring as S
from ..functions import texts as X
from ..functions import titles as T
from ..functions import validation
from ..functions import variants as V
from ..operators import alerts as al
from ..operators import budget, delivery, evals, extraction, market, rolling, series, state, worklists
from ..sources import feed
from .fixtures import AS_OF, oracle, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    """Registers a function of a table reader under its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: table(spark, sf_dir, name))
        if sql:
            ORACLE_SQL[f.__name__] = oracle(sql, *views)
        return f

    return add


PAID = "CASE WHEN quantity > 1 THEN (coalesce(sold_price, price) + coalesce(shipping_cost, 0)) / quantity ELSE coalesce(sold_price, price) + coalesce(shipping_cost, 0) END"
UNIT = "CASE WHEN quantity > 1 THEN (price + coalesce(shipping_cost, 0)) / quantity ELSE price + coalesce(shipping_cost, 0) END"
MONEY = "cast(cast(cast({} AS decimal(20,6)) AS decimal(10,2)) AS double)".format
SINCE = f"TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY"
BASE = f"""(SELECT product_key, sample_count, {", ".join(f"{MONEY(f'p[{k}]')} AS p{n}" for k, n in enumerate((10, 25, 50, 75, 90), 1))}, {MONEY("m")} AS mean FROM (
  SELECT product_key, count(*) AS sample_count, quantile_cont(u, [0.1, 0.25, 0.5, 0.75, 0.9]) AS p, avg(u) AS m FROM (SELECT *, {PAID} AS u FROM listings)
  WHERE active AND product_key <> '' AND condition_norm <> 'for_parts' AND updated_at >= {SINCE} GROUP BY product_key HAVING count(*) >= 5))"""


def lerp(lo: str, hi: str, a: float, b: float) -> str:
    return f"CASE WHEN {hi} = {lo} THEN {a}.0e0 ELSE {a} + (unit_price - {lo}) / ({hi} - {lo}) * ({b - a}) END"


PRICE = f"""CASE WHEN sample_count IS NULL OR sample_count < 10 THEN 50.0e0 WHEN unit_price <= p10 THEN 100.0e0 WHEN unit_price <= p25 THEN {lerp("p10", "p25", 100, 70)}
  WHEN unit_price <= p50 THEN {lerp("p25", "p50", 70, 30)} WHEN unit_price <= p75 THEN {lerp("p50", "p75", 30, 10)} WHEN unit_price <= p90 THEN {lerp("p75", "p90", 10, 0)} ELSE 0.0e0 END"""
SELLER_BOTH = """((CASE WHEN seller_feedback_score >= 5000 THEN 100.0e0 WHEN seller_feedback_score >= 500 THEN 70.0e0 WHEN seller_feedback_score >= 100 THEN 40.0e0 ELSE 10.0e0 END
  + CASE WHEN seller_feedback_pct >= 99.5e0 THEN 100.0e0 WHEN seller_feedback_pct >= 98.0e0 THEN 80.0e0 WHEN seller_feedback_pct >= 95.0e0 THEN 50.0e0 ELSE 0.0e0 END) / 2)"""
SELLER = f"CASE WHEN seller_top_rated THEN least({SELLER_BOTH} + 20, 100.0e0) ELSE {SELLER_BOTH} END"
CONDITION = "CASE condition_norm WHEN 'new' THEN 100.0e0 WHEN 'like_new' THEN 90.0e0 WHEN 'used_working' THEN 70.0e0 WHEN 'for_parts' THEN 10.0e0 ELSE 40.0e0 END"
QUANTITY = "CASE WHEN quantity >= 16 THEN 90.0e0 WHEN quantity >= 8 THEN 80.0e0 WHEN quantity >= 4 THEN 70.0e0 WHEN quantity > 1 THEN 60.0e0 ELSE 50.0e0 END"
TIME = f"""CASE WHEN listing_type = 'auction' AND auction_end_at IS NOT NULL AND auction_end_at < TIMESTAMP '{AS_OF}' + INTERVAL 4 HOUR THEN 100.0e0
  WHEN first_seen_at > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR THEN 80.0e0 ELSE 30.0e0 END"""
QUALITY = "CASE WHEN image_url <> '' THEN 40.0e0 ELSE 0.0e0 END + CASE WHEN attributes IS NOT NULL AND attributes <> '{}' THEN 30.0e0 ELSE 0.0e0 END"
SCORED = f"""(SELECT *, cast(least(greatest(round(price_score * 0.4e0 + seller_score * 0.2e0 + condition_score * 0.15e0 + quantity_score * 0.1e0 + quality_score * 0.1e0 + time_score * 0.05e0), 0), 100) AS int) AS score FROM (
  SELECT *, {PRICE} AS price_score, {SELLER} AS seller_score, {CONDITION} AS condition_score, {QUANTITY} AS quantity_score, {QUALITY} AS quality_score, {TIME} AS time_score FROM (
    SELECT l.*, {UNIT} AS unit_price, sample_count, p10, p25, p50, p75, p90 FROM listings l LEFT JOIN {BASE} b ON b.product_key = l.product_key WHERE active AND l.product_key <> '')))"""


def base_of(t) -> DataFrame:
    return market.baselines(t("listings"), AS_OF)


def scored_of(t) -> DataFrame:
    return market.scored(t("listings"), base_of(t), AS_OF)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship_scored_listings"](spark, sf_dir)


SCORES = ["listing_id", "product_key", "score", "price_score", "seller_score", "condition_score", "quantity_score", "quality_score", "time_score"]


@query(f"SELECT {', '.join(SCORES)} FROM {SCORED} ORDER BY score DESC, listing_id LIMIT 500", "listings")
def flagship_scored_listings(t):
    return market.page(scored_of(t).select(*SCORES), "score", 500)


@query(f"SELECT * FROM {BASE}", "listings")
def baseline_recompute(t):
    return base_of(t)


@query(f"SELECT l.listing_id, l.product_key, {MONEY(UNIT)} AS unit_price, sample_count, p50 FROM listings l LEFT JOIN {BASE} b ON b.product_key = l.product_key WHERE active", "listings")
def listings_with_baseline(t):
    rows = market.with_baseline(t("listings"), base_of(t))
    return rows.select("listing_id", "product_key", S.money(F.col("unit_price")).alias("unit_price"), "sample_count", "p50")


@query(f"SELECT listing_id, {MONEY(UNIT)} AS unit_price FROM listings", "listings")
def unit_price(t):
    return market.priced(t("listings")).select("listing_id", S.money(F.col("unit_price")).alias("unit_price"))


@query(f"SELECT listing_id, cast(round(price_score, 3) AS decimal(9,3)) AS price_score FROM {SCORED}", "listings")
def price_score(t):
    return scored_of(t).select("listing_id", F.round("price_score", 3).cast("decimal(9,3)").alias("price_score"))


@query(f"SELECT listing_id, {SELLER} AS seller_score FROM listings", "listings")
def seller_score(t):
    return t("listings").select("listing_id", S.seller_score(F.col("seller_feedback_score"), F.col("seller_feedback_pct"), F.col("seller_top_rated")).alias("seller_score"))


@query(f"SELECT score, count(*) AS n FROM {SCORED} GROUP BY score", "listings")
def composite_score(t):
    return scored_of(t).groupBy("score").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT listing_id, CASE component_type WHEN 'ram' THEN concat('ram:ddr4:', CASE WHEN ecc THEN 'ecc_unbuf' ELSE 'non_ecc' END, ':', cast(capacity_gb AS string), 'gb:', cast(coalesce(speed_mhz, 0) AS string))
  WHEN 'drive' THEN 'drive:unknown:unknown:unknown:unknown' WHEN 'server' THEN 'server:unknown:unknown:unknown:unknown' WHEN 'cpu' THEN 'cpu:unknown:unknown:unknown' WHEN 'nic' THEN 'nic:unknown:0p:unknown'
  WHEN 'gpu' THEN concat('gpu:unknown:unknown:unknown:', cast(capacity_gb AS string), 'gb') END AS key FROM listings""", "listings")  # fmt: skip
def product_key(t):
    attributes = {"generation": F.lit("DDR4"), "ecc": F.col("ecc"), "capacity_gb": F.col("capacity_gb"), "speed_mhz": F.col("speed_mhz"), "vram_gb": F.col("capacity_gb")}
    return t("listings").select("listing_id", A.product_key(F.col("component_type"), attributes).alias("key"))


@query(f"SELECT listing_id, CASE WHEN {T.in_sql(T.BAREBONE)} THEN 'barebone' WHEN {T.in_sql(T.CPU_PRESENT)} AND {T.in_sql(T.RAM_PRESENT)} THEN 'configured' ELSE 'partial' END AS tier FROM listings", "listings")
def server_tier(t):
    return t("listings").select("listing_id", T.server_tier(F.col("title")).alias("tier"))


@query(f"SELECT listing_id, {T.in_sql(T.COMPOUND_ACCESSORY)} OR ({T.in_sql(T.ACCESSORY)} AND NOT {T.in_sql(T.PRIMARY)}) AS accessory FROM listings", "listings")
def accessory_only(t):
    return t("listings").select("listing_id", T.accessory_only(F.col("title")).alias("accessory"))


@query(f"SELECT listing_id, CASE WHEN NOT {T.in_sql(T.COMPLETE)} THEN '' WHEN {T.in_sql(T.WORKSTATION)} THEN 'workstation' WHEN {T.in_sql(T.DESKTOP)} THEN 'desktop' ELSE '' END AS system FROM listings", "listings")
def system_type_title(t):
    return t("listings").select("listing_id", T.system_type(F.col("title")).alias("system"))


@query(f"SELECT o_orderkey, coalesce({T.case_sql(T.CONDITIONS, 'raw')}, 'unknown') AS condition FROM (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'brand new' WHEN 1 THEN 'pre-owned' WHEN 2 THEN 'as-is' WHEN 3 THEN 'open box' ELSE lower(o_orderpriority) END AS raw FROM orders)")
def condition_norm(t):
    key = F.col("o_orderkey") % 5
    raw = F.when(key == 0, " Brand New").when(key == 1, "Pre-Owned").when(key == 2, "AS-IS").when(key == 3, "Open box ").otherwise(F.col("o_orderpriority"))
    return t("orders").select("o_orderkey", T.condition(raw).alias("condition"))


@query(f"""SELECT listing_id, coalesce({T.case_sql(T.MODULE_MHZ, f"regexp_extract(title, '{T.MODULE}', 1)")},
  CASE WHEN try_cast(regexp_extract(title, '{T.SPEED}', 1) AS int) BETWEEN 800 AND 8400 THEN try_cast(regexp_extract(title, '{T.SPEED}', 1) AS int) END) AS mhz FROM listings""", "listings")  # fmt: skip
def pc4_speed(t):
    return t("listings").select("listing_id", T.title_speed(F.col("title")).alias("mhz"))


@query("""SELECT o_orderkey, CASE WHEN v <= 1024 THEN v WHEN v % 1024 = 0 AND v // 1024 BETWEEN 1 AND 1024 THEN v // 1024 WHEN v % 1000 = 0 AND v // 1000 BETWEEN 1 AND 1024 THEN v // 1000 ELSE v END AS capacity_gb
  FROM (SELECT o_orderkey, (o_orderkey % 64) * CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1024 ELSE 1000 END AS v FROM orders)""")
def capacity_fix(t):
    key = F.col("o_orderkey")
    value = (key % 64) * F.when(key % 3 == 0, 1).when(key % 3 == 1, 1024).otherwise(1000)
    return t("orders").select("o_orderkey", A.fewer_units(value, 1024).cast("long").alias("capacity_gb"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'geforce-rtx' WHEN 1 THEN 'quadro-rtx' WHEN 2 THEN 'a-series' ELSE 'radeon-pro' END AS family,
  CASE p_partkey % 4 WHEN 0 THEN '3090ti' WHEN 1 THEN 'a2000' WHEN 2 THEN 'a100' ELSE 'w6800' END AS model, CASE WHEN p_partkey % 2 = 0 THEN 24 ELSE 20 END AS vram_gb FROM part""")
def gpu_canonical(t):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = t("part").select("p_partkey", pick("RTX 3090_Ti", "rtx_A2000", "A100", "W6800").alias("m"), pick("GeForce", "Quadro", "Tesla", "Radeon Pro").alias("f"), F.when(F.col("p_partkey") % 2 == 0, 23552).otherwise(20).alias("v"))
    return rows.select("p_partkey", A.gpu_family(F.col("f"), F.col("m")).alias("family"), A.gpu_model(F.col("m")).alias("model"), A.gpu_vram(F.col("v")).cast("int").alias("vram_gb"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'dell' WHEN 1 THEN 'hp' WHEN 2 THEN 'lenovo' ELSE 'some-maker' END AS vendor,
  CASE p_partkey % 4 WHEN 0 THEN 'precision' WHEN 1 THEN 'z-by-hp' WHEN 2 THEN 'thinkcentre' ELSE 'tower-line' END AS line,
  CASE p_partkey % 4 WHEN 0 THEN 't3620' WHEN 1 THEN 'z8 g4' WHEN 2 THEN 'm720' ELSE 'x1' END AS model FROM part""")
def system_canonical(t):
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = t("part").select("p_partkey", pick("Dell Inc.", "HPE", "IBM", "Some Maker").alias("v"), pick("PowerEdge", "HP Z", "", "Tower Line").alias("l"), pick("Dell T3620", "hp_Z8 G4", "Lenovo M720", "X1").alias("m"))
    return rows.select("p_partkey", A.system_vendor(F.col("v")).alias("vendor"), A.system_line(F.col("l"), F.col("m")).alias("line"), A.system_model(F.col("m")).alias("model"))


@query("SELECT listing_id, price, component_type FROM listings WHERE component_type = 'gpu' AND condition_norm IN ('new', 'like_new') AND seller_feedback_score >= 500 ORDER BY price ASC NULLS LAST, listing_id LIMIT 100 OFFSET 50", "listings")
def listing_filter_page(t):
    keep = market.any_of({"component_type": "gpu", "conditions": ["new", "like_new"], "min_feedback": 500, "max_price": None})
    return market.page(t("listings").where(keep).select("listing_id", "price", "component_type"), "price", 100, 50)


@query("SELECT count(*) AS n FROM listings WHERE component_type = 'gpu' AND price <= 20000", "listings")
def listing_count(t):
    return t("listings").where(market.any_of({"component_type": "gpu", "max_price": 20000})).agg(F.count(F.lit(1)).alias("n"))


LACKING = """active AND component_type IS NOT NULL AND (component_type = 'ram' AND (product_key LIKE '%:0' OR json_extract_string(attributes, '$.speed_mhz') IS NULL)
  OR component_type = 'drive' AND product_key LIKE '%:unknown%')"""


@query(f"SELECT listing_id FROM listings WHERE {LACKING}", "listings")
def incomplete(t):
    return market.incomplete(t("listings")).select("listing_id")


@query(f"SELECT listing_id FROM listings WHERE component_type = 'drive' AND {LACKING}", "listings")
def incomplete_of_type(t):
    return market.incomplete(t("listings"), "drive").select("listing_id")


@query(f"SELECT count(*) AS total_incomplete, 0 AS types FROM listings WHERE {LACKING}", "listings")
def extraction_stats(t):
    return market.extraction_stats(t("listings")).select("total_incomplete", F.size("by_type").alias("types"))


@query("SELECT listing_id, coalesce(condition_norm, 'unknown') AS condition_norm, coalesce(product_key, '') AS product_key, coalesce(attributes, '{{}}') AS attributes FROM listings".replace("{{}}", "{}"), "listings")
def listing_defaults(t):
    return market.with_defaults(t("listings")).select("listing_id", "condition_norm", "product_key", "attributes")


@query(f"SELECT listing_id, {QUALITY} AS quality_score, {TIME} AS time_score FROM listings", "listings")
def quality_and_time(t):
    x = S.inputs(AS_OF)
    quality = S.quality_score(x["has_images"], x["has_specifics"], F.lit(0))
    return t("listings").select("listing_id", quality.alias("quality_score"), S.time_score(x["is_auction"], x["ending_soon"], x["is_new"]).alias("time_score"))


WATCH = """unit_price <= coalesce(price_max, unit_price) AND unit_price >= coalesce(price_min, unit_price) AND seller_feedback_score >= min_feedback
  AND seller_feedback_pct >= coalesce(min_feedback_pct, seller_feedback_pct) AND (NOT top_rated_only OR seller_top_rated) AND (conditions = '' OR list_contains(string_split(conditions, ','), condition_norm))
  AND enabled AND CASE w.watch_id WHEN 0 THEN coalesce(cast(json_extract(attributes, '$.capacity_gb') AS double) BETWEEN 16 AND 48, false)
    WHEN 2 THEN coalesce(cast(json_extract(attributes, '$.speed_mhz') AS double) IN (2666, 3200), false) WHEN 5 THEN coalesce(json_extract_string(attributes, '$.ecc') = 'true', false) ELSE true END"""
MATCHED = f"(SELECT s.*, w.watch_id, w.score_threshold FROM {SCORED} s JOIN watches w ON w.component_type = s.component_type WHERE s.score >= w.score_threshold AND {WATCH})"


@query(f"SELECT watch_id, listing_id, score FROM {MATCHED}", "listings", "watches")
def watch_match(t):
    return al.watch_matches(scored_of(t), t("watches")).select("watch_id", "listing_id", "score")


MANY = f"""(SELECT s.listing_id, s.score, w.watch_id, w.component_type FROM {SCORED} s JOIN many_watches w ON w.component_type = s.component_type WHERE s.score >= w.score_threshold AND w.enabled
  AND (price_max IS NULL OR unit_price <= price_max) AND (price_min IS NULL OR unit_price >= price_min) AND (min_feedback = 0 OR seller_feedback_score >= min_feedback)
  AND (min_feedback_pct IS NULL OR seller_feedback_pct >= min_feedback_pct) AND (NOT top_rated_only OR seller_top_rated) AND (conditions = '' OR list_contains(string_split(conditions, ','), condition_norm)))"""


@query(f"SELECT watch_id, listing_id, score FROM {MANY}", "listings", "many_watches")
def many_watches_match(t):
    return al.watch_matches(scored_of(t), t("many_watches").drop("watch_name")).select("watch_id", "listing_id", "score")


@query(f"SELECT w.watch_id, count(m.listing_id) AS n, max(m.score) AS best FROM many_watches w LEFT JOIN {MANY} m ON m.watch_id = w.watch_id GROUP BY w.watch_id", "listings", "many_watches")
def matches_by_watch(t):
    found = al.watch_matches(scored_of(t), t("many_watches").drop("watch_name")).groupBy("watch_id").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))
    return t("many_watches").select("watch_id").join(found, "watch_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


RECENT = f"TIMESTAMP '{AS_OF}' - INTERVAL 24000 HOUR"


@query(f"SELECT watch_id, listing_id FROM {MATCHED} m WHERE NOT EXISTS (SELECT 1 FROM alerts a WHERE a.notified AND a.notified_at > {RECENT} AND a.watch_id = m.watch_id AND a.listing_id = m.listing_id)", "listings", "watches", "alerts")
def cooldown_anti_join(t):
    return al.outside_cooldown(al.watch_matches(scored_of(t), t("watches")), t("alerts"), AS_OF, 24000).select("watch_id", "listing_id")


@query(f"SELECT watch_id, listing_id, score FROM {MATCHED} m WHERE NOT EXISTS (SELECT 1 FROM alerts a WHERE NOT a.notified AND a.watch_id = m.watch_id AND a.listing_id = m.listing_id)", "listings", "watches", "alerts")
def pending_dedupe(t):
    return al.create_alerts(al.watch_matches(scored_of(t), t("watches")).select("watch_id", "listing_id", "score"), t("alerts"))


REVIEW = "alerts a JOIN (SELECT listing_id, title, component_type, price FROM listings) l ON l.listing_id = a.listing_id JOIN watches w ON w.watch_id = a.watch_id"


@query(f"SELECT a.alert_id, a.score, l.title, w.watch_name FROM {REVIEW} WHERE NOT a.notified AND a.score >= 75 ORDER BY a.score DESC, a.created_at DESC, a.alert_id DESC LIMIT 25 OFFSET 25", "listings", "watches", "alerts")
def alert_review_page(t):
    rows = al.review(t("alerts"), t("listings"), t("watches"), "active", 75)
    return al.review_page(rows, "", 2)[0].select("alert_id", "score", "title", "watch_name")


@query(f"SELECT a.alert_id, w.watch_name FROM {REVIEW} WHERE a.watch_id = 3 ORDER BY a.created_at DESC, a.alert_id DESC LIMIT 100", "listings", "watches", "alerts")
def review_by_watch(t):
    return al.review_page(al.review(t("alerts"), t("listings"), t("watches"), "all", watch_id=3), "created", 0, 500)[0].select("alert_id", "watch_name")


@query(f"SELECT a.alert_id, w.watch_name FROM {REVIEW} WHERE a.dismissed_at IS NULL ORDER BY w.watch_name, a.score DESC, a.alert_id DESC LIMIT 40 OFFSET 80", "listings", "watches", "alerts")
def review_by_name(t):
    return al.review_page(al.review(t("alerts"), t("listings"), t("watches"), "undismissed"), "watch", 3, 40)[0].select("alert_id", "watch_name")


@query(f"SELECT count(*) AS total FROM {REVIEW} WHERE a.dismissed_at IS NOT NULL AND l.component_type = 'gpu'", "listings", "watches", "alerts")
def review_total(t):
    return al.review_page(al.review(t("alerts"), t("listings"), t("watches"), "dismissed", component="gpu"))[1]


@query("SELECT alert_id FROM alerts WHERE alert_id NOT IN (SELECT alert_id FROM judged WHERE input_tokens > 900)", "listings", "alerts", "judged")
def undelivered(t):
    tried = t("judged").select("alert_id", (F.col("input_tokens") > 900).alias("succeeded"))
    return al.undelivered(t("alerts"), tried).select("alert_id")


@query("SELECT count(*) FILTER (WHERE NOT notified) AS active, count(*) FILTER (WHERE notified) AS notified, count(*) FILTER (WHERE dismissed_at IS NOT NULL) AS dismissed, max(created_at) AS newest FROM alerts", "listings", "alerts")
def alert_status_counts(t):
    return t("alerts").agg(F.count_if(~F.col("notified")).alias("active"), F.count_if("notified").alias("notified"), F.count_if(F.col("dismissed_at").isNotNull()).alias("dismissed"), F.max("created_at").alias("newest"))


@query(f"SELECT a.alert_id, l.title FROM {REVIEW} WHERE l.title ILIKE '%xeon%'", "listings", "watches", "alerts")
def title_ilike(t):
    return al.review(t("alerts"), t("listings"), t("watches"), "all", search="xeon").select("alert_id", "title")


@query(f"""SELECT a.alert_id, w.watch_name, a.score, w.score_threshold, l.title, coalesce(b.sample_count, 0) AS sample_count, coalesce(b.p25, 0) AS p25, coalesce(b.p50, 0) AS p50, coalesce(a.trace_id, '') AS trace_id
  FROM alerts a JOIN listings l ON l.listing_id = a.listing_id JOIN watches w ON w.watch_id = a.watch_id LEFT JOIN {BASE} b ON b.product_key = l.product_key
  WHERE a.created_at >= TIMESTAMP '1995-06-01' AND a.alert_id NOT IN (SELECT alert_id FROM judged) ORDER BY a.created_at DESC NULLS LAST, a.alert_id LIMIT 500""", "listings", "watches", "alerts", "judged")  # fmt: skip
def judge_candidates(t):
    rows = al.judge_candidates(t("alerts"), t("listings"), t("watches"), base_of(t), t("judged"), "1995-06-01 00:00:00", 500)
    return al.judge_context(rows).select("alert_id", "watch_name", "score", "score_threshold", "title", "sample_count", "p25", "p50", "trace_id")


RATES = "(VALUES ('small-model', 0.5e0, 1.5e0)) AS r(model, input_rate, output_rate)"
COST = f"(SELECT j.*, coalesce(input_tokens / 1e6 * input_rate + output_tokens / 1e6 * output_rate, 0) AS cost FROM judged j LEFT JOIN {RATES} ON r.model = j.model)"


def costs_of(t) -> DataFrame:
    judged = t("judged")
    return al.cost(judged.sparkSession.sql(f"SELECT * FROM {RATES}"), judged)


@query(f"SELECT date_trunc('day', judged_at)::timestamp AS day, model, count(*) AS n, cast(sum(cast(cost AS decimal(20,9))) AS decimal(20,4)) AS spend, cast(sum(input_tokens) AS bigint) AS input_tokens FROM {COST} GROUP BY ALL", "judged")
def judge_spend_daily(t):
    day = F.date_trunc("day", F.col("judged_at").cast("timestamp")).cast("timestamp_ntz").alias("day")
    return costs_of(t).groupBy(day, "model").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("cost").cast("decimal(20,9)")).cast("decimal(20,4)").alias("spend"), F.sum("input_tokens").alias("input_tokens"))


@query(f"SELECT alert_id FROM (SELECT *, coalesce(sum(cost) OVER (ORDER BY judged_at, alert_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT * FROM {COST} ORDER BY judged_at, alert_id LIMIT 200)) WHERE before < 0.01", "judged")
def budget_cut(t):
    batch = costs_of(t).orderBy("judged_at", "alert_id").limit(200)
    return al.within_budget(batch, 0.01).select("alert_id")


@query("""SELECT CASE WHEN judge_score < 0.33 THEN 'noise' WHEN judge_score < 0.66 THEN 'edge' ELSE 'deal' END AS verdict, dismissed_at IS NOT NULL AS dismissed, count(*) AS n
  FROM alerts a JOIN judged j ON j.alert_id = a.alert_id WHERE created_at > TIMESTAMP '1998-07-15' - INTERVAL 900 DAY GROUP BY ALL""", "listings", "alerts", "judged")  # fmt: skip
def judge_vs_operator(t):
    recent = t("alerts").where(F.col("created_at") > F.lit("1998-07-15").cast("timestamp_ntz") - F.expr("INTERVAL 900 DAYS"))
    rows = recent.join(t("judged"), "alert_id").groupBy(delivery.report_verdict(F.col("judge_score")).alias("verdict"), F.col("dismissed_at").isNotNull().alias("dismissed"))
    return rows.agg(F.count(F.lit(1)).alias("n"))


@query("SELECT model, CASE WHEN judge_score >= 0.7 THEN 'deal' WHEN judge_score >= 0.3 THEN 'edge' ELSE 'noise' END AS verdict, count(*) AS n FROM judged GROUP BY ALL", "judged")
def verdict_counts(t):
    return t("judged").groupBy("model", al.verdict(F.col("judge_score")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority AS job_name, o_orderkey AS run_id, o_orderdate AS started_at FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_job_runs(t):
    runs = t("orders").select(F.col("o_orderpriority").alias("job_name"), F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"))
    return state.latest(runs, "job_name", F.col("started_at").desc(), F.col("run_id").desc())


@query("SELECT job_id, priority, attempts + 1 AS attempts FROM queue WHERE NOT completed AND NOT claimed ORDER BY priority DESC, enqueued_at, job_id LIMIT 100", "queue")
def queue_claim(t):
    return state.claim(t("queue"), 100).select("job_id", "priority", "attempts")


@query("SELECT priority, count(*) AS n, count(*) FILTER (WHERE NOT completed) AS depth, count(*) FILTER (WHERE error_text IS NOT NULL) AS failed FROM queue GROUP BY priority", "queue")
def queue_health(t):
    return t("queue").groupBy("priority").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("completed")).alias("depth"), F.count_if(F.col("error_text").isNotNull()).alias("failed"))


@query(f"SELECT product_key, sample_count FROM {BASE} WHERE product_key NOT IN (SELECT product_key FROM listings WHERE price > 104000 AND product_key IS NOT NULL)", "listings")
def orphan_baselines(t):
    return state.orphans(base_of(t), t("listings").where("price > 104000")).select("product_key", "sample_count")


@query(f"""SELECT (SELECT count(*) FROM watches) AS watches_total, (SELECT count(*) FROM watches WHERE enabled) AS watches_enabled, (SELECT count(*) FROM listings WHERE active) AS listings_total,
  (SELECT count(*) FROM listings WHERE active AND (component_type IS NULL OR component_type = '')) AS listings_unextracted, (SELECT count(*) FROM listings WHERE active AND quantity % 2 = 0) AS listings_unscored,
  (SELECT count(*) FROM listings WHERE active AND (component_type = 'ram' AND (product_key IS NULL OR product_key LIKE '%:0') OR component_type = 'drive' AND product_key LIKE '%:unknown%')) AS listings_incomplete,
  (SELECT count(*) FROM alerts WHERE NOT notified) AS alerts_pending, (SELECT count(*) FROM {BASE}) AS baselines_total, (SELECT count(*) FROM {BASE} WHERE sample_count >= 10) AS baselines_warm,
  (SELECT count(*) FROM {BASE} WHERE sample_count < 10) AS baselines_cold, (SELECT count(DISTINCT product_key) FROM listings WHERE active AND product_key IS NOT NULL AND product_key NOT IN (SELECT product_key FROM {BASE})) AS keys_without_baseline,
  (SELECT count(*) FROM queue WHERE NOT completed) AS queue_depth""", "listings", "watches", "alerts", "queue")  # fmt: skip
def system_state(t):
    listings = t("listings").withColumn("score", F.when(F.col("quantity") % 2 != 0, 50))
    return market.system_state(listings, t("watches"), t("alerts"), base_of(t), t("queue"))


@query(f"SELECT CASE WHEN {T.in_sql(T.BAREBONE)} THEN 'barebone' WHEN {T.in_sql(T.CPU_PRESENT)} AND {T.in_sql(T.RAM_PRESENT)} THEN 'configured' ELSE 'partial' END AS tier, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.9) AS p90, count(*) AS n FROM {SCORED} GROUP BY tier", "listings")
def tier_score_percentiles(t):
    p = lambda q: F.percentile("score", F.lit(q))  # noqa: E731  scores have 101 values, so groups of any size stay small
    return scored_of(t).groupBy(T.server_tier(F.col("title")).alias("tier")).agg(p(0.5).alias("p50"), p(0.9).alias("p90"), F.count(F.lit(1)).alias("n"))


@query(f"""SELECT listing_id, CASE WHEN order_key % 10 = 0 THEN price + 1 ELSE price END AS price, active OR order_key % 10 = 0 AS active, CASE WHEN order_key % 10 = 0 THEN TIMESTAMP '{AS_OF}' ELSE updated_at END AS updated_at, title FROM listings WHERE order_key % 3 <> 0
  UNION ALL SELECT listing_id, price + 1, true, TIMESTAMP '{AS_OF}', title FROM listings WHERE order_key % 3 = 0 AND order_key % 10 = 0""", "listings")  # fmt: skip
def upsert_listings(t):
    rows = t("listings").select("listing_id", "price", "active", "updated_at", "title", "order_key")
    came = rows.where("order_key % 10 = 0").withColumn("price", F.col("price") + 1).select("listing_id", "price", "title")
    return state.upsert(rows.where("order_key % 3 <> 0").drop("order_key"), came, "listing_id", ["price"], AS_OF)


@query(f"SELECT alert_id, coalesce(trace_id, '') AS trace_id, TIMESTAMP '{AS_OF}' AS dismissed_at FROM alerts WHERE dismissed_at IS NULL AND alert_id % 6 = 0", "listings", "alerts")
def dismiss_returning(t):
    ids = t("orders").where("o_orderkey % 6 = 0").select(F.col("o_orderkey").alias("alert_id"))
    return state.dismiss(t("alerts"), ids, AS_OF).select("alert_id", F.coalesce("trace_id", F.lit("")).alias("trace_id"), "dismissed_at")


@query("SELECT component_type, count(*) AS n_alerts, greatest(max(score), 0) AS max_score FROM alerts a JOIN listings l ON l.listing_id = a.listing_id GROUP BY component_type", "listings", "alerts")
def summary_by_type(t):
    return al.summary(t("alerts"), t("listings"))


@query("SELECT alert_id, watch_id, cast((row_number() OVER (PARTITION BY watch_id ORDER BY score DESC, alert_id) - 1) // 10 AS int) AS chunk FROM alerts WHERE NOT notified", "listings", "alerts")
def chunk_assign(t):
    return al.in_chunks(t("alerts").where(~F.col("notified"))).select("alert_id", "watch_id", "chunk")


@query("SELECT listing_id, component_type FROM (SELECT *, row_number() OVER (PARTITION BY component_type ORDER BY updated_at DESC, listing_id) AS rn FROM listings) ORDER BY rn, component_type LIMIT 100", "listings")
def stratified_interleave(t):
    return evals.interleaved(t("listings").select("listing_id", "component_type", "updated_at"), "component_type", 100, F.col("updated_at").desc(), F.col("listing_id")).select("listing_id", "component_type")


@query("SELECT listing_id, component_type FROM listings QUALIFY row_number() OVER (PARTITION BY component_type ORDER BY updated_at DESC, listing_id) <= 12", "listings")
def stratified_newest(t):
    return evals.stratified(t("listings"), "component_type", 12, F.col("updated_at").desc(), F.col("listing_id")).select("listing_id", "component_type")


@query("SELECT coalesce(component_type, 'overall') AS expected, count(*) AS n, count(*) FILTER (WHERE component_type = 'server' AND contains(lower(title), 'server') OR component_type = 'ram' AND contains(lower(title), 'ddr')) AS n_right FROM listings GROUP BY ROLLUP (component_type)", "listings")
def class_accuracy(t):
    guess = F.when(F.contains(F.lower("title"), F.lit("server")) & (F.col("component_type") == "server"), "server").when(F.contains(F.lower("title"), F.lit("ddr")) & (F.col("component_type") == "ram"), "ram").otherwise("")
    rows = t("listings").select(F.col("component_type").alias("expected"), guess.alias("actual"))
    return evals.accuracy_with_overall(rows, "expected", "actual").select("expected", "n", "n_right")


@query("SELECT event_type, max(value) FILTER (WHERE pos = (n - 1) * 50 // 100) AS p50, max(value) FILTER (WHERE pos = (n - 1) * 95 // 100) AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY event_type")
def nearest_rank_latency(t):
    return evals.nearest_rank(t("events").where("value IS NOT NULL"), "event_type", "value", (50, 95))


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, count(*) AS n FROM events GROUP BY ALL")
def rate_5m(t):
    return series.rates(t("events"))


@query("SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def rate_by_label(t):
    return series.rates(t("events"), 60, ["event_type"])


BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0]


def quantile_sql(q: float) -> str:
    low = [0.0, *BOUNDS]
    cases = [f"WHEN c{k + 1} >= r THEN {low[k]} + ({b} - {low[k]}) * (r - c{k}) / (c{k + 1} - c{k})" for k, b in enumerate(BOUNDS)]
    counts = ", ".join(f"count(*) FILTER (WHERE value <= {b})::double AS c{k}" for k, b in enumerate(BOUNDS, 1))
    return f"SELECT event_type, total, round(CASE {' '.join(cases)} ELSE {BOUNDS[-1]} END, 6) AS p95 FROM (SELECT event_type, count(*) AS total, {q}::double * count(*) AS r, 0::double AS c0, {counts} FROM events WHERE value IS NOT NULL GROUP BY event_type)"


@query(quantile_sql(0.95))
def histogram_quantile(t):
    hist = series.buckets(t("events").where("value IS NOT NULL"), BOUNDS, "event_type")
    return series.quantile(hist, 0.95).select("event_type", "total", F.round("quantile", 6).alias("p95"))


@query("SELECT event_type, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE value <= {b}) AS le_{int(b)}" for b in BOUNDS) + " FROM events WHERE value IS NOT NULL GROUP BY event_type")
def histogram_buckets(t):
    hist = series.buckets(t("events").where("value IS NOT NULL"), BOUNDS, "event_type")
    return hist.select("event_type", "total", *[F.col("buckets")[k]["cum"].alias(f"le_{int(b)}") for k, b in enumerate(BOUNDS)])


@query("""SELECT id, name, sum(delta) OVER (PARTITION BY name ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS increase FROM (
  SELECT *, CASE WHEN value < lag(value) OVER w THEN value ELSE coalesce(value - lag(value) OVER w, 0) END AS delta FROM (
    SELECT event_id AS id, event_type AS name, date_trunc('second', ts) AS ts, cast(event_id % 1000 AS double) AS value FROM events) WINDOW w AS (PARTITION BY name ORDER BY ts, id))""")
def counter_increase(t):
    return series.increase(counters(t), seconds=3600).select("id", "name", "increase")


def counters(t) -> DataFrame:
    second = F.date_trunc("second", F.col("ts").cast("timestamp")).cast("timestamp_ntz")
    return t("events").select(F.col("event_id").alias("id"), F.col("event_type").alias("name"), second.alias("ts"), (F.col("event_id") % 1000).cast("double").alias("value"))


HOURS = "(SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS ts, event_type, count(*) FILTER (WHERE value > 50) > 0 AS condition FROM events GROUP BY ALL)"


@query(f"""SELECT ts, event_type, condition AND coalesce(epoch(ts) - epoch(max(CASE WHEN fresh THEN ts END) OVER (PARTITION BY event_type ORDER BY ts)) >= 7200, false) AS firing FROM (
  SELECT *, condition AND NOT (coalesce(lag(condition) OVER w, false) AND epoch(ts) - epoch(lag(ts) OVER w) <= 3600) AS fresh FROM {HOURS} WINDOW w AS (PARTITION BY event_type ORDER BY ts))""")
def alert_rule_for(t):
    ticks = series.rates(t("events"), 60, ["event_type"]).select(F.col("window_start").alias("ts"), "event_type")
    hot = series.rates(t("events").where("value > 50"), 60, ["event_type"]).select(F.col("window_start").alias("ts"), "event_type", F.lit(True).alias("condition"))
    ticks = ticks.join(hot, ["ts", "event_type"], "left").withColumn("condition", F.coalesce("condition", F.lit(False)))
    return series.held(ticks, "event_type", 120, 60).select("ts", "event_type", "firing")


@query(f"""SELECT tick, event_type, round(sum(delta) / 300, 6) AS rate FROM (
  SELECT make_timestamp(((ceil(epoch(ts) / 60) * 60 + k * 60) * 1000000)::bigint) AS tick, name AS event_type, delta FROM (
    SELECT *, CASE WHEN value < lag(value) OVER w THEN value ELSE coalesce(value - lag(value) OVER w, 0) END AS delta FROM (
      SELECT event_id AS id, event_type AS name, date_trunc('second', ts) AS ts, cast(event_id % 1000 AS double) AS value FROM events) WINDOW w AS (PARTITION BY name ORDER BY ts, id)), (VALUES (0), (1), (2), (3), (4)) AS s(k)
) GROUP BY ALL""")
def counter_rate(t):
    return series.rate_at(counters(t), "name", ["name"]).select("tick", F.col("name").alias("event_type"), F.round("rate", 6).alias("rate"))


METRICS = """(SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS ts, count(*)::double AS http_requests, count(*) FILTER (WHERE event_type = 'error')::double AS http_errors, max(value) FILTER (WHERE event_type = 'error') AS alerts_pending FROM events GROUP BY ALL)"""


def rule_sql(name: str, condition: str, minutes: int) -> str:
    return f"""SELECT ts, '{name}' AS rule, c AND epoch(ts) - epoch(max(CASE WHEN fresh THEN ts END) OVER (ORDER BY ts)) >= {60 * minutes} AS firing FROM (
      SELECT *, c AND NOT (coalesce(lag(c) OVER w, false) AND epoch(ts) - epoch(lag(ts) OVER w) <= 3600) AS fresh FROM (SELECT ts, coalesce({condition}, false) AS c FROM {METRICS}) WINDOW w AS (ORDER BY ts))"""


@query("SELECT ts, rule, coalesce(firing, false) AS firing FROM (" + " UNION ALL ".join([rule_sql("down", "true", 2), rule_sql("high_error_rate", "http_errors / http_requests > 0.05", 5), rule_sql("pending_backlog", "alerts_pending > 50", 10)]) + ")")
def named_rules(t):
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts")
    bad = F.col("event_type") == "error"
    ticks = t("events").groupBy(hour).agg(F.count(F.lit(1)).cast("double").alias("http_requests"), F.count_if(bad).cast("double").alias("http_errors"), F.max(F.when(bad, F.col("value"))).alias("alerts_pending"))
    return series.rule_states(ticks, 60).where(F.col("rule").isin("down", "high_error_rate", "pending_backlog"))


@query("SELECT listing_id, title FROM listings WHERE contains(lower(title), 'server') AND contains(lower(title), 'xeon') ORDER BY listing_id LIMIT 50 OFFSET 10", "listings")
def mock_search(t):
    return feed.search(t("listings"), "Server XEON").orderBy("listing_id").offset(10).limit(50).select("listing_id", "title")


@query("SELECT event_id AS key FROM events WHERE event_id < 2000 AND event_id < coalesce((SELECT min(event_id) FROM events WHERE event_id > 500 AND event_type = 'error'), 2000)")
def known_listing_prefix(t):
    items = t("events").select(F.col("event_id").alias("pos"), F.col("event_id").alias("key"))
    known = t("events").where("event_id > 500 AND event_type = 'error'").select(F.col("event_id").alias("key"))
    return state.known_prefix(items, known, 200, 10).select("key")


@query("SELECT listing_id, substr(sha256(title), 1, 16) AS hash FROM listings", "listings")
def title_hash(t):
    return t("listings").select("listing_id", T.title_hash(F.col("title")).alias("hash"))


@query("SELECT s.ts FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 5 MINUTE)) AS ts) s WHERE s.ts NOT IN (SELECT time_bucket(INTERVAL 5 MINUTE, ts) FROM events WHERE event_type = 'error')")
def absent_series(t):
    return series.absent(t("events").where("event_type = 'error'"), "2024-01-01", "2024-01-31", 5)


@query("SELECT listing_id, product_key FROM listings WHERE active AND (capacity_gb BETWEEN 16 AND 48) AND ecc AND speed_mhz IN (2666, 3200)", "listings")
def attribute_filter_match(t):
    return t("listings").where(F.col("active") & F.col("capacity_gb").between(16, 48) & F.col("ecc") & F.col("speed_mhz").isin(2666, 3200)).select("listing_id", "product_key")


@query(f"SELECT id, component_type, {validation.error_sql('component_type', 'attributes')} AS error FROM extracted", "extracted")
def extraction_error(t):
    return t("extracted").select("id", "component_type", validation.first_error(F.col("component_type"), V.attributes(F.col("attributes"))).alias("error"))


JSON_NUMBER = "CASE WHEN json_type(attributes, '$.{0}') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN trunc(cast(json_extract(attributes, '$.{0}') AS double))::bigint END".format
JSON_TEXT = "CASE WHEN json_type(attributes, '$.{0}') = 'VARCHAR' THEN json_extract_string(attributes, '$.{0}') END".format
UNITS = "CASE WHEN {0} <= {1} THEN {0} WHEN {0} % 1024 = 0 AND {0} // 1024 BETWEEN 1 AND {1} THEN {0} // 1024 WHEN {0} % 1000 = 0 AND {0} // 1000 BETWEEN 1 AND {1} THEN {0} // 1000 ELSE {0} END".format
NO_PLACEHOLDER = "CASE WHEN lower(trim({0})) NOT IN ('n/a', 'na', 'unknown', 'none', 'null', 'not specified', 'not applicable') THEN {0} END".format


@query(f"""SELECT id, CASE WHEN component_type = 'ram' THEN {UNITS("capacity", 1024)} ELSE capacity END AS capacity_gb, CASE WHEN component_type <> 'ram' OR speed BETWEEN 800 AND 8400 THEN speed WHEN title LIKE '%PC4-19200T%' THEN 2400 END AS speed_mhz,
  CASE WHEN component_type = 'server' THEN CASE WHEN title LIKE '%no cpu%' THEN 'barebone' WHEN title LIKE '%6130%' THEN 'configured' ELSE 'partial' END END AS tier,
  CASE WHEN component_type = 'gpu' THEN CASE WHEN vram = 17 THEN 16 ELSE {UNITS("vram", 256)} END ELSE vram END AS vram_gb, CASE WHEN component_type = 'gpu' AND model IS NOT NULL THEN 'a4000' ELSE model END AS model,
  CASE WHEN component_type <> 'gpu' THEN family WHEN model IS NULL THEN 'tesla' ELSE 'quadro-rtx' END AS family, {NO_PLACEHOLDER("interface")} AS interface, {NO_PLACEHOLDER("form_factor")} AS form_factor, {NO_PLACEHOLDER("port_type")} AS port_type
  FROM (SELECT id, component_type, title, {JSON_NUMBER("capacity_gb")} AS capacity, {JSON_NUMBER("speed_mhz")} AS speed, {JSON_NUMBER("vram_gb")} AS vram, {", ".join(f"{JSON_TEXT(c)} AS {c}" for c in ("model", "family", "interface", "form_factor", "port_type"))} FROM extracted)""", "extracted")  # fmt: skip
def extraction_normalized(t):
    rows = t("extracted").withColumn("a", extraction.normalized(F.col("component_type"), F.col("title"), V.attributes(F.col("attributes"))))
    numbers = [V.whole(F.col("a"), c).alias(c) for c in ("capacity_gb", "speed_mhz", "vram_gb")]
    return rows.select("id", *numbers, *[V.text(F.col("a"), c).alias(c) for c in ("tier", "model", "family", "interface", "form_factor", "port_type")])


FILTER = '{"capacity_gb": {"min": 20, "max": 150}, "generation": {"in": ["DDR4", "DDR5"]}, "vram_gb": {"eq": 17}}'


@query(f"SELECT id FROM extracted WHERE ({JSON_NUMBER('capacity_gb')} IS NULL OR {JSON_NUMBER('capacity_gb')} BETWEEN 20 AND 150) AND {JSON_TEXT('generation')} IN ('DDR4', 'DDR5') AND {JSON_NUMBER('vram_gb')} = 17", "extracted")
def open_attribute_filter(t):
    return t("extracted").where(al.attribute_match(V.attributes(F.col("attributes")), al.read_filters(F.lit(FILTER)))).select("id")


@query("""SELECT alert_id, printf('$%.2f', cast(cast(price AS decimal(20,6)) AS decimal(18,2))::double) AS price_text, concat('seller (', seller_feedback_score, ')') AS seller_text, CASE WHEN score >= 90 THEN 3066993 WHEN score >= 80 THEN 15844367 ELSE 15105570 END AS color,
  concat('Deal Alert: ', title) AS title, concat(score, '/100') AS first_field FROM alerts a JOIN (SELECT listing_id, title, price, seller_feedback_score FROM listings) l ON l.listing_id = a.listing_id""", "listings", "alerts")  # fmt: skip
def alert_embeds(t):
    sellers = market.priced(t("listings")).withColumns({"seller_name": F.lit("seller"), "item_url": F.lit(""), "image_url": F.lit("")})
    rows = delivery.embeds(delivery.payloads(t("alerts").join(sellers.drop("score"), "listing_id")))
    return rows.select("alert_id", "price_text", "seller_text", F.col("embed.color").alias("color"), F.col("embed.title").alias("title"), F.col("embed.fields")[0]["value"].alias("first_field"))


@query("SELECT alert_id, watch_id, pos <= 40 AS succeeded, CASE WHEN pos <= 40 THEN '' ELSE 'limit' END AS error_text FROM (SELECT alert_id, watch_id, row_number() OVER (PARTITION BY watch_id ORDER BY alert_id) AS pos FROM alerts WHERE NOT notified)", "listings", "alerts")
def partial_batches(t):
    outcomes = t("watches").select(F.col("watch_id").cast("int"), F.lit(40).alias("sent"), F.lit("limit").alias("error"))
    return delivery.attempts(t("alerts").where(~F.col("notified")), outcomes, AS_OF).select("alert_id", "watch_id", "succeeded", "error_text")


@query(f"SELECT a.alert_id, l.title, w.watch_name, count(j.alert_id) AS n_attempts FROM {REVIEW} LEFT JOIN judged j ON j.alert_id = a.alert_id GROUP BY ALL", "listings", "watches", "alerts", "judged")
def alert_details(t):
    tried = t("judged").select("alert_id", F.col("judged_at").alias("attempted_at"), F.lit(True).alias("succeeded"), F.lit("").alias("error_text"))
    rows = delivery.details(t("alerts"), t("listings"), t("watches"), tried)
    return rows.select("alert_id", "listing.title", "watch.watch_name", F.size("history").cast("long").alias("n_attempts"))


@query(f"""SELECT listing_id, CASE WHEN active AND {T.in_sql(T.ACCESSORY)} AND NOT {T.in_sql(T.PRIMARY)} THEN 'other' ELSE component_type END AS component_type,
  CASE WHEN active AND component_type = 'server' AND NOT ({T.in_sql(T.ACCESSORY)} AND NOT {T.in_sql(T.PRIMARY)}) THEN product_key || ':' || (CASE WHEN {T.in_sql(T.BAREBONE)} THEN 'barebone' WHEN {T.in_sql(T.CPU_PRESENT)} AND {T.in_sql(T.RAM_PRESENT)} THEN 'configured' ELSE 'partial' END) ELSE product_key END AS product_key
  FROM listings""", "listings")  # fmt: skip
def backfilled(t):
    rows = extraction.reclassified(t("listings").withColumn("confidence", F.lit(0.9)))
    return extraction.with_tier(extraction.promoted(rows)).select("listing_id", "component_type", "product_key")


@query("SELECT job_id, completed OR job_id % 2 = 0 AS completed, CASE WHEN job_id % 4 = 0 THEN 'late' WHEN job_id % 2 = 0 THEN NULL ELSE error_text END AS error_text FROM queue", "queue")
def queue_complete(t):
    outcomes = t("orders").where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("job_id"), F.when(F.col("o_orderkey") % 4 == 0, "late").otherwise("").alias("error"))
    return state.completed(t("queue"), outcomes).select("job_id", "completed", "error_text")


@query("SELECT DISTINCT c_custkey AS listing_key FROM customer WHERE c_custkey NOT IN (SELECT listing_key FROM queue WHERE NOT completed)", "queue")
def queue_enqueue(t):
    return state.insert_unless(t("customer").select(F.col("c_custkey").alias("listing_key")), t("queue").where(~F.col("completed")), ["listing_key"])


@query("SELECT count(*) FILTER (WHERE NOT completed) AS pending, count(*) FILTER (WHERE completed AND error_text IS NULL) AS done_ok, count(*) FILTER (WHERE completed AND error_text IS NOT NULL) AS done_err FROM queue WHERE listing_key IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)", "queue")
def queue_drain(t):
    return state.drain(t("queue"), t("customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("listing_key")))


@query("SELECT o_orderkey AS run_id, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-07-01' - INTERVAL 2 HOUR THEN 'crashed' WHEN o_orderstatus = 'O' THEN 'running' ELSE 'ok' END AS status FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01' - INTERVAL 30 DAY")
def job_run_sweep(t):
    status = F.when(F.col("o_orderstatus") == "O", "running").otherwise("ok").alias("status")
    runs = t("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"), status, F.lit(None).cast("timestamp_ntz").alias("completed_at"))
    return state.swept_runs(runs, "1998-07-01 00:00:00").select("run_id", "status")


@query(f"SELECT product_key, coalesce(b.sample_count, 1) AS sample_count FROM (SELECT DISTINCT product_key FROM listings) l LEFT JOIN {BASE} b USING (product_key)", "listings")
def baseline_upsert(t):
    stale = t("listings").select("product_key", F.lit(1).cast("long").alias("sample_count")).distinct()
    return state.refreshed(stale, base_of(t).select("product_key", "sample_count"), "product_key")


@query("SELECT event_type, arg_max(value, (ts, value)) AS value, max(ts) AS ts FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latest_gauge(t):
    return series.latest(t("events").where("value IS NOT NULL"), "event_type")


@query("SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS window_start, count(*) FILTER (WHERE event_type = 'error') * 100.0e0 / count(*) AS percent FROM events GROUP BY ALL")
def error_ratio(t):
    errors = series.rates(t("events").where("event_type = 'error'"), 60).withColumnRenamed("n", "bad")
    rows = series.rates(t("events"), 60).join(errors, "window_start", "left")
    return rows.select("window_start", series.percent(F.coalesce("bad", F.lit(0)), F.col("n")).alias("percent"))


@query("SELECT CASE WHEN product_key LIKE '%:barebone' THEN 'barebone' WHEN product_key LIKE '%:configured' THEN 'configured' WHEN product_key LIKE '%:partial' THEN 'partial' ELSE 'unknown' END AS tier, count(*) AS n FROM (SELECT product_key || CASE WHEN order_key % 3 = 0 THEN ':barebone' WHEN order_key % 3 = 1 THEN ':partial' ELSE '' END AS product_key FROM listings) GROUP BY ALL", "listings")
def key_tiers(t):
    end = F.when(F.col("order_key") % 3 == 0, ":barebone").when(F.col("order_key") % 3 == 1, ":partial").otherwise("")
    return t("listings").groupBy(extraction.tier_of_key(F.concat("product_key", end)).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


UNTYPED = "(SELECT listing_id, title, active, updated_at, nullif(component_type, 'gpu') AS component_type FROM listings)"


def untyped(t) -> DataFrame:
    rows = t("listings").select("listing_id", "title", "active", "updated_at", "component_type")
    return rows.withColumn("component_type", F.nullif(F.col("component_type"), F.lit("gpu")))


@query(f"SELECT listing_id, title, updated_at FROM {UNTYPED} WHERE active AND component_type IS NULL ORDER BY updated_at DESC NULLS LAST, listing_id LIMIT 50", "listings")
def unextracted_newest(t):
    return worklists.newest(worklists.unextracted(untyped(t)), "updated_at", "listing_id", 50).select("listing_id", "title", "updated_at")


@query(f"SELECT listing_id, component_type, updated_at FROM (SELECT *, CASE WHEN listing_id LIKE '%1' THEN 50 END AS score FROM {UNTYPED}) WHERE active AND component_type IS NOT NULL AND score IS NULL ORDER BY updated_at DESC NULLS LAST, listing_id LIMIT 50", "listings")
def unscored_newest(t):
    rows = untyped(t).withColumn("score", F.when(F.col("listing_id").like("%1"), 50))
    return worklists.newest(worklists.unscored(rows), "updated_at", "listing_id", 50).select("listing_id", "component_type", "updated_at")


@query(f"SELECT listing_id, active AND component_type IS NOT NULL AS active FROM {UNTYPED}", "listings")
def deactivate_unextracted(t):
    return worklists.deactivated(untyped(t)).select("listing_id", "active")


@query("SELECT job_id, listing_id, title, error_text, attempts FROM queue JOIN listings ON order_key = job_id WHERE error_text IS NOT NULL", "listings", "queue")
def failed_jobs(t):
    return worklists.failed_jobs(t("queue"), t("listings"), "job_id", "order_key").select("job_id", "listing_id", "title", "error_text", "attempts")


@query(f"SELECT product_key, sample_count, p50 FROM {BASE} ORDER BY sample_count DESC, product_key LIMIT 20", "listings")
def baseline_coverage(t):
    return worklists.best_covered(base_of(t)).select("product_key", "sample_count", "p50")


@query(f"SELECT product_key, count(*) AS n_listings FROM listings WHERE active AND product_key <> '' AND product_key NOT IN (SELECT product_key FROM {BASE} WHERE sample_count >= 10) GROUP BY product_key", "listings")
def keys_without_warm_baseline(t):
    return worklists.uncovered(t("listings"), base_of(t).where("sample_count >= 10"))


@query(f"""SELECT a.alert_id, a.score, l.title, l.price, w.watch_name FROM alerts a JOIN listings l ON l.listing_id = a.listing_id JOIN watches w ON w.watch_id = a.watch_id
  WHERE a.created_at >= TIMESTAMP '{AS_OF}' - INTERVAL 200 DAY AND a.created_at <= TIMESTAMP '{AS_OF}'""", "listings", "watches", "alerts")  # fmt: skip
def recent_alerts(t):
    return worklists.recent_alerts(t("alerts"), t("listings"), t("watches"), AS_OF, 200).select("alert_id", "score", "title", "price", "watch_name")


@query("SELECT a.watch_id, watch_name, count(*) AS n_alerts, max(score) AS best_score, max(created_at) AS newest FROM alerts a JOIN watches w ON w.watch_id = a.watch_id WHERE NOT notified AND listing_id IN (SELECT listing_id FROM listings WHERE active) GROUP BY ALL", "listings", "watches", "alerts")
def pending_by_watch(t):
    return worklists.pending_by_watch(t("alerts"), t("listings").where("active"), t("watches"))


@query(f"SELECT component_type, count(*) FILTER (WHERE sample_count >= 10) AS warm, count(*) FILTER (WHERE sample_count IS NULL OR sample_count < 10) AS cold FROM {SCORED} GROUP BY component_type", "listings")
def warm_and_cold(t):
    return worklists.warm_and_cold(scored_of(t))


@query(f"SELECT cast(coalesce(sum(cast(cost AS decimal(20,9))), 0) AS decimal(20,6)) AS spend FROM {COST} WHERE judged_at >= date_trunc('day', TIMESTAMP '1998-07-15 13:30:00')", "judged")
def spent_today(t):
    return worklists.spent_today(costs_of(t), "1998-07-15 13:30:00")


@query("""SELECT date_trunc('day', created_at)::timestamp AS day, CASE WHEN count(judge_score) > 0 THEN count(*) FILTER (WHERE judge_score < 0.3) / count(judge_score) END AS noise_share,
  count(dismissed_at) / count(*) AS dismissed_share FROM alerts a LEFT JOIN judged j ON j.alert_id = a.alert_id GROUP BY ALL""", "listings", "alerts", "judged")  # fmt: skip
def noise_and_dismissals(t):
    return worklists.noise_and_dismissals(t("alerts"), t("judged"))


@query("SELECT component_type, count(*) AS n FROM listings WHERE regexp_matches(product_key, '^(ram|drive):brand_[0-9]+$') OR regexp_matches(title, 'xeon +gold', 'i') GROUP BY component_type", "listings")
def regex_keys(t):
    return worklists.matching_keys(t("listings"), "^(ram|drive):brand_[0-9]+$", "xeon +gold").groupBy("component_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT job_id, claimed OR first AS claimed, attempts + first::int AS attempts FROM (SELECT *, NOT completed AND NOT claimed AND row_number() OVER (PARTITION BY NOT completed AND NOT claimed ORDER BY priority DESC, enqueued_at, job_id) <= 100 AS first FROM queue)", "queue")
def queue_after_claim(t):
    return state.claimed(t("queue"), 100).select("job_id", "claimed", "attempts")


@query("SELECT watch_id, watch_name, enabled AND watch_id <> 2 AS enabled FROM watches UNION ALL SELECT 99, 'new', true", "watches")
def watch_upsert(t):
    watches = state.set_enabled(t("watches"), 2, False)
    new = watches.sparkSession.sql("SELECT 99 AS watch_id, 'new' AS watch_name, true AS enabled")
    return state.upserted(watches, new, "watch_id").select("watch_id", "watch_name", "enabled")


@query(f"SELECT listing_id, score, price_score FROM listings l LEFT JOIN (SELECT listing_id AS id, score, cast(round(price_score, 3) AS decimal(9,3)) AS price_score FROM {SCORED}) ON id = listing_id", "listings")
def scores_written_back(t):
    rows = state.scored_back(t("listings"), scored_of(t), ["price_score", "seller_score"])
    return rows.select("listing_id", "score", F.round("score_breakdown.price_score", 3).cast("decimal(9,3)").alias("price_score"))


ASKED = "(SELECT c_custkey AS watch_id, c_custkey % 11 AS n, coalesce(sum(c_custkey % 11) OVER (ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM customer)"


def asked_of(t) -> DataFrame:
    return t("customer").select(F.col("c_custkey").alias("watch_id"), (F.col("c_custkey") % 11).alias("n_pages"))


@query(f"SELECT watch_id, CASE WHEN before < 3001 THEN n ELSE 0 END AS granted FROM {ASKED}")
def cycle_budget(t):
    return budget.granted(asked_of(t), "watch_id", "n_pages", 3001).select("watch_id", "granted")


@query(f"SELECT watch_id, cast(greatest(0, least(CASE WHEN before < 3001 THEN n ELSE 0 END, 333 - before)) AS bigint) AS granted FROM {ASKED}")
def cycle_daily_limit(t):
    return budget.granted(asked_of(t), "watch_id", "n_pages", 3001, daily_left=333).select("watch_id", "granted")


@query(f"SELECT alert_id FROM (SELECT *, coalesce(sum(cast(cost AS decimal(20,9))) OVER (ORDER BY judged_at, alert_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM {COST}) WHERE before + 0.05 < 0.75", "judged")
def budget_cut_all(t):
    return al.within_budget(costs_of(t), 0.75, 0.05).select("alert_id")


STOPPED = """SELECT feed, coalesce(hit, least(n, most)) AS new_listings, CASE WHEN hit IS NULL THEN least(n, most) ELSE hit + 1 END AS total_seen,
  cast(CASE WHEN hit IS NOT NULL THEN hit // 3 + 1 WHEN n <= most THEN ceil(n / 3.0) ELSE most // 3 END AS bigint) AS pages_used,
  CASE WHEN hit IS NOT NULL THEN 'known_listing' WHEN n <= most THEN 'no_more_results' ELSE 'max_pages' END AS stopped_at
FROM (SELECT feed, n, most, CASE WHEN first_known < most THEN first_known END AS hit FROM (
  SELECT feed, count(*) AS n, min(CASE WHEN known THEN pos END) AS first_known, cast(CASE WHEN bool_or(first_run) THEN 15 ELSE 24 END AS bigint) AS most FROM feeds GROUP BY feed))"""


@query(STOPPED, "feeds")
def feeds_paging(t):
    feeds = t("feeds")
    return state.paging(feeds, feeds.where("known").select("key"), "feed", 3, 8, "first_run")


@query(f"SELECT * FROM {BASE}", "listings")
def baselines_after_changes(t):
    """Baselines of ten days ago, brought up to the moment by what changed since: half of it in one run, half in the next."""
    rows = t("listings").withColumn("changed", F.datediff(F.lit(AS_OF).cast("date"), F.to_date("updated_at")))
    old, first, second = rows.where("changed > 10"), rows.where("changed > 5 AND changed <= 10"), rows.where("changed <= 5")
    then, later = "2001-10-26 00:00:00", "2001-10-31 00:00:00"
    counts = rolling.price_counts(old)
    base = rolling.baselines_of(counts.where(F.col("day") >= rolling.since(then)))
    counts, base = rolling.advanced(counts.where(F.col("day") >= rolling.since(then)), base, rolling.price_counts(first), later)
    return rolling.advanced(counts, base, rolling.price_counts(second), AS_OF)[1]


GROWN = """(SELECT *, CASE WHEN prev IS NULL THEN 0 WHEN value < prev THEN value ELSE value - prev END AS delta, epoch(ts) AS sec FROM (
  SELECT *, lag(value) OVER (PARTITION BY series, le ORDER BY ts, id) AS prev FROM buckets))"""
TICKED = f"(SELECT series, le, cast(step + later AS bigint) AS tick, g.* EXCLUDE (series, le) FROM (SELECT *, ceil(sec / 60) * 60 AS step FROM {GROWN}) g, (VALUES (0), (60), (120), (180), (240)) AS o(later))"
TICK = "make_timestamp(tick * 1000000) AS tick"
FILLED = f"""(SELECT tick, series, le, grown * (between_ + CASE WHEN grown > 0 AND first_value >= 0 THEN least(s, between_ * (first_value / grown)) ELSE s END + e) / between_ AS increase FROM (
  SELECT *, CASE WHEN first_ts - (tick - 300) < 1.1e0 * gap THEN first_ts - (tick - 300) ELSE gap / 2 END AS s, CASE WHEN tick - last_ts < 1.1e0 * gap THEN tick - last_ts ELSE gap / 2 END AS e
  FROM (SELECT *, last_ts - first_ts AS between_, (last_ts - first_ts) / (n - 1) AS gap FROM (
    SELECT tick, series, le, count(*) AS n, min(sec) AS first_ts, max(sec) AS last_ts, arg_min(value, (sec, id)) AS first_value, sum(delta) - arg_min(delta, (sec, id)) AS grown FROM {TICKED} GROUP BY ALL)
    WHERE n > 1 AND last_ts > first_ts)))"""


@query(f"SELECT {TICK}, series, le, cast(increase AS decimal(20,6)) AS increase FROM {FILLED}", "buckets")
def extrapolated_increase(t):
    found = series.extrapolated(t("buckets"), ["series", "le"])
    return found.select("tick", "series", "le", F.col("increase").cast("decimal(20,6)").alias("increase"))


REPAIRED = f"(SELECT tick, le, max(rate) OVER (PARTITION BY tick ORDER BY le) AS cum FROM (SELECT tick, le, sum(increase / 300) AS rate FROM {FILLED} GROUP BY ALL))"


@query(f"""SELECT {TICK}, cast(CASE WHEN total > 0 AND last = 'Infinity'::double AND n > 1 THEN CASE WHEN le = 'Infinity'::double THEN finite ELSE low + (le - low) * (0.931e0 * total - below) / (cum - below) END END AS decimal(20,4)) AS quantile FROM (
  SELECT tick, any_value(total) AS total, max(le) AS last, count(*) AS n, max(le) FILTER (WHERE le < 'Infinity'::double) AS finite, coalesce(max(le) FILTER (WHERE cum < 0.931e0 * total), 0) AS low,
    coalesce(max(cum) FILTER (WHERE cum < 0.931e0 * total), 0) AS below, min(le) FILTER (WHERE cum >= 0.931e0 * total) AS le, min(cum) FILTER (WHERE cum >= 0.931e0 * total) AS cum
  FROM (SELECT *, max(cum) OVER (PARTITION BY tick) AS total FROM {REPAIRED}) GROUP BY tick)""", "buckets")  # fmt: skip
def bucket_rate_quantile(t):
    found = series.rate_quantile(series.extrapolated(t("buckets"), ["series", "le"]), 0.931, ["tick"])
    return found.select("tick", F.col("quantile").cast("decimal(20,4)").alias("quantile"))


@query(f"SELECT {TICK}, series, arg_max(value, (sec, id)) AS value FROM {TICKED} WHERE le = 'Infinity'::double GROUP BY tick, series", "buckets")
def gauge_at_ticks(t):
    return series.instant(t("buckets").where(F.col("le") == float("inf")), ["series"])


@query("SELECT listing_id, component_type FROM listings WHERE component_type IN ('gpu', 'nic') QUALIFY row_number() OVER (PARTITION BY component_type ORDER BY updated_at DESC, listing_id) <= 12", "listings")
def dataset_sample(t):
    return evals.dataset(t("listings"), "component_type", 12, ["gpu", "nic"], F.col("updated_at").desc(), F.col("listing_id")).select("listing_id", "component_type")


@query("SELECT (SELECT count(*) FROM listings WHERE contains(lower(title), 'server')) AS total, 150 AS next_offset", "listings")
def search_total(t):
    return feed.search_page(t("listings"), " SERVER ", sort="-price", offset=100)[1]


@query(f"SELECT product_key, sample_count FROM {BASE} WHERE starts_with(product_key, 'gpu:') UNION ALL SELECT product_key, sample_count FROM {BASE} WHERE sample_count < 10", "listings")
def cold_and_prefixed(t):
    base = base_of(t).select("product_key", "sample_count")
    return worklists.of_prefix(base, "gpu:").unionByName(worklists.cold(base))


@query(f"SELECT a.alert_id, l.title, l.condition_norm, l.seller_feedback_score, w.watch_name, w.score_threshold, coalesce(a.trace_id, '') AS trace_id FROM alerts a JOIN listings l ON l.listing_id = a.listing_id JOIN watches w ON w.watch_id = a.watch_id", "listings", "watches", "alerts")
def review_wide(t):
    rows = al.wide(t("alerts"), t("listings"), t("watches"))
    return rows.select("alert_id", "listing.title", "listing.condition_norm", "listing.seller_feedback_score", "watch.watch_name", "watch.score_threshold", F.coalesce("trace_id", F.lit("")).alias("trace_id"))


from . import rules  # noqa: E402, F401  (registers its queries)
