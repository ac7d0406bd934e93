"""Domain views over the plain tables, in SQL that both Spark and the oracle read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: The moment that time-dependent queries take for now.
AS_OF = "2001-11-05 00:00:00"

KIND = """CASE p.p_type WHEN 'ECONOMY' THEN 'ram' WHEN 'SMALL' THEN 'drive' WHEN 'MEDIUM' THEN 'server'
    WHEN 'PROMO' THEN 'cpu' WHEN 'STANDARD' THEN 'nic' ELSE 'gpu' END"""

LISTINGS = f"""SELECT
  concat_ws('-', cast(l.l_orderkey AS string), cast(l.l_linenumber AS string), cast(l.l_partkey AS string),
            cast(l.l_suppkey AS string), cast(cast(floor(l.l_quantity) AS int) AS string)) AS listing_id,
  l.l_orderkey AS order_key,
  CASE l.l_partkey % 10
    WHEN 0 THEN 'Hynix 16GB DDR4 PC4-19200T ECC RDIMM memory module'
    WHEN 1 THEN 'Rack chassis R730 barebone no cpu no ram'
    WHEN 2 THEN '2U server dual Xeon Gold 6130 128GB RAM tested'
    WHEN 3 THEN 'R730 drive caddy 2.5 inch with screws'
    WHEN 4 THEN 'ThinkStation P520 Xeon 64GB RAM Windows 10'
    WHEN 5 THEN 'OptiPlex 7060 i5-8500 16GB DDR4 512GB SSD'
    WHEN 6 THEN 'SAS cable for R730 2U server'
    WHEN 7 THEN 'Quadro RTX A4000 16GB with bracket'
    WHEN 8 THEN '1.2TB SAS 10K HDD 2.5'
    ELSE 'Server rack with DDR5-4800 memory, no drives' END AS title,
  {KIND} AS component_type,
  CASE WHEN l.l_orderkey % 97 = 0 THEN NULL WHEN l.l_orderkey % 89 = 0 THEN '' ELSE
    concat({KIND}, ':', lower(replace(p.p_brand, '#', '_')), CASE l.l_partkey % 14 WHEN 0 THEN ':0' WHEN 1 THEN ':unknown' ELSE '' END) END AS product_key,
  8 * (1 + l.l_partkey % 8) AS capacity_gb, l.l_partkey % 2 = 0 AS ecc,
  CASE WHEN l.l_partkey % 3 = 0 THEN NULL ELSE 2666 END AS speed_mhz,
  l.l_extendedprice AS price,
  CASE WHEN l.l_orderkey % 4 = 0 THEN NULL ELSE
    cast(cast(cast(l.l_extendedprice * l.l_tax AS decimal(20,6)) AS decimal(10,2)) AS double) END AS shipping_cost,
  CASE WHEN l.l_orderkey % 3 = 0 THEN cast(floor(l.l_quantity) AS int) ELSE 1 END AS quantity,
  CASE WHEN l.l_partkey % 6 = 0 THEN 'auction' WHEN l.l_partkey % 6 = 1 THEN 'best_offer' ELSE 'buy_it_now' END AS listing_type,
  cast(floor(abs(s.s_acctbal)) AS int) AS seller_feedback_score,
  90.0e0 + (s.s_suppkey % 101) / 10.0e0 AS seller_feedback_pct,
  s.s_suppkey % 5 = 0 AS seller_top_rated,
  CASE WHEN l.l_returnflag = 'R' AND l.l_linenumber % 3 = 0 THEN 'for_parts' WHEN l.l_returnflag = 'R' THEN 'used_working'
    WHEN l.l_returnflag = 'A' THEN 'like_new' WHEN l.l_linenumber % 5 = 0 THEN NULL ELSE 'new' END AS condition_norm,
  l.l_orderkey % 7 <> 0 AS active, l.l_shipdate AS updated_at,
  CASE WHEN l.l_orderkey % 5 = 0 THEN '' WHEN l.l_orderkey % 5 = 1 THEN NULL ELSE 'picture' END AS image_url,
  CASE WHEN l.l_orderkey % 6 = 0 THEN '{{{{}}}}' WHEN l.l_orderkey % 17 = 0 THEN NULL ELSE concat('{{{{"capacity_gb": ', cast(8 * (1 + l.l_partkey % 8) AS string),
    CASE WHEN l.l_partkey % 2 = 0 THEN ', "ecc": true' ELSE ', "ecc": false' END, CASE WHEN l.l_partkey % 3 = 0 THEN '' ELSE ', "speed_mhz": 2666' END, '}}}}') END AS attributes,
  CASE WHEN l.l_partkey % 6 <> 0 OR l.l_orderkey % 4 = 3 THEN NULL WHEN l.l_orderkey % 4 = 0 THEN cast('2001-11-05 03:00:00' AS {{ntz}})
    WHEN l.l_orderkey % 4 = 1 THEN cast('2001-11-05 05:00:00' AS {{ntz}}) ELSE l.l_shipdate END AS auction_end_at,
  CASE WHEN l.l_orderkey % 9 = 0 THEN cast('2001-11-04 10:00:00' AS {{ntz}}) ELSE l.l_shipdate END AS first_seen_at,
  CASE WHEN l.l_orderkey % 8 = 0 THEN l.l_extendedprice * 0.75e0 END AS sold_price
FROM {{lineitem}} l JOIN {{part}} p ON p.p_partkey = l.l_partkey JOIN {{supplier}} s ON s.s_suppkey = l.l_suppkey"""

WATCHES = """SELECT * FROM (VALUES
  (0, 'cheap memory', 'ram', 50, 20000.0e0, cast(NULL AS double), 0, cast(NULL AS double), false, '', true, '{{"capacity_gb": {{"min": 16, "max": 48}}}}'),
  (1, 'trusted drives', 'drive', 55, cast(NULL AS double), cast(NULL AS double), 5000, 98.0e0, false, '', true, cast(NULL AS string)),
  (2, 'working servers', 'server', 45, cast(NULL AS double), 500.0e0, 0, cast(NULL AS double), false, 'new,like_new', true, '{{"speed_mhz": {{"in": [2666, 3200]}}}}'),
  (3, 'any processor', 'cpu', 0, cast(NULL AS double), cast(NULL AS double), 0, cast(NULL AS double), false, '', true, cast(NULL AS string)),
  (4, 'top sellers', 'nic', 40, cast(NULL AS double), cast(NULL AS double), 0, cast(NULL AS double), true, '', false, cast(NULL AS string)),
  (5, 'graphics', 'gpu', 50, 30000.0e0, 100.0e0, 100, 95.0e0, false, 'new,like_new,used_working', true, '{{"ecc": {{"eq": true}}}}'),
  (6, 'spares', 'ram', 0, cast(NULL AS double), cast(NULL AS double), 0, cast(NULL AS double), false, 'for_parts', true, '{{}}'),
  (7, 'nothing', 'desktop', 0, cast(NULL AS double), cast(NULL AS double), 0, cast(NULL AS double), false, '', true, cast(NULL AS string))
) AS w(watch_id, watch_name, component_type, score_threshold, price_max, price_min, min_feedback, min_feedback_pct, top_rated_only, conditions, enabled, attribute_filters)"""

#: Watches of many users: one an order, with bounds of its own.
MANY_WATCHES = """SELECT o_orderkey AS watch_id, concat('order ', cast(o_orderkey AS string)) AS watch_name,
  CASE o_orderkey % 5 WHEN 0 THEN 'ram' WHEN 1 THEN 'drive' WHEN 2 THEN 'server' WHEN 3 THEN 'cpu' ELSE 'gpu' END AS component_type, cast(40 + o_custkey % 45 AS int) AS score_threshold,
  CASE WHEN o_orderkey % 1000 = 7 THEN NULL ELSE o_totalprice / 8 + 60.0e0 END AS price_max, CASE WHEN o_orderkey % 1000 = 1 THEN NULL ELSE o_totalprice / 8 END AS price_min,
  cast(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 40 * 250 END AS int) AS min_feedback, CASE WHEN o_orderkey % 7 = 0 THEN 92.5e0 + o_orderkey % 6 END AS min_feedback_pct,
  o_orderkey % 9 = 0 AS top_rated_only, CASE o_orderkey % 6 WHEN 0 THEN 'new,like_new' WHEN 1 THEN 'used_working' ELSE '' END AS conditions, o_orderstatus <> 'P' AS enabled,
  cast(NULL AS string) AS attribute_filters FROM {orders}"""

ALERTS = """SELECT o.o_orderkey AS alert_id, cast(o.o_custkey % 8 AS int) AS watch_id, f.listing_id,
  cast(o.o_orderkey % 101 AS int) AS score, o.o_orderstatus = 'F' AS notified, o.o_orderdate AS created_at,
  CASE WHEN o.o_orderstatus = 'F' AND o.o_orderkey % 2 = 0 THEN o.o_orderdate + INTERVAL 2000 DAY WHEN o.o_orderstatus = 'F' THEN o.o_orderdate END AS notified_at,
  CASE WHEN o.o_orderkey % 4 = 0 THEN o.o_orderdate + INTERVAL 1 DAY END AS dismissed_at,
  CASE WHEN o.o_orderkey % 5 = 0 THEN NULL ELSE concat('t', cast(o.o_orderkey AS string)) END AS trace_id
FROM {orders} o JOIN (SELECT order_key, min(listing_id) AS listing_id FROM {listings} GROUP BY order_key) f ON f.order_key = o.o_orderkey"""

JUDGED = """SELECT o_orderkey AS alert_id, (o_orderkey % 101) / 100.0e0 AS judge_score,
  CASE WHEN o_orderkey % 2 = 0 THEN 'small-model' ELSE 'large-model' END AS model,
  cast(500 + o_orderkey % 1000 AS int) AS input_tokens, cast(50 + o_orderkey % 100 AS int) AS output_tokens, o_orderdate AS judged_at
FROM {orders} WHERE o_orderkey % 3 = 0"""

QUEUE = """SELECT o_orderkey AS job_id, o_custkey AS listing_key, cast(substr(o_orderpriority, 1, 1) AS int) AS priority, o_orderdate AS enqueued_at,
  o_orderstatus = 'F' AS completed, o_orderstatus = 'O' AND o_orderkey % 2 = 0 AS claimed, cast(o_orderkey % 3 AS int) AS attempts,
  CASE WHEN o_orderkey % 11 = 0 THEN 'failed' END AS error_text
FROM {orders}"""

#: Counters of a histogram's buckets, a sample of each an event; a series starts anew every 40 events, and every seventh
#: lacks one of its buckets.
BUCKETS = """SELECT series, le, event_id AS id, ts, cast(sum(CASE WHEN value <= le THEN 1 ELSE 0 END) OVER (PARTITION BY series, le, era ORDER BY ts, event_id) AS double) AS value FROM (
  SELECT cast(user_id % 12 AS int) AS series, event_id, ts, value, cast(floor((row_number() OVER (PARTITION BY user_id % 12 ORDER BY ts, event_id)) / 40) AS int) AS era FROM {events}) e,
  (VALUES (20.0e0), (60.0e0), (120.0e0), (cast('Infinity' AS double))) AS b(le) WHERE NOT (series % 7 = 3 AND le = 60.0e0)"""

#: Feeds of customers, newest order first; which orders are known, and whose feed is read for the first time.
FEEDS = """SELECT o_custkey AS feed, o_orderkey AS key, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) - 1 AS bigint) AS pos,
  o_custkey % 4 = 0 AS first_run, o_orderkey % 13 = 0 AS known FROM {orders}"""

#: JSON of attributes: name and the text of its value. Each has values that break its rules on some parts.
MEMBERS = {
    "condition": """CASE WHEN p_partkey % 23 = 0 THEN 'null' ELSE '"Used"' END""",
    "confidence": """CASE WHEN p_partkey % 19 = 0 THEN '"0.9"' WHEN p_partkey % 17 = 0 THEN '1.5' ELSE '0.75' END""",
    "quantity": "CASE WHEN p_partkey % 29 = 0 THEN '0.5' WHEN p_partkey % 5 = 0 THEN 'null' ELSE '2' END",
    "capacity_gb": """CASE WHEN p_partkey % 7 = 0 THEN '"32"' WHEN p_partkey % 3 = 0 THEN '32768' ELSE cast(p_partkey % 200 AS string) END""",
    "generation": """CASE WHEN p_partkey % 9 = 0 THEN '"DDR9"' ELSE '"DDR4"' END""",
    "speed_mhz": "CASE WHEN p_partkey % 4 = 0 THEN '100' WHEN p_partkey % 4 = 1 THEN 'null' ELSE '2666' END",
    "capacity": """CASE WHEN p_partkey % 7 = 0 THEN '""' ELSE '"1.2TB"' END""",
    "interface": """CASE WHEN p_partkey % 11 = 0 THEN '" N/A "' WHEN p_type = 'SMALL' THEN '"SAS"' ELSE '"PCIe 4.0 x16"' END""",
    "form_factor": """CASE WHEN p_partkey % 13 = 0 THEN '"unknown"' WHEN p_type = 'SMALL' THEN '"2.5"' WHEN p_type = 'MEDIUM' THEN '"2U"' ELSE '"FHFL"' END""",
    "type": """CASE WHEN p_partkey % 8 = 0 THEN '"tape"' ELSE '"HDD"' END""",
    "rpm": "'10000'",
    "manufacturer": """CASE WHEN p_partkey % 12 = 0 THEN '""' WHEN p_type = 'PROMO' THEN '"Intel"' ELSE '"NVIDIA"' END""",
    "family": """CASE WHEN p_type = 'PROMO' THEN '"Xeon"' ELSE '"Tesla"' END""",
    "model": """CASE WHEN p_partkey % 10 = 0 THEN 'true' ELSE '"RTX A4000"' END""",
    "cores": "cast(p_partkey % 300 AS string)",
    "base_clock_ghz": "cast(p_partkey % 8 AS string)",
    "vram_gb": "CASE WHEN p_partkey % 2 = 0 THEN '16384' ELSE '17' END",
    "speed": """CASE WHEN p_partkey % 6 = 0 THEN '"2GbE"' ELSE '"10GbE"' END""",
    "port_count": "cast(p_partkey % 10 AS string)",
    "port_type": """CASE WHEN p_partkey % 15 = 0 THEN '"none"' ELSE '"SFP+"' END""",
}
EXTRACTED = f"""SELECT p_partkey AS id, {KIND} AS component_type,
  CASE p_partkey % 4 WHEN 0 THEN 'Hynix PC4-19200T RDIMM' WHEN 1 THEN '2U server Gold 6130 64GB RAM' WHEN 2 THEN 'chassis no cpu' ELSE 'plain' END AS title,
  concat('{{{{', {", ',', ".join(f"""'"{k}":', {v}""" for k, v in MEMBERS.items())}, '}}}}') AS attributes FROM {{part}} p"""

VIEWS = {"listings": LISTINGS, "watches": WATCHES, "many_watches": MANY_WATCHES, "alerts": ALERTS, "judged": JUDGED, "buckets": BUCKETS, "feeds": FEEDS, "queue": QUEUE, "extracted": EXTRACTED}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df in some tasks a core: a table of few bytes a row is read by few tasks, however long its rows take later."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view or a plain table as a DataFrame."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    needs = [t for t in (*TABLES, *VIEWS) if f"{{{t}}}" in VIEWS[name]]
    text = VIEWS[name].replace("{ntz}", "timestamp_ntz")
    tables = {t: table(spark, sf_dir, t) for t in needs}
    if name == "extracted":
        tables["part"] = dealt(tables["part"], "p_partkey")
    return spark.sql(text, **tables) if needs else spark.sql(text.format())


def oracle(body: str, *views: str) -> str:
    """body, for the oracle, with the given views before it."""
    plain = {t: t for t in (*TABLES, *VIEWS)} | {"ntz": "timestamp"}
    ctes = ", ".join(f"{v} AS ({VIEWS[v].format(**plain)})" for v in views)
    return f"WITH {ctes} {body}" if ctes else body
