"""Matching listings with any number of watches through an index of what watches ask for.

Watches of a type that ask for like scores, feedback and widths of price stand in order of their price, and so many of
them as a chunk holds are a row of the index, with all that they ask for and with the bounds that hold for each of them.
Prices of a type are cut into stretches in which about the same number of watches begin. A listing lies in one stretch and
is dealt there once; a chunk is dealt to each stretch that it reaches into. Within a stretch a listing opens the chunks
whose bounds it keeps to, and no other. What is taken is then tested with the whole predicate, in the same task, which the
bounds only foreshadow: pairs of a listing and a watch are never dealt anew, so what is written grows with listings and
watches, not with pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .market import BROADCAST_ROWS, small
from .ranks import even_cuts

#: Cells a doubling of the price, and doublings below 1 (2^-8 and less is one cell).
A_DOUBLING = 1024
BELOW_ONE = 8
PRICE_CELLS = 1 << 15
#: Cells that are looked up together in the table of stretches.
LOOK = 64
FEEDBACK_CELLS = 8
#: Watches that begin in a stretch, of a row of the index, and scores that may share one.
STRETCH = 4096
CHUNK = 16
SCORES = 16
#: Chunks up to which the index is broadcast.
BROADCAST_CHUNKS = 4096
#: Parts at least over which the listings of a type are dealt where the index is too large for that.
SALTS = 16


def price_cell(price: Column) -> Column:
    """A cell from 0 that does not fall as the price rises; all prices from 2^24 on, and what is no number, share the last."""
    at = F.floor((F.log2(F.greatest(price.cast("double"), F.lit(2.0**-BELOW_ONE))) + BELOW_ONE) * A_DOUBLING)
    return F.when(F.isnan(price.cast("double")), PRICE_CELLS - 1).otherwise(F.least(at, F.lit(PRICE_CELLS - 1)).cast("int"))


def feedback_cell(value: Column, cuts: Column) -> Column:
    """How many cuts are not above the value; a type has fewer than FEEDBACK_CELLS. No function over an array, as Spark
    does not compile a plan's node that has one."""
    return sum((F.coalesce((F.get(cuts, F.lit(k)) <= value).cast("int"), F.lit(0)) for k in range(FEEDBACK_CELLS - 1)), F.lit(0))


def feedback_cuts(watches: DataFrame) -> DataFrame:
    """One row a type: cuts of feedback at even shares of what its watches ask for, or at all of it where that is few."""
    asked = watches.select("component_type", F.nullif("min_feedback", F.lit(0)).cast("double").alias("_feedback"))
    cuts = even_cuts(asked, "component_type", "_feedback", FEEDBACK_CELLS).select(F.col("_by").alias("component_type"), F.array_distinct("_cuts").alias("feedback_cuts"))
    types = watches.select("component_type").distinct().join(cuts, "component_type", "left")
    return types.withColumn("feedback_cuts", F.coalesce("feedback_cuts", F.array().cast("array<double>")))


def ranged(watches: DataFrame) -> DataFrame:
    """watches with the first and the last cell of their prices; a null bound is open."""
    first = F.when(F.col("price_min").isNull(), 0).otherwise(price_cell(F.col("price_min")))
    last = F.when(F.col("price_max").isNull(), PRICE_CELLS - 1).otherwise(price_cell(F.col("price_max")))
    return watches.withColumns({"_first": first, "_last": last})


def stretches(ranges: DataFrame) -> DataFrame:
    """component_type, stretch (from 0), start and upto, its cells, and salts: in each stretch of a type begin about STRETCH
    watches, more where one cell has more. They are read on both sides of the join, so they depend on counts alone."""
    of = W.partitionBy("component_type").orderBy("start")
    counts = ranges.where(F.col("component_type").isNotNull()).groupBy("component_type", F.col("_first").alias("start")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(of.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = counts.withColumn("_share", F.floor(before / STRETCH)).groupBy("component_type", "_share").agg(F.min("start").alias("start"))
    found = found.withColumns({"stretch": F.row_number().over(of) - 1, "upto": F.coalesce(F.lead("start").over(of) - 1, F.lit(PRICE_CELLS - 1))})
    all_of = F.count(F.lit(1)).over(W.partitionBy("component_type"))
    return found.select("component_type", "stretch", F.when(F.col("stretch") == 0, 0).otherwise(F.col("start")).alias("start"), "upto", F.greatest(F.lit(1), F.floor(SALTS / all_of)).cast("int").alias("salts"))


def placed(rows: DataFrame, cell: str, looked: DataFrame, name: str) -> DataFrame:
    """rows with the stretch of a cell under a name, and salts; looked: stretches, once for each LOOK cells."""
    own = looked.select(F.col("component_type").alias("_type"), "_look", "start", "upto", F.col("stretch").alias(name), "salts")
    at = (F.col("component_type") == F.col("_type")) & (F.floor(F.col(cell) / LOOK) == F.col("_look")) & F.col(cell).between(F.col("start"), F.col("upto"))
    return rows.join(own, at).drop("_type", "_look", "start", "upto")


def index_of(watches: DataFrame, looked: DataFrame) -> DataFrame:
    """component_type, stretch, salt, watches (structs of all columns of watches, at most CHUNK in a row), and what holds for
    each of them: least score and feedback, low and high price, and whether one of them takes listings without a price."""
    own = F.struct(*[c for c in watches.columns if c != "component_type"]).alias("_watch")
    rows = ranged(watches.where(F.col("score_threshold").isNotNull())).join(small(feedback_cuts(watches), BROADCAST_ROWS), "component_type")
    rows = placed(placed(rows, "_first", looked, "_from").drop("salts"), "_last", looked, "_to")
    feedback = F.nullif("min_feedback", F.lit(0)).cast("double")
    like = {
        "_score": F.floor(F.col("score_threshold") / SCORES), "_feedback": F.floor(feedback_cell(feedback, F.col("feedback_cuts")) / 2),
        "_width": F.floor(F.log2(F.greatest(F.col("_last") - F.col("_first"), F.lit(0)) + 1) / 4), "_near": F.floor(F.col("_from") / 8),
    }
    bounds = {
        "_low": F.coalesce(F.col("price_min").cast("double"), F.lit(float("-inf"))), "_high": F.coalesce(F.col("price_max").cast("double"), F.lit(float("nan"))),
        "_least": F.coalesce(feedback, F.lit(float("-inf"))), "_open": F.col("price_min").isNull() & F.col("price_max").isNull(),
    }
    rows = rows.withColumns(like | bounds).select("component_type", "salts", "_from", "_to", "score_threshold", "watch_id", *like, *bounds, own)
    # A chunk's watches are neighbours by price among those that ask for like things; a window sees these only.
    key = ["component_type", *like]
    rank = F.row_number().over(W.partitionBy(*key).orderBy("_low", "_high", "watch_id")) - 1
    chunks = rows.withColumn("_chunk", F.floor(rank / CHUNK)).groupBy(*key, "_chunk").agg(
        F.collect_list("_watch").alias("_watches"), F.min("score_threshold").alias("_least_score"), F.min("_least").alias("_least"), F.min("_low").alias("_low"), F.max("_high").alias("_high"),
        F.bool_or("_open").alias("_open"), F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.first("salts").alias("salts"),
    )
    chunks = chunks.select("component_type", "_watches", "_least_score", "_least", "_low", "_high", "_open", "salts", F.explode(F.when(F.col("_from") <= F.col("_to"), F.sequence("_from", "_to"))).alias("stretch"))
    return chunks


def candidates(scored: DataFrame, watches: DataFrame) -> DataFrame:
    """Rows of scored with the columns of each watch that the index gives for them."""
    looked = small(stretches(ranged(watches)).withColumn("_look", F.explode(F.sequence(F.floor(F.col("start") / LOOK), F.floor(F.col("upto") / LOOK)))), BROADCAST_ROWS)
    index = index_of(watches, looked)
    # A price that is not known fits watches that ask for none, which reach into every stretch.
    rows = placed(scored.withColumn("_cell", F.when(F.col("unit_price").isNull(), 0).otherwise(price_cell(F.col("unit_price")))), "_cell", looked, "stretch").drop("_cell")
    key = ["component_type", "stretch"]
    if watches.limit(BROADCAST_CHUNKS * CHUNK + 1).count() <= BROADCAST_CHUNKS * CHUNK:
        rows, index = rows.drop("salts"), F.broadcast(index.drop("salts"))
    else:  # a type with few stretches has many listings in each
        salt = F.pmod(F.xxhash64(*[c for c in ("listing_id", "unit_price", "score") if c in rows.columns]), F.col("salts")).cast("int")
        rows = rows.withColumn("_salt", salt).drop("salts")
        index = index.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        key = [*key, "_salt"]
    index = index.select(*[F.col(c).alias(f"_of_{c}") if c in key else F.col(c) for c in index.columns])
    price, feedback = F.col("unit_price").cast("double"), F.coalesce(F.col("seller_feedback_score").cast("double"), F.lit(float("-inf")))
    # Scores that are not known are not filtered first: Spark would work out the score once more for it, in code too large to compile.
    fits = F.coalesce(F.col("_least_score") <= F.col("score"), F.lit(False)) & (F.col("_least") <= feedback) & F.coalesce((F.col("_low") <= price) & (price <= F.col("_high")), F.col("_open"))
    at = fits
    for c in key:
        at = (F.col(c) == F.col(f"_of_{c}")) & at
    found = rows.join(index, at).withColumn("_watch", F.explode("_watches")).where(F.coalesce(F.col("_watch.score_threshold") <= F.col("score"), F.lit(False)))
    return found.select(*scored.columns, "_watch.*")
