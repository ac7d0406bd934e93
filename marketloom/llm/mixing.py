"""Mixing sources to target weights (operator 1).

Each document gets a hash-random key. Within each source the keys are cut into about sqrt(rows) ranges, rows are sorted
within each range, and prefix sums of word counts are built on two levels: over the ranges of a source and over the
rows of a range. Both levels see about sqrt(rows) items, so a source that holds a third of all rows is spread over many
tasks. The budget of a source is cut exactly where its prefix sum reaches it, after as many whole epochs as fit.

Defined cases: null or empty text has size 0; a null source is a source of its own, the last one; documents of size 0
take nothing; repeated rows are each a document; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize, maybe_broadcast, scratch, table, text_or_empty, word_count

#: Source tables of up to this many rows are broadcast (a few dozen bytes a row); larger ones are joined by shuffle.
BROADCAST_SOURCES = 50_000


def random_key(seed: int) -> Column:
    """63 random bits of a document, the same in each run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 1)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """One row per source: rank, weight, documents, source_size, target.

    Targets share the total by weight; none passes max_epochs times its source's size, and what is above is shared
    again by weight, until none is above: the level of shares a unit of weight rises, and with it the number of capped
    sources, by Newton's steps on a concave function, each one aggregation. Ranks are counted by ranges of names, so
    there may be any number of sources.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("documents"))
    by = by.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id())
    by = materialize(by, "sources")
    starts = by.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    starts = starts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    by = by.join(F.broadcast(starts), "part")
    by = by.withColumn("rank", (F.col("before") + F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))).cast("int"))
    by = by.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("long"))
    by = materialize(by.select("source", "rank", "weight", "documents", "source_size"), "weights")
    cap, level = F.lit(max_epochs) * F.col("source_size"), 0.0
    while True:
        capped = F.col("weight") * F.lit(level) > cap
        left, free = by.agg(F.sum("source_size") - F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)), F.sum(F.when(~capped, F.col("weight")))).first()
        if not free or left / free <= level:
            break
        level = left / free
    target = F.least(cap.cast("double"), F.lit(level) * F.col("weight"))
    return by.withColumn("target", target)


def mixed(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 1) -> DataFrame:
    """One row per document: doc_id, source, size, key, source_size, target, epochs (whole repeats of the source),
    rest (words that the last, partial epoch takes from the source), start (words of the source before the document
    in random order) and taken."""
    sized = docs.select("doc_id", "source", word_count(text_or_empty()).alias("size"), random_key(seed).alias("key"))
    sized = materialize(sized, "sizes")
    sources = materialize(source_targets(sized, weights, max_epochs), "sources")
    budget = F.least(F.round("target").cast("long"), F.lit(max_epochs) * F.col("source_size"))
    sources = sources.withColumn("budget", budget).withColumn("ranges", F.ceil(F.sqrt("documents")))
    sources = sources.withColumn("epochs", F.coalesce(F.expr("try_divide(budget, source_size)"), F.lit(0)).cast("long"))
    sources = sources.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "source_")
    keyed = sized.join(maybe_broadcast(sources, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("source_"))).drop("source_")
    keyed = keyed.withColumn("range", F.shiftright(F.shiftright(F.col("key"), 32) * F.col("ranges"), 31))
    offsets = keyed.groupBy("rank", "range").agg(F.sum("size").alias("words"))
    upto = W.partitionBy("rank").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    offsets = offsets.select("rank", "range", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("offset"))
    inside = W.partitionBy("rank", "range").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    keyed = keyed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["rank", "range"])
    keyed = keyed.withColumn("start", F.col("offset") + F.col("inside"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return keyed.select(
        "doc_id", "source", "size", "key", "source_size", "target", "epochs", "rest", "start",
        (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
    )


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = 3, seed: int = 1) -> DataFrame:
    """The mixed corpus with the columns of docs: whole documents, repeated by epochs.

    No text is cut here: a document is in the last epoch if at least half of it lies within its source's budget. As the
    keys order each source, the decision of a source is one bound on (key, doc_id, size), so texts are not shuffled.
    """
    inside = (F.col("size") > 0) & (2 * (F.col("rest") - F.col("start")) >= F.col("size"))
    with scratch(docs.sparkSession):
        cuts = mixed(docs, weights, max_epochs, seed).groupBy(F.col("source").alias("_ml_source")).agg(
            F.first("epochs").alias("_ml_epochs"), F.max(F.when(inside, F.struct("key", "doc_id"))).alias("_ml_cut")
        )
        cuts = materialize(cuts, "cuts", keep=True)
    own = F.struct(random_key(seed).alias("key"), F.col("doc_id"))
    copies = F.col("_ml_epochs") + F.when(own <= F.col("_ml_cut"), 1).otherwise(0)
    rows = docs.join(maybe_broadcast(cuts, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_ml_source")))
    rows = rows.where(copies > 0).withColumn("_ml_copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    return rows.select(*[docs[c] for c in docs.columns])


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixed(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "epochs", "start")
