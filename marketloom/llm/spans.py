"""Places of pattern matches in texts, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,hit:string,before:string>>"
#: Running values are gathered in parts of this size, as adding to an array copies it.
PART = 128
FAR = 2**31 - 1


def no_spans() -> Column:
    return F.from_json(F.lit("[]"), F.lit(SPAN))


def running(items: Column, zero: int, step: Callable[[Column, Column], Column]) -> Column:
    """The whole number that step makes of the one before and each item, as an array beside items."""
    no_part = F.array().cast("array<int>")
    start = F.struct(F.lit(zero).alias("at"), F.array().cast("array<array<int>>").alias("done"), no_part.alias("part"))

    def add(acc: Column, item: Column) -> Column:
        full = F.size(acc["part"]) >= PART
        now = step(acc["at"], item)
        return F.struct(
            now.alias("at"), F.when(full, F.concat(acc["done"], F.array(acc["part"]))).otherwise(acc["done"]).alias("done"),
            F.concat(F.when(full, no_part).otherwise(acc["part"]), F.array(now)).alias("part"),
        )

    return F.aggregate(items, start, add, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["part"]))))


def matches(text: Column, pattern: str, kind: str, rank: int, valid: Callable[[Column], Column]) -> Column:
    """Leftmost non-overlapping matches of pattern in text that are valid, as an array of SPAN.

    The text is read as (gap, match) pairs, each starting where the last ended, and lengths are summed up; positions
    are code points, end exclusive. pattern has no capturing groups and no quantifier that backtracks over a run.
    """
    pairs = rf"\G([\s\S]*?)({pattern})"
    gaps, hits = (F.regexp_extract_all(text, F.lit(pairs), F.lit(k)) for k in (1, 2))
    cut = F.transform(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), lambda p: F.struct(F.length(p["gap"]).alias("gap"), F.right(p["gap"], F.lit(24)).alias("before"), p["hit"].alias("hit")))

    def placed(pairs: Column) -> Column:
        ends = running(pairs, 0, lambda at, p: at + p["gap"] + F.length(p["hit"]))
        spans = F.transform(
            F.arrays_zip(pairs.alias("p"), ends.alias("end")),
            lambda x: F.struct(
                (x["end"] - F.length(x["p"]["hit"])).alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"),
                x["p"]["hit"].alias("hit"), x["p"]["before"].alias("before"),
            ),
        )
        return F.filter(spans, lambda s: F.coalesce(valid(s["hit"]), F.lit(False)))

    # The pairs are named by a one-element array, so that they are cut once.
    return F.when(F.rlike(text, F.lit(pattern)), F.get(F.transform(F.array(cut), placed), F.lit(0))).otherwise(no_spans())


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, by start and then by rank of kind, with commas between."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def apart(more: Column, base: Column, first_rank: int) -> Column:
    """Those of more (ranks from first_rank on) that overlap no span of base, in order of start."""

    def kept(spans: Column) -> Column:
        is_base = lambda s: s["rank"] < first_rank
        before = running(spans, 0, lambda at, s: F.greatest(at, F.when(is_base(s), s["end"]).otherwise(0)))
        after = F.reverse(running(F.reverse(spans), FAR, lambda at, s: F.least(at, F.when(is_base(s), s["start"]).otherwise(FAR))))
        free = F.filter(
            F.arrays_zip(spans.alias("s"), before.alias("before"), after.alias("after")),
            lambda x: ~is_base(x["s"]) & (x["before"] <= x["s"]["start"]) & (x["after"] >= x["s"]["end"]),
        )
        return F.transform(free, lambda x: x["s"])

    return F.when(F.size(more) > 0, F.get(F.transform(F.array(F.array_sort(F.concat(base, more))), kept), F.lit(0))).otherwise(more)


def first_of_overlapping(spans: Column) -> Column:
    """In order of start, those spans that start where all before them have ended."""

    def kept(ordered: Column) -> Column:
        ends = running(ordered, 0, lambda at, s: F.greatest(at, s["end"]))
        before = F.concat(F.array(F.lit(0)), ends)
        free = F.filter(F.arrays_zip(ordered.alias("s"), before.alias("before")), lambda x: x["s"].isNotNull() & (x["before"] <= x["s"]["start"]))
        return F.transform(free, lambda x: x["s"])

    return F.when(F.size(spans) > 1, F.get(F.transform(F.array(F.array_sort(spans)), kept), F.lit(0))).otherwise(spans)
