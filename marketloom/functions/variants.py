"""Open attributes: MAP<STRING, VARIANT> columns, read by the type that JSON gave a value."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "^(BIGINT|DECIMAL|DOUBLE|FLOAT)"


def attributes(json: Column) -> Column:
    """The members of a JSON object; null where the text is no object or repeats a key."""
    return F.try_parse_json(json).try_cast("map<string, variant>")


def once(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """body over a struct of the values, each of which is worked out once a row, however often body names it."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def is_number(value: Column) -> Column:
    return F.coalesce(F.rlike(F.schema_of_variant(value), F.lit(NUMBER)), F.lit(False))


def as_number(value: Column) -> Column:
    return F.when(is_number(value), F.try_variant_get(value, "$", "double"))


def text(attrs: Column, name: str) -> Column:
    """A JSON string, else null; the number 32 is no text."""
    value = F.try_element_at(attrs, F.lit(name))
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def number(attrs: Column, name: str) -> Column:
    """A JSON number, else null; the text "32" is no number."""
    return as_number(F.try_element_at(attrs, F.lit(name)))


def whole(attrs: Column, name: str) -> Column:
    """A JSON number cut towards zero."""
    return number(attrs, name).cast("long")


def same(a: Column, b: Column) -> Column:
    """Equal values of one JSON type; numbers are compared as doubles."""
    plain = F.coalesce(F.to_json(a) == F.to_json(b), F.lit(False))
    return F.when(is_number(a) & is_number(b), as_number(a) == as_number(b)).otherwise(plain)


def edited(attrs: Column, changes: dict[str, Column], dropped: Column | None = None) -> Column:
    """attrs with members set, where the new value is not null, and those named in the array dropped gone."""
    new = F.map_filter(F.create_map(*[x for k, v in changes.items() for x in (F.lit(k), v.cast("variant"))]), lambda _, v: v.isNotNull())
    dropped = F.array().cast("array<string>") if dropped is None else dropped

    def put(x: Column) -> Column:
        return F.map_concat(F.map_filter(attrs, lambda k, _: ~F.map_contains_key(x["new"], k) & ~F.array_contains(x["dropped"], k)), x["new"])

    return once({"new": new, "dropped": dropped}, put)
