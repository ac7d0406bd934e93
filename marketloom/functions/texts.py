"""Texts that go out and come in: money, prompts' fields, model replies, item specifics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
# Tokens of item specifics.
WORKSTATION_SERIES = ["thinkstation", "z by hp", "z-by-hp", "hp z", "dell precision", "precision tower", "precision", "pro max"]
DESKTOP_SERIES = ["optiplex", "thinkcentre", "elitedesk", "prodesk"]
DESKTOP_FORMS = ["tower", "desktop", "sff", "micro", "mini tower", "small form factor"]


def trimmed(value: Column) -> Column:
    return F.trim(value, F.lit(WHITE))


def dollars(value: Column) -> Column:
    """Rounded half up to cents."""
    return F.concat(F.lit("$"), plain_money(value))


def plain_money(value: Column) -> Column:
    """Two decimals without grouping, from the double's decimal value."""
    return F.format_string("%.2f", value)


def money(value: Column, currency: Column) -> Column:
    """P16."""
    return F.concat_ws(" ", F.coalesce(F.nullif(currency, F.lit("")), F.lit("USD")), plain_money(value))


def trace_url(base: Column, trace: Column) -> Column:
    """Empty if either part is."""
    bare = F.rtrim(base, F.lit("/"))
    known = (F.coalesce(base, F.lit("")) != "") & (F.coalesce(trace, F.lit("")) != "")
    return F.when(known, F.concat(bare, F.lit("/trace/"), trace)).otherwise("")


def unfenced(reply: Column) -> Column:
    """What stands between code fences; a reply that opens with none is only trimmed."""
    body = trimmed(reply)
    inner = F.regexp_replace(F.regexp_replace(body, r"\A```(json)?(```)?", ""), r"```\z", "")
    return F.when(F.startswith(body, F.lit("```")), trimmed(inner)).otherwise(body)


def shortened(value: Column, most: int) -> Column:
    """At most so many code points, with an ellipsis if some were cut."""
    return F.when(F.char_length(value) > most, F.concat(F.left(value, F.lit(most)), F.lit("…"))).otherwise(value)


def shortened_bytes(value: Column, most: int) -> Column:
    """The other variant, of most bytes and three dots; a character cut through is one that cannot be read."""
    data = value.cast("binary")
    return F.when(F.octet_length(value) > most, F.concat(F.decode(F.substring(data, 1, most), "UTF-8"), F.lit("..."))).otherwise(value)


def whole_seconds(epoch: Column) -> Column:
    """T5: a moment from seconds with a fraction, to the microsecond."""
    return F.timestamp_seconds(epoch.cast("decimal(20,6)")).cast("timestamp_ntz")


def harmless(value: Column, most: int = 200) -> Column:
    """Without control characters but tabs, shortened."""
    return shortened(F.regexp_replace(value, r"[\p{Cc}&&[^\t]]", ""), most)


def specifics_text(specifics: Column) -> Column:
    """Names and values in order of name; N/A if there are none."""
    pairs = F.transform(F.array_sort(F.map_entries(specifics)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit(""))))
    return F.when(F.coalesce(F.size(specifics), F.lit(0)) <= 0, "N/A").otherwise(F.array_join(pairs, ", "))


def has_any(value: Column, tokens: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, tokens)), lambda t: F.contains(value, t))


def system_of(specifics: Column) -> Column:
    """Workstation, desktop or empty, from item specifics; of names equal but for case, the first counts."""
    norm = lambda c: F.lower(trimmed(c))
    get = lambda name: F.coalesce(norm(F.get(F.filter(F.map_entries(specifics), lambda e: norm(e["key"]) == name), F.lit(0))["value"]), F.lit(""))
    line = trimmed(F.concat_ws(" ", get("series"), get("product line")))
    shape = F.concat_ws(" ", get("form factor"), get("type"))
    pro = F.array_contains(F.split(line, r"\s+"), "pro") & has_any(shape, DESKTOP_FORMS)
    workstation = F.contains(get("most suitable for"), F.lit("workstation")) | has_any(line, WORKSTATION_SERIES)
    return F.when(workstation, "workstation").when(has_any(line, DESKTOP_SERIES) | pro, "desktop").otherwise("")


def parsed_verdict(reply: Column) -> Column:
    """Score and reason of a judge's reply; null unless it is an object whose score is a number from 0 to 1.

    A score that is left out counts as 0, a reason as empty.
    """
    read = F.try_parse_json(unfenced(reply))
    kind = F.schema_of_variant(F.try_variant_get(read, "$.score", "variant"))
    score = F.when(kind.isNull() | (kind == "VOID"), 0.0).when(F.rlike(kind, F.lit("^(BIGINT|DECIMAL|DOUBLE)")), F.try_variant_get(read, "$.score", "double"))
    reason = F.coalesce(F.try_variant_get(read, "$.reason", "string"), F.lit(""))
    return F.when(F.startswith(F.schema_of_variant(read), F.lit("OBJECT")) & score.between(0, 1), F.struct(score.alias("score"), reason.alias("reason")))


def filled(template: str, fields: dict[str, Column]) -> Column:
    """The template with every {name} replaced; text that comes from a field is not looked at again."""
    parts, rest = [], template
    while (opened := rest.find("{")) >= 0:
        name, _, after = rest[opened + 1 :].partition("}")
        parts += [F.lit(rest[:opened]), F.coalesce(fields[name].cast("string"), F.lit(""))]
        rest = after
    return F.concat(*parts, F.lit(rest))
