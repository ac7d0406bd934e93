"""Clean-up of extracted attributes and product keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import trimmed

# Spellings, model rules and sizes.
GPU_FAMILIES = {
    "tesla": "tesla", "quadro": "quadro", "geforce": "geforce", "rtx": "rtx", "rtx-pro": "rtx", "rtx pro": "rtx", "a-series": "a-series", "a series": "a-series", "ampere": "a-series",
    "l-series": "l-series", "l series": "l-series", "lovelace": "l-series", "h-series": "h-series", "h series": "h-series", "hopper": "h-series",
    "radeon pro": "radeon-pro", "radeonpro": "radeon-pro", "radeon-pro": "radeon-pro", "instinct": "instinct", "arc": "arc", "arc pro": "arc",
}
GPU_MODELS = [
    (r"^(p40|p100|v100|k80|m40|m60|t4)$", "tesla"), (r"^a(10|30|40|100)$", "a-series"), (r"^l(4|40|40s)$", "l-series"), (r"^h(100|200)$", "h-series"),
    (r"^mi(50|60|100|210|250|300)$", "instinct"), (r"^[2-5]0\d{2}(ti|super)?$", "geforce-rtx"), (r"^a[2-6]000$", "quadro-rtx"),
]
VRAM_SIZES = [8, 12, 16, 24, 32, 40, 48, 80, 96, 128]
VENDORS = {
    "dell": "dell", "dell inc.": "dell", "dell inc": "dell", "dell technologies": "dell", "hp": "hp", "hewlett-packard": "hp", "hewlett packard": "hp",
    "hewlett packard enterprise": "hp", "hpe": "hp", "lenovo": "lenovo", "ibm": "lenovo", "ibm/lenovo": "lenovo", "apple": "apple",
}
LINES = {
    "precision": "precision", "dell precision": "precision", "precision tower": "precision", "precision-tower": "precision",
    "thinkstation": "thinkstation", "think station": "thinkstation", "z by hp": "z-by-hp", "z-by-hp": "z-by-hp", "hp z": "z-by-hp", "hp z-series": "z-by-hp",
    "z series": "z-by-hp", "z-series": "z-by-hp", "pro max": "pro-max", "pro-max": "pro-max", "promax": "pro-max", "optiplex": "optiplex",
    "dell optiplex": "optiplex", "thinkcentre": "thinkcentre", "think centre": "thinkcentre", "think center": "thinkcentre", "elitedesk": "elitedesk",
    "elite desk": "elitedesk", "hp elitedesk": "elitedesk", "prodesk": "prodesk", "pro desk": "prodesk", "hp prodesk": "prodesk", "pro": "pro", "dell pro": "pro",
}
SERVER_LINES = ["poweredge", "power-edge", "proliant", "pro-liant", "ucs", "supermicro", "super-micro", "dell-emc", "emc", "system-x", "systemx"]
LINE_MODELS = [
    (r"^t\d{4}$", "precision"), (r"^p\d{3}$", "thinkstation"), (r"^z\d+\s+g\d+$", "z-by-hp"), (r"^z\d+g\d+$", "z-by-hp"), (r"^m\d{3}[a-z]?$", "thinkcentre"),
    (r"^optiplex", "optiplex"), (r"^elitedesk", "elitedesk"), (r"^prodesk", "prodesk"),
]
PLACEHOLDERS = ["n/a", "na", "unknown", "none", "null", "not specified", "not applicable"]


def lookup(values: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), key)


def first_rule(rules: list[tuple[str, str]], text: Column) -> Column:
    return F.coalesce(*[F.when(F.rlike(text, F.lit(p)), F.lit(v)) for p, v in rules])


def fewer_units(value: Column, most: int) -> Column:
    """A number of megabytes taken for gigabytes, if it divides evenly into range."""
    by = lambda d: (value % d == 0) & (value / d).between(1, most)
    return F.when(value <= most, value).when(by(1024), F.floor(value / 1024)).when(by(1000), F.floor(value / 1000)).otherwise(value)


def without_placeholder(value: Column) -> Column:
    """X10."""
    return F.when(~F.lower(trimmed(value)).isin(PLACEHOLDERS), value)


def gpu_model(model: Column) -> Column:
    """X13."""
    bare = F.regexp_replace(F.lower(trimmed(model)), r"^rtx[_\s-]?", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(\d)[_\s-]ti$", "$1ti"), r"(\d)[_\s-]super$", "$1super")


def gpu_family(family: Column, model: Column) -> Column:
    """What the model says, else the family's usual name."""
    key = F.lower(trimmed(family))
    return F.coalesce(first_rule(GPU_MODELS, gpu_model(model)), lookup(GPU_FAMILIES, key), F.replace(key, F.lit(" "), F.lit("-")))


def gpu_vram(vram: Column) -> Column:
    """The first size within one of the given."""
    value = fewer_units(vram, 256)
    return F.coalesce(*[F.when(F.abs(value - s) <= 1, F.lit(s)) for s in VRAM_SIZES], value)


def system_vendor(vendor: Column) -> Column:
    """X14."""
    key = F.lower(trimmed(vendor))
    return F.coalesce(lookup(VENDORS, key), F.replace(key, F.lit(" "), F.lit("-")))


def system_model(model: Column) -> Column:
    return F.regexp_replace(F.lower(trimmed(model)), r"^(dell|hp|hpe|lenovo|ibm)[_\s-]+", "")


def system_line(line: Column, model: Column) -> Column:
    key = F.lower(trimmed(line))
    named = F.coalesce(lookup(LINES, key), F.replace(key, F.lit(" "), F.lit("-")))
    named = F.when((key != "") & ~named.isin(SERVER_LINES), named)
    return F.coalesce(named, first_rule(LINE_MODELS, system_model(model)), line)


def part(value: Column) -> Column:
    return F.coalesce(F.nullif(F.replace(F.lower(value), F.lit(" "), F.lit("_")), F.lit("")), F.lit("unknown"))


def whole(value: Column) -> Column:
    return F.coalesce(value, F.lit(0)).cast("long").cast("string")


def ram_kind(ecc: Column, registered: Column) -> Column:
    """X16."""
    return F.when(ecc.isNull(), "unknown").when(~ecc, "non_ecc").when(F.coalesce(registered, F.lit(False)), "ecc_reg").otherwise("ecc_unbuf")


def drive_kind(kind: Column, rpm: Column) -> Column:
    """X17."""
    by_rpm = F.when(rpm == 7200, "7k2").when(rpm == 10000, "10k").when(rpm == 15000, "15k").otherwise("hdd")
    return F.when(kind.isNull(), "unknown").when(F.lower(kind) == "ssd", "ssd").otherwise(by_rpm)


def product_key(component: Column, a: dict[str, Column]) -> Column:
    """X15, from attributes by name; absent ones are null."""
    get = lambda name, kind="string": a.get(name, F.lit(None).cast(kind))
    text = lambda *names: [part(get(n)) for n in names]
    key = lambda *parts: F.concat_ws(":", component, *parts)
    ram = key(part(get("generation")), ram_kind(get("ecc", "boolean"), get("registered", "boolean")), F.concat(whole(get("capacity_gb", "long")), F.lit("gb")), whole(get("speed_mhz", "long")))
    return (
        F.when(component == "ram", ram)
        .when(component == "drive", key(*text("interface", "form_factor", "capacity"), drive_kind(get("type"), get("rpm", "long"))))
        .when(component == "server", key(*text("manufacturer", "model", "drive_form_factor", "tier")))
        .when(component == "cpu", key(*text("manufacturer", "family", "model")))
        .when(component == "nic", key(part(get("speed")), F.concat(whole(get("port_count", "long")), F.lit("p")), part(get("port_type"))))
        .when(component == "gpu", key(*text("manufacturer", "family", "model"), F.concat(whole(get("vram_gb", "long")), F.lit("gb"))))
        .when(component.isin("workstation", "desktop"), key(*text("vendor", "line", "model")))
        .otherwise(F.concat(F.lit("other:"), component))
    )
