"""The first rule that extracted attributes break, as a text column; null where all hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import variants as V

# Fixed values, in the order in which rules are tried: field, kind, whether it must be there, and bounds or values.
# A text that must be there is not empty either. Bounds are inclusive.
COMMON = [("condition", "any text", True, None), ("confidence", "number", True, (0.0, 1.0)), ("quantity", "whole", False, (1, None))]
SYSTEM = [
    ("vendor", "text", True, None), ("model", "text", True, None), ("form_factor", "one of", False, ["tower", "sff", "micro", "mini"]),
    ("ram_gb", "whole", False, (1, 8192)), ("storage_gb", "whole", False, (1, 1048576)),
]
RULES = {
    "ram": [("capacity_gb", "whole", True, (1, 1024)), ("generation", "one of", True, ["DDR3", "DDR4", "DDR5"]), ("speed_mhz", "whole", False, (800, 8400))],
    "drive": [
        ("capacity", "text", True, None), ("interface", "one of", True, ["SAS", "SATA", "NVMe", "U.2"]),
        ("form_factor", "one of", False, ["2.5", "3.5"]), ("type", "one of", False, ["SSD", "HDD"]),
    ],
    "server": [
        ("manufacturer", "text", True, None), ("model", "text", True, None),
        ("form_factor", "one of", False, ["1U", "2U", "3U", "4U", "5U", "6U", "7U", "8U", "10U", "tower"]),
    ],
    "cpu": [
        ("manufacturer", "one of", True, ["Intel", "AMD"]), ("family", "one of", True, ["Xeon", "EPYC"]), ("model", "text", True, None),
        ("cores", "whole", False, (1, 256)), ("base_clock_ghz", "number", False, (0.5, 6.0)), ("tdp_watts", "whole", False, (10, 500)),
    ],
    "nic": [
        ("speed", "one of", True, ["1GbE", "10GbE", "25GbE", "40GbE", "100GbE"]), ("port_count", "whole", True, (1, 8)),
        ("port_type", "one of", False, ["SFP+", "SFP28", "QSFP+", "QSFP28", "RJ45", "BaseT"]),
    ],
    "gpu": [
        ("manufacturer", "one of", True, ["NVIDIA", "AMD", "Intel"]), ("model", "text", True, None), ("vram_gb", "whole", True, (1, 256)),
        ("memory_type", "one of", False, ["GDDR5", "GDDR6", "GDDR6X", "HBM2", "HBM2e", "HBM3"]),
        ("interface", "one of", False, ["PCIe 3.0 x16", "PCIe 4.0 x16", "PCIe 5.0 x16", "SXM2", "SXM4", "SXM5"]), ("tdp_watts", "whole", False, (15, 700)),
        ("form_factor", "one of", False, ["single_slot", "dual_slot", "triple_slot", "FHFL", "HHHL", "LP"]), ("cooling", "one of", False, ["passive", "active", "blower"]),
    ],
    "workstation": SYSTEM,
    "desktop": SYSTEM,
}
MISSING, UNKNOWN, RANGE = "missing", "not a known value", "out of range"


def broken(attrs: Column, rule: tuple) -> Column:
    """What is wrong with one field; null if nothing is."""
    field, kind, needed, extra = rule
    value = {"whole": V.whole, "number": V.number}.get(kind, V.text)(attrs, field)
    absent = value.isNull() | (F.lit(kind == "text") & (value == ""))
    out = F.when(absent, f"{field}: {MISSING}" if needed else None)
    if kind == "one of":
        out = out.when(~value.isin(extra), f"{field}: {UNKNOWN}")
    elif extra:
        low, high = extra
        out = out.when((value < low) if high is None else ~value.between(low, high), f"{field}: {RANGE}")
    return out


def first_error(component: Column, attrs: Column) -> Column:
    """The common rules, then those of the component; other components have none. JSON is read once a row."""
    return V.once({"attrs": attrs}, lambda x: first_broken(component, x["attrs"]))


def first_broken(component: Column, attrs: Column) -> Column:
    own = F.lit(None).cast("string")
    for name, rules in RULES.items():
        own = F.when(component == name, F.coalesce(*[broken(attrs, r) for r in rules])).otherwise(own)
    return F.coalesce(*[broken(attrs, r) for r in COMMON], own)


def rule_sql(rule: tuple, json: str) -> str:
    """One rule for the oracle, over a JSON text."""
    field, kind, needed, extra = rule
    at, of = f"json_extract({json}, '$.{field}')", f"json_type({json}, '$.{field}')"
    kinds, read = ("('BIGINT', 'UBIGINT', 'DOUBLE')", f"cast({at} AS double)") if kind in ("whole", "number") else ("('VARCHAR')", f"json_extract_string({json}, '$.{field}')")
    value = f"CASE WHEN {of} IN {kinds} THEN {read} END"
    value = f"trunc({value})" if kind == "whole" else f"nullif({value}, '')" if kind == "text" else f"({value})"
    cases = [f"WHEN {value} IS NULL THEN " + (f"'{field}: {MISSING}'" if needed else "NULL")]
    if kind == "one of":
        cases.append(f"WHEN {value} NOT IN ({', '.join(map(repr, extra))}) THEN '{field}: {UNKNOWN}'")
    elif extra:
        low, high = extra
        cases.append(f"WHEN {value} < {low}" + (f" OR {value} > {high}" if high is not None else "") + f" THEN '{field}: {RANGE}'")
    return f"CASE {' '.join(cases)} END"


def error_sql(component: str, json: str) -> str:
    own = " ".join(f"WHEN '{name}' THEN coalesce({', '.join(rule_sql(r, json) for r in rules)})" for name, rules in RULES.items())
    return f"coalesce({', '.join(rule_sql(r, json) for r in COMMON)}, CASE {component} {own} END)"
