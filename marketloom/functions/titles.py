"""What listing titles say: rules over lower-cased text, one regular expression match per class of rules."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .texts import trimmed

# Patterns of each class, with ASCII word boundaries.
COMPOUND_ACCESSORY = [
    r"\b(sas|sata|nvme|m\.?2|pcie|usb|power|fan)\s+(cables?|caddy|caddies|tray|trays|sled|sleds|backplane|riser|bezel|bracket)\b",
    r"\b(nvme|sas|sata)\s+ssd\s+(backplane|tray|caddy)\b",
]
ACCESSORY = [
    r"\bbackplane\b", r"\b(drive\s+)?(caddy|caddies|tray|trays|sled|sleds)\b", r"\brails?\b", r"\bbezels?\b", r"\b(mounting\s+)?brackets?\b",
    r"\brisers?\b", r"\bheat[\s-]?sinks?\b", r"\bfan\s+(assembly|kit|tray|module)\b", r"\bcable\b", r"\bgpu\s+riser\b",
]
GRAPHICS = [r"\b(tesla|quadro|rtx\s+a\d+|a100|h100|l40|mi\d{3}|radeon\s+pro)\b"]
PRIMARY = [
    r"\bddr[2345]\b", r"\b(rdimm|udimm|lrdimm|fbdimm|sodimm)\b", r"\b(nvme|sas|sata|scsi)\b", r"\bssd\b", r"\bhdd\b",
    r"\b(xeon|epyc|opteron|threadripper)\b", r"\b(\d+gb|\d+tb)\b", r"\b\d+u\b", r"\bbar(e)?bone\b", r"\bchassis\b",
    r"\b(gold|silver|platinum|bronze)\s+\d{4}\b", r"\bidrac\b", *GRAPHICS,
    r"\b(precision\s+t?\d{4}|precision\s+\d{4}|pro\s+max|thinkstation|workstation|hp\s+z\d)\b", r"\b(optiplex|elitedesk|thinkcentre)\b",
    r"\bdell\s+pro\b.*\b(tower|desktop|sff|micro|mini\s+tower)\b", r"\b(tower|desktop|sff|micro|mini\s+tower)\b.*\bdell\s+pro\b",
]
BAREBONE = [r"\bbar(e)?bone\b", r"\b(no|w/o|without|no/?)\s*(cpu|ram|memory|hdd?s?|drives?|os)\b", r"\bcto\b"]
CPU_PRESENT = [r"\b(gold|silver|platinum|bronze)\s+\d{4}\b", r"\bxeon\s+(e[357]|d|w|gold|silver|platinum|bronze)[-\s]*\d", r"\bepyc\s+\d{4}", r"\bcore\s+i[3579]\b"]
RAM_PRESENT = [r"\bddr[2345]\b", r"\b(rdimm|udimm|lrdimm|fbdimm|sodimm)\b", r"\b\d+\s*gb\s+(ram|memory|ecc|reg|rdimm)\b", r"\b(ram|memory)[:\s]+\d+\s*gb\b"]
WORKSTATION = [r"\bprecision\s+t?\d{4}\b", r"\bdell\s+pro\s+max\b", r"\bthinkstation\b", r"\bhp\s+z\d\b"]
DESKTOP = [r"\boptiplex\b", r"\belitedesk\b", r"\bthinkcentre\b", r"\bprodesk\b"]
COMPLETE = [
    r"\b\d+\s*cores?\b", r"\b\d+\.\d+\s*ghz\b", r"\bgold\s+\d{4}\b", r"\bsilver\s+\d{4}\b", r"\bplatinum\s+\d{4}\b", r"\b(xeon|epyc|threadripper)\b",
    r"\bi[3579][\s-]?\d{4,5}[a-z]?\b", r"\bryzen\s+\d\b", r"\bwin(dows)?\s*1[01]\b", r"\bwin1[01]\b", r"\b\d+gb\s+(ram|ddr[345]|memory)\b",
    r"\b\d+gb\s+(ssd|hdd|nvme|m\.?2)\b", r"\b\d+\s*tb\s+(ssd|hdd|nvme|m\.?2)\b", r"\b(ddr[345])\s+\d+gb\b",
]
MODULE_MHZ = {
    "10600": 1333, "12800": 1600, "14900": 1866, "17000": 2133, "19200": 2400, "21300": 2666, "23400": 2933, "25600": 3200,
    "38400": 4800, "44800": 5600, "51200": 6400,
}
CONDITIONS = {
    "new": "new", "like_new": "like_new", "used_working": "used_working", "for_parts": "for_parts", "unknown": "unknown",
    "brand new": "new", "factory sealed": "new", "open box": "like_new", "manufacturer refurbished": "like_new", "used": "used_working",
    "pre-owned": "used_working", "seller refurbished": "used_working", "pulled from working": "used_working", "tested working": "used_working",
    "for parts": "for_parts", "not working": "for_parts", "parts only": "for_parts", "as-is": "for_parts",
}
MODULE = r"(?i)\bPC[345]-?(\d{5,6})[A-Z]?\b"
SPEED = r"(?i)\bDDR[345]-(\d{4})\b"

_OPEN, _CLOSE = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"


def ascii_edges(pattern: str) -> str:
    """The pattern with word boundaries that know ASCII only; the JVM's are Unicode-aware.

    A boundary before a word character is an opening one, any other a closing one, so each is one look to one side.
    """
    return re.sub(r"\\b(?=\(|\\d|[A-Za-z])", lambda _: _OPEN, pattern).replace(r"\b", _CLOSE)


def says(title: Column, patterns: list[str]) -> Column:
    """Whether the title matches one of the patterns, which all open at a word: the look back is shared."""
    rest = "|".join(ascii_edges(p.removeprefix(r"\b")) for p in patterns)
    return F.rlike(F.lower(title), F.lit(f"{_OPEN}(?:{rest})"))


def accessory_only(title: Column) -> Column:
    """A part for a machine and nothing else."""
    return says(title, COMPOUND_ACCESSORY) | (says(title, ACCESSORY) & ~says(title, PRIMARY))


def server_tier(title: Column) -> Column:
    """X4."""
    equipped = says(title, CPU_PRESENT) & says(title, RAM_PRESENT)
    return F.when(says(title, BAREBONE), "barebone").when(equipped, "configured").otherwise("partial")


def system_type(title: Column) -> Column:
    """Workstation, desktop, or empty."""
    return F.when(~says(title, COMPLETE), "").when(says(title, WORKSTATION), "workstation").when(says(title, DESKTOP), "desktop").otherwise("")


def condition(raw: Column) -> Column:
    """X5."""
    known = F.create_map(*[F.lit(x) for pair in CONDITIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(trimmed(raw))), F.lit("unknown"))


def title_speed(title: Column) -> Column:
    """From the first module number if it is known, else from the first DDR speed within range."""
    known = F.create_map(*[F.lit(x) for pair in MODULE_MHZ.items() for x in pair])
    # Most titles have neither: a plain search, which the patterns imply, comes before each match.
    has = lambda text: F.contains(F.lower(title), F.lit(text))
    module = F.when(has("pc"), F.try_element_at(known, F.regexp_extract(title, ascii_edges(MODULE), 1)))
    plain = F.when(has("ddr"), F.regexp_extract(title, ascii_edges(SPEED), 1).try_cast("int"))
    return F.coalesce(module, F.when(plain.between(800, 8400), plain))


def module_speed(number: Column) -> Column:
    """X6."""
    known = F.create_map(*[F.lit(x) for pair in MODULE_MHZ.items() for x in pair])
    bare = F.regexp_replace(F.regexp_replace(F.upper(trimmed(number)), "^PC[345]-?", ""), "[A-Z]$", "")
    return F.try_element_at(known, bare)


def title_hash(title: Column) -> Column:
    """X27."""
    return F.substring(F.sha2(title, 256), 1, 16)


def in_sql(patterns: list[str], title: str = "title") -> str:
    joined = "|".join(patterns).replace("'", "''")
    return f"regexp_matches(lower({title}), '{joined}')"


def case_sql(values: dict, key: str) -> str:
    quote = lambda v: str(v) if isinstance(v, int) else f"'{v}'"
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in values.items()) + " END"
