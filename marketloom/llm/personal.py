"""Personal data by boosted trees over proposed spans (operator 9), with DataFrame operations only.

Generators of high recall propose spans that may overlap: the base kinds, and further ones (numbers written in groups,
long digit runs, account and document numbers, dates, addresses, names after a title, handles, hardware and network
addresses) that alone mean little. Boosted trees with two levels look at the format of a span and at the words before
it; a threshold, calibrated on labelled examples whose lead-in phrases training has not seen, selects what is redacted
besides the base spans. Of selected spans that overlap the one that starts first stays. Training runs once, on
TRAIN_ROWS labelled examples that a rule generates, through the same feature columns; the trees then are plain column
expressions in the scan, which shuffles nothing.

Defined cases: null text is empty; null doc_id is carried; repeated rows are reported each; an empty table gives an
empty result; time is near linear in the number of spans of a text.
"""

from __future__ import annotations

from math import log

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .spans import apart, first_of_overlapping, joined, matches, no_spans

#: The base patterns. Possessive runs, entered only at their start, find the same matches in linear time.
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
BASE = ("email", "ip", "card", "phone")
#: Further proposals, by kind; their ranks follow those of the base kinds.
STREET = "Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Boulevard|Blvd|Court|Place|Square|Way"
PROPOSED = {
    "number": r"(?<![0-9A-Za-z.-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{2,3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "hardware": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Za-z:])",
    "digits": r"(?<![0-9A-Za-z.,-])[0-9]{7,12}(?![0-9A-Za-z])",
    "document": r"(?<![0-9A-Za-z-])[A-Z]{1,2}[0-9]{6,9}(?![0-9A-Za-z])",
    "date": r"(?<![0-9./-])(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})(?![0-9])",
    "address": rf"(?<![0-9A-Za-z])[0-9]{{1,5}}\x20(?:[A-Z][a-z]{{2,14}}\x20){{1,3}}(?:{STREET})(?![A-Za-z])",
    "name": r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]{1,20}(?:\x20[A-Z][a-z]{1,20})?(?![a-z])",
    "handle": r"(?<![A-Za-z0-9._@/])@[A-Za-z][A-Za-z0-9_]{2,20}(?![A-Za-z0-9_@.])",
    "network": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
}
#: Stems of words, in lower case, by what they say about the span that they come before.
CUES = {
    "phone": "phone|fon|tel|call|mobil|cell|fax|ring|dial|reach|whatsapp|text me|hotline|sms",
    "tax": "ssn|social|taxpayer|tax id|steuer|insurance|nif|dni|national id",
    "bank": "iban|account|konto|compte|cuenta|transfer|bank|wire|payee|deposit",
    "device": "mac|device|hardware|adapter|interface|ether|wifi|bluetooth",
    "birth": "born|birth|dob|geboren|naci|née|né le",
    "document": "passport|licen[cs]e|id card|ausweis|visa|permit|carte|identity|reisepass",
    "home": "live|address|home|resid|deliver|adresse|wohn|moved|ship|mail to|visit|house",
    "host": "ip|host|login|client|session|logged|visitor|connect",
    "person": "contact|sign|patient|dear|regards|customer|tenant|ask for|attn|owner|applicant|employee|username|follow|profile|dm",
    "thing": "order|part|invoice|serial|version|item|isbn|ref|page|sku|build|model|ticket|batch|room|issue|figure|lot|edition|catalog|release|tracking|chapter|section|revision|published|checksum|digest|commit|updated",
}
#: Binary features as (what, rule): the kind; a number of digits; a pattern in the span; a pattern at the end of the words before.
FEATURES = [
    *(("kind", k) for k in PROPOSED),
    ("digits", 9), ("digits", 10),
    ("hit", r"[(]"), ("hit", r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), ("hit", r"^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$"), ("hit", r"^(?:000|666|9)"), ("hit", r"\x20"),
    *(("before", rf"(?:^|[^a-z])(?:{stems})[^.!?]{{0,14}}$") for stems in CUES.values()),
    ("before", r"[:=#]\x20?$"), ("before", r"^$"), ("before", r"(?:no|nr|number|num)[.:]?\x20?$"),
]
TRAIN_ROWS = 3000
ROUNDS = 40
PRECISION = 0.95

#: Lead-in phrases of labelled examples by style of span: those of personal data, then others. Every other one is kept for calibration.
LEADS = {
    "dash": (["my phone is", "please call", "tel", "her mobile:", "reach me at", "fax", "you can dial", "his cell number"], ["order", "the ticket number", "part", "tracking code", "we counted", "invoice", "revision", "the sum of"]),
    "paren": (["phone:", "call me", "telephone", "they answer at", "ring", "text me at", "mobile", "office"], ["batch", "model", "ref", "release", "catalog entry", "lot", "figure", "item"]),
    "plain": (["phone", "call", "bank account", "my mobile", "deposit to account", "tel:", "whatsapp", "wire it to"], ["order", "a total of", "item", "population", "sku", "about", "serial", "build"]),
    "tax": (["ssn", "social security number:", "taxpayer id", "national insurance", "his social", "ssn is"], ["invoice no.", "serial", "it was", "the lot", "version", "ref"]),
    "account": (["iban", "transfer to", "bank account", "konto", "pay into my account", "payee", "wire to", "deposit"], ["serial", "code", "the checksum", "license key of release", "part", "digest", "model", "edition"]),
    "hardware": (["mac", "device", "wifi adapter", "hardware address", "my bluetooth", "interface"], ["version", "sum", "the digest", "checksum", "build", "times were"]),
    "birth": (["born on", "date of birth:", "dob", "geboren am", "her birthday is", "birth date"], ["published on", "updated", "the meeting of", "release", "since", "version of", "on", "edition"]),
    "document": (["passport", "driving licence", "passport number:", "visa", "id card no", "residence permit"], ["part", "model", "sku", "batch", "order", "the flight"]),
    "address": (["she lives at", "home address:", "deliver to", "they moved to", "ship to", "i reside at"], ["the museum at", "page", "a shop on", "section", "the square near", "figure"]),
    "name": (["patient", "dear", "signed by", "contact", "the tenant", "please ask for", "owner", "applicant"], ["the book by", "a theory of", "chapter", "the film about", "novel of", "edition by"]),
    "handle": (["follow", "my username is", "contact", "his profile", "dm", "applicant"], ["the decorator", "use", "version", "add", "build", "release"]),
    "network": (["client", "login from", "her host", "visitor", "connected from", "session of"], ["checksum", "digest", "version", "commit", "build", "the sum"]),
}


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(hit: Column) -> Column:
    backwards = F.reverse(digits(hit))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(backwards, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(backwards)), F.lit(0), add) % 10 == 0


def is_card(hit: Column) -> Column:
    return F.when(F.length(digits(hit)).between(12, 19), luhn(hit)).otherwise(False)


def every(hit: Column) -> Column:
    return F.lit(True)


def base_spans(text: Column) -> Column:
    found = [
        F.when(F.contains(text, F.lit("@")), matches(text, EMAIL, "email", 0, every)).otherwise(no_spans()),
        matches(text, IP, "ip", 1, lambda hit: F.rlike(hit, F.lit(rf"^{PART}(?:\.{PART}){{3}}$"))),
        # Any two digits match; texts without a run of twelve are spared.
        F.when(F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}")), matches(text, CARD, "card", 2, is_card)).otherwise(no_spans()),
        matches(text, PHONE, "phone", 3, lambda hit: F.length(digits(hit)).between(9, 15)),
    ]
    return F.concat(*found)


def proposals(text: Column) -> Column:
    return F.concat(*[matches(text, pattern, kind, len(BASE) + k, every) for k, (kind, pattern) in enumerate(PROPOSED.items())])


def feature(span: Column, what: str, rule: object) -> Column:
    if what == "kind":
        return span["kind"] == rule
    if what == "digits":
        return F.length(digits(span["hit"])) == rule
    return F.rlike(span["hit"] if what == "hit" else F.lower(span["before"]), F.lit(rule))


def features(span: Column) -> Column:
    """An array of truth values, in the order of FEATURES."""
    return F.array(*[feature(span, *f) for f in FEATURES])


def examples(spark: SparkSession, rows: int = TRAIN_ROWS, leads: dict = LEADS) -> DataFrame:
    """Labelled texts that a rule generates: id, text, label, and which of a style's phrases leads in."""
    number = lambda k, width: F.lpad(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(10**width)).cast("string"), width, "0")
    below = lambda k, n: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(n)).cast("int")
    pick = lambda k, *words: F.element_at(F.array(*map(F.lit, words)), below(k, len(words)) + 1)
    upper = lambda k: F.char(below(k, 26) + 65)
    hexed = lambda k, width: F.lower(F.lpad(F.hex(below(k, 16**width)), width, "0"))
    area, first, last = F.concat(F.lit("5"), number(1, 2)), pick(21, "Anna", "Jonas", "Maria", "Piet", "Lena"), pick(22, "Weber", "Martin", "Lopez", "Novak", "Khan")
    styles = {
        "dash": F.concat(area, F.lit("-"), number(2, 3), F.lit("-"), number(3, 4)),
        "paren": F.concat(F.lit("("), area, F.lit(") "), number(2, 3), F.lit("-"), number(3, 4)),
        "plain": F.concat(F.lit("7"), F.when(F.col("id") % 2 == 0, number(2, 8)).otherwise(number(3, 9))),
        "tax": F.concat(area, F.lit("-"), number(2, 2), F.lit("-"), number(3, 4)),
        "account": F.concat(F.lit("DE"), number(1, 2), F.lit(" "), number(2, 4), F.lit(" "), number(3, 4), F.lit(" "), number(4, 4), F.lit(" "), number(5, 2)),
        "hardware": F.concat_ws(":", *[hexed(k, 2) for k in range(6)]),
        "birth": F.concat((below(1, 28) + 1).cast("string"), pick(2, ".", "/", "-"), (below(3, 12) + 1).cast("string"), pick(2, ".", "/", "-"), (below(4, 90) + 1930).cast("string")),
        "document": F.concat(upper(1), F.when(F.col("id") % 2 == 0, upper(2)).otherwise(""), number(3, 7)),
        "address": F.concat((below(1, 900) + 1).cast("string"), F.lit(" "), pick(2, "Maple", "High", "Station", "Old Mill"), F.lit(" "), pick(3, "Street", "Road", "Lane", "Avenue")),
        "name": F.concat(pick(1, "Mr", "Mrs", "Ms", "Dr", "Dr.", "Prof."), F.lit(" "), F.when(F.col("id") % 3 == 0, F.concat(first, F.lit(" "))).otherwise(""), last),
        "handle": F.concat(F.lit("@"), F.lower(first), F.lit("_"), F.lower(last)),
        "network": F.concat_ws(":", *[hexed(k, 4) for k in range(8)]),
    }
    cases = [(list(styles).index(s), k, lead, 1 - side) for s, both in leads.items() for side, phrases in enumerate(both) for k, lead in enumerate(phrases)]
    rows_of = spark.range(0, rows, 1, 1).select("id", F.array(*styles.values()).alias("styles"), pick(31, "", "so ", "and then ", "yes, ").alias("first"))
    at = F.pmod("id", F.lit(len(cases))).cast("int")
    style, lead, words, label = (F.get(F.array(*[F.lit(c[k]) for c in cases]), at) for k in range(4))
    return rows_of.select("id", F.concat("first", words, F.lit(" "), F.get("styles", style), F.lit(" today")).alias("text"), label.alias("label"), lead.alias("lead"))


def boosted(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = 0.3) -> list[tuple]:
    """Trees (feature, feature if it holds, feature if not, four leaf values) by second-order boosting of log loss."""
    margin, trees = np.zeros(len(y)), []
    on = x.astype(float)

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[float, int, float, float]:
        """gain, feature, value where it holds, value where not: the best split of some rows."""
        g, h = g * rows, h * rows
        yes_g, yes_h = g @ on, h @ on
        no_g, no_h = g.sum() - yes_g, h.sum() - yes_h
        gains = yes_g**2 / (yes_h + 1) + no_g**2 / (no_h + 1)
        f = int(gains.argmax())
        return gains[f], f, -yes_g[f] / (yes_h[f] + 1), -no_g[f] / (no_h[f] + 1)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        options = [(f, split(x[:, f], g, h), split(~x[:, f], g, h)) for f in range(x.shape[1])]
        f, yes, no = max(options, key=lambda o: (o[1][0] + o[2][0], -o[0]))
        tree = (f, yes[1], no[1], *(float(rate * v) for v in (yes[2], yes[3], no[2], no[3])))
        trees.append(tree)
        margin += margins([tree], x)
    return trees


def margins(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    return sum((np.where(x[:, f], np.where(x[:, y], a, b), np.where(x[:, n], c, d)) for f, y, n, a, b, c, d in trees), np.zeros(len(x)))


def trained(spark: SparkSession, rows: int = TRAIN_ROWS) -> tuple[list[tuple], float]:
    """The trees, fitted on examples of every other lead-in phrase, and the least margin that keeps PRECISION on the rest."""
    spans = examples(spark, rows).select("id", "label", "lead", F.explode(proposals(F.col("text"))).alias("s"))
    found = spans.select("id", "label", "lead", features(F.col("s")).alias("x")).orderBy("id").collect()
    x, y = np.array([r.x for r in found], bool), np.array([r.label for r in found])
    held_out = np.array([r.lead % 2 for r in found], bool)
    trees = boosted(x[~held_out], y[~held_out])
    m, truth = margins(trees, x[held_out]), y[held_out]
    good = [t for t in np.unique(m) if truth[m >= t].mean() >= PRECISION]
    return trees, max(min(good, default=log(9)), 0.0)


def margin(trees: list[tuple], f: str) -> str:
    """The sum of the trees over the array f, in SQL."""
    pick = lambda k, yes, no: f"IF(get({f}, {k}), {yes}, {no})"
    return " + ".join(["0e0", *(pick(k, pick(y, f"{a!r}D", f"{b!r}D"), pick(n, f"{c!r}D", f"{d!r}D")) for k, y, n, a, b, c, d in trees)])


def selected(rows: DataFrame, spans: str, trees: list[tuple], least: float) -> DataFrame:
    """rows with the array spans cut to those whose margin reaches least; features of a span are computed once."""
    seen = F.transform(spans, lambda s: F.struct(s.alias("s"), features(s).alias("f")))
    chosen = F.expr(f"transform(filter(_seen, x -> {margin(trees, 'x.f')} >= {float(least)!r}D), x -> x.s)")
    rows = rows.withColumn("_seen", F.when(F.size(spans) > 0, seen))
    return rows.withColumn(spans, F.coalesce(chosen, F.col(spans))).drop("_seen")


def find_personal(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of base spans, all spans."""
    trees, least = trained(docs.sparkSession)
    text = text_or_empty()
    rows = docs.select("doc_id", base_spans(text).alias("base"), proposals(text).alias("more"))
    rows = selected(rows, "more", trees, least).withColumn("more", apart(F.col("more"), F.col("base"), len(BASE)))
    rows = rows.withColumn("more", first_of_overlapping(F.col("more")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return rows.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "more")).alias("spans"),
    )


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"))
