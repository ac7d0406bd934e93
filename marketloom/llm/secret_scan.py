"""Secret scans with corpus-wide ownership frequency (operator 2), with DataFrame operations only.

Candidates are the base matches and opaque tokens of mixed characters. Their hashes are aggregated over the corpus by
distinct repositories (documents, unless a column says otherwise) and owners (sources): a value that several owners
have, or that is in many repositories of one, is a copied example; one that a single owner has in few and that looks
random is taken for a live credential. Base spans are always reported; opaque tokens only if live. Each
value's two counts are returned. Copies within a task, and then within an owner, are merged before
values are counted, so a value in a third of all rows sends a few rows per task.

Defined cases: null text is empty; null source is an owner of its own; null doc_id is carried; repeated rows are
reported each and count as one repository; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty
from .spans import apart, joined, matches

#: The base patterns, by kind in the order of reports.
KEYWORD = r"(?i:password|passwd|secret|token|api_?key)"
VALUE = r"[A-Za-z0-9+/_.=-]"
ASSIGN = rf"{KEYWORD}[\"']?\x20*+[:=]\x20*+[\"']?{VALUE}++"
ASSIGN_VALUE = rf"^{KEYWORD}[\"']?\x20*+[:=]\x20*+[\"']?({VALUE}++)$"
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
#: Runs of token characters, looked at from the start of a run only.
OPAQUE = r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}+"
#: From so many owners on, a value is a copied example.
SHARED_OWNERS = 2
#: So is, from so many repositories on, one of a single owner; a credential in use is in a few of them.
SHARED_REPOSITORIES = 50


def assigned(hit: Column) -> Column:
    return F.regexp_extract(hit, ASSIGN_VALUE, 1)


def mixed_characters(hit: Column) -> Column:
    """Looks random: at least two digits, two small and two large letters, and eight different characters."""
    some = lambda kind: F.length(F.regexp_replace(hit, f"[^{kind}]", "")) >= 2
    return some("0-9") & some("a-z") & some("A-Z") & (F.size(F.array_distinct(F.split(hit, ""))) >= 8)


def secret_value(span: Column) -> Column:
    return F.when(span["kind"] == "assign", assigned(span["hit"])).otherwise(span["hit"])


def looks_live(value: Column) -> Column:
    """Random enough for a credential: eight different characters with a digit among them, and no run of one character."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= 8) & F.rlike(value, F.lit("[0-9]")) & ~F.rlike(value, F.lit(r"(.)\1\1\1"))


def scanned(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    text = text_or_empty()
    base = [
        matches(text, ASSIGN, "assign", 0, lambda hit: F.length(assigned(hit)) >= 6),
        matches(text, ACCESS, "access", 1, lambda hit: F.lit(True)),
        matches(text, HEX, "hex", 2, lambda hit: F.lit(True)),
    ]
    rows = docs.select(
        "doc_id", F.col(repository).cast("string").alias("repository"), F.col(owner).cast("string").alias("owner"),
        F.concat(*base).alias("base"), matches(text, OPAQUE, "opaque", 3, mixed_characters).alias("opaque"),
    )
    rows = rows.withColumn("opaque", apart(F.col("opaque"), F.col("base"), 3))
    slim = lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"),
        F.sha2(secret_value(s), 256).alias("hash"), looks_live(secret_value(s)).alias("live"),
    )
    return rows.withColumns({c: F.transform(c, slim) for c in ("base", "opaque")}).withColumn("rid", F.monotonically_increasing_id())


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, repositories, owners: how many distinct ones have each value."""
    owner = F.coalesce(F.concat(F.lit("="), "owner"), F.lit("")).alias("owner")
    each = candidates.select("hash", owner, F.coalesce("repository", F.lit("")).alias("repository")).distinct()
    by_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count(F.lit(1)).alias("owners"))


def find_secrets(docs: DataFrame, repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row per document: counts and spans, n_live and n_shared (spans by ownership), and
    ownership (kind:start:end:repositories:owners of each candidate)."""
    rows = materialize(scanned(docs, repository, owner), "secrets")
    candidates = rows.where((F.size("base") > 0) | (F.size("opaque") > 0)).select("rid", "repository", "owner", F.explode(F.concat("base", "opaque")).alias("s"))
    candidates = candidates.select("rid", "repository", "owner", "s", F.col("s.hash").alias("hash"))
    judged = candidates.join(ownership(candidates), "hash")
    shared = (F.col("owners") >= SHARED_OWNERS) | (F.col("repositories") >= SHARED_REPOSITORIES)
    live = ~shared & F.col("s.live")
    added = F.when(live & (F.col("s.kind") == "opaque"), F.struct("s.start", "s.rank", "s.end", "s.kind"))
    by_row = judged.groupBy("rid").agg(
        F.count_if(live).alias("n_live"), F.count_if(shared).alias("n_shared"), F.collect_list(added).alias("added"),
        F.collect_list(F.struct("s.start", "s.rank", F.concat_ws(":", "s.kind", "s.start", "s.end", "repositories", "owners").alias("counts"))).alias("counted"),
    )
    out = rows.join(by_row, "rid", "left")
    base = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.when(F.col("added").isNull(), base).otherwise(F.concat(base, "added"))).alias("spans"),
        F.coalesce("n_live", F.lit(0)).cast("long").alias("n_live"), F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"),
        F.coalesce(F.array_join(F.transform(F.array_sort("counted"), lambda s: s["counts"]), ","), F.lit("")).alias("ownership"),
    )


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
