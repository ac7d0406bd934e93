"""URL filters by rules and by the links between hosts (operator 11).

Rules of the form host/path fit a host with all its subdomains where the path starts as the rule's does; the longest
that fits decides. Every other url gets its host's verdict: trust flows from trusted hosts along links, distrust from
blocked hosts against them, both as personalised PageRank over distinct host edges, and a host whose distrust is above
RATIO times its trust is blocked. A host is a seed if more than half of its pages are allowed (blocked) by rules.

Ranks are integers (TOTAL units a seed set), so sums do not depend on their order and reruns agree to the unit. A round
joins edges with what each host passes on and sums by receiver; the state of a round is a table in the shared folder. A
host of more than HUB_EDGES edges is dealt over as many parts as it needs. Rounds end when nothing changes, at ROUNDS
at the latest, when 0.85^ROUNDS (4 %) of the mass is still on its way. Hosts without pages cannot link on: they count in
their linkers' degrees, and what they would receive is dropped.

Defined cases: a null url, or one without "://", has an empty host and path, and an empty host is no node of the graph;
null html has no links; a host without evidence is allowed, so is one of equal trust and distrust; links within a host
and repeated links count once or not at all; null page_id is carried; repeated rows are each judged (and each counts as
a page); other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, maybe_broadcast, salted_join, scratch, table, text_or_empty

#: Verdict, host and path of each rule.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Units of rank that the seeds of one kind share.
TOTAL = 10**15
#: Percent of a host's rank that goes on along its edges; the rest comes anew from the seeds.
DAMPING = 85
ROUNDS = 20
#: Distrust above so many times the trust blocks a host.
RATIO = 1
HUB_EDGES = 100_000
#: Host tables of up to this many rows are broadcast (about 100 bytes a row).
BROADCAST_HOSTS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]"
#: The host of a link with a host of its own; relative links stay within their host.
LINK = rf"""(?i)\bhref{SPACE}*+={SPACE}*+["']?+{SPACE}*+(?:https?:)?//([^/?#"'<>\x20\x09-\x0D]++)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(url, r"://[^/?#]*+([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple) -> Column:
    """Struct of rule and verdict, null if none fits. Rules are few: they become one expression."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (source, target) of links from a page's host to another host."""
    links = F.array_distinct(F.regexp_extract_all(text_or_empty("html"), F.lit(LINK), F.lit(1)))
    edges = pages.select(url_parts(F.col("url"))[0].alias("source"), F.explode(links).alias("link"))
    edges = edges.select("source", F.translate("link", UPPER, LOWER).alias("target"))
    return edges.where((F.col("source") != "") & (F.col("source") != F.col("target"))).distinct()


def host_seeds(pages: DataFrame, rules: tuple) -> DataFrame:
    """host, pages, trusted, blocked of every host."""
    host, path = url_parts(F.col("url"))
    ruled = longest_rule(host, path, rules)["verdict"]
    by = pages.select(host.alias("host"), ruled.alias("ruled")).where(F.col("host") != "").groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allow"), F.count_if(F.col("ruled") == "block").alias("block")
    )
    return by.select("host", "pages", (2 * F.col("allow") > F.col("pages")).alias("trusted"), (2 * F.col("block") > F.col("pages")).alias("blocked"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, hub_edges: int = HUB_EDGES) -> DataFrame:
    """host, trust, distrust: both ranks in one run, as nodes of two kinds (0 along links, 1 against them)."""
    share = F.lit(TOTAL * (100 - DAMPING) // 100)
    n = seeds.agg(F.count_if("trusted").alias("n_trusted"), F.count_if("blocked").alias("n_blocked"))
    seed = lambda flag, of: F.when(F.col(flag), F.expr(f"{TOTAL * (100 - DAMPING) // 100} div {of}")).otherwise(0)
    nodes = seeds.crossJoin(F.broadcast(n)).select(  # n is one row
        "host", F.explode(F.array(F.struct(F.lit(0).alias("kind"), seed("trusted", "n_trusted").alias("seed")), F.struct(F.lit(1).alias("kind"), seed("blocked", "n_blocked").alias("seed")))).alias("x")
    ).select("host", "x.kind", F.col("x.seed").cast("long").alias("seed"))
    both = F.array(F.struct(F.lit(0).alias("kind"), F.col("source").alias("host"), F.col("target").alias("to")), F.struct(F.lit(1).alias("kind"), F.col("target").alias("host"), F.col("source").alias("to")))
    out = materialize(edges.select(F.explode(both).alias("x")).select("x.*"), "edges")
    degrees = out.groupBy("kind", "host").agg(F.count(F.lit(1)).alias("degree"))
    nodes = materialize(nodes.join(degrees, ["kind", "host"], "left").withColumns({"mass": F.col("seed"), "before": F.lit(-1).cast("long")}), "ranks")
    parts = lambda: F.ceil(F.col("degree") / hub_edges)
    hubs = nodes.where(F.col("degree") > hub_edges).select("kind", "host", parts().alias("parts"))  # at most 2 edges / HUB_EDGES rows
    known = nodes.where("kind = 0").select(F.col("host").alias("to"))
    dealt = out.join(known, "to", "left_semi").join(maybe_broadcast(hubs, BROADCAST_HOSTS), ["kind", "host"], "left")
    dealt = dealt.select("kind", "host", "to", F.coalesce(F.pmod(F.xxhash64("to"), F.col("parts")), F.lit(0)).cast("int").alias("part"))
    dealt = materialize(dealt, "dealt")
    for _ in range(rounds if not dealt.isEmpty() else 0):
        passed = nodes.where("mass > 0 and degree > 0").select("kind", "host", F.expr(f"(mass * {DAMPING}) div (100 * degree)").alias("passed"), F.explode(F.sequence(F.lit(0), parts().cast("int") - 1)).alias("part"))
        got = dealt.join(passed, ["kind", "host", "part"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum("passed").alias("got"))
        new = nodes.join(got, ["kind", "host"], "left").select("kind", "host", "seed", "degree", (F.col("seed") + F.coalesce("got", F.lit(0))).alias("mass"), F.col("mass").alias("before"))
        nodes = materialize(new, "ranks")
        if nodes.where("mass != before").isEmpty():
            break
    by_kind = lambda k: F.max(F.when(F.col("kind") == k, F.col("mass")))
    return nodes.groupBy("host").agg(by_kind(0).alias("trust"), by_kind(1).alias("distrust"))


def judged_urls(pages: DataFrame, rules: tuple = RULES, rounds: int = ROUNDS, ratio: int = RATIO, hub_edges: int = HUB_EDGES) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust of every url."""
    with scratch(pages.sparkSession):
        seeds = materialize(host_seeds(pages, rules), "hosts")
        ranks = materialize(propagate(seeds, host_edges(pages), rounds, hub_edges), "ranks", keep=True)
    host, path = url_parts(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("ruled", longest_rule(F.col("host"), F.col("path"), rules))
    rows = salted_join(rows, ranks, ["host"], "left", F.xxhash64("page_id", "path"), BROADCAST_HOSTS)
    trust, distrust = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("trust", "distrust"))
    own = F.when(distrust > ratio * trust, "block").otherwise("allow")
    return rows.select("page_id", "host", "path", F.col("ruled.rule").alias("rule"), F.coalesce(F.col("ruled.verdict"), own).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    """The same in SQL: one step of the chain a round."""
    rule = "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{'rule': '{h + p}', 'verdict': '{v}'}}"
        for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    ) + " END"
    link = LINK.replace("*+", "*").replace("?+", "?").replace("++", "+").replace("'", "''")
    spread = TOTAL * (100 - DAMPING) // 100
    step = """m{k} AS MATERIALIZED (SELECT s.kind, s.host, s.seed, s.degree, s.seed + coalesce(g.got, 0) AS mass FROM m{j} s LEFT JOIN
  (SELECT e.kind, e.t AS host, cast(sum((x.mass * {d}) // (100 * x.degree)) AS bigint) AS got FROM ends e JOIN m{j} x ON x.kind = e.kind AND x.host = e.host GROUP BY ALL) g ON g.kind = s.kind AND g.host = s.host)"""
    return f"""
WITH u AS MATERIALIZED (SELECT page_id, html, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS MATERIALIZED (SELECT page_id, host, path, {rule} AS ruled FROM u),
h AS MATERIALIZED (SELECT host, 2 * count_if(ruled.verdict = 'allow') > count(*) AS trusted, 2 * count_if(ruled.verdict = 'block') > count(*) AS blocked FROM r WHERE host <> '' GROUP BY host),
edges AS MATERIALIZED (SELECT DISTINCT host AS s, translate(link, '{UPPER}', '{LOWER}') AS t FROM (SELECT host, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS link FROM u) WHERE host <> '' AND host <> translate(link, '{UPPER}', '{LOWER}')),
ends AS MATERIALIZED (SELECT 0 AS kind, s AS host, t FROM edges UNION ALL SELECT 1, t, s FROM edges),
degrees AS (SELECT kind, host, count(*) AS degree FROM ends GROUP BY ALL),
seeds AS (SELECT 0 AS kind, host, CASE WHEN trusted THEN {spread} // (SELECT count_if(trusted) FROM h) ELSE 0 END AS seed FROM h UNION ALL SELECT 1, host, CASE WHEN blocked THEN {spread} // (SELECT count_if(blocked) FROM h) ELSE 0 END FROM h),
m0 AS MATERIALIZED (SELECT s.kind, s.host, s.seed, d.degree, s.seed AS mass FROM seeds s LEFT JOIN degrees d ON d.kind = s.kind AND d.host = s.host),
{", ".join(step.format(k=k, j=k - 1, d=DAMPING) for k in range(1, ROUNDS + 1))}
SELECT page_id, host, path, ruled.rule AS rule, coalesce(ruled.verdict, CASE WHEN distrust > {RATIO} * trust THEN 'block' ELSE 'allow' END) AS verdict, trust, distrust FROM (
  SELECT r.*, cast(coalesce(a.mass, 0) AS bigint) AS trust, cast(coalesce(b.mass, 0) AS bigint) AS distrust FROM r LEFT JOIN m{ROUNDS} a ON a.kind = 0 AND a.host = r.host LEFT JOIN m{ROUNDS} b ON b.kind = 1 AND b.host = r.host)
"""


OP11_SQL = _sql()
