"""URL filters by rules and by trust and distrust over host links.

A rule names a host, with all its subdomains, and the start of a path; the longest
fitting rule decides. Where none fits, the link graph does: hosts that the rules
allow are trusted seeds, hosts they block (and never allow) are distrusted
seeds. Trust flows along host links by personalised PageRank, distrust flows
against them (who links to blocked hosts is suspect). A host is blocked if its
distrust reaches ``threshold`` and exceeds its trust. Every seed starts with a
mass of 1, however many there are, so a host's scores follow from the hosts it is
linked with and unrelated seeds change nothing.

Links are reduced to weighted host pairs before anything is joined; each round
is one join and one aggregation by host, and the lineage is cut every few rounds.
A hub's links are cut into parts of about ``HUB_LINKS``, to which its score goes
several times, so no task holds all links of one host.
Rounds go on until the scores of all hosts together change by no more than
``tolerance``.

Edge cases: a null url, or one without ``://``, has an empty host and path, fits
no rule and is allowed; null html has no links; hosts without links keep what they
are seeded with; a host with trust equal to its distrust is blocked only if distrust is
larger; extra columns are ignored; repeated rows each appear (and their links count
again); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import lower_ascii, materialize, small, table

#: (verdict, host, start of the path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
ROUNDS, DAMPING, THRESHOLD, CUT_EVERY = 8, 0.85, 1e-6, 4
#: Change of all scores at which the rounds end, and what rounding of doubles can leave of each unit of mass. (ROUNDS is only the DuckDB statement's, which has no loop.)
TOLERANCE, ROUNDING = 1e-9, 1e-14
HUB_LINKS = 100_000
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest fitting rule, else null."""
    out = None
    for verdict, name, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        value = F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, weight the share of src's links."""
    found = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), 1)).alias("to"))
    target = F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), F.col("to"))).otherwise(F.col("to"))
    pairs = found.select("src", host_of(target).alias("dst")).where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    return pairs


def _rank(nodes: DataFrame, links: DataFrame, seed: str, source: str, target: str, damping: float, tolerance: float, hub_links: int) -> DataFrame:
    """Personalised PageRank: (host, score); mass that leaves at hosts without links is not returned."""
    out = materialize(links.groupBy(source).agg(F.sum("n").alias("total"), F.ceil(F.count("*") / hub_links).cast("int").alias("parts")), "host-out")
    hubs = small(out.where("parts > 1").select(F.col(source).alias("hub"), F.col("parts").alias("cuts")))
    part = F.pmod(F.xxhash64(target), F.coalesce("cuts", F.lit(1))).cast("int").alias("part")
    flow = links.join(hubs, F.col(source) == F.col("hub"), "left").select(F.col(source).alias("from"), F.col(target).alias("to"), "n", part)
    flow = materialize(flow, "host-flow")
    now = nodes.join(out.withColumnRenamed(source, "host"), "host", "left").select("host", F.col(seed).alias("base"), F.col(seed).alias("score"), "total", "parts")
    if flow.isEmpty():
        return now.select("host", (F.lit(1 - damping) * F.col("base")).alias("score"))
    now = materialize(now, "host-start")
    # No round hands on more than ``damping`` of the change before, so this ends.
    while True:
        for _ in range(CUT_EVERY):
            given = now.where("score > 0 and total > 0").select(F.col("host").alias("giver"), (F.col("score") / F.col("total")).alias("share"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("cut"))
            come = given.join(flow, (F.col("giver") == F.col("from")) & (F.col("cut") == F.col("part"))).groupBy("to").agg(F.sum(F.col("share") * F.col("n")).alias("come"))
            score = F.lit(1 - damping) * F.col("base") + F.lit(damping) * F.coalesce("come", F.lit(0.0))
            now = now.join(come, F.col("host") == F.col("to"), "left").select("host", "base", score.alias("score"), "total", "parts", F.abs(score - F.col("score")).alias("change"))
        now = materialize(now, "host-rank")
        change, mass = now.agg(F.sum("change"), F.sum("score")).first()
        if (change or 0.0) <= max(tolerance, ROUNDING * (mass or 0.0)):
            return now.select("host", "score")


def scores(seeds: DataFrame, links: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, hub_links: int = HUB_LINKS) -> DataFrame:
    """(host, trust, distrust) of all hosts that are seeds (host, trusted, blocked: 0 or 1) or linked (src, dst, n)."""
    linked = links.select(F.col("src").alias("host")).union(links.select("dst")).distinct()
    trusted = F.coalesce("trusted", F.lit(0.0))
    nodes = seeds.join(linked, "host", "full").select("host", trusted.alias("trusted"), F.when(trusted > 0, 0.0).otherwise(F.coalesce("blocked", F.lit(0.0))).alias("blocked"))
    nodes = materialize(nodes, "host-nodes")
    trust = _rank(nodes, links, "trusted", "src", "dst", damping, tolerance, hub_links).withColumnRenamed("score", "trust")
    return trust.join(_rank(nodes, links, "blocked", "dst", "src", damping, tolerance, hub_links).withColumnRenamed("score", "distrust"), "host")


def judge(pages: DataFrame, rules=RULES, damping: float = DAMPING, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """page_id, host, path, rule, verdict of every row."""
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    rows = materialize(rows.select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("ruled")), "url-rules")
    links = materialize(host_links(pages), "host-links")
    seeds = rows.where("host <> ''").groupBy("host").agg(
        F.max(F.when(F.col("ruled") == "allow", 1.0).otherwise(0.0)).alias("trusted"), F.max(F.when(F.col("ruled") == "block", 1.0).otherwise(0.0)).alias("blocked")
    )
    found = scores(seeds, links, damping, tolerance)
    suspect = found.where((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))).select("host", F.lit("block").alias("graph"))
    suspect = small(materialize(suspect, "host-blocked"))
    found = rows.join(suspect, "host", "left")
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", "graph", F.lit("allow")).alias("verdict"))


def op9_url_graph(spark, sf_dir: str) -> DataFrame:
    """Contract of query 9."""
    return judge(table(spark, sf_dir, "pages"))


def oracle() -> str:
    """DuckDB SQL of query 9: the rounds written out."""
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rest = lambda x: f"CASE WHEN instr({x}, '://') > 0 THEN substr({x}, instr({x}, '://') + 3) END"
    host = lambda x: "coalesce(" + lower(f"regexp_extract({rest(x)}, '^([^/?#]*)', 1)") + ", '')"
    path = f"coalesce(regexp_extract({rest('url')}, '^[^/?#]*([^?#]*)', 1), '')"
    cases = " ".join(
        f"WHEN (host = '{n}' OR ends_with(host, '.{n}')) AND starts_with(path, '{s}') THEN '{v} {n}{s}'" for v, n, s in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    )
    href = HREF.replace("'", "''")
    steps = []
    for kind, seed, a, b in (("t", "trusted", "src", "dst"), ("d", "blocked", "dst", "src")):
        steps.append(f"{kind}f AS (SELECT {a} AS a, {b} AS b, n / sum(n) OVER (PARTITION BY {a}) AS w FROM links)")
        steps.append(f"{kind}0 AS (SELECT host, {seed} AS base, {seed} AS score FROM nodes)")
        for k in range(1, ROUNDS + 1):
            steps.append(
                f"{kind}{k} AS MATERIALIZED (SELECT x.host, any_value(x.base) AS base, {1 - DAMPING} * any_value(x.base) + {DAMPING} * coalesce(sum(p.score * f.w), 0) AS score "
                f"FROM {kind}{k - 1} x LEFT JOIN {kind}f f ON f.b = x.host LEFT JOIN {kind}{k - 1} p ON p.host = f.a GROUP BY x.host)"
            )
    return f"""
WITH p AS (SELECT page_id, {host('url')} AS host, {path} AS path, coalesce(html, '') AS html FROM pages),
r AS (SELECT *, CASE {cases} END AS hit FROM p),
rr AS (SELECT page_id, host, path, html, split_part(hit, ' ', 2) AS rule, split_part(hit, ' ', 1) AS ruled FROM r),
l0 AS (SELECT host AS src, unnest(regexp_extract_all(html, '{href}', 1)) AS t FROM p),
l1 AS (SELECT src, {host("(CASE WHEN starts_with(t, '//') THEN 'x:' || t ELSE t END)")} AS dst FROM l0),
links AS (SELECT src, dst, count(*) AS n FROM l1 WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
s AS (SELECT host, max((ruled = 'allow')::INT) AS tr, max((ruled = 'block')::INT) AS bl FROM rr WHERE host <> '' GROUP BY host),
h AS (SELECT host FROM s UNION SELECT src FROM links UNION SELECT dst FROM links),
nodes AS (SELECT host, coalesce(tr, 0)::DOUBLE AS trusted, CASE WHEN coalesce(tr, 0) > 0 THEN 0 ELSE coalesce(bl, 0) END::DOUBLE AS blocked FROM h LEFT JOIN s USING (host)),
{", ".join(steps)},
bad AS (SELECT d{ROUNDS}.host FROM d{ROUNDS} JOIN t{ROUNDS} USING (host) WHERE d{ROUNDS}.score >= {THRESHOLD} AND d{ROUNDS}.score > t{ROUNDS}.score)
SELECT page_id, host, path, nullif(rule, '') AS rule, CASE WHEN ruled <> '' THEN ruled WHEN host IN (SELECT host FROM bad) THEN 'block' ELSE 'allow' END AS verdict FROM rr"""
