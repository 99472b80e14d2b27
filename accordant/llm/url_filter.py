"""URL filter: explicit rules first, then trust and distrust that spread over the links between hosts.

Rules name a host (with all its subdomains) and the beginning of a path; the longest that fits decides. Pages that no
rule fits get the verdict of their host. A host's trust seed is the share of its pages that a rule allows, its
distrust seed the share that a rule blocks. Trust spreads along the links (personalised PageRank from the trusted
seeds), distrust against them (from the blocked seeds):

    rank = seed + DAMPING x (sum over neighbours of rank x share of the neighbour's links)

Power iterations run until no rank changes by more than TOLERANCE. What a round adds shrinks by DAMPING at least, so ROUNDS
(a bound that follows from both) are enough for any graph. A host is blocked where distrust exceeds trust by
more than LIMIT. Everything is DataFrame functions. Ranks and edges hold one row per host or host pair, are shuffled
by host and written to the shared folder every round. The number of links between two hosts is summed before the
shuffle, and pages meet host verdicts in an equi join that only pages without a rule take part in.

Defined cases: null urls, or urls without `://`, have an empty host and path; null html has no links; relative links
stay on their host and carry nothing; repeated pages count as often as they stand; no pages give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table

#: (host, path, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
DAMPING, TOLERANCE, LIMIT = 0.85, 1e-5, 0.25
#: Seeds add up to one a host at most and shares to DAMPING, so round k changes the sum over all hosts by DAMPING ** k of it.
ROUNDS = math.ceil(math.log(TOLERANCE) / math.log(DAMPING))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""
#: The host of an absolute link (with or without a scheme).
TARGET = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]+)"


def split_url(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts, from the absolute links of pages(host, html)."""
    found = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("href"))
    found = found.select("src", F.translate(F.regexp_extract("href", TARGET, 1), UPPER, LOWER).alias("dst"))
    return found.filter("dst <> '' and src <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def host_ranks(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust) from seeds(host, trust, distrust) and edges(src, dst, links)."""
    both = edges.select(F.lit("trust").alias("kind"), "src", "dst", "links").unionByName(edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links"))
    total = both.groupBy("kind", "src").agg(F.sum("links").alias("all"))
    steps = materialize(both.join(total, ["kind", "src"]).select("kind", "src", "dst", (DAMPING * F.col("links") / F.col("all")).alias("share")))
    seed = materialize(seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "rank")).filter("rank > 0"))
    ranks = seed
    for _ in range(ROUNDS):
        flow = ranks.withColumnRenamed("host", "src").join(steps, ["kind", "src"]).select("kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share")).alias("rank"))
        new = materialize(seed.select("kind", "host", "rank").unionByName(flow).groupBy("kind", "host").agg(F.sum("rank").alias("rank")))
        moved = new.join(ranks.withColumnRenamed("rank", "was"), ["kind", "host"], "left").filter(F.abs(F.col("rank") - F.coalesce("was", F.lit(0.0))) > TOLERANCE).limit(1).count()
        ranks = new
        if not moved:
            break
    value = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0)).alias(kind)
    return ranks.groupBy("host").agg(value("trust"), value("distrust"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages(page_id, url, html)."""
    host, path = split_url("url")
    named = pages.select("page_id", "html", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    named = named.withColumns({"rule": rule, "ruled": verdict})
    share = lambda v: F.avg((F.coalesce(F.col("ruled"), F.lit("")) == v).cast("double"))
    seeds = named.groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    bad = materialize(host_ranks(seeds, host_edges(named)).filter(F.col("distrust") - F.col("trust") > LIMIT).select("host", F.lit("block").alias("by_host")))
    judged = named.drop("html")
    ruled = judged.filter("ruled is not null").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict"))
    others = judged.filter("ruled is null").join(bad, "host", "left").select("page_id", "host", "path", "rule", F.coalesce("by_host", F.lit("allow")).alias("verdict"))
    return ruled.unionByName(others)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def _sql() -> str:
    fits = lambda h, p: f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')"
    rules = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    case = lambda f: "case " + " ".join(f"when {fits(h, p)} then '{f(h, p, v)}'" for h, p, v in rules) + " end"
    rounds = "".join(
        f", r{k} as (select kind, host, sum(rank) as rank from (select kind, host, rank from seed union all select s.kind, s.dst, r.rank * s.share from r{k - 1} r join steps s on r.kind = s.kind and r.host = s.src) group by all)"
        for k in range(1, ROUNDS + 1)
    )
    link, target = LINK.replace("'", "''"), TARGET
    return f"""
with cut as (select page_id, html, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
named as (select page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
judged as (select *, {case(lambda h, p, v: h + p)} as rule, {case(lambda h, p, v: v)} as ruled from named),
seeds as (select host, avg(case when ruled = 'allow' then 1.0 else 0.0 end) as trust, avg(case when ruled = 'block' then 1.0 else 0.0 end) as distrust from judged group by host),
hrefs as (select host as src, unnest(regexp_extract_all(html, '{link}', 1)) as href from judged),
edges as (select src, dst, count(*) as links from (select src, translate(regexp_extract(href, '{target}', 1), '{UPPER}', '{LOWER}') as dst from hrefs) where dst <> '' and src <> '' and src <> dst group by all),
pairs as (select 'trust' as kind, src, dst, links from edges union all select 'distrust', dst, src, links from edges),
steps as (select kind, src, dst, {DAMPING} * links / sum(links) over (partition by kind, src) as share from pairs),
seed as (select * from (select 'trust' as kind, host, trust as rank from seeds union all select 'distrust', host, distrust from seeds) where rank > 0),
r0 as (select * from seed){rounds},
bad as (select host from r{ROUNDS} group by host having sum(case when kind = 'distrust' then rank else -rank end) > {LIMIT})
select page_id, host, path, rule, coalesce(ruled, case when host in (select host from bad) then 'block' else 'allow' end) as verdict from judged
"""


SQL = _sql()
