"""URL filters: rules first, and propagation over the host graph for what no rule fits.

A rule is a host and the beginning of a path, allowing or blocking. It fits its host and all
subdomains; the longest fitting rule (host and path together) decides, the first listed on ties.

Other pages are judged by their host. Trust is a personalised PageRank from the hosts of allowed
pages along links; distrust one from the hosts of blocked pages against the links' direction (who
links to a blocked host becomes suspect). Edges are pairs of hosts, aggregated before they are joined,
so a host with many pages or links is a few rows. Rounds go on until all hosts together move by less than
``TOLERANCE`` and no further host is reached, so a host has trust or distrust however many links it is from a
seed; what is left is below TOLERANCE * DAMPING / (1 - DAMPING) for all hosts together. A host is blocked if it has distrust and its share of
distrust in both reaches ``BLOCK_AT``.

Only DataFrame functions are used. Defined cases: a null url, or one without ``://``, has empty host
and path, fits no rule and is allowed; a null html has no links; urls and pages are read whole; rows
that repeat are judged alike; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

#: (verdict, host, path)
Rule = tuple[str, str, str]
RULES: tuple[Rule, ...] = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
DAMPING, TOLERANCE, BLOCK_AT = 0.85, 1e-6, 0.5
#: Rounds after which the tolerance holds on any graph; only hosts further than that from a seed need more.
ROUNDS = math.ceil(math.log(TOLERANCE / 4, DAMPING))
#: Up to so many rules are one expression; more are joined by host suffix.
INLINE_RULES = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)://(.*)$", 1)
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.regexp_extract(url, r"(?s)://(.*)$", 1), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _fits(host: Column, path: Column, rule: Rule) -> Column:
    return ((host == rule[1]) | host.endswith("." + rule[1])) & path.startswith(rule[2])


def ruled(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` (null where none fits) to rows with ``host`` and ``path``."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    if not ranked:
        return pages.withColumns({"rule": F.lit(None).cast("string"), "rule_verdict": F.lit(None).cast("string")})
    if len(ranked) <= INLINE_RULES:
        rule = verdict = None
        for r in ranked:
            fits = _fits(F.col("host"), F.col("path"), r)
            rule = F.when(fits, r[1] + r[2]) if rule is None else rule.when(fits, r[1] + r[2])
            verdict = F.when(fits, r[0]) if verdict is None else verdict.when(fits, r[0])
        return pages.withColumns({"rule": rule, "rule_verdict": verdict})
    # Host suffixes, one for each label, meet the rules of that host.
    listed = pages.sparkSession.createDataFrame([(r[0], r[1], r[2], k) for k, r in enumerate(ranked)], "v string, h string, p string, k int")
    keyed = pages.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    suffixes = keyed.withColumn("h", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    best = suffixes.join(listed, "h").where(F.col("path").startswith(F.col("p"))).groupBy("host", "path").agg(F.min_by(F.struct(F.concat("h", "p").alias("rule"), F.col("v").alias("rule_verdict")), "k").alias("r"))
    return pages.join(best.select("host", "path", "r.*"), ["host", "path"], "left")


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, n: links between different hosts, from whole pages."""
    found = F.regexp_extract_all("html", F.lit(r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["']?((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    links = pages.select(F.col("host").alias("src"), F.explode(found).alias("link"))
    link = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), F.col("link"))).otherwise(F.col("link"))
    return links.select("src", host_of(link).alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """host, trust, distrust from ``seeds`` (host, t, d, each summing to one or nothing)."""
    if edges.limit(1).count() == 0:
        return seeds.select("host", F.col("t").alias("trust"), F.col("d").alias("distrust"))
    out = edges.groupBy("src").agg(F.sum("n").alias("o"))
    back = edges.groupBy("dst").agg(F.sum("n").alias("b"))
    flow = staged(edges.join(out, "src").join(back, "dst").select("src", "dst", (F.col("n") / F.col("o")).alias("forth"), (F.col("n") / F.col("b")).alias("back")), "flow")
    nodes = flow.select(F.col("src").alias("host")).union(flow.select("dst")).union(seeds.select("host")).distinct()
    ranks = staged(nodes.join(seeds, "host", "left").select("host", F.coalesce("t", F.lit(0.0)).alias("t"), F.coalesce("d", F.lit(0.0)).alias("d")).withColumns({"trust": F.col("t"), "distrust": F.col("d")}), "ranks")
    zero = F.lit(0.0)
    mix = lambda seed, flowed: F.lit(1 - DAMPING) * F.col(seed) + F.lit(DAMPING) * F.col(flowed)
    while True:
        there = flow.join(ranks.select(F.col("host").alias("src"), "trust"), "src").select(F.col("dst").alias("host"), (F.col("trust") * F.col("forth")).alias("x"), zero.alias("y"), zero.alias("t"), zero.alias("d"), zero.alias("trust"), zero.alias("distrust"))
        here = flow.join(ranks.select(F.col("host").alias("dst"), "distrust"), "dst").select(F.col("src").alias("host"), zero, (F.col("distrust") * F.col("back")), zero, zero, zero, zero)
        own = ranks.select("host", zero, zero, "t", "d", "trust", "distrust")
        got = there.union(here).union(own).groupBy("host").agg(*(F.sum(c).alias(c) for c in ("x", "y", "t", "d", "trust", "distrust")))
        moved = F.abs(mix("t", "x") - F.col("trust")) + F.abs(mix("d", "y") - F.col("distrust"))
        reached = ((F.col("trust") == 0) & (mix("t", "x") > 0)) | ((F.col("distrust") == 0) & (mix("d", "y") > 0))
        ranks = staged(got.select("host", "t", "d", mix("t", "x").alias("trust"), mix("d", "y").alias("distrust"), moved.alias("moved"), reached.alias("reached")), "ranks")
        still = ranks.agg(F.sum("moved").alias("moved"), F.count_if("reached").alias("reached")).first()
        if still["moved"] < TOLERANCE and not still["reached"]:
            return ranks.select("host", "trust", "distrust")


def judged(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the host's trust and distrust (the query leaves those two out)."""
    own = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = ruled(own.select("page_id", "host", "path"), rules)
    by_host = staged(known.where("host <> ''").groupBy("host").agg(F.count_if(F.col("rule_verdict") == "allow").alias("a"), F.count_if(F.col("rule_verdict") == "block").alias("b")), "hosts")
    total = by_host.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()
    seeds = by_host.select("host", (F.col("a") / F.lit(float(total["a"] or 1))).alias("t"), (F.col("b") / F.lit(float(total["b"] or 1))).alias("d"))
    ranks = propagate(staged(host_edges(own), "edges"), seeds)
    suspect = (F.col("distrust") > 0) & (F.col("distrust") >= F.lit(BLOCK_AT) * (F.col("trust") + F.col("distrust")))
    verdict = F.coalesce("rule_verdict", F.when(suspect, "block"), F.lit("allow"))
    return known.join(ranks, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    """The query in plain SQL: ROUNDS rounds over all hosts, so it reaches hosts up to so many links from a seed."""
    ranked = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for _, h, p in ranked]
    rule = "case " + " ".join(f"when {f} then '{r[1] + r[2]}'" for f, r in zip(fits, ranked, strict=True)) + " end"
    ruled_as = "case " + " ".join(f"when {f} then '{r[0]}'" for f, r in zip(fits, ranked, strict=True)) + " end"
    lower = lambda v: f"translate({v}, '{_UPPER}', '{_LOWER}')"
    rest = lambda v: f"regexp_extract({v}, '(?s)://(.*)$', 1)"
    host = lambda v: f"coalesce({lower(f"regexp_extract({rest(v)}, '^[^/?#]*')")}, '')"
    link = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["'']?((?:https?:)?//[^"''\s>]+)"""
    return f"""with recursive own as (
 select page_id, html, {host('url')} as host, coalesce(regexp_extract({rest('url')}, '^[^/?#]*([^?#]*)', 1), '') as path from pages),
known as (select page_id, host, path, {rule} as rule, {ruled_as} as ruled from own),
seeds as (select host, count(*) filter (ruled = 'allow') as a, count(*) filter (ruled = 'block') as b from known where host <> '' group by host),
seeded as (select host, cast(a as double)/greatest(sum(a) over (), 1) as t, cast(b as double)/greatest(sum(b) over (), 1) as d from seeds),
links as (select host as src, unnest(regexp_extract_all(html, '{link}', 1)) as link from own),
edges as (select src, dst, cast(count(*) as double) as n from (select src, {host("case when starts_with(link, '//') then 'http:' || link else link end")} as dst from links) l
 where src <> dst and src <> '' and dst <> '' group by src, dst),
flow as (select src, dst, n/sum(n) over (partition by src) as forth, n/sum(n) over (partition by dst) as back from edges),
nodes as (select h as host, coalesce(t, 0) as t, coalesce(d, 0) as d from (select src as h from edges union select dst from edges union select host from seeds) e left join seeded on seeded.host = h),
moves as (select src as f, dst as h, forth as x, cast(0 as double) as y, cast(0 as double) as keep from flow
 union all select dst, src, 0, back, 0 from flow union all select host, host, 0, 0, 1 from nodes),
ranks(k, host, t, d, trust, distrust) as (select 0, host, t, d, t, d from nodes
 union all select k+1, m.h, max(keep*t), max(keep*d), {1 - DAMPING!r}*max(keep*t)+{DAMPING}*sum(x*trust), {1 - DAMPING!r}*max(keep*d)+{DAMPING}*sum(y*distrust)
 from ranks join moves m on m.f = ranks.host where k < {ROUNDS} group by k, m.h)
select page_id, known.host as host, path, rule, coalesce(ruled, case when distrust > 0 and distrust >= {BLOCK_AT}*(trust+distrust) then 'block' end, 'allow') as verdict
from known left join (select * from ranks where k = {ROUNDS}) r on r.host = known.host"""


ORACLE_SQL = _sql()
