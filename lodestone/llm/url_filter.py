"""URL filters: longest-match rules, then trust and distrust over the host graph.

Personalised PageRank runs twice over the host edges found in the pages' links: trust flows along the
links from hosts that allow rules meet, distrust flows against them from hosts that block rules meet (who
links to a blocked host is distrusted). A host whose distrust exceeds its trust by MARGIN is blocked; so a
host without any evidence is allowed. Ranks are a table of hosts, never of pages, and mass at hosts without
links leaks away.

Rounds go on until one block of them adds no more than TOLERANCE of all rank. Every round adds at most DAMPING
of what the last one added, so that is after 132 rounds at most; a graph without cycles ends sooner.

Defined results: a null url, or one without "://", has an empty host and path, fits no rule and is
allowed; null html has no links; repeated rows count as often as they occur.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written

#: (verdict, host, path): a rule fits its host and all subdomains, where the url's path starts with its path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
DAMPING, ROUNDS_PER_WRITE = 0.85, 4
#: What ends the rounds, as a share of all rank; what distrust must exceed trust by.
TOLERANCE, MARGIN = 1e-9, 1e-6
#: Absolute and protocol-relative links; relative ones stay on their host.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*(/[^?#]*)?", 1)


def matched(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule = verdict = None
    for v, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1:])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def parsed(pages: DataFrame, rules=RULES) -> DataFrame:
    df = pages.select(F.col("page_id"), F.col("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matched(F.col("host"), F.col("path"), rules)
    return df.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("rule_verdict"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    hits = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1))
    df = pages.select(host_of(F.col("url")).alias("src"), F.explode(hits).alias("dst")).select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return df.where("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def host_scores(judged: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, trust, distrust) of the hosts that have any."""
    seeds = judged.where("rule_verdict IS NOT NULL AND host <> ''").groupBy("host", F.col("rule_verdict").alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    ruled = seeds.groupBy("host").agg(F.sum("n").alias("all"))
    # a host's seed is the share of its ruled pages, so a large host weighs no more than a small one
    seeds = written(seeds.join(ruled, "host").select("host", "kind", (F.col("n") / F.col("all")).alias("seed")), "url-seeds")
    both = edges.select(F.lit("allow").alias("kind"), F.col("src").alias("host"), F.col("dst").alias("to"), "n").unionByName(edges.select(F.lit("block").alias("kind"), F.col("dst").alias("host"), F.col("src").alias("to"), "n"))
    out = both.groupBy("kind", "host").agg(F.sum("n").alias("all"))
    both = written(both.join(out, ["kind", "host"]).select("kind", "host", "to", (F.col("n") / F.col("all")).alias("w")), "url-edges")
    start = rank = written(seeds.select("host", "kind", ((1 - DAMPING) * F.col("seed")).alias("r")), "url-rank")
    total = 0.0
    while True:
        for _ in range(ROUNDS_PER_WRITE):
            passed = rank.join(both, ["kind", "host"]).select(F.col("to").alias("host"), "kind", (DAMPING * F.col("r") * F.col("w")).alias("r"))
            rank = passed.unionByName(start).groupBy("host", "kind").agg(F.sum("r").alias("r"))
        rank = written(rank, "url-rank")
        was, total = total, rank.agg(F.sum("r")).first()[0] or 0.0
        if total - was <= TOLERANCE * total:  # ranks only grow
            break
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("r"))), F.lit(0.0))
    return rank.groupBy("host").agg(of("allow").alias("trust"), of("block").alias("distrust"))


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    judged = written(parsed(pages, rules), "url-parsed")
    scores = host_scores(judged, host_edges(pages))
    blocked = scores.where(F.col("distrust") - F.col("trust") > MARGIN).select(F.col("host").alias("bad"))
    # only pages that no rule decides need their host's score
    df = judged.join(blocked, F.when(F.col("rule_verdict").isNull(), F.col("host")) == F.col("bad"), "left")
    verdict = F.coalesce("rule_verdict", F.when(F.col("bad").isNotNull(), "block").otherwise("allow"))
    return df.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def oracle() -> str:
    """The same by SQL, with as many rounds as the tolerance can ever take."""
    order = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1:]))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    case = lambda k: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{(h + p, v)[k]}'" for v, h, p in order) + " END"
    link = LINK.replace("'", "''")
    most = ROUNDS_PER_WRITE * math.ceil(math.log(TOLERANCE) / math.log(DAMPING) / ROUNDS_PER_WRITE + 1)
    return f"""
WITH RECURSIVE a AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1), '') AS path FROM a),
j AS (SELECT page_id, host, path, {case(0)} AS rule, {case(1)} AS rv FROM p),
l AS (SELECT host AS src, unnest(regexp_extract_all(coalesce(html, ''), '{link}', 1)) AS dst FROM p),
e AS (SELECT src, translate(dst, '{UPPER}', '{LOWER}') AS dst, count(*) AS n FROM l WHERE src <> '' AND src <> translate(dst, '{UPPER}', '{LOWER}') GROUP BY 1, 2),
u AS (SELECT 'allow' AS kind, src AS host, dst, n FROM e UNION ALL SELECT 'block', dst, src, n FROM e),
b AS (SELECT kind, host, dst, n / sum(n) OVER (PARTITION BY kind, host) AS w FROM u),
s AS (SELECT host, rv AS kind, count(*) AS n FROM j WHERE rv IS NOT NULL AND host <> '' GROUP BY 1, 2),
r0 AS (SELECT host, kind, {1 - DAMPING} * (n / sum(n) OVER (PARTITION BY host)) AS r FROM s),
r AS (SELECT 0 AS k, host, kind, r FROM r0 UNION ALL
    SELECT k + 1, host, kind, sum(r) FROM (SELECT r.k, b.dst AS host, b.kind, {DAMPING} * r.r * b.w AS r FROM r JOIN b ON b.kind = r.kind AND b.host = r.host UNION ALL SELECT k, host, kind, r FROM r0, (SELECT DISTINCT k FROM r)) WHERE k < {most} GROUP BY 1, 2, 3),
t AS (SELECT host, coalesce(sum(CASE WHEN kind = 'allow' THEN r END), 0) AS trust, coalesce(sum(CASE WHEN kind = 'block' THEN r END), 0) AS distrust FROM r WHERE k = {most} GROUP BY host)
SELECT j.page_id, j.host, j.path, j.rule, coalesce(j.rv, CASE WHEN t.distrust - t.trust > {MARGIN} THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN t ON t.host = j.host
"""
