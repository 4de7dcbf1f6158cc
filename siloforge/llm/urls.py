"""URL filtering: rules first, link-graph propagation for the rest.

A rule is a host and a path ("example.org/es/"): it fits the host and all its subdomains where the URL's path starts with the
rule's; of the rules that fit the longest wins (of equally long ones the longer host, then block). Pages that no rule fits
get their host's verdict. Hosts are linked by the absolute links of their pages' html, each pair of different
hosts counting once for each page that links it. Trust is personalised PageRank along the links from the hosts
of allowed pages, distrust the same against the links from the hosts of blocked pages (a link to a bad host counts against
its source). A host's seed is the number of its allowed, or blocked, pages over the number of all pages with a rule. A host is
blocked if more than THRESHOLD of its trust and distrust together is distrust, else allowed; so are hosts that no seed reaches.

Ranks stay distributed: an iteration is one join by host and one pre-aggregated sum, and every STEPS iterations are cut by a table in the shared folder;
they end when no rank moves by more than TOLERANCE of itself, however far from a seed its host is. The heavy side of the join can be split.

Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased; path: from there up to "?", "#" or the
end; both empty for null URLs and those without "://". The empty host has no links. Null html has no links.
Repeated rows get their own equal row. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siloforge.session import cut, discard, table

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
DAMPING, ITERATIONS, STEPS, TOLERANCE, THRESHOLD = 0.85, 5000, 4, 1e-6, 0.6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """A struct (rule, verdict), null where none fits. The rules are a small parameter, not data."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    ranked = sorted(rules, key=lambda r: (len(r[0]), len(r[0].partition("/")[0]), r[1] == "block"))
    for rule, verdict in ranked:  # later ones override
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | F.endswith(host, F.lit("." + own))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def links(pages: DataFrame) -> DataFrame:
    """(a, b, n): from how many pages of host a a link leads to host b."""
    targets = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)<[a-z][^>]*?\s(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"'>]+)"""), 1)
    hosts = F.array_distinct(F.transform(targets, lambda t: host_of(F.regexp_replace(t, "^//", "x://"))))
    out = pages.select(F.col("host").alias("a"), F.explode(hosts).alias("b")).filter("a <> b AND a <> '' AND b <> ''")
    return out.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))


def propagated(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE, most: int = ITERATIONS) -> DataFrame:
    """Personalised PageRank of several kinds at once. edges: (kind, a, b, n); seeds: (kind, host, seed), weights of any sum. Returns (kind, host, rank), which sum to the seeds of their kind.

    A host without links gives its rank back to the seeds. That only scales all ranks of a kind, so it is left out of the iterations and the ranks are scaled at the end. A table holds STEPS iterations. They go on until no rank differs from the table before by more than this share of itself, so every host that a seed reaches has one; if most iterations don't do, that is an error.
    """
    total = edges.groupBy(F.col("kind").alias("k"), F.col("a").alias("h")).agg(F.sum("n").alias("total"))
    steps = cut(edges.join(total, (F.col("kind") == F.col("k")) & (F.col("a") == F.col("h"))).select("kind", "a", "b", (damping * F.col("n") / F.col("total")).alias("share")), "steps")
    ranks = start = cut(seeds.select("kind", "host", F.col("seed").alias("rank")), "ranks")
    if steps.isEmpty():
        return ranks
    given = start.select("kind", "host", ((1 - damping) * F.col("rank")).alias("rank"))
    for _ in range(0, most, STEPS):
        new = ranks
        for _ in range(STEPS):
            r = new.select(F.col("kind").alias("k"), F.col("host").alias("h"), "rank")
            moved = steps.join(r, (F.col("kind") == F.col("k")) & (F.col("a") == F.col("h"))).select("kind", F.col("b").alias("host"), (F.col("share") * F.col("rank")).alias("rank"))
            new = moved.unionByName(given).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        new = cut(new, "ranks")
        was = ranks.select("kind", "host", F.col("rank").alias("was"))
        moving = new.join(was, ["kind", "host"], "left").filter(F.abs(F.col("rank") - F.coalesce("was", F.lit(0.0))) > tolerance * F.col("rank"))
        settled = moving.isEmpty()
        if ranks is not start:
            discard(ranks)
        ranks = new
        if settled:
            break
    else:
        raise RuntimeError("propagated: ranks still move after the iterations allowed")
    discard(steps)
    scale = start.groupBy("kind").agg(F.sum("rank").alias("whole")).join(ranks.groupBy("kind").agg(F.sum("rank").alias("sum")), "kind")
    return ranks.join(F.broadcast(scale), "kind").select("kind", "host", (F.col("rank") * F.col("whole") / F.col("sum")).alias("rank"))  # a row a kind


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and its host's trust and distrust."""
    p = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    p = p.withColumn("best", best_rule(F.col("host"), F.col("path"), rules))
    ruled = p.filter("best IS NOT NULL AND host <> ''").groupBy(F.when(F.col("best.verdict") == "allow", "trust").otherwise("distrust").alias("kind"), "host").agg(F.count(F.lit(1)).alias("n"))
    ruled = cut(ruled, "seeds")
    whole = ruled.agg(F.sum("n")).first()[0] or 1
    seeds = ruled.select("kind", "host", (F.col("n") / F.lit(float(whole))).alias("seed"))
    e = cut(links(p), "links")
    edges = e.select(F.lit("trust").alias("kind"), "a", "b", "n").unionByName(e.select(F.lit("distrust").alias("kind"), F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    ranks = propagated(edges, seeds).groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("rank")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")))
    ranks = ranks.withColumnRenamed("host", "h")
    out = p.drop("html").join(ranks, F.col("host") == F.col("h"), "left")
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    method = F.when(distrust > threshold * (trust + distrust), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def oracle(rules: tuple[tuple[str, str], ...] = RULES, iterations: int = 300) -> str:
    """The judgement of all pages as SQL, by so many iterations: enough for the ranks of hosts some 150 links from a seed. Where there are no links, none is made."""
    host = lambda u: f"translate(regexp_extract({u}, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    listed = ", ".join(f"('{r}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{v}')" for r, v in rules)
    return rf"""
WITH RECURSIVE p AS MATERIALIZED (SELECT row_number() OVER () r, page_id, coalesce({host("url")}, '') host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') path, coalesce(html, '') html FROM pages),
u(rule, own, start, verdict) AS (VALUES {listed}),
f AS (SELECT r, rule, verdict, row_number() OVER (PARTITION BY r ORDER BY length(rule) DESC, length(own) DESC, verdict = 'block' DESC) k FROM p JOIN u ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, start)),
j AS MATERIALIZED (SELECT p.*, rule, verdict FROM p LEFT JOIN (SELECT * FROM f WHERE k = 1) f USING (r)),
sd AS (SELECT CASE WHEN verdict = 'allow' THEN 'trust' ELSE 'distrust' END kind, host, count(*) n FROM j WHERE verdict IS NOT NULL AND host <> '' GROUP BY ALL),
s AS MATERIALIZED (SELECT kind, host, n / CAST((SELECT sum(n) FROM sd) AS DOUBLE) seed, n / CAST(sum(n) OVER (PARTITION BY kind) AS DOUBLE) own FROM sd),
h AS (SELECT r, host, unnest(regexp_extract_all(html, '(?i)<[a-z][^>]*?\s(?:href|src)\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"''>]+)', 1)) t FROM p WHERE host <> ''),
l AS (SELECT a, b, CAST(count(*) AS DOUBLE) n FROM (SELECT DISTINCT r, host a, {host("regexp_replace(t, '^//', 'x://')")} b FROM h) WHERE a <> b AND b <> '' GROUP BY a, b),
e AS (SELECT 'trust' kind, a, b, n FROM l UNION ALL SELECT 'distrust', b, a, n FROM l),
st AS MATERIALIZED (SELECT kind, a, b, n / sum(n) OVER (PARTITION BY kind, a) share FROM e),
dead AS (SELECT DISTINCT kind, a FROM st),
ends AS (SELECT kind, host FROM (SELECT kind, host FROM s UNION SELECT kind, b FROM st) q WHERE (kind, host) NOT IN (SELECT (kind, a) FROM dead)),
step AS MATERIALIZED (SELECT kind, a, b, {DAMPING} * share share FROM st UNION ALL SELECT ends.kind, ends.host, s.host, {DAMPING} * s.own FROM ends JOIN s ON s.kind = ends.kind),
it AS (SELECT 0 i, kind, host, seed AS rank FROM s UNION ALL
  SELECT i, kind, host, sum(x) FROM (SELECT it.i + 1 i, it.kind, step.b host, it.rank * step.share x FROM it JOIN step ON step.kind = it.kind AND step.a = it.host
    UNION ALL SELECT (SELECT min(i) FROM it) + 1, s.kind, s.host, {1 - DAMPING} * s.seed FROM s) WHERE i <= (SELECT CASE WHEN count(*) > 0 THEN {iterations} ELSE 0 END FROM st) GROUP BY i, kind, host),
z AS (SELECT host, sum(rank) FILTER (WHERE kind = 'trust') t, sum(rank) FILTER (WHERE kind = 'distrust') d FROM it WHERE i = (SELECT max(i) FROM it) GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(verdict, CASE WHEN coalesce(d, 0) > {THRESHOLD} * (coalesce(t, 0) + coalesce(d, 0)) THEN 'block' ELSE 'allow' END) verdict FROM j LEFT JOIN z ON j.host = z.host
"""


ORACLE = oracle()
