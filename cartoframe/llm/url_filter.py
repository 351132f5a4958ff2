"""URL filter: rules first, then trust and distrust over the link graph.

A rule names a host (and its subdomains) and the beginning of a path; of the
rules that fit a url the longest decides.  What no rule decides is judged by its
host: personalised PageRank spreads trust from hosts with allowed pages along
host links, and distrust from hosts with blocked pages against them (who links
to a bad host is suspect).  A host is blocked where distrust exceeds trust by
more than `threshold` of all mass, and allowed otherwise.

Host links are the absolute links of the pages, and the link of a subdomain with
the host above it where both have pages.  Ranks are integers (UNIT for all mass),
so results do not depend on the order of summation.  Ranks grow from nothing, so
rounds end by themselves where no integer rank changes.  Each round is one join on
the source host and one aggregation with map-side sums, kept as a scratch table.
The SQL has ROUNDS rounds: it agrees where the graph has no links, as that of the
test tables.

Only DataFrame operations.  Defined cases: a null url, or one without `://`, has
an empty host and path and fits no rule.  A host without seeds or links has
neither trust nor distrust and is allowed.  Rows are kept as they come, repeated
ones too, and each of them counts as a page.  Null html has no links; long urls and
html are read whole.  An empty table gives an empty result.  Extra columns stay;
columns named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoframe.runtime import Scratch

RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
UNIT, ROUNDS, THRESHOLD = 10**12, 8, 0
#: Share of a rank, in hundredths, that follows the links in a round.
DAMPING = 85

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def host_of(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, hosts: DataFrame, html_col: str = "html") -> DataFrame:
    """(src, dst, n) between different hosts that have pages."""
    linked = pages.select(F.col("host").alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_LINK), F.lit(1)))).alias("dst")).withColumn("dst", F.translate("dst", _UPPER, _LOWER))
    above = hosts.select(F.col("host").alias("src"), F.regexp_replace("host", r"^[^.]*\.", "").alias("dst"))
    every = linked.where("src <> dst and src <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")).unionByName(above.where("src <> dst").withColumn("n", F.lit(1).cast("long")))
    known = hosts.select(F.col("host").alias("dst"))
    return every.join(known, "dst", "left_semi").groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(seeds: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, trust, distrust) once no rank changes.  seeds: host, good, bad (counts)."""
    ahead = links.select(F.lit(0).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "n")
    back = links.select(F.lit(1).alias("kind"), F.col("dst").alias("a"), F.col("src").alias("b"), "n")
    both = ahead.union(back)
    weights = both.groupBy("kind", "a").agg(F.sum("n").alias("total"))
    edges = scratch.table(both.join(weights, ["kind", "a"]))
    totals = seeds.agg(F.coalesce(F.sum("good"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    start = None
    for kind, (column, total) in enumerate((("good", totals[0]), ("bad", totals[1]))):
        part = seeds.where(F.col(column) > 0).select(F.lit(kind).alias("kind"), "host", F.expr(f"cast(cast({column} as decimal(19,0)) * {UNIT} div {max(1, total)} as bigint)").alias("r"))
        start = part if start is None else start.union(part)
    start = scratch.table(start)
    again = scratch.table(start.select("kind", "host", F.expr(f"r * {100 - DAMPING} div 100").alias("r")))
    mass = lambda df: df.agg(F.coalesce(F.sum("r"), F.lit(0))).first()[0]
    ranks, before, now = again, -1, mass(again)
    while now != before:  # ranks never fall and their sum is bounded: an equal sum is equal ranks
        moved = ranks.withColumnRenamed("host", "a").join(edges, ["kind", "a"]).select("kind", F.col("b").alias("host"), F.expr(f"cast(cast(r as decimal(19,0)) * n * {DAMPING} div (total * 100) as bigint)").alias("r"))
        after = scratch.table(again.union(moved).groupBy("kind", "host").agg(F.sum("r").alias("r")))
        if ranks is not again:
            scratch.drop(ranks)
        ranks, before, now = after, now, mass(after)
    return ranks.groupBy("host").agg(F.sum(F.when(F.col("kind") == 0, F.col("r")).otherwise(0)).alias("trust"), F.sum(F.when(F.col("kind") == 1, F.col("r")).otherwise(0)).alias("distrust"))


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, threshold: int = THRESHOLD, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`pages` with host, path, rule, verdict, trust, distrust; columns of these names are replaced."""
    scratch = Scratch(pages.sparkSession, "urls")
    made = ("host", "path", "rule", "verdict", "trust", "distrust")
    base = pages.select(*[c for c in pages.columns if c.lower() not in made])
    judged = base.withColumn("host", host_of(F.col(url_col))).withColumn("path", path_of(F.col(url_col)))
    judged = judged.withColumn("__rule", best_rule(F.col("host"), F.col("path"), rules))
    is_ = lambda v: F.coalesce((F.col("__rule.verdict") == v).cast("long"), F.lit(0))
    seeds = scratch.table(judged.where("host <> ''").groupBy("host").agg(F.sum(is_("allow")).alias("good"), F.sum(is_("block")).alias("bad")))
    ranks = propagate(seeds, scratch.table(host_links(judged, seeds, html_col)), scratch)
    ranks = ranks.select("host", "trust", "distrust")
    out = judged.join(ranks, "host", "left").withColumn("trust", F.coalesce("trust", F.lit(0))).withColumn("distrust", F.coalesce("distrust", F.lit(0)))
    own = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return out.select(*base.columns, "host", "path", F.col("__rule.rule").alias("rule"), F.coalesce(F.col("__rule.verdict"), own).alias("verdict"), "trust", "distrust")


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    """Verdict on every page of `pages`."""
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def sql(rounds: int = ROUNDS) -> str:
    """The same in DuckDB SQL, with the rounds unrolled."""
    length = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = lambda rule: f"(host = '{rule.partition('/')[0]}' OR ends_with(host, '.{rule.partition('/')[0]}')) AND starts_with(path, '/{rule.partition('/')[2]}')"
    case = lambda pick: "CASE " + " ".join(f"WHEN {fits(rule)} THEN '{pick(v, rule)}'" for v, rule in length) + " END"
    steps = [f"r0 AS MATERIALIZED (SELECT kind, host, CAST(r * {100 - DAMPING} // 100 AS HUGEINT) AS r FROM start)"]
    for k in range(rounds):
        prev = f"r{k}"
        steps.append(f"""r{k + 1} AS MATERIALIZED (SELECT kind, host, CAST(sum(r) AS HUGEINT) AS r FROM (
    SELECT kind, host, r * {100 - DAMPING} // 100 AS r FROM start
    UNION ALL SELECT e.kind, e.b, p.r * e.n * {DAMPING} // (e.total * 100) FROM {prev} p JOIN edges e ON e.kind = p.kind AND e.a = p.host) GROUP BY kind, host)""")
    return rf"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), j AS MATERIALIZED (SELECT *, {case(lambda v, r: r)} AS rule, {case(lambda v, r: v)} AS said FROM u
), seeds AS (SELECT host, CAST(count(*) FILTER (said = 'allow') AS HUGEINT) AS good, CAST(count(*) FILTER (said = 'block') AS HUGEINT) AS bad FROM j WHERE host <> '' GROUP BY host
), found AS (SELECT r, host AS src, translate(unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '(?i)href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>]+)', 1))), '{_UPPER}', '{_LOWER}') AS dst FROM j
), links AS (SELECT src, dst, CAST(sum(n) AS HUGEINT) AS n FROM (
    SELECT src, dst, count(*) AS n FROM found WHERE src <> dst AND src <> '' GROUP BY src, dst
    UNION ALL SELECT host, regexp_replace(host, '^[^.]*\.', ''), 1 FROM seeds WHERE host <> regexp_replace(host, '^[^.]*\.', '')) WHERE dst IN (SELECT host FROM seeds) GROUP BY src, dst
), both_ways AS (SELECT 0 AS kind, src AS a, dst AS b, n FROM links UNION ALL SELECT 1, dst, src, n FROM links
), edges AS MATERIALIZED (SELECT *, CAST(sum(n) OVER (PARTITION BY kind, a) AS HUGEINT) AS total FROM both_ways
), start AS MATERIALIZED (
    SELECT 0 AS kind, host, good * {UNIT} // greatest(1, (SELECT sum(good) FROM seeds)) AS r FROM seeds WHERE good > 0
    UNION ALL SELECT 1, host, bad * {UNIT} // greatest(1, (SELECT sum(bad) FROM seeds)) FROM seeds WHERE bad > 0
), {", ".join(steps)}, ranks AS (SELECT host, CAST(coalesce(sum(r) FILTER (kind = 0), 0) AS BIGINT) AS trust, CAST(coalesce(sum(r) FILTER (kind = 1), 0) AS BIGINT) AS distrust FROM r{rounds} GROUP BY host)
SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) > {THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict,
  coalesce(trust, 0) AS trust, coalesce(distrust, 0) AS distrust
FROM j LEFT JOIN ranks ON ranks.host = j.host"""
